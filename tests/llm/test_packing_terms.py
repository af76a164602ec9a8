"""Neighbours by every shared term."""

import numpy as np

from quillstream.llm import packing, tokens
from quillstream.llm.tokens import END_ID, Encoder, encoder


def brute(texts, seed, k1=packing.K1, b=packing.B):
    sets, n = [set(x.tolist()) - {END_ID} for x in texts], len(texts)
    mean = sum(map(len, texts)) / n
    score = np.zeros(n)
    for t in sets[seed]:
        df = sum(t in s for s in sets)
        for i in range(n):
            tf = int((texts[i] == t).sum())
            score[i] += np.log1p((n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(texts[i]) / mean))
    return score


def test_neighbours_use_all_terms():
    r = np.random.default_rng(4)
    texts = [np.r_[r.zipf(1.3, int(r.integers(1, 200))).clip(1, 900) + 10, END_ID].astype(np.uint16) for _ in range(150)]
    rare = np.arange(2000, 2020)
    texts += [np.r_[rare, 3000, END_ID].astype(np.uint16), np.r_[rare, END_ID].astype(np.uint16), np.r_[3000, END_ID].astype(np.uint16), np.array([END_ID], np.uint16)]
    index = packing.Bm25(texts)
    for seed in range(len(texts)):
        unused = np.ones(len(texts), bool)
        unused[seed] = False
        want = brute(texts, seed)
        got = index.neighbours(seed, unused, len(texts))
        assert set(got.tolist()) == {i for i in range(len(texts)) if want[i] > 0 and i != seed}
        assert (np.diff(want[got]) <= 1e-3).all()


def test_letters_and_signs_after_them_need_no_pattern():
    enc = encoder()
    chunks = ["plain", "comma,", "stars***", "äpfel.", "o'", "it''", "it's", "a,b", "1.", "x1,", ",", "'s", "don't,", "(in", "²", "a²,", "l'été,"]
    want = ["".join(p + "\x01" for p in enc.pieces.findall(c)) for c in chunks]
    asked = []
    real = enc.pieces

    class Counting:
        def findall(self, chunk):
            asked.append(chunk)
            return real.findall(chunk)

    enc.pieces = Counting()
    try:
        assert [enc._marked(c) for c in chunks] == want
    finally:
        enc.pieces = real
    assert asked == chunks[6:]


def test_a_chunk_is_looked_up_once_for_a_lot():
    asked = []

    class Counting(dict):
        def get(self, chunk, default=None):
            asked.append(chunk)
            return super().get(chunk, default)

        def __getitem__(self, chunk):
            asked.append(chunk)
            return super().__getitem__(chunk)

    enc = Encoder()
    enc.cache = Counting()
    texts = ["One two, one\ttwo, three"] * 50
    want = np.array(enc.whole.encode(texts[0], add_special_tokens=False).ids, "<u2").tobytes()
    assert enc.encode(texts) == [want] * 50
    assert sorted(asked) == ["one", "three", "two,"]


def test_plain_characters():
    """Each character of the fast way, alone and within words, case and white space included."""
    enc = Encoder()
    texts = [t for c in map(chr, range(0x250)) if tokens._is_plain(c) for t in (c, f"a{c}b", f"{c}A {c}", f"1{c}{c},{c} x")]
    assert len(texts) > 2000
    for t, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == enc.whole.encode(t, add_special_tokens=False).ids, ascii(t)


def test_small_lots_and_a_small_cache_give_the_same_ids(monkeypatch):
    texts = [None, "", " ", "a b", "don't stop,  stop\xa0now...", "x" * 50, "<|endoftext|> a", "ἀλφα β", "\n", "word " * 40, "a b", "Éa, été"] * 3
    want = [np.array(encoder().whole.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    monkeypatch.setattr(tokens, "LOT_CHARS", 30)
    enc = Encoder(cache_entries=4)
    assert enc.encode(texts) == enc.encode(texts) == want and len(enc.cache) <= 5
    assert enc.encode([]) == [] and enc.encode([None, ""]) == [b"", b""]


def test_a_full_cache_keeps_chunks_that_came_again(monkeypatch):
    monkeypatch.setattr(tokens, "LOT_CHARS", 1)
    enc = Encoder(cache_entries=4)
    learnt = []
    real = enc._learn

    def learn(chunks):
        learnt.append(sorted(chunks))
        return real(chunks)

    enc._learn = learn
    texts = ["a b", "a c", "a d e", "d e f g", "h i j k l"]
    got = enc.encode(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [enc.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert learnt == [["a", "b"], ["c"], ["d", "e"], ["d", "e", "f", "g"], ["h", "i", "j", "k", "l"]]


def test_the_tokenizer_itself_is_loaded_when_needed():
    enc = Encoder()
    plain = enc.encode(["plain words, été", None])
    assert "whole" not in vars(enc)
    odd = enc.encode(["ἀλφα"])
    assert "whole" in vars(enc)
    assert [np.frombuffer(x, "<u2").tolist() for x in (plain[0], odd[0])] == [enc.whole.encode(t, add_special_tokens=False).ids for t in ("plain words, été", "ἀλφα")]
