"""Exact token ids of the word-end BPE vocabulary, several times faster than encoding each text afresh.

Chunks between white space are independent of each other in this tokenizer. A lot of texts is split into chunks and these
are numbered as Arrow columns, so that only the lot's different chunks become Python objects and are looked up; the lot's ids are
then taken by number. Each chunk is encoded once and its ids are kept in a bounded cache; when that is full, chunks that came in one
lot only go first. New chunks go through a byte-pair encoder over the same merges; texts with characters outside the plain Latin
range, control characters or markers of special tokens go to the tokenizer itself. Both ways give the tokenizer's ids (test_tokens
in tests/llm/test_llm_operators.py compares them).
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Texts of about so many characters are split and numbered together; no more are held as chunks at once.
LOT_CHARS = 1_000_000
_END = "\x01"
#: ASCII signs: neither letters, numbers nor white space.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Outside the fast way: control characters, the marks of special tokens, soft hyphen and all above Latin Extended-B.
_ODD = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9fİɐ-\U0010ffff]|<\|")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


#: Characters of Latin-1 that need no look beyond: no control characters, no soft hyphen.
_PLAIN = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA0, 0xAD), *range(0xAE, 0x100)])


def _is_plain(text: str) -> bool:
    """Whether the fast way is right for a text: in the plain Latin range, composed, without controls and markers."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return not _ODD.search(text) and unicodedata.is_normalized("NFC", text)
    if raw.translate(None, _PLAIN):
        return not _ODD.search(text) and unicodedata.is_normalized("NFC", text)
    return b"<|" not in raw


class Encoder:
    """encode(texts) gives the ids of each text as little-endian uint16 bytes, without the closing id."""

    def __init__(self, path: str | None = None, cache_entries: int = 350_000):
        import tiktoken

        self.path = path or vocabulary_path()
        with open(self.path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = _byte_of_letter()
        ranks: dict[bytes, int] = {}
        for token, rank in vocab.items():
            end = token.endswith("</w>")
            body = token[:-4] if end else token
            if body and all(c in letters for c in body):
                ranks[bytes(letters[c] for c in body) + _END.encode() * end] = rank
        #: Whether an id closes a piece.
        self.closing = np.zeros(1 << 16, bool)
        self.closing[[rank for token, rank in ranks.items() if token.endswith(_END.encode())]] = True
        self.fast = tiktoken.Encoding("word-ends", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})
        import regex

        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.entries = cache_entries
        #: Known chunks, each with its row of `ids`.
        self.cache: dict[str, int] = {}
        self.ids = pa.array([], pa.large_binary())
        #: Whether a later lot has had the row's chunk, since there was last no room.
        self.again = np.zeros(0, bool)

    @cached_property
    def whole(self):
        """The tokenizer itself, about 30 MB; loaded for the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _marked(self, chunk: str) -> str:
        """The chunk's pieces, each with an end. Letters alone are one piece, and signs after them one more; all else is for the pattern to split."""
        body = chunk.rstrip(_SIGNS)
        if body.isalpha():
            return body + _END if len(body) == len(chunk) else body + _END + chunk[len(body) :] + _END
        return "".join([p + _END for p in self.pieces.findall(chunk)])

    def _learn(self, chunks: list[str]) -> range:
        """The rows that the new chunks' ids get."""
        marked = [c + _END if c.isalpha() else self._marked(c) for c in chunks]
        ids = np.asarray(self.fast.encode_to_numpy("".join(marked), disallowed_special=())).astype("<u2")
        closed = np.r_[0, np.flatnonzero(self.closing[ids]) + 1]
        pieces = np.fromiter((m.count(_END) for m in marked), np.int64, len(marked))
        edge = 2 * closed[np.r_[0, np.cumsum(pieces)]]
        new = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(edge), pa.py_buffer(ids)])
        rows = range(len(self.ids), len(self.ids) + len(chunks))
        self.ids = pa.concat_arrays([self.ids, new])
        self.again = np.r_[self.again, np.zeros(len(chunks), bool)]
        self.cache.update(zip(chunks, rows))
        return rows

    def _rows(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.cache.get, chunks, repeat(-1)), np.int64, len(chunks))

    def _make_room(self, needed: int) -> None:
        """Keeps the chunks that came again, none if they leave too little room."""
        kept = np.flatnonzero(self.again)
        if len(kept) + needed > self.entries:
            kept = kept[:0]
        chunks = list(self.cache)  # in the order of their rows
        self.cache.clear()
        self.cache.update(zip([chunks[k] for k in kept.tolist()], range(len(kept))))
        self.ids = self.ids.take(pa.array(kept))
        self.again = np.zeros(len(kept), bool)

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        # in the plain Latin range, Arrow's lower case and white space are Python's (test_plain_characters)
        split = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        numbered = split.flatten().dictionary_encode()
        chunks = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        row = self._rows(chunks)
        self.again[row[row >= 0]] = True
        if len(self.cache) + np.count_nonzero(row < 0) > self.entries:
            self._make_room(len(chunks))
            row = self._rows(chunks)
        new = np.flatnonzero(row < 0)
        if len(new):
            row[new] = self._learn([chunks[k] for k in new.tolist()])
        ids = self.ids.take(pa.array(row)).take(numbered.indices)
        _, offsets, raw = ids.buffers()
        edge = np.frombuffer(offsets, np.int64, len(ids) + 1)[split.offsets.to_numpy()].tolist()
        raw = memoryview(raw) if raw else b""
        return [bytes(raw[a:z]) for a, z in zip(edge, edge[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        lot: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if not _is_plain(text):
                out[i] = np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()
                continue
            if lot and held + len(text) > LOT_CHARS:
                for k, ids in zip(lot, self._encode_plain([texts[k] for k in lot])):
                    out[k] = ids
                lot, held = [], 0
            lot.append(i)
            held += len(text)
        for k, ids in zip(lot, self._encode_plain([texts[k] for k in lot]) if lot else ()):
            out[k] = ids
        return out


_kept: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    key = path or ""
    if key not in _kept:
        _kept[key] = Encoder(path)
    return _kept[key]
