"""Secret scan: patterns propose candidates, a character convolutional network decides on those that no fixed rule settles.

Base findings (assign, access, hex) are always reported. Every other token of `LEAST_TOKEN` characters and more that is not a
plain word, tokens that reach beyond a base finding, and every private-key block are candidates; the network reads all
their characters with the text around them. Its probability is calibrated on held-out findings that went through the same
choice of candidates, and the threshold is the highest up to 0.5 that keeps `RECALL` of their secrets, those that are
no candidate counted as lost. Scores of base findings are kept too.

The network is numpy only: each character (by class and by whether it stands before, in or after the candidate) looks up its
filter responses, which are summed over five positions, rectified, pooled by maximum and mean, and weighed once more.
Candidates are read in lots of a bounded number of characters, long ones in pieces whose maxima and sums are put
together, which gives what the whole would give. It is trained on the driver, from a fixed seed, on labelled findings that
`labelled_findings` makes: keys and passwords of common makes and their look-alikes (numbers, paths, identifiers, addresses,
compound words, decorated words).

Defined results: a null text is empty and has no spans; repeated rows and rows that repeat an id or have none are reported
each; an empty table gives an empty result; whole texts are read, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import lots

# The base patterns and the least lengths of their findings.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "network")

LEAST_TOKEN = 12
#: ASCII characters of tokens, in which decoration at either end is no part of the candidate.
_IN_TOKEN = r"A-Za-z0-9+/_=.@#$%^&*!?~:-"
TOKEN = re.compile(rf"[{_IN_TOKEN}]{{{LEAST_TOKEN},}}")
DECORATION = ".!?:#$%&*"
#: What sets a token apart from a word: a digit, a change to a capital letter, or a sign within; or uncommon length.
UNLIKE_WORD = re.compile(r"[0-9]|[a-z][A-Z]|[+/_=@#$%^&*!?~:.-]")
LONG_WORD = 24
#: A key block: a header and, if nothing but key characters stands between, all up to the next footer.
HEADER = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
FOOTER = re.compile(r"(?=(-----END [A-Z ]*PRIVATE KEY-----))")
NO_KEY = re.compile(r"[^A-Za-z0-9+/=\s\\-]")
_STARTS = ("passw", "secret", "token", "apikey", "api_key")
_HEX_RUN = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_TOKEN_RUN = bytes(121 if b < 128 and re.match(rf"[{_IN_TOKEN}]", chr(b)) else 32 for b in range(256))
CONTEXT = 24
RECALL = 0.98


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings, in code points."""
    out = []
    low = text.lower()
    if any(s in low for s in _STARTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"x" * LEAST["hex"] in text.encode().translate(_HEX_RUN):
        out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]{16,}", text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Key blocks, leftmost first and apart; headers, footers and what ends a key are found in one pass each."""
    if "PRIVATE KEY" not in text:
        return []
    footers = [(m.start(), m.end(1)) for m in FOOTER.finditer(text)]
    starts = [s for s, _ in footers]
    breaks = [m.start() for m in NO_KEY.finditer(text)] if footers else []
    out: list[tuple[int, int]] = []
    for m in HEADER.finditer(text):
        if out and m.start() < out[-1][1]:
            continue
        f, b = bisect_left(starts, m.end()), bisect_left(breaks, m.end())
        whole = f < len(footers) and (b == len(breaks) or breaks[b] >= starts[f])
        out.append((m.start(), footers[f][1] if whole else m.end()))
    return out


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Tokens that are not plain words, and key blocks, that lie in no base finding; tokens of a key block are part of it."""
    blocks, found = key_blocks(text), []
    if b"y" * LEAST_TOKEN in text.encode("utf-8", "surrogatepass").translate(_TOKEN_RUN):
        for m in TOKEN.finditer(text):
            token = m[0].rstrip(DECORATION)
            end = m.start() + len(token)
            token = token.lstrip(DECORATION)
            if len(token) >= LEAST_TOKEN and (len(token) >= LONG_WORD or UNLIKE_WORD.search(token)):
                found.append((end - len(token), end))
    taken = sorted([*blocks, *((s, e) for s, e, _ in base)])
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

    def inside(start: int, end: int) -> bool:
        """Whether a taken span that begins no later ends no earlier."""
        k = bisect_right(starts, start)
        return k > 0 and reach[k - 1] >= end

    return sorted([*blocks, *(c for c in found if not inside(*c))])


# --- the network -------------------------------------------------------------------------------------------------------

_CLASSES, _WIDTH, _FILTERS = 40, 5, 24


def _class_of(c: str) -> int:
    if "0" <= c <= "9":
        return 1 + (c != "0")
    if "a" <= c <= "z":
        return 3 + "aeiou".find(c) if c in "aeiou" else (8 if c in "bcdf" else 9 + (ord(c) - 97) % 4)
    if "A" <= c <= "Z":
        return 13 if c in "AEIOU" else (14 if c in "BCDF" else 15 + (ord(c) - 65) % 4)
    return 19 + " \n\"':=+/-_.,()[]{}<>".find(c) if c in " \n\"':=+/-_.,()[]{}<>" else 39


_TABLE = np.array([_class_of(chr(i)) for i in range(128)], np.int16)


def classes(text: str) -> np.ndarray:
    """Class of each character."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(raw < 128, _TABLE[np.minimum(raw, 127)], 39).astype(np.int16)


def codes(cls: np.ndarray, start: int, end: int) -> np.ndarray:
    """Class and place of each character from CONTEXT before to CONTEXT after the candidate, of a text's classes."""
    a, b = max(0, start - CONTEXT), min(len(cls), end + CONTEXT)
    out = cls[a:b].copy()
    out[start - a : end - a] += _CLASSES
    out[end - a :] += 2 * _CLASSES
    return out


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {
            "w": r.normal(0, 0.15, (_WIDTH, 3 * _CLASSES, _FILTERS)),
            "b": np.zeros(_FILTERS),
            "v": r.normal(0, 0.2, 2 * _FILTERS),
            "c": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _pooled(self, x: np.ndarray):
        pad = np.concatenate([x[:1].repeat(_WIDTH // 2), x, x[-1:].repeat(_WIDTH // 2)])
        z = sum(self.p["w"][k][pad[k : k + len(x)]] for k in range(_WIDTH)) + self.p["b"]
        a = np.maximum(z, 0)
        top = a.argmax(0)
        return pad, z, top, np.r_[a.max(0), a.mean(0)]

    def logit_of_one(self, x: np.ndarray) -> float:
        return float(self._pooled(x)[3] @ self.p["v"] + self.p["c"][0])

    def logits(self, xs: list[np.ndarray], piece: int = 20_000) -> np.ndarray:
        """Of each candidate's codes; no more than a lot of about `piece` characters is in memory as filter responses."""
        w, bias = self.p["w"].astype(np.float32), self.p["b"].astype(np.float32)
        top, total = np.zeros((len(xs), _FILTERS), np.float32), np.zeros((len(xs), _FILTERS))
        lot: list[np.ndarray] = []
        who: list[int] = []

        def settle() -> None:
            flat = np.concatenate(lot)
            n = len(flat) - _WIDTH + 1
            a = np.empty((n + 1, _FILTERS), np.float32)
            np.take(w[0], flat[:n], axis=0, out=a[:n])
            for k in range(1, _WIDTH):
                a[:n] += w[k][flat[k : k + n]]
            a[:n] += bias
            np.maximum(a, 0, out=a)
            a[n] = 0
            size = np.array([len(x) for x in lot])
            start = np.cumsum(size) - size
            edges = np.stack([start, start + size - _WIDTH + 1], 1).ravel()  # responses across two candidates are left out
            np.maximum.at(top, who, np.maximum.reduceat(a, edges)[::2])
            np.add.at(total, who, np.add.reduceat(a, edges)[::2])
            lot.clear()
            who.clear()

        held, half = 0, _WIDTH // 2
        for i, x in enumerate(xs):
            padded = np.concatenate([x[:1].repeat(half), x, x[-1:].repeat(half)])
            for k in range(0, len(x), piece):
                lot.append(padded[k : k + piece + 2 * half])
                who.append(i)
                held += len(lot[-1])
                if held >= piece:
                    settle()
                    held = 0
        if lot:
            settle()
        mean = total / np.array([max(1, len(x)) for x in xs])[:, None] if xs else total
        return np.c_[top, mean] @ self.p["v"] + self.p["c"][0]

    def probabilities(self, xs: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logits(xs) + self.shift)))

    def fit(self, xs: list[np.ndarray], ys: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 6) -> "Network":
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(xs))
            for lot in np.array_split(order, max(1, len(xs) // 32)):
                g = {k: np.zeros_like(v) for k, v in self.p.items()}
                for i in lot:
                    pad, z, top, h = self._pooled(xs[i])
                    e = (1 / (1 + np.exp(-(h @ self.p["v"] + self.p["c"][0]))) - ys[i]) / len(lot)
                    g["v"] += e * h
                    g["c"] += e
                    dz = np.tile(e * self.p["v"][_FILTERS:] / len(z), (len(z), 1))
                    dz[top, np.arange(_FILTERS)] += e * self.p["v"][:_FILTERS]
                    dz *= z > 0
                    g["b"] += dz.sum(0)
                    for k in range(_WIDTH):
                        np.add.at(g["w"][k], pad[k : k + len(z)], dz)
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def calibrate(self, findings: list[tuple[str, int, int, int]], recall: float = RECALL) -> "Network":
        """Fits a scale and a shift of the logit to held-out findings; the threshold is the highest up to 0.5 with this recall of their secrets, end to end."""
        xs, ys, of = [], [], []
        for k, (text, a, b, y) in enumerate(findings):
            cls, base = classes(text), base_spans(text)
            for s, e in candidates(text, base):
                if s < b and a < e:
                    xs.append(codes(cls, s, e))
                    ys.append(y)
                    of.append(k)
        z, y = self.logits(xs), np.array(ys)
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps with a little damping
            p = 1 / (1 + np.exp(-(a * z + b)))
            w = np.maximum(p * (1 - p), 1e-6)
            g = np.array([((p - y) * z).sum() + 0.01 * (a - 1), (p - y).sum() + 0.01 * b])
            h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
            a, b = np.array([a, b]) - 0.5 * np.linalg.solve(h, g)
        self.scale, self.shift = float(a), float(b)
        best: dict[int, float] = {k: float(bool(base_spans(t[s:e]))) for k, (t, s, e, y) in enumerate(findings) if y}
        for k, p in zip(of, 1 / (1 + np.exp(-(a * z + b)))):
            if k in best:
                best[k] = max(best[k], float(p))
        self.threshold = min(0.5, sorted(best.values())[int((1 - recall) * len(best))])
        return self


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of made-up secrets and look-alikes in context."""
    r = np.random.default_rng(seed)
    pick = lambda letters, k: "".join(np.array(list(letters))[r.integers(0, len(letters), k)])
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    every = low + up + dig
    syllables = ["ra", "ten", "lo", "mi", "ver", "con", "da", "est", "pro", "ung", "ci", "tre", "the", "ing", "er", "on"]
    word = lambda k=3: "".join(syllables[i] for i in r.integers(0, len(syllables), k))
    prose = lambda k: " ".join(word(int(r.integers(1, 5))) for _ in range(k))
    secret = [
        lambda: pick(every, int(r.integers(20, 48))),
        lambda: pick(low + up, int(r.integers(24, 40))),
        lambda: pick(every + "+/", 40) + "=" * int(r.integers(0, 2)),
        lambda: "ghp_" + pick(every, 36),
        lambda: "sk_live_" + pick(every, 24),
        lambda: "xoxb-" + pick(dig, 11) + "-" + pick(every, 24),
        lambda: "eyJ" + pick(every, 20) + "." + pick(every, 40) + "." + pick(every + "_-", 43),
        lambda: "AIza" + pick(every + "_-", 35),
        lambda: "-----BEGIN " + ["RSA ", "EC ", "OPENSSH ", ""][r.integers(0, 4)] + "PRIVATE KEY-----\n" + pick(every + "+/", 64) + "\n-----END PRIVATE KEY-----",
        lambda: pick(up + dig, 32),
        lambda: pick(every, 6) + pick("#$%^&*!?@", 1) + pick(every, 5) + pick("#$%^&*!?@", 1) + pick(every, int(r.integers(1, 6))),
        lambda: pick(up, 1) + pick(every, int(r.integers(11, 18))) + pick(dig, 1),
    ]
    plain = [
        lambda: "-".join(word(2) for _ in range(6)) + "-" + pick(dig, 2),
        lambda: "-".join(word(2) for _ in range(int(r.integers(2, 5)))),
        lambda: "/".join(word(2) for _ in range(5)) + "/" + pick(dig, 4),
        lambda: "https://" + word(2) + ".example.com/" + word(2) + "/" + pick(dig, 3) + "?" + word(1) + "=" + word(2),
        lambda: "_".join(word(2) for _ in range(5)) + pick(dig, 1),
        lambda: pick(dig, 4) + "-" + pick(dig, 2) + "-" + pick(dig, 2) + "T" + pick(dig, 2) + ":" + pick(dig, 2) + ":" + pick(dig, 2) + ".000",
        lambda: word(9) + pick(dig, 1),
        lambda: word(int(r.integers(9, 15))),
        lambda: word(2) + "." + pick(dig, 2) + "@mail" + pick(dig, 1) + ".example.com",
        lambda: word(3) + "@" + word(2) + ".example.org",
        lambda: pick(low, int(r.integers(4, 9))) + "." + pick(dig, 2) + "@mail" + pick(dig, 1) + ".example.com",
        lambda: word(3).upper() + "." + word(2).upper(),
        lambda: ".".join(str(int(x)) for x in r.integers(100, 255, 4)),
        lambda: "+" + pick(dig, 2) + "-" + pick(dig, 3) + "-" + pick(dig, 4) + "-" + pick(dig, 2),
        lambda: "." + word(3) + "." + word(3) + "." + word(4) + ".v" + pick(dig, 2),
        lambda: "!!".join(word(2).upper() for _ in range(3)),
        lambda: "xxxxxxxxxxxxxxxxxxxx" + pick(dig, 1),
        lambda: word(4) + "." + pick(dig, 2) + "." + word(4) + ".example.com",
        lambda: "=" * int(r.integers(10, 30)) + word(3) + pick(dig, 1) + "=" * 10,
        lambda: "0" * int(r.integers(10, 30)) + "a1b" + "0" * 5,
        lambda: "isbn-" + pick(dig, 3) + "-" + pick(dig, 1) + "-" + pick(dig, 4) + "-" + pick(dig, 4) + "-" + pick(dig, 1),
        lambda: word(3).capitalize() + word(3).capitalize() + word(3).capitalize() + "Factory" + pick(dig, 1),
        lambda: word(2) + word(2).capitalize() + word(2).capitalize(),
        lambda: word(3) + "." + word(3).capitalize(),
    ]
    leads = ["", "", "key = ", "auth: ", "Bearer ", "export KEY=", "see ", "id ", "file "]
    out = []
    for _ in range(n):
        y = int(r.integers(0, 2))
        make = secret if y else plain
        s = make[r.integers(0, len(make))]()
        before = prose(int(r.integers(0, 6))) + " " + leads[r.integers(0, len(leads))]
        text = before + s + " " + prose(int(r.integers(0, 6)))
        out.append((text, len(before), len(before) + len(s), y))
    return out


@lru_cache(maxsize=2)
def trained(findings: int = 2400, seed: int = 7) -> Network:
    """Trained on `findings` labelled findings (the bound), calibrated on a third as many others."""
    rows = labelled_findings(findings, seed)
    xs = [codes(classes(t), a, b) for t, a, b, _ in rows]
    return Network().fit(xs, np.array([y for *_, y in rows])).calibrate(labelled_findings(findings // 3, seed + 1))


def scan_texts(texts: list[str | None], network: Network) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], list[float]]]:
    """For each text: base spans, all spans, and the network's probability for each of the latter."""
    xs: list[np.ndarray] = []
    asked: list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]] = []
    for text in texts:
        text = text or ""
        base = base_spans(text)
        every = [*base, *((s, e, "network") for s, e in candidates(text, base))]
        if every:
            cls = classes(text)
            xs += [codes(cls, s, e) for s, e, _ in every]
        asked.append((base, every))
    p, at, out = network.probabilities(xs), 0, []
    for base, every in asked:
        kept = [(*x, float(q)) for x, q in zip(every, p[at : at + len(every)]) if x[2] != "network" or q >= network.threshold]
        at += len(every)
        kept.sort(key=lambda x: (x[0], KINDS.index(x[2])))
        out.append((base, [x[:3] for x in kept], [x[3] for x in kept]))
    return out


def scan(df: DataFrame, text: str = "text", id_column: str = "doc_id", network: Network | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_network, scores."""
    net = network or trained()
    line = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)

    def run(batches):
        for b in lots(batches, 200):
            cols: list[list] = [[] for _ in range(7)]
            for base, every, scores in scan_texts(b.column(1).to_pylist(), net):
                kinds = [k for _, _, k in every]
                digest = hashlib.sha256(line(base).encode()).hexdigest()
                row = (*(kinds.count(k) for k in KINDS[:3]), digest, line(every), kinds.count("network"), [round(p, 6) for p in scores])
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64())]
            names = ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_network", "scores"]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], names)

    schema = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_network long, scores array<double>"
    return df.select(F.col(id_column).cast("long").alias("id"), F.col(text)).mapInArrow(run, schema).withColumnRenamed("id", id_column)
