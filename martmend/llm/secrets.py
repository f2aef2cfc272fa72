"""Secret scans (operator 5): fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Every run of 20 or more characters of an encoding's alphabet is a candidate. Its encoding is the smallest alphabet that
holds it; three tests ask whether its characters could be drawn evenly from that alphabet: chi-squared uniformity, runs
above and below the middle of the alphabet, and lag-one serial correlation. The p-value is three times the least of the
three (Bonferroni): random tokens have any p-value alike (or a higher one), others a low one.

What is reported is bounded by its share of false reports, for each encoding and length class on its own, as short tokens of
words look random more often than long ones. Of a class's candidates over all rows, those with p-values above a half are twice
the random ones that remain there, which gives the number of random candidates; of all candidates above a threshold, those
beyond the random ones expected there are false reports. The threshold is the lowest with a share of at most ``q``. The counts are
gathered as a histogram of p-values over all rows, of a size fixed by the number of classes and bins. Candidates above the
threshold that mix letters with digits are reported as ``random``, save where they lie within a span of the fixed patterns.

Defined results: null is the empty text; an empty table has empty results and no thresholds; long texts are scanned whole; rows that
repeat others are counted and scanned like them; spans that tie in their start follow the order of the kinds; other columns do
not matter.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
#: The patterns asked for.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: Alphabets of encodings, smallest first.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
BINS, PER_TEN = 400, 20
#: Bin from which on nothing is reported: a p-value of a thousandth.
LEAST = 60


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    spans = []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(token: str) -> tuple[str, float] | None:
    """The inferred encoding and the battery's p-value; None where letters and digits do not mix or no alphabet fits."""
    if not any(map(str.isdigit, token)) or not any(map(str.isalpha, token)):
        return None
    held = set(token)
    found = next(((name, a) for name, a in ALPHABETS if held <= set(a)), None)
    if not found:
        return None
    name, alphabet = found
    n, size = len(token), len(alphabet)
    value = np.array([alphabet.index(c) for c in token], np.float64)
    counts = np.bincount(value.astype(np.int64), minlength=size)
    # Wilson-Hilferty: the cube root of chi-squared over its degrees of freedom is nearly normal.
    free = size - 1
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    z = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    uniform = 0.5 * math.erfc(z / math.sqrt(2))
    high = value >= size / 2
    ones = int(high.sum())
    zeros = n - ones
    runs = 1.0
    if ones and zeros:
        mean = 1 + 2 * ones * zeros / n
        spread = 2 * ones * zeros * (2 * ones * zeros - n) / (n * n * (n - 1))
        runs = _normal_tail((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    centred = value - value.mean()
    power = float((centred**2).sum())
    serial = _normal_tail(float((centred[1:] * centred[:-1]).sum()) / power * math.sqrt(n)) if power else 0.0
    return name, min(1.0, 3 * min(uniform, runs, serial))


def candidates(text: str) -> list[tuple[str, int, int, int]]:
    """(class, start, end, bin) of each candidate; a class is an encoding and a power of 1.5 of the length, a bin a twentieth of a power of ten."""
    out = []
    for m in CANDIDATE.finditer(text):
        if found := randomness(m[0]):
            name, p = found
            out.append((f"{name}/{int(math.log(len(m[0])) / math.log(1.5))}", m.start(), m.end(), min(BINS - 1, int(-PER_TEN * math.log10(max(p, 1e-300))))))
    return out


def lowest_bins(counts: np.ndarray, q: float) -> int:
    """Bins from 0 (the highest p-values) whose candidates are reported, all together with a share of false ones of at most q.

    counts: candidates by bins of the p-value. Random candidates are estimated by those above a half."""
    half = round(PER_TEN * math.log10(2))
    above = np.cumsum(counts)
    share = 1 - 10.0 ** (-(np.arange(BINS) + 1) / PER_TEN)  # of random candidates, those above a bin's end
    expected = above[half - 1] / share[half - 1] * share
    false = 1 - expected / np.maximum(above, 1)
    good = np.flatnonzero((false <= q) & (above > 0) & (np.arange(BINS) < LEAST))
    return int(good[-1]) + 1 if good.size else 0


def thresholds(df: DataFrame, text: str = "text", q: float = 0.05) -> dict[str, int]:
    """For each class the number of bins whose candidates are reported, over all rows."""

    @F.pandas_udf("array<string>")
    def binned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [f"{c}/{b}" for c, _, _, b in candidates(t)])

    counts = df.select(F.explode(binned(F.coalesce(F.col(text), F.lit("")))).alias("k")).groupBy("k").count().collect()
    tally: dict[str, np.ndarray] = {}
    for r in counts:
        name, _, b = r.k.rpartition("/")
        tally.setdefault(name, np.zeros(BINS, np.int64))[int(b)] += r["count"]
    return {name: lowest_bins(c, q) for name, c in tally.items()}


def find(text: Column, limits: dict[str, int]) -> Column:
    """Array of (kind, start, end), code points, end exclusive: the fixed patterns' spans and random candidates beside them."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def scan(texts: pd.Series) -> pd.Series:
        def one(t: str) -> list:
            base = base_spans(t)
            more = [("random", s, e) for c, s, e, b in candidates(t) if b < limits.get(c, 0) and not any(x[1] <= s and e <= x[2] for x in base)]
            return [{"kind": k, "start": s, "end": e} for k, s, e in sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0])))]

        return texts.map(one)

    return scan(F.coalesce(text, F.lit("")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
