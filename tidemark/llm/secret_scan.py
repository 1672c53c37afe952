"""Secrets in texts: fixed kinds by pattern, unnamed ones by a battery of randomness tests.

A candidate is a maximal run of at least 16 token characters with a letter in it. Its encoding is the smallest known
alphabet that holds it. A run with "/", "+", "-" or "_" may be a path or a name around a key: its parts between these are
candidates as well, and of candidates that overlap the longest one that passes is reported. Four tests ask whether it
could be uniform over that alphabet: chi-squared over equal groups of symbols, the runs test about the middle symbol,
the serial correlation of neighbours, and the number of digits, or of both cases where letters alone make the alphabet.
Runs of one case without digits hold too few digits for their alphabet, as words do. The combined p-value (Sidak) is
uniform for random strings and near zero for words, paths and numbers.

Short strings cannot be told apart as well as long ones, so the threshold is set per encoding and length band from all
documents: the random ones are uniform, hence their number above any threshold follows from the upper half of the
p-values (Storey); the smallest threshold at which at most ``fdr`` of the strings above it are not random is taken.
Each different string counts once, however many copies of its document there are. A band with fewer than
``LEAST_STRINGS`` strings takes in its encoding's nearest bands; an encoding with fewer reports from ``SPARSE`` on.

Defined results: a null text counts as empty. Repeated rows are scanned one by one. Candidates that overlap a span of
a fixed kind are not reported again, nor counted. Offsets are code points, ends are exclusive. An empty table gives
an empty result.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, carrying

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # as maximal runs of which shorter ones are dropped
#: A run with its padding; an "=" before the run or between a name and its value is none.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: Parts of a run: without "/" and "+", without "-" and "_", without any of them.
PARTS = tuple(re.compile(rf"[A-Za-z0-9{more}]{{16,}}={{0,2}}") for more in ("_-", "+/", ""))

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex lower", DIGITS + "abcdef"),
    ("hex upper", DIGITS + "ABCDEF"),
    ("base32", UPPER + "234567"),
    ("base36 lower", DIGITS + LOWER),
    ("base36 upper", DIGITS + UPPER),
    ("letters", UPPER + LOWER),
    ("base62", DIGITS + UPPER + LOWER),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64 url", UPPER + LOWER + DIGITS + "-_"),
)
PLACES = tuple({c: i for i, c in enumerate(symbols)} for _, symbols in ENCODINGS)
SETS = tuple(frozenset(symbols) for _, symbols in ENCODINGS)
BINS = 50
FDR = 0.05
#: Different strings from which a threshold is estimated, and the threshold of an encoding with fewer of them.
LEAST_STRINGS = 100
SPARSE = 0.05

Span = tuple[int, int, int]  # start, kind, end


def encoding_of(token: str) -> int | None:
    """Number of the smallest alphabet that holds the token without its padding; None if it mixes alphabets."""
    used = set(token.rstrip("="))
    return next((i for i, symbols in enumerate(SETS) if used <= symbols), None)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity(places: list[int], size: int) -> float:
    """Chi-squared test over equal groups of symbols, at least five expected in each; p by Wilson and Hilferty."""
    n = len(places)
    groups = max(2, min(size, n // 5))
    seen = Counter(x * groups // size for x in places)
    width = Counter(x * groups // size for x in range(size))
    chi = sum((seen[g] - n * w / size) ** 2 / (n * w / size) for g, w in width.items())
    free = groups - 1
    z = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    return math.erfc(z / math.sqrt(2)) / 2


def runs(places: list[int], size: int) -> float:
    """Wald-Wolfowitz runs test about the middle of the alphabet."""
    high = [2 * x >= size for x in places]
    n, up = len(high), sum(high)
    down = n - up
    if not up or not down:
        return 2.0 ** (1 - n)
    found = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    mean = 1 + 2 * up * down / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    return _two_sided((found - mean) / math.sqrt(spread)) if spread > 0 else 1.0


def serial(places: list[int]) -> float:
    """Correlation of each symbol with the next."""
    n = len(places)
    mean = sum(places) / n
    off = [x - mean for x in places]
    power = sum(x * x for x in off)
    if not power:
        return 0.0
    r = sum(a * b for a, b in zip(off, off[1:], strict=False)) / power
    return _two_sided((r + 1 / n) * math.sqrt(n))


def scarcity(token: str, encoding: int) -> float:
    """Chance of so few digits or fewer: words have none, random strings seldom. Of letters alone, of so uneven cases."""
    n, letters = len(token), ENCODINGS[encoding][0] == "letters"
    held = sum(c in (UPPER if letters else DIGITS) for c in token)
    held = min(held, n - held) if letters else held
    share = 0.5 if letters else sum(c in DIGITS for c in ENCODINGS[encoding][1]) / len(PLACES[encoding])
    if held >= n * share:  # of no weight in the least of the tests
        return 1.0
    ways = (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share) for k in range(held + 1))
    return math.fsum(map(math.exp, ways)) * (2 if letters else 1)


def battery(token: str, encoding: int) -> float:
    """Combined p-value under uniform random symbols."""
    token = token.rstrip("=")
    places = [PLACES[encoding][c] for c in token]
    size = len(PLACES[encoding])
    least = min(uniformity(places, size), runs(places, size), serial(places), scarcity(token, encoding))
    return 1 - (1 - min(1.0, max(0.0, least))) ** 4


def stratum_of(encoding: int, length: int) -> int:
    """Encoding and length band: four bands per doubling."""
    return encoding * 1000 + int(4 * math.log2(length))


def base_spans(text: str) -> list[Span]:
    """The fixed kinds, each leftmost and without overlap within the kind, ordered by start and kind."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def readings(start: int, run: str) -> set[tuple[int, int]]:
    """(start, end) of a run and of its parts that are long enough."""
    found = {(start, start + len(run))}
    if any(c in "/+-_" for c in run):
        found |= {(start + m.start(), start + m.end()) for part in PARTS for m in part.finditer(run)}
    return found


class Taken:
    """Disjoint stretches in order; asking and adding take the logarithm of their number."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    @classmethod
    def covered(cls, spans: list[Span]) -> Taken:
        """The places that spans, ordered by start, cover."""
        self = cls()
        for start, _, end in spans:
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)
        return self

    def meets(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start

    def add(self, start: int, end: int) -> None:
        i = bisect.bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, int, float]]:
    """(start, end, stratum, p) of each candidate that overlaps no span of a fixed kind."""
    found = []
    fixed = Taken.covered(base)
    for m in CANDIDATE.finditer(text):
        for start, end in sorted(readings(m.start(), m.group())):
            token = text[start:end]
            if not any(c.isalpha() for c in token) or fixed.meets(start, end):
                continue
            if (encoding := encoding_of(token)) is not None:
                found.append((start, end, stratum_of(encoding, len(token.rstrip("="))), battery(token, encoding)))
    return found


def thresholds(docs: DataFrame, fdr: float = FDR) -> dict[int, float]:
    """Per stratum the least combined p-value of a reported string, from the different candidates of all documents."""
    body = docs.select(docs["text"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text"):
                seen = set()
                for text in batch.column("text").to_pylist():
                    if text:
                        for s, e, k, p in candidates(text, base_spans(text)):
                            seen.add((k, xxhash.xxh64_intdigest(text[s:e]) - (1 << 63), min(BINS - 1, int(p * BINS))))
                rows = list(seen)
                kinds = (("stratum", pa.int32()), ("token", pa.int64()), ("bin", pa.int32()))
                yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(kinds)})

    once = body.mapInArrow(found, "stratum int, token long, bin int").distinct()
    strata: dict[int, list[int]] = {}
    for r in once.groupBy("stratum", "bin").agg(F.count("*").alias("n")).collect():  # encodings x length bands x BINS rows at most
        strata.setdefault(r["stratum"], [0] * BINS)[r["bin"]] = r["n"]
    return {s: SPARSE if (n := pooled(strata, s)) is None else threshold(n, fdr) for s in strata}


def pooled(strata: dict[int, list[int]], stratum: int) -> list[int] | None:
    """Counts of a stratum and as many of its encoding's nearest length bands as ``LEAST_STRINGS`` take; None if all do not."""
    encoding, band = divmod(stratum, 1000)
    near = sorted((abs(s % 1000 - band), s) for s in strata if s // 1000 == encoding)
    counts = [0] * BINS
    for i, (far, s) in enumerate(near):
        counts = [a + b for a, b in zip(counts, strata[s], strict=True)]
        if sum(counts) >= LEAST_STRINGS and (i + 1 == len(near) or near[i + 1][0] > far):
            return counts
    return None


def threshold(counts: list[int], fdr: float = FDR) -> float:
    """Least bin edge above which at most ``fdr`` of the strings exceed what uniform p-values explain."""
    random = 2 * sum(counts[BINS // 2 :])  # expected number of random strings in all bins
    for i in range(BINS // 2):
        above = sum(counts[i:])
        if above and max(0.0, above - random * (1 - i / BINS)) / above <= fdr:
            return i / BINS
    return 0.5


def all_spans(text: str, least: dict[int, float]) -> list[Span]:
    base = base_spans(text)
    passed = [(s, e) for s, e, k, p in candidates(text, base) if p >= least.get(k, SPARSE)]
    chosen = Taken()
    for s, e in sorted(passed, key=lambda x: (x[0] - x[1], x[0])):
        if not chosen.meets(s, e):
            chosen.add(s, e)
    return sorted(base + [(s, 3, e) for s, e in zip(chosen.starts, chosen.ends, strict=True)])


SPANS = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())])
)
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, least: dict[int, float], *carried: str) -> DataFrame:
    """(carried columns, spans): every span of each whole text, ordered by start and kind."""
    chosen, kinds = carrying(docs, carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text"):
                found = [
                    [{"start": s, "kind": k, "end": e} for s, k, e in all_spans(t, least)] if t else []
                    for t in batch.column("text").to_pylist()
                ]
                names = [f.name for f in kinds]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, ARROW_SPANS)], names=[*names, "spans"])

    return chosen.mapInArrow(run, T.StructType([*kinds, T.StructField("spans", SPANS)])).toDF(*carried, "spans")


def spelled(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, least: dict[int, float], mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and ``n_chars`` counted anew; overlapping spans become one mark."""
    columns = docs.columns
    at, counted = columns.index("text"), columns.index("n_chars")
    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))

    def clean(text: str) -> str:
        parts, done = [], 0
        for start, _, end in all_spans(text, least):
            if start >= done:
                parts += [text[done:start], mark]
            done = max(done, end)
        return "".join([*parts, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, f"c{at}"):
                text = [clean(t) if t else t for t in batch.column(at).to_pylist()]
                held = batch.column(counted).to_pylist()
                size = [n if a == b else len(b) for n, a, b in zip(held, batch.column(at).to_pylist(), text, strict=True)]
                yield batch.set_column(at, f"c{at}", pa.array(text, pa.string())).set_column(
                    counted, f"c{counted}", pa.array(size, batch.column(counted).type)
                )

    return plain.mapInArrow(run, plain.schema).toDF(*columns)
