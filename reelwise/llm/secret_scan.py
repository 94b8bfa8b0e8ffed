"""Secrets in text: fixed patterns, and long tokens that pass a battery of randomness tests.

A token's encoding is inferred from its characters. Under the hypothesis that its symbols are drawn evenly from that
alphabet it takes a chi-squared test of uniformity, a runs test and a serial-correlation test; ordinary words fail, keys
pass. How often ordinary tokens pass depends on length, so the share is measured on the corpus for each length, on
tokens of letters in one case, and a stratum (encoding, length) is reported only where the expected share of false
discoveries stays within a bound.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelwise.llm.batches import slices
from reelwise.session import cut_lineage

# The base patterns, their least lengths, and the order of kinds in a report.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "random")

LEAST_RANDOM, LONGEST_BIN = 20, 64
ALPHABETS = {"hex": 16, "base32": 32, "lower36": 36, "upper36": 36, "base64": 64, "letters": 26}
LEVEL = 0.01  # a token passes if no test rejects evenness at this level


def _class(letters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(letters.encode())] = True
    return table


SMALL, LARGE, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
IS_HEX, IS_TOKEN = _class(DIGITS + "abcdef"), _class(SMALL + LARGE + DIGITS + "+/_-")


def runs_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the longest runs of a byte class inside single texts."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = (ends - starts >= least) & inside[starts] if len(starts) else np.zeros(0, bool)
    return starts[keep], ends[keep]


def encoding_of(token: str) -> str:
    kinds = set(token)
    if kinds <= set(DIGITS + "abcdef") or kinds <= set(DIGITS + "ABCDEF"):
        return "hex"
    if kinds <= set(LARGE + "234567") and kinds & set("234567"):
        return "base32"
    if token[1:].islower() and token.isalpha() or token.isupper() and token.isalpha() or token.istitle() and token.isalpha():
        return "letters"
    if kinds <= set(SMALL + DIGITS):
        return "lower36"
    if kinds <= set(LARGE + DIGITS):
        return "upper36"
    return "base64"


ORDER = {
    "hex": DIGITS + "abcdef",
    "base32": LARGE + "234567",
    "lower36": SMALL + DIGITS,
    "upper36": LARGE + DIGITS,
    "base64": LARGE + SMALL + DIGITS + "+/-_",
    "letters": SMALL,
}
PLACES = {name: {c: i for i, c in enumerate(letters)} for name, letters in ORDER.items()}


def chi2_tail(value: float, freedom: int) -> float:
    """Upper tail of the chi-squared distribution by the cube-root normal approximation."""
    z = ((value / freedom) ** (1 / 3) - (1 - 2 / (9 * freedom))) / math.sqrt(2 / (9 * freedom))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, encoding: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation for a token read in an encoding."""
    size = ALPHABETS[encoding]
    text = token.lower() if encoding in ("letters", "hex") else token
    places = PLACES[encoding]
    x = [places.get(c, size - 1) % size for c in text]
    n = len(x)
    counts = np.bincount(x, minlength=size)
    uniform = chi2_tail(float(((counts - n / size) ** 2).sum() / (n / size)), size - 1)
    # Short tokens: the count of equal pairs is what the statistic above measures; vowels and bigrams show below.
    high = [v >= size / 2 for v in x]
    ones = sum(high)
    if 0 < ones < n:
        mean = 1 + 2 * ones * (n - ones) / n
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        turns = 1 + sum(a != b for a, b in zip(high, high[1:]))
        runs = math.erfc(abs(turns - mean) / spread / math.sqrt(2))
    else:
        runs = 0.0
    centred = np.array(x) - (size - 1) / 2
    power = float(centred @ centred)
    serial = math.erfc(abs(float(centred[1:] @ centred[:-1]) / power) * math.sqrt(n) / math.sqrt(2)) if power else 0.0
    return uniform, runs, serial


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the assign and access patterns; hex runs come from the byte scan."""
    out = []
    if (":" in text or "=" in text) and any(k in (small := text.lower()) for k in KEYWORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in slices(batch, "text"):
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            texts = rows.column("text").to_pylist()
            base = [base_spans(text or "") for text in texts]
            starts, ends = runs_of(data, offsets, IS_HEX, LEAST["hex"])
            owner = np.searchsorted(offsets, starts, side="right") - 1
            for r, a, b in zip(owner.tolist(), chars[starts] - chars[offsets[owner]], chars[ends] - chars[offsets[owner]]):
                base[r].append((int(a), "hex", int(b)))
            found = [[] for _ in texts]
            starts, ends = runs_of(data, offsets, IS_TOKEN, LEAST_RANDOM)
            owner = np.searchsorted(offsets, starts, side="right") - 1
            for r, s, a, b in zip(owner.tolist(), starts.tolist(), (chars[starts] - chars[offsets[owner]]).tolist(), (chars[ends] - chars[offsets[owner]]).tolist()):
                token = data[s : s + b - a].tobytes().decode()
                encoding = encoding_of(token)
                found[r].append({"start": a, "end": b, "encoding": encoding, "bin": min(b - a, LONGEST_BIN), "passed": min(battery(token, encoding)) >= LEVEL})
            spans = [[{"start": s, "end": e, "kind": k} for s, k, e in sorted(x, key=lambda y: (y[0], KINDS.index(y[1])))] for x in base]
            yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(spans, SPANS), pa.array(found, FOUND)], names=["row", "base", "found"])


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("bin", pa.int32()), ("passed", pa.bool_())]))
PLACE = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())
SPAN_TYPE = T.ArrayType(T.StructType([*PLACE.fields, T.StructField("kind", T.StringType())]))
FOUND_TYPE = T.ArrayType(
    T.StructType(
        [*PLACE.fields, T.StructField("encoding", T.StringType()), T.StructField("bin", T.IntegerType()), T.StructField("passed", T.BooleanType())]
    )
)


def admitted(found: DataFrame, rate: float) -> DataFrame:
    """(encoding, bin) strata in which at most a share `rate` of the passing tokens is expected to be ordinary.

    Ordinary tokens are the corpus's tokens of letters in one case; of those, the share passing at a length (smoothed
    upwards) times the stratum's tokens bounds its false discoveries. Strata of letters are never admitted.
    """
    each = found.groupBy("encoding", "bin").agg(F.count("*").alias("n"), F.sum(F.col("passed").cast("long")).alias("good"))
    plain = each.filter("encoding = 'letters'").select("bin", ((F.col("good") + 1) / (F.col("n") + 2)).alias("share"))
    # Where a length has no ordinary token, evenness has to be shown by length alone: chance 1 in 2 per 4 characters.
    tested = each.filter("encoding <> 'letters' AND good > 0").join(plain, "bin", "left")
    false_hits = F.col("n") * F.least(F.coalesce("share", F.lit(1.0)), F.pow(F.lit(0.5), F.col("bin") / 4))
    return tested.filter(false_hits <= rate * F.col("good")).select("encoding", "bin")


def secrets(df: DataFrame, rate: float = 0.1, text: str = "text") -> DataFrame:
    """Add `base` and `spans`: arrays of (start, end, kind) in code points, end exclusive, by start, then kind.

    Base kinds: `assign` (a secret's name, then : or =, then a value of 12 or more characters), `access` (AKIA and more,
    18 or more characters) and `hex` (16 or more lower hex digits). `spans` adds `random`: tokens of 20 or more characters
    that pass the battery in an admitted stratum and overlap no base span. A null text counts as empty and has no span.
    Every row stays, repeated rows too; spans of equal start are ordered by kind; whole texts are read; an empty table gives an
    empty one; columns with the added names are replaced.
    """
    added = ("base", "spans")
    own = [f for f in df.schema.fields if f.name not in added]
    quoted = [F.col("`" + f.name.replace("`", "``") + "`") for f in own]
    base = df.select(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(quoted)]).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([base.schema["row"], T.StructField("base", SPAN_TYPE), T.StructField("found", FOUND_TYPE)])
    scanned = cut_lineage(base.mapInArrow(_scan, schema))
    strata = admitted(scanned.select(F.inline("found")), rate)
    # At most one entry per encoding and length.
    known = strata.agg(F.collect_set(F.concat_ws(":", "encoding", "bin")).alias("known")).scalar()
    with_known = scanned.withColumn("known", known)
    extra = F.expr(
        "transform(filter(found, x -> x.passed AND array_contains(known, concat_ws(':', x.encoding, x.bin)) "
        "AND NOT exists(base, y -> y.start < x.end AND x.start < y.end)), x -> struct(x.start AS start, x.end AS end, 'random' AS kind))"
    )
    place = F.array_sort(F.concat("base", extra), lambda a, b: _before(a, b))
    return with_known.select(*[F.col(f"row.c{i}").alias(f.name) for i, f in enumerate(own)], "base", place.alias("spans"))


def _before(a, b):
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).cast("int")
    return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(rank(a) - rank(b))
