"""Language identification in two steps: the family first, then the language within it.

Both steps vote among one-versus-one linear support vector machines on hashed letter n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelwise.functions.ordering import top_n
from reelwise.llm.batches import binary_rows, slices
from reelwise.llm.labelled import id_remainder
from reelwise.llm.linear import fit_hinge, fit_sigmoid, sigmoid
from reelwise.llm.wordhash import LOWER

# Families of common language codes. A code outside the list is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb yi fy",
    "romance": "fr es pt it ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "indic": "hi ur bn pa gu mr ne si",
    "turkic": "tr az kk uz tk ky tt",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
WIDTH = 1 << 13
SLICE_ROWS = 512  # rows whose dense features are held at once
LEAST_QUOTA = 20
SPACED = LOWER.copy()
SPACED[:65] = SPACED[91:97] = SPACED[123:128] = 32  # everything but ASCII letters and non-ASCII bytes is a gap


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows x WIDTH) root frequencies of hashed 2- to 4-byte sequences of lowered text, scaled to length 1."""
    n = len(offsets) - 1
    letters = np.concatenate([SPACED[data], np.full(3, 32, np.uint8)]).astype(np.uint32)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    grown = np.zeros(len(data), np.uint32)
    counts = np.zeros(n * WIDTH, np.float32)
    with np.errstate(over="ignore"):
        for size in range(4):
            grown = (grown << np.uint32(8)) | letters[size : size + len(data)]
            if size:
                # Counted only if it starts inside a word or at its gap and does not leave its text.
                keep = (letters[1 : 1 + len(data)] != 32) & (np.arange(len(data)) + size < offsets[rows + 1])
                where = (grown[keep] * np.uint32(0x9E3779B1) ^ np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - 13)
                counts += np.bincount(rows[keep] * WIDTH + where, minlength=n * WIDTH)
    table = np.sqrt(counts).reshape(n, WIDTH)
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)


@dataclass
class Votes:
    """One-versus-one machines over some classes."""

    classes: list[str]
    weights: np.ndarray
    slopes: np.ndarray

    def probabilities(self, table: np.ndarray) -> np.ndarray:
        """(rows x classes), each row summing to 1; a class's share is the product of its pairwise wins."""
        logs = np.zeros((len(table), len(self.classes)))
        if len(self.classes) > 1:
            margins = table @ self.weights[:, :-1].T + self.weights[:, -1]
            for k, (i, j) in enumerate(combinations(range(len(self.classes)), 2)):
                win = sigmoid(self.slopes[k, 0] * margins[:, k] + self.slopes[k, 1])
                logs[:, i] += np.log(np.maximum(win, 1e-12))
                logs[:, j] += np.log(np.maximum(1 - win, 1e-12))
        share = np.exp(logs - logs.max(1, keepdims=True))
        return share / share.sum(1, keepdims=True)


def fit_votes(rows: list[tuple[np.ndarray, np.ndarray]], names: np.ndarray) -> Votes:
    """Fit on sparse rows (columns, values)."""
    classes = sorted(set(names.tolist()))
    weights, slopes = [], []
    for one, other in combinations(classes, 2):
        picked = np.flatnonzero((names == one) | (names == other))
        signs = np.where(names[picked] == one, 1, -1)
        held = np.arange(len(picked)) % 5 == 4
        train = picked[~held]
        w = fit_hinge([rows[r][0] for r in train], [rows[r][1] for r in train], signs[~held], WIDTH, cost=4.0)
        margins = np.array([w[rows[r][0]] @ rows[r][1] + w[-1] for r in picked])
        truth = (signs == 1).astype(int)
        test = held if 0 < truth[held].sum() < held.sum() else np.ones(len(picked), bool)
        weights.append(w)
        slopes.append(fit_sigmoid(margins[test], truth[test]))
    return Votes(classes, np.array(weights, np.float32).reshape(-1, WIDTH + 1), np.array(slopes).reshape(-1, 2))


@dataclass
class Model:
    families: Votes
    within: dict[str, Votes]

    def predict(self, table: np.ndarray) -> tuple[list[str], np.ndarray]:
        share = self.families.probabilities(table)
        best = share.argmax(1)
        names, scores = [""] * len(table), np.zeros(len(table))
        for k, family in enumerate(self.families.classes):
            rows = np.flatnonzero(best == k)
            inner = self.within[family].probabilities(table[rows])
            top = inner.argmax(1) if len(rows) else []
            for r, t in zip(rows, top):
                names[r] = self.within[family].classes[t]
            scores[rows] = share[rows, k] * (inner.max(1) if len(rows) else 0)
        return names, scores


def fit(rows: list[tuple[np.ndarray, np.ndarray]], names: np.ndarray) -> Model | None:
    if not len(names):
        return None
    families = np.array([FAMILY_OF.get(x, x) for x in names])
    inside = lambda f: [row for row, own in zip(rows, families) if own == f]
    return Model(fit_votes(rows, families), {f: fit_votes(inside(f), names[families == f]) for f in set(families.tolist())})


def has_letter(raw: bytes) -> bool:
    return raw.isalpha() or any(map(str.isalpha, raw.decode()))


def languages(df: DataFrame, max_labelled: int = 2_000, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Add `held_out`, `lang_pred` and `score` (0 to 1).

    Learns from the text and non-null `lang` of rows whose crc32 of the id as text, mod 5, is not 0. Every language gets an
    equal share of `max_labelled` rows (20 at least), those with the smallest id hashes (ties: the smaller id), so a rare
    language is learned however large the table is; this is the only bound. Predictions depend on the text alone. A null text or one
    without a letter is `und` with score 0, as is every text if nothing could be learned. An empty table
    gives an empty one. Ids may repeat; whole texts are read; columns with the added names are replaced.
    """
    spark = df.sparkSession
    added = ("held_out", "lang_pred", "score")
    own = [f for f in df.schema.fields if f.name not in added]
    quoted = [F.col("`" + f.name.replace("`", "``") + "`") for f in own]
    labelled = df.select(F.col(doc).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    labelled = labelled.filter(id_remainder(F.col("doc_id"), 5) != 0)
    ids = labelled.select("lang", "doc_id").distinct()
    quota = max(LEAST_QUOTA, max_labelled // max(1, ids.select("lang").distinct().count()))
    chosen = top_n(ids, ["lang"], [F.xxhash64("doc_id"), F.asc("doc_id")], quota).select("lang", "doc_id")

    def collect_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", 1 << 18, SLICE_ROWS):
                table = features(data, offsets)
                row, column = np.nonzero(table)
                ends = np.searchsorted(row, np.arange(rows.num_rows), side="right")
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("lang"), binary_rows(column.astype(np.int16), ends), binary_rows(table[row, column], ends)],
                    names=["doc_id", "lang", "columns", "values"],
                )

    same = labelled["doc_id"].eqNullSafe(chosen["doc_id"]) & (labelled["lang"] == chosen["lang"])
    sampled = labelled.join(F.broadcast(chosen), same, "left_semi")
    sampled = sampled.mapInArrow(collect_rows, "doc_id long, lang string, columns binary, values binary")
    known = sorted((r.doc_id if r.doc_id is not None else -1, r.lang, bytes(r.columns), bytes(r["values"])) for r in sampled.collect())
    rows = [(np.frombuffer(c, np.int16).astype(np.int64), np.frombuffer(v, np.float32)) for _, _, c, v in known]
    model = spark.sparkContext.broadcast(fit(rows, np.array([r[1] for r in known])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", 1 << 18, SLICE_ROWS):
                n = rows.num_rows
                raw = data.tobytes()
                known = np.array([has_letter(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], bool)
                if model.value is None or not known.any():
                    names, scores = ["und"] * n, np.zeros(n)
                else:
                    names, scores = model.value.predict(features(data, offsets))
                    names = [name if k else "und" for name, k in zip(names, known)]
                    scores = np.where(known, scores, 0.0)
                yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(names, pa.string()), pa.array(scores)], names=["row", "lang_pred", "score"])

    base = df.select(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(quoted)], F.col(doc).alias("doc")).alias("row"), F.col(text).alias("text"))
    done = base.mapInArrow(run, T.StructType([base.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return done.select(
        *[F.col(f"row.c{i}").alias(f.name) for i, f in enumerate(own)], (id_remainder(F.col("row.doc"), 5) == 0).alias("held_out"), "lang_pred", "score"
    )
