"""Quality scores by naive Bayes support vectors.

N-gram indicators, scaled by their class log-count ratios, feed a linear hinge-loss model fitted by dual coordinate
descent on a bounded sample of labelled documents. Every document is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelwise.llm.batches import binary_rows, slices
from reelwise.llm.labelled import id_remainder, sample_labels
from reelwise.llm.linear import fit_hinge, fit_sigmoid, sigmoid
from reelwise.llm.wordhash import WORD_PUNCT, mix, tokens

BITS = 18
MIN_DOCS = 5  # an n-gram must be in that many sampled documents
REPEATS = (np.uint64(0x1D8E4E27C47D124F), np.uint64(0x72BE5D74F27B896F))  # any token two or three times in a row


def indicators(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram: tokens, neighbouring pairs, and "the same token two / three times"."""
    found = tokens(data, offsets, WORD_PUNCT, lower=False)
    h, rows = found.hashes, found.rows
    if not len(h):
        return rows, np.zeros(0, np.int64)
    inside = rows[1:] == rows[:-1]
    same = inside & (h[1:] == h[:-1])
    with np.errstate(over="ignore"):
        pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    pairs[same] = REPEATS[0]
    thrice = np.flatnonzero(same[1:] & same[:-1])
    buckets = np.concatenate([h, pairs[inside], np.full(len(thrice), REPEATS[1])]) >> np.uint64(64 - BITS)
    return np.concatenate([rows, rows[1:][inside], rows[thrice]]), buckets.astype(np.int64)


def unique_pairs(rows: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows << BITS | buckets)
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of each bucket, the ratio included; 0 for buckets outside the vocabulary
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, buckets = indicators(data, offsets)
        used = self.ratios[buckets] != 0
        rows, buckets = unique_pairs(rows[used], buckets[used])
        n = len(offsets) - 1
        total = np.bincount(rows, weights=self.weights[buckets], minlength=n)
        norm = np.sqrt(np.bincount(rows, weights=self.ratios[buckets] ** 2, minlength=n))
        return sigmoid(self.slope * (total / np.maximum(norm, 1e-9) + self.bias) + self.shift)


def fit(sets: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit on bucket sets; every fifth row is kept for the sigmoid. One class alone gives a constant score."""
    width = 1 << BITS
    if len(set(labels.tolist())) < 2:
        rate = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(width), np.zeros(width), 0.0, 1.0, float(np.log(rate / (1 - rate))))
    counts = {c: np.zeros(width) for c in (0, 1)}
    for s, y in zip(sets, labels.tolist()):
        counts[y][s] += 1  # a set holds a bucket once
    use = counts[0] + counts[1] >= MIN_DOCS
    smooth = {c: np.where(use, counts[c] + 1.0, 0) / ((counts[c][use] + 1.0).sum() or 1) for c in (0, 1)}
    ratios = np.zeros(width)
    ratios[use] = np.log(smooth[1][use] / smooth[0][use])
    rows = [s[use[s]] for s in sets]
    values = [(ratios[s] / max(np.linalg.norm(ratios[s]), 1e-9)).astype(np.float32) for s in rows]
    signs = np.where(labels == 1, 1, -1)
    held = np.arange(len(labels)) % 5 == 4
    pick = lambda items, mask: [x for x, m in zip(items, mask) if m]
    w = fit_hinge(pick(rows, ~held), pick(values, ~held), signs[~held], width)
    margins = np.array([w[r] @ v + w[-1] for r, v in zip(rows, values)])
    test = held if len(set(labels[held].tolist())) == 2 else ~held
    slope, shift = fit_sigmoid(margins[test], labels[test])
    return Model(w[:-1] * ratios, ratios, float(w[-1]), slope, shift)


def quality_scores(df: DataFrame, labels: DataFrame, max_labelled: int = 8_000, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Add `held_out`, `score` (0 to 1, higher: quality 1 is likelier) and `predicted` (1 if score >= 0.3).

    Learns from rows of `labels` (doc_id, quality) whose crc32 of the id as text, mod 5, is not 0; of those at most
    `max_labelled` with the smallest id hashes, the only bound. Scores depend on the text alone. Null and empty texts get
    the score of a text without known n-grams; without labels of both kinds all scores equal one rate. An id
    labelled twice takes the larger label. Ids may repeat; an empty table gives an empty one. Columns with the added names
    are replaced.
    """
    spark = df.sparkSession
    added = ("held_out", "score", "predicted")
    own = [f for f in df.schema.fields if f.name not in added]
    quoted = [F.col("`" + f.name.replace("`", "``") + "`") for f in own]
    chosen = sample_labels(labels, "quality", max_labelled, id_remainder(F.col("doc_id"), 5) != 0)
    texts = df.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))

    def collect_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                row, bucket = unique_pairs(*indicators(data, offsets))
                ends = np.searchsorted(row, np.arange(rows.num_rows), side="right")
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), binary_rows(bucket.astype(np.int32), ends)], names=["doc_id", "label", "sets"])

    sampled = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(collect_sets, "doc_id long, label int, sets binary")
    known = sorted((r.doc_id, r.label, bytes(r.sets)) for r in sampled.collect())
    model = spark.sparkContext.broadcast(fit([np.frombuffer(s, np.int32) for _, _, s in known], np.array([x[1] for x in known], np.int64)))
    del known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(model.value.scores(data, offsets))], names=["row", "score"])

    base = df.select(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(quoted)], F.col(doc).alias("doc")).alias("row"), F.col(text).alias("text"))
    done = base.mapInArrow(run, T.StructType([base.schema["row"], T.StructField("score", T.DoubleType())]))
    return done.select(
        *[F.col(f"row.c{i}").alias(f.name) for i, f in enumerate(own)],
        (id_remainder(F.col("row.doc"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
