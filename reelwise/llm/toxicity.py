"""Toxicity by the nearest labelled examples.

Labelled documents become TF-IDF vectors over all their terms, which are word stems. A document's nearest examples by
exact cosine come from an inverted index with block maxima: examples are numbered so that similar ones stand together,
and every frequent term's list is cut into blocks of examples with the largest weight of each block. The rare terms'
postings are summed for all examples; with the frequent terms' maxima they bound every block. The most promising blocks
are scored first, the k-th best similarity so far is the threshold, and blocks whose bound stays below it are skipped.
Whatever comes close to the k-th similarity is computed again in double precision. Similarity-weighted votes, put through
a sigmoid fitted on leave-one-out votes, give the score; the neighbours are the evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelwise.llm.batches import settle, slices
from reelwise.llm.labelled import id_remainder, sample_labels
from reelwise.llm.linear import fit_sigmoid, sigmoid
from reelwise.llm.wordhash import POWERS, WORD_PUNCT, mix, tokens

STEM = 4  # a term is a word's first bytes, so that inflected forms meet
COMMON = 16  # terms in more than one of so many examples are frequent: their lists have block maxima
BLOCK = 128  # examples per block
EARLY = 2  # blocks scored before the threshold is taken
BATCH = 128  # texts scored together
PART = 1 << 18  # postings prepared together
SLACK = 1e-4  # more than the error of single precision
NEIGHBOURS = 25
PRIOR = 0.5  # similarity mass of the vote of an unmarked text


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every occurrence of a lowered word's stem: its first STEM bytes, or the whole word if shorter."""
    found = tokens(data, offsets, WORD_PUNCT, lower=True)
    word = found.kinds == 1
    starts, sizes = found.starts[word], (found.ends - found.starts)[word]
    lowered = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64) + np.uint64(1)
    lowered = np.append(lowered, np.zeros(STEM, np.uint64))
    with np.errstate(over="ignore"):
        h = np.full(len(starts), np.uint64(0xA0761D6478BD642F))
        for k in range(STEM):
            h += np.where(k < sizes, lowered[starts + k], np.uint64(0)) * POWERS[k + 7]
    return found.rows[word], mix(h)


@dataclass
class Index:
    """The labelled examples' inverted index and labels."""

    terms: np.ndarray  # sorted hashes
    idf: np.ndarray
    starts: np.ndarray  # postings of term t: starts[t]:starts[t + 1], ascending by example
    examples: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    unmarked: float  # share of toxic texts among those without a known term

    def __reduce__(self):
        """Numbers and counts in few bytes are shipped."""
        small = [x.astype(np.min_scalar_type(x.max(initial=0))) for x in (self.examples, self.counts)]
        return assemble, (self.ids, self.labels, self.terms, self.starts, *small)

    def vectors(self, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) of the unit TF-IDF vectors, by row."""
        if not len(self.terms) or not len(hashes):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0)
        maybe = self.mask[(hashes & np.uint64(0xFFFFF)).astype(np.int64)]
        rows, hashes = rows[maybe], hashes[maybe]
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        hit = self.terms[at] == hashes
        pairs, counts = np.unique(rows[hit] * len(self.terms) + at[hit], return_counts=True)
        row, term = pairs // len(self.terms), pairs % len(self.terms)
        weight = (1 + np.log(counts)) * self.idf[term]
        norm = np.sqrt(np.bincount(row, weights=weight**2)) if len(row) else np.zeros(0)
        return row, term, weight / norm[row] if len(row) else weight

    @property
    def weights(self) -> np.ndarray:
        """The postings' weights in unit vectors, until `prepare`."""
        raw = (1 + np.log(self.counts.astype(float))) * np.repeat(self.idf, np.diff(self.starts))
        return raw / self.norms(len(self.labels))[self.examples]

    @property
    def mask(self) -> np.ndarray:
        if not hasattr(self, "_mask"):
            self._mask = np.zeros(1 << 20, bool)
            self._mask[(self.terms & np.uint64(0xFFFFF)).astype(np.int64)] = True
        return self._mask

    def prepare(self) -> None:
        """What follows from the postings and is not shipped: example order, blocks with maxima, and postings by example."""
        n, df = len(self.labels), np.diff(self.starts)
        common = df * COMMON > n
        owner = np.repeat(np.arange(len(df), dtype=np.int32), df)
        # Worked out a part of the postings at a time: several workers prepare at once beside the executor's heap.
        parts = [slice(low, low + PART) for low in range(0, len(owner), PART)]
        self._norms = self.norms(n)
        weights = np.empty(len(owner), np.float32)
        for p in parts:
            weights[p] = (1 + np.log(self.counts[p].astype(float))) * self.idf[owner[p]] / self._norms[self.examples[p]]
        # Examples with the same heaviest frequent term stand together, so that blocks differ in their maxima.
        most, heavy = np.zeros(n, np.float32), np.full(n, -1, np.int32)
        for p in parts:
            listed = common[owner[p]]
            np.maximum.at(most, self.examples[p][listed], weights[p][listed])
        for p in parts:
            top = common[owner[p]] & (weights[p] == most[self.examples[p]])
            heavy[self.examples[p][top]] = owner[p][top]
        self._number = np.argsort(heavy, kind="stable")  # example at each place
        place = np.empty(n, np.int32)
        place[self._number] = np.arange(n, dtype=np.int32)
        self._column = np.full(len(df), -1, np.int32)
        self._column[common] = np.arange(int(common.sum()))
        self._blocks = np.zeros((-(-n // BLOCK), int(common.sum()), BLOCK), np.float32)
        for p in parts:
            listed = common[owner[p]]
            at = place[self.examples[p][listed]]
            self._blocks[at // BLOCK, self._column[owner[p][listed]], at % BLOCK] = weights[p][listed]
        self._maxima = np.ascontiguousarray(self._blocks.max(2).T)
        rare = ~common[owner]
        self._rare = place[self.examples[rare]], weights[rare]
        self._rare_starts = np.concatenate([[0], np.cumsum(np.where(common, 0, df))])
        del weights, rare
        order = np.argsort(self.examples, kind="stable").astype(np.int32)
        self._terms, self._counts = owner[order], self.counts[order]
        self._cuts = np.concatenate([[0], np.cumsum(np.bincount(self.examples, minlength=n))])
        self._query = np.zeros(len(df))
        # Lists by term are not read any more.
        self.examples = self.counts = None

    def norms(self, n: int) -> np.ndarray:
        raw = self.counts.astype(float)
        np.log(raw, out=raw)
        raw += 1
        raw *= np.repeat(self.idf, np.diff(self.starts))
        np.square(raw, out=raw)
        return np.sqrt(np.bincount(self.examples, weights=raw, minlength=n))

    def nearest_of(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of the texts 0 to n - 1 with (row, term, weight) by row: the k most similar examples (ties to the
        lower example) and their cosines, exactly."""
        if not hasattr(self, "_blocks"):
            self.prepare()
        cuts = np.searchsorted(row, np.arange(n + 1))
        for low in range(0, n, BATCH):
            high = min(n, low + BATCH)
            own = slice(cuts[low], cuts[high])
            rough = self._rough(row[own] - low, term[own], weight[own], high - low, k)
            for i in range(low, high):
                part = slice(cuts[i], cuts[i + 1])
                yield self._best(rough[i - low], term[part], weight[part], k)

    def _rough(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
        """Similarities in single precision by text and place; -1 in blocks that cannot hold one of the k best."""
        blocks, column = len(self._blocks), self._column[term]
        query = np.zeros((n, len(self._maxima)), np.float32)
        query[row[column >= 0], column[column >= 0]] = weight[column >= 0]
        total = np.zeros((n, blocks * BLOCK), np.float32)
        places, values = self._rare
        cuts = np.searchsorted(row, np.arange(n + 1))
        for i in range(n):
            part = slice(cuts[i], cuts[i + 1])
            rare = column[part] < 0
            first = self._rare_starts[term[part][rare]]
            at, sizes = spread(first, self._rare_starts[term[part][rare] + 1] - first)
            total[i] = np.bincount(places[at], weights=np.repeat(weight[part][rare], sizes) * values[at], minlength=total.shape[1])
        by_block = total.reshape(n, blocks, BLOCK)
        bound = by_block.max(2) + query @ self._maxima
        done = np.zeros((n, blocks), bool)

        def score(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(0)):
                rows = np.flatnonzero(wanted[:, b])
                by_block[rows, b] += query[rows] @ self._blocks[b]
            done[wanted] = True

        early = min(EARLY, blocks)
        wanted = np.zeros((n, blocks), bool)
        np.put_along_axis(wanted, np.argpartition(-bound, early - 1, axis=1)[:, :early], True, axis=1)
        score(wanted)
        least = np.full(n, -np.inf, np.float32)
        if early * BLOCK >= k:
            seen = by_block[wanted].reshape(n, -1)
            least = np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k]
        score(~done & (bound >= least[:, None] - SLACK))
        by_block[~done] = -1
        return total

    def _best(self, total: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        least = np.partition(total, len(total) - k)[len(total) - k] - SLACK if len(total) > k else 0.0
        some = self._number[np.flatnonzero((total > 0) & (total >= least))]
        at, sizes = spread(self._cuts[some], self._cuts[some + 1] - self._cuts[some])
        self._query[term] = weight
        found = self._terms[at]
        parts = (1 + np.log(self._counts[at].astype(float))) * self.idf[found] * self._query[found]
        exact = np.bincount(np.repeat(np.arange(len(some)), sizes), weights=parts, minlength=len(some)) / self._norms[some]
        self._query[term] = 0
        best = np.lexsort((some, -np.round(exact, 9)))[:k]
        return some[best], exact[best]

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples (ties to the lower example) of one text and their cosines, exactly."""
        return next(self.nearest_of(np.zeros(len(term), np.int64), term, weight, 1, k))

    def vote(self, best: np.ndarray, likeness: np.ndarray) -> float:
        return float(((likeness * self.labels[best]).sum() + PRIOR * self.unmarked) / (likeness.sum() + PRIOR))

    def nearest_all(self, data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """nearest_of for texts; one without a known term has no neighbours."""
        row, term, weight = self.vectors(*term_hashes(data, offsets))
        if not len(row):
            return iter([(row, weight)] * (len(offsets) - 1))
        return self.nearest_of(row, term, weight, len(offsets) - 1, k)


def spread(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the runs of `sizes` from `first` on, and the sizes."""
    return np.repeat((first - (np.cumsum(sizes) - sizes)).astype(np.int32), sizes) + np.arange(int(sizes.sum()), dtype=np.int32), sizes


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def build(ids: np.ndarray, labels: np.ndarray, terms: np.ndarray, rows: np.ndarray, where: np.ndarray, counts: np.ndarray) -> Index:
    """Index the sampled documents: `counts[i]` times term `where[i]` of the sorted vocabulary in row `rows[i]`."""
    order = np.lexsort((rows, where))
    starts = np.searchsorted(where[order], np.arange(len(terms) + 1))
    return assemble(ids, labels, terms, starts, rows[order], counts[order])


def assemble(ids: np.ndarray, labels: np.ndarray, terms: np.ndarray, starts: np.ndarray, row: np.ndarray, counts: np.ndarray) -> Index:
    """The index of postings given by term; its sigmoid is still to be fitted."""
    n, df = len(labels), np.diff(starts)
    idf = np.log(1 + n / np.maximum(df, 1))
    unmarked = np.bincount(row, minlength=n) == 0
    share = (labels[unmarked].sum() + 0.5) / (unmarked.sum() + 5.0)
    return Index(terms, idf, starts, row.astype(np.int32), labels.astype(float), ids, counts, float(share))


def learn(sampled: DataFrame) -> tuple[Broadcast, float, float]:
    """The broadcast index of the sampled texts (doc_id, label, text), and the slope and shift of the sigmoid.

    Spark counts the terms and finds the leave-one-out votes; what reaches the driver is the bounded list of examples
    and their terms. A document given twice is two examples.
    """

    sampled = settle(sampled.withColumn("example", F.monotonically_increasing_id()))
    known = sorted((r.doc_id, r.example, r.label) for r in sampled.select("doc_id", "example", "label").collect())
    examples = np.array([x[1] for x in known], np.int64)
    order = np.argsort(examples)
    ranked = examples[order]

    def numbers(rows: pa.RecordBatch) -> np.ndarray:
        return order[np.searchsorted(ranked, rows.column("example").to_numpy())].astype(np.int32)

    def collect_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                row, term = term_hashes(data, offsets)
                order = np.lexsort((term, row))
                row, term = row[order], term[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])) if len(row) else row
                counts = np.diff(np.append(first, len(row))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers(rows)[row[first]]), pa.array(term[first].view(np.int64)), pa.array(counts)],
                    names=["example", "term", "count"],
                )

    texts = sampled.select("example", "text")
    listed = texts.mapInArrow(collect_terms, "example int, term long, count int")
    grouped = listed.groupBy("term").agg(F.collect_list(F.struct("example", "count")).alias("found")).toArrow()
    terms = grouped["term"].to_numpy().view(np.uint64)
    by_term = np.argsort(terms)
    terms, found = terms[by_term], grouped["found"].combine_chunks().take(pa.array(by_term))
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy())]).astype(np.int64)
    row, counts = (found.flatten().field(name).to_numpy() for name in ("example", "count"))
    del grouped, found
    ids, labels = (np.array([x[k] for x in known], np.int64) for k in (0, 2))
    index = sampled.sparkSession.sparkContext.broadcast(assemble(ids, labels, terms, starts, row, counts))
    if not 0 < labels.sum() < len(labels):
        return index, 1.0, 0.0

    def leave_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                own, votes = numbers(rows), np.full(rows.num_rows, known.unmarked)
                for i, (best, likeness) in enumerate(known.nearest_all(data, offsets, NEIGHBOURS + 1)):
                    mine = best != own[i]
                    if len(best):
                        votes[i] = known.vote(best[mine][:NEIGHBOURS], likeness[mine][:NEIGHBOURS])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(votes)], names=["example", "vote"])

    votes = np.zeros(len(labels))
    for r in texts.mapInArrow(leave_out, "example int, vote double").collect():
        votes[r.example] = r.vote
    return index, *fit_sigmoid(logit(votes), labels)


def toxicity(df: DataFrame, labels: DataFrame, max_labelled: int = 12_000, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Add `held_out`, `score` (0 to 1, higher: toxic is likelier), `predicted` (1 if score >= 0.3), `evidence`.

    `evidence` lists the nearest examples as (doc_id, toxic, similarity). Examples come from rows of `labels` (doc_id,
    toxic) whose crc32 of the id as text, mod 4, is not 2; of those at most `max_labelled` with the smallest id hashes,
    the only bound. Scores depend on the text alone. Null and empty texts and texts without a known term get the rate of
    such texts; with no labels of both kinds all scores equal one rate. Ids may repeat; an example given twice counts twice; equal
    similarities go to the smaller id; whole texts are read; an empty table gives an empty one; columns with the added names are
    replaced.
    """
    added = ("held_out", "score", "predicted", "evidence")
    own = [f for f in df.schema.fields if f.name not in added]
    quoted = [F.col("`" + f.name.replace("`", "``") + "`") for f in own]
    chosen = sample_labels(labels, "toxic", max_labelled, id_remainder(F.col("doc_id"), 4) != 2)
    texts = df.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))

    sampled = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    index, slope, shift = learn(sampled)

    place = [f.name for f in own].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            # The text is shipped once, inside the row.
            row = batch.column("row")
            for rows, data, offsets in slices(pa.RecordBatch.from_arrays([row, row.field(place)], names=["row", "text"]), "text"):
                n = rows.num_rows
                votes, found = np.full(n, known.unmarked), [[] for _ in range(n)]
                for i, (best, likeness) in enumerate(known.nearest_all(data, offsets, NEIGHBOURS)):
                    if not len(best):
                        continue
                    votes[i] = known.vote(best, likeness)
                    found[i] = [{"doc_id": int(known.ids[b]), "toxic": int(known.labels[b]), "similarity": float(s)} for b, s in zip(best, likeness)]
                yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(sigmoid(slope * logit(votes) + shift)), pa.array(found, EVIDENCE)], names=["row", "score", "evidence"])

    base = df.select(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(quoted)], F.col(doc).alias("doc")).alias("row"))
    evidence = T.ArrayType(T.StructType().add("doc_id", T.LongType()).add("toxic", T.IntegerType()).add("similarity", T.DoubleType()))
    done = base.mapInArrow(run, T.StructType([base.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("evidence", evidence)]))
    return done.select(
        *[F.col(f"row.c{i}").alias(f.name) for i, f in enumerate(own)],
        (id_remainder(F.col("row.doc"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "evidence",
    )


EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())]))
