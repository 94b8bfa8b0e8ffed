"""Top-K of user vectors against item vectors: item blocks stream past blocks of users.

Users and items are hashed into blocks of bounded size. A task holds one block of users and their best rows so far; the
item blocks pass through it one after another, each scored by strips of users and merged into the best rows. What
leaves a task is at most k rows per user, however many items there are. Where there are fewer user blocks than tasks, the
item blocks are dealt to several chunks, whose lists are merged afterwards. Every item is sent once to each user block and
every user once to each chunk, so blocks and chunks are chosen to send about equally many rows of both kinds. Before they
are sent, the rows of a block are packed: a pack is one binary value, however many numbers its vectors hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelwise.functions.columns import steady
from reelwise.functions.ordering import top_n
from reelwise.session import cut_lineage

USER_BLOCK = 32768
USER_STRIP = 128
ITEM_BLOCK = 8192
PACK_BYTES = 1 << 20
MEANS_BLOCK = 2048
ROUND_ENTRIES = 1 << 26  # entries of lists that may be shuffled at a time in any case
MEANS_ENTRIES = 1 << 15  # vectors that a mean gathers at once
DIGITS = 9
USER, SEEN, ITEM = 0, 1, 2

RESCORED = 1 << 14  # pairs whose vectors are gathered at once
PAIRS = 1 << 20  # products that a sparse join expands at once
DATA = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType())])


class Scores(NamedTuple):
    """Scores of a strip of users against an item block: rows x items, the item ids ascending.

    With `exact` the scores are rough: within `slack` (one number a row) of the doubles that `exact(rows, places)` gives.
    """

    items: np.ndarray
    scores: np.ndarray
    slack: np.ndarray | None = None
    exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None


Score = Callable[[pa.Table, pa.Table], Scores]


def block_runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...] = ("_ub", "_ic", "_ib")) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """(values of `by`, rows) of batches sorted by these columns."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in by]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            here = tuple(int(c[low]) for c in columns)
            if held and here != key:
                yield key, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            key = here
    if held:
        yield key, pa.Table.from_batches(held)


def set_places(hit: np.ndarray) -> np.ndarray:
    """Flat places of the set entries of a contiguous mask, of which most eights hold none."""
    flat = hit.ravel()
    whole = len(flat) // 8 * 8
    at = (8 * np.flatnonzero(flat[:whole].view(np.uint64))[:, None] + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


class Best:
    """The best `k` (row, item) pairs of each row so far: by rounded score, ties to the lower item."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.row, self.item = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score, self.least = np.zeros(0), np.full(rows, -np.inf)

    def add(self, items: np.ndarray, scores: np.ndarray, slack: np.ndarray | None = None, exact: Callable | None = None) -> None:
        """Merge a block's scores (rows x items); -inf marks pairs that do not count. See Scores for rough ones."""
        kind, slack = scores.dtype.type, np.zeros(len(scores)) if slack is None else slack

        def under(floor: np.ndarray, slack: np.ndarray) -> np.ndarray:
            # What rounds to at least the floor lies above a slightly lower one; scores are rounded only once they pass it.
            low = floor - slack - 2 * 10.0**-DIGITS - 1e-14 * np.abs(floor)
            return np.nextafter(np.maximum(low, np.finfo(kind).min / 2).astype(kind), kind(-np.inf))[:, None]

        hit = scores >= under(self.least, slack)
        if scores.shape[1] > self.k and np.count_nonzero(hit) > 4 * self.k * len(scores):
            busy = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * self.k)
            part = scores[busy]
            kth = np.partition(part, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            hit[busy] = part >= under(np.maximum(self.least[busy], kth - slack[busy]), slack[busy])
        row, at = np.divmod(set_places(hit), scores.shape[1])
        if not len(row):
            return
        found = scores[row, at] if exact is None else exact(row, at)
        # Rows without a hit stay as they are.
        met = np.zeros(len(scores), bool)
        met[row] = True
        old = met[self.row]
        item = np.concatenate([self.item[old], items[at]])
        score = np.concatenate([self.score[old], found])
        row = np.concatenate([self.row[old], row])
        order = np.lexsort((item, -np.round(score, DIGITS), row))
        row, item, score = row[order], item[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        full = keep & (place == self.k - 1)
        self.least[row[full]] = np.round(score[full], DIGITS)
        self.row, self.item, self.score = (np.concatenate([x[~old], y[keep]]) for x, y in ((self.row, row), (self.item, item), (self.score, score)))


def pack(table: pa.Table) -> bytes:
    """Rows as one value, in Arrow's stream format."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(packs: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(value.as_buffer()).read_all() for value in packs]).combine_chunks()


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_block, _a, _pack): the rows of each block, in packs of about PACK_BYTES named by their first id."""
    for (block,), table in block_runs(batches, ("_block",)):
        table = table.drop_columns(["_block"])
        step = max(1, PACK_BYTES * table.num_rows // max(table.nbytes, 1))
        for low in range(0, table.num_rows, step):
            piece = table.slice(low, step).combine_chunks()
            data = [pa.array([block], pa.int32()), piece.column("_a").chunk(0).slice(0, 1), pa.array([pack(piece)], pa.binary())]
            yield pa.RecordBatch.from_arrays(data, names=["_block", "_a", "_pack"])


def streamed(
    users: DataFrame,
    items: DataFrame,
    seen: DataFrame | None,
    k: int | None,
    score: Score,
    user_block: int,
    item_block: int,
    strip: int = USER_STRIP,
) -> DataFrame:
    """(user_id, item_id, score): at most `k` unseen items per user and chunk; with `k` None every pair that scores above 0.

    Both tables carry their vector in the same columns after the id; the types may differ.
    """
    spark = users.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows_of = lambda df: F.greatest(F.coalesce(df.agg(F.count("*")).scalar(), F.lit(1)), F.lit(1))
    sizes = {"_nu": rows_of(users), "_ni": rows_of(items)}
    # Sent are nu * items rows, and partitions / nu * users rows that cost about four times as much with the lists coming back:
    # least at this nu, unless a block would hold too many users.
    even = F.least(F.lit(float(partitions)), F.sqrt(F.lit(4 * partitions) * F.col("_nu") / F.col("_ni")), F.col("_nu") / F.lit(strip))
    blocks = {"_nu": F.greatest(F.ceil(F.col("_nu") / F.lit(user_block)), F.ceil(even)).cast("int"), "_ni": F.ceil(F.col("_ni") / F.lit(item_block)).cast("int")}
    chunks = {"_nc": F.least(F.col("_ni"), F.ceil(F.lit(partitions) / F.col("_nu")).cast("int"))}
    of = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sized = lambda df: df.withColumns(sizes).withColumns(blocks).withColumns(chunks)

    def packed(df: DataFrame, key: str, n: str) -> DataFrame:
        vector = [name for name in df.columns if name != key]
        placed = sized(df).select(of(key, n).alias("_block"), F.col(key).cast("long").alias("_a"), *vector)
        return placed.repartition(partitions, "_block").sortWithinPartitions("_block", "_a").mapInArrow(packs, "_block int, _a long, _pack binary")

    def rows(df: DataFrame, kind: int, ub: Column, ic: Column, ib: Column, b: Column, data: Column) -> DataFrame:
        first = sized(df).withColumn("_ub", ub).withColumn("_ib", ib).withColumn("_ic", ic)
        return first.select("_ub", "_ic", "_ib", F.lit(kind).alias("_kind"), "_a", b.cast("long").alias("_b"), data.cast("binary").alias("_pack"))

    block, none, held = F.pmod(F.col("_ib"), F.col("_nc")).cast("int"), F.lit(None), F.col("_pack")
    parts = rows(packed(users, "user_id", "_nu"), USER, F.col("_block"), each("_nc"), F.lit(-1), none, held)
    parts = parts.unionByName(rows(packed(items, "item_id", "_ni"), ITEM, each("_nu"), block, F.col("_block"), none, held))
    if seen is not None:
        near = seen.select("user_id", "item_id").join(items.select("item_id"), "item_id", "left_semi").filter("user_id IS NOT NULL")
        parts = parts.unionByName(rows(near.withColumn("_a", F.col("user_id").cast("long")), SEEN, of("user_id", "_nu"), block, of("item_id", "_ni"), F.col("item_id"), none))
    sorted_parts = parts.repartition(partitions, "_ub", "_ic").sortWithinPartitions("_ub", "_ic", "_ib", "_kind", "_a")

    def result(user_ids: pa.Array, row: np.ndarray, item: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([user_ids.take(pa.array(row)), pa.array(item), pa.array(found)], names=["user_id", "item_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, people, named, ids, best = None, None, None, None, []
        for (ub, ic, ib), table in block_runs(batches):
            if (ub, ic) != group:
                for n, part in enumerate(best):
                    yield result(named, part.row + n * strip, part.item, part.score)
                group, people, best = (ub, ic), None, []
            if ib < 0:
                people = unpack(table.column("_pack"))
                named = people.column("_a").combine_chunks()
                ids = pc.fill_null(named, np.iinfo(np.int64).min).to_numpy()  # a user without id comes first
                best = [Best(min(strip, len(ids) - low), k) for low in range(0, len(ids), strip)] if k is not None else []
                continue
            first = int(np.searchsorted(table.column("_kind").to_numpy(), ITEM))
            if people is None or first == table.num_rows:
                continue  # no user, or no item, in this block
            catalog = unpack(table.column("_pack").slice(first))
            who, what = (table.column(c).slice(0, first).to_numpy() for c in ("_a", "_b"))
            row = np.minimum(np.searchsorted(ids, who), len(ids) - 1)
            for low in range(0, len(ids), strip):
                item_ids, scores, slack, exact = score(people.slice(low, strip), catalog)
                if k is None:
                    hit, at = np.nonzero(scores > 0)
                    yield result(named, hit + low, item_ids[at], scores[hit, at])
                    continue
                here = slice(*np.searchsorted(row, [low, low + strip]))  # users ascend in both
                at = np.minimum(np.searchsorted(item_ids, what[here]), len(item_ids) - 1)
                both = (ids[row[here]] == who[here]) & (item_ids[at] == what[here])
                scores[row[here][both] - low, at[both]] = -np.inf
                best[low // strip].add(item_ids, scores, slack, exact)
        for n, part in enumerate(best):
            yield result(named, part.row + n * strip, part.item, part.score)

    return sorted_parts.mapInArrow(run, DATA)


def dense_scores(people: pa.Table, catalog: pa.Table) -> Scores:
    """Dot products of `vector`. The product of all pairs is taken in floats; doubles are left to the pairs that may count."""

    def matrix(table: pa.Table) -> np.ndarray:
        column = table.column("vector").combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

    def exact(row: np.ndarray, at: np.ndarray) -> np.ndarray:
        cuts = range(0, len(row), RESCORED)
        both = ((left[row[n : n + RESCORED]].astype(np.float64), right[at[n : n + RESCORED]].astype(np.float64)) for n in cuts)
        return np.concatenate([np.einsum("ij,ij->i", a, b) for a, b in both])

    left, right = matrix(people), matrix(catalog)
    ids, width = catalog.column("_a").to_numpy(), right.shape[1]
    longest = np.sqrt(np.square(left, dtype=np.float64).sum(1))
    widest = np.sqrt(width) * max(float(right.max()), -float(right.min())) if width else 0.0
    if not (longest.max() < 1e15 and widest < 1e15):  # beyond, or not numbers: floats could overflow
        return Scores(ids, left.astype(np.float64) @ right.astype(np.float64).T)
    # Rounding both factors and each of the sums: at most this share of the product of the lengths.
    share = (width + 8) * 2.0**-24
    return Scores(ids, left.astype(np.float32) @ right.astype(np.float32, copy=False).T, 1.01 * share * longest * widest, exact)


def entries(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, term, weight) of the `terms` and `weights` arrays."""
    terms, weights = (table.column(c).combine_chunks() for c in ("terms", "weights"))
    return np.repeat(np.arange(table.num_rows), pc.list_value_length(terms).to_numpy()), terms.flatten(), weights.flatten().to_numpy()


def sparse_scores(people: pa.Table, catalog: pa.Table) -> Scores:
    """Dot products of (terms, weights), in the space of the terms the item block uses."""
    rows, terms, weights = entries(catalog)
    space = terms.unique()
    right = np.zeros((catalog.num_rows, len(space)))
    right[rows, pc.index_in(terms, value_set=space).to_numpy()] = weights
    rows, terms, weights = entries(people)
    at = pc.fill_null(pc.index_in(terms, value_set=space), -1).to_numpy()
    left = np.zeros((people.num_rows, len(space)))
    left[rows[at >= 0], at[at >= 0]] = weights[at >= 0]
    return Scores(catalog.column("_a").to_numpy(), left @ right.T)


def linked_topk(users: DataFrame, lists: DataFrame, seen: DataFrame, k: int, user_block: int = 1024) -> DataFrame:
    """(user_id, item_id, score, rank): best `k` unseen items by summed weight over the users' lists, ties by item; written.

    `users` (user_id, terms, weights) names lists by id with a factor each; `lists` (item_id, terms, weights) holds item ids
    and their weights, one row per list. A block of users gets each list it names once, so what is shuffled grows with
    the tails, and a list that many users name is sent once per block. Only positive sums count. Whole users stay in one
    task: ranks need no further shuffle. Lists are written beside the blocks that name them, and many blocks take their turn in
    rounds: what is shuffled at a time is about twice the lists, or ROUND_ENTRIES if that is more, however many blocks name them.
    """
    partitions = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.coalesce(users.agg(F.ceil(F.count("*") / F.lit(user_block))).scalar(), F.lit(1))
    named = cut_lineage(users.withColumn("_ub", F.pmod(F.xxhash64("user_id"), F.greatest(size, F.lit(partitions))).cast("int")))
    wanted = named.select("_ub", F.explode("terms").alias("item_id")).distinct().groupBy("item_id").agg(F.collect_list("_ub").alias("_blocks"))
    sent = cut_lineage(wanted.join(lists, "item_id"))
    held = sent.agg(F.sum(F.size("terms").cast("long")).alias("own"), F.sum(F.size("terms").cast("long") * F.size("_blocks")).alias("all")).first()
    rounds = max(1, -(-(held["all"] or 0) // max(2 * (held["own"] or 0), ROUND_ENTRIES)))
    met = cut_lineage(seen.groupBy("user_id").agg(F.collect_set("item_id").alias("terms")).join(named.select("user_id", "_ub"), "user_id"))
    none = F.lit(None).cast("array<double>")

    def part(df: DataFrame, kind: int, key: str, weights: Column) -> DataFrame:
        return df.select("_ub", F.lit(kind).alias("_kind"), F.col(key).cast("long").alias("_a"), F.col("terms").cast("array<long>").alias("terms"), weights.cast("array<double>").alias("weights"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in block_runs(batches, ("_ub",)):
            kinds = table.column("_kind").to_numpy()
            cuts = np.searchsorted(kinds, [USER, SEEN, ITEM, ITEM + 1])
            people, past, links = (table.slice(low, high - low) for low, high in zip(cuts, cuts[1:]))
            if people.num_rows and links.num_rows:
                yield from linked_best(people, past, links, k)

    best = None
    for turn in range(rounds):
        now = F.pmod("_ub", F.lit(rounds)) == turn
        blocks = F.explode(F.filter("_blocks", lambda b: F.pmod(b, F.lit(rounds)) == turn))
        parts = part(named.filter(now), USER, "user_id", F.col("weights")).unionByName(part(met.filter(now), SEEN, "user_id", none))
        parts = parts.unionByName(part(sent.select("item_id", "terms", "weights", blocks.alias("_ub")), ITEM, "item_id", F.col("weights")))
        sorted_parts = parts.repartition("_ub").sortWithinPartitions("_ub", "_kind", "_a")
        found = cut_lineage(sorted_parts.mapInArrow(run, T.StructType([*DATA.fields, T.StructField("rank", T.IntegerType())])))
        best = found if best is None else best.unionByName(found)
    return best


def linked_best(people: pa.Table, past: pa.Table, links: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """The ranked best items of one block of users; at most PAIRS products, or one user's, at a time."""
    ids, sources = people.column("_a").to_numpy(), links.column("_a").to_numpy()
    terms, weights = (links.column(c).combine_chunks() for c in ("terms", "weights"))
    sizes = pc.list_value_length(terms).to_numpy().astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    linked, weights = terms.flatten().to_numpy(), weights.flatten().to_numpy()
    met = past.column("terms").combine_chunks()
    who = np.searchsorted(ids, np.repeat(past.column("_a").to_numpy(), pc.list_value_length(met).to_numpy()))
    what = met.flatten().to_numpy()
    row, wanted, pull = entries(people)
    wanted = wanted.to_numpy()
    at = np.minimum(np.searchsorted(sources, wanted), len(sources) - 1)
    hit = sources[at] == wanted
    row, pull, at = row[hit], pull[hit], at[hit]
    edges = np.searchsorted(row, np.arange(len(ids) + 1))
    upto = np.append(0, np.cumsum(sizes[at]))[edges]  # products of the users before
    first = 0
    while first < len(ids):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + PAIRS, side="right")) - 1)
        own = slice(edges[first], edges[last])
        n = sizes[at[own]]
        where = np.repeat(starts[at[own]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        here, value = linked[where], np.repeat(pull[own], n) * weights[where]
        past_own = slice(*np.searchsorted(who, [first, last]))
        # Pairs get keys, for the users at hand only; with their places below them one sort brings equal ones together.
        bits, many = len(here).bit_length(), last - first
        lowest, highest = (int(here.min()), int(here.max())) if len(here) else (0, 0)
        span, items = highest - lowest + 1, None
        if (many * span) << bits < 1 << 62:
            code, past_code = here - lowest, what[past_own] - lowest
            known = (what[past_own] >= lowest) & (what[past_own] <= highest)
        else:  # ids far apart
            items, code = np.unique(here, return_inverse=True)
            span = len(items)
            past_code = np.minimum(np.searchsorted(items, what[past_own]), span - 1)
            known = items[past_code] == what[past_own]
        seen = np.unique(((who[past_own] - first) * span + past_code)[known])
        key = np.sort(((np.repeat(row[own] - first, n) * span + code) << bits) | np.arange(len(here)))
        value = value[key & ((1 << bits) - 1)]
        key >>= bits
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
        key, score = key[heads], np.add.reduceat(value, heads) if len(key) else value
        keep = score > 0
        if len(seen):
            keep &= seen[np.minimum(np.searchsorted(seen, key), len(seen) - 1)] != key
        key, score = key[keep], score[keep]
        user, steady_score = key // span, np.round(score, DIGITS)
        # Only what reaches a user's k-th score is put in order.
        cuts, hit = np.searchsorted(user, np.arange(many + 1)), np.ones(len(key), bool)
        for u in np.flatnonzero(np.diff(cuts) > k):
            part = steady_score[cuts[u] : cuts[u + 1]]
            hit[cuts[u] : cuts[u + 1]] = part >= np.partition(part, len(part) - k)[len(part) - k]
        key, score, user, steady_score = key[hit], score[hit], user[hit], steady_score[hit]
        order = np.lexsort((key, -steady_score, user))
        place = np.arange(len(order)) - np.searchsorted(user, user)
        best = order[place < k]
        named = key[best] % span
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[user[best] + first]), pa.array(named + lowest if items is None else items[named]), pa.array(score[best]), pa.array((place[place < k] + 1).astype(np.int32))],
            names=["user_id", "item_id", "score", "rank"],
        )
        first = last


def linked_means(users: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, vector): mean `vector` over the items a user names in `terms`, repeats counted, in doubles.

    A block of users gets the vector of each item it names once, so vectors are never multiplied by the users naming them.
    Items without a vector do not count; a user with none gets no row. `users` is read several times.
    """
    partitions = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.coalesce(users.agg(F.ceil(F.count("*") / F.lit(MEANS_BLOCK))).scalar(), F.lit(1))
    named = users.withColumn("_ub", F.pmod(F.xxhash64("user_id"), F.greatest(size, F.lit(partitions))).cast("int"))
    wanted = named.select("_ub", F.explode("terms").alias("item_id")).distinct()
    kind = items.schema["vector"].dataType

    def part(df: DataFrame, kind_no: int, key: str, terms: Column, vector: Column) -> DataFrame:
        return df.select("_ub", F.lit(kind_no).alias("_kind"), F.col(key).cast("long").alias("_a"), terms.cast("array<long>").alias("terms"), vector.cast(kind).alias("vector"))

    known = items.select("item_id", "vector").filter("vector IS NOT NULL")
    parts = part(named, USER, "user_id", F.col("terms"), F.lit(None)).unionByName(part(wanted.join(known, "item_id"), ITEM, "item_id", F.lit(None), F.col("vector")))
    sorted_parts = parts.repartition("_ub").sortWithinPartitions("_ub", "_kind", "_a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in block_runs(batches, ("_ub",)):
            people_rows = int(np.searchsorted(table.column("_kind").to_numpy(), ITEM))
            if 0 < people_rows < table.num_rows:
                yield from block_means(table.slice(0, people_rows), table.slice(people_rows))

    return sorted_parts.mapInArrow(run, T.StructType([T.StructField("user_id", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def block_means(people: pa.Table, links: pa.Table) -> Iterator[pa.RecordBatch]:
    """The mean vectors of one block of users; at most MEANS_ENTRIES vectors, or one user's, are gathered at a time."""
    ids, sources = people.column("_a").combine_chunks(), links.column("_a").to_numpy()
    vectors = links.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(sources), -1)
    terms = people.column("terms").combine_chunks()
    row, wanted = np.repeat(np.arange(len(ids)), pc.list_value_length(terms).to_numpy()), terms.flatten().to_numpy()
    # An item with several vectors counts with each.
    at, until = np.searchsorted(sources, wanted), np.searchsorted(sources, wanted, side="right")
    times = until - at
    row, at = np.repeat(row, times), np.repeat(at - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    edges = np.searchsorted(row, np.arange(len(ids) + 1))
    first = 0
    while first < len(ids):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + MEANS_ENTRIES, side="right")) - 1)
        n = np.diff(edges[first : last + 1])
        found = first + np.flatnonzero(n)
        if len(found):
            gathered = vectors[at[edges[first] : edges[last]]].astype(np.float64)
            means = np.add.reduceat(gathered, edges[found] - edges[first], axis=0) / n[n > 0][:, None]
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * means.shape[1])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(found)), pa.ListArray.from_arrays(offsets, pa.array(means.ravel()))], names=["user_id", "vector"])
        first = last


def dense_topk(
    users: DataFrame,
    items: DataFrame,
    seen: DataFrame,
    k: int,
    user_block: int = USER_BLOCK,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """(user_id, item_id, score, rank): best `k` unseen items by dot product of `vector`, ties by item.

    Users and items with a NULL vector get no rows.
    """
    known = lambda df, key: df.select(key, "vector").filter("vector IS NOT NULL")
    found = streamed(known(users, "user_id"), known(items, "item_id"), seen, k, dense_scores, user_block, item_block)
    return top_n(found, ["user_id"], [F.desc(steady("score", DIGITS)), F.asc("item_id")], k)


def sparse_products(users: DataFrame, items: DataFrame, user_block: int = 512, item_block: int = 1024) -> DataFrame:
    """(user_id, item_id, score): every positive dot product of (terms, weights) arrays."""
    return streamed(users, items, None, None, sparse_scores, user_block, item_block, user_block)
