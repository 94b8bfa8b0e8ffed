"""Ranked lists: history tails, per-list first unseen items, cold/known interleave, quota fusion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelwise.functions.ordering import GROUP_LIMIT, running_totals, top_n
from reelwise.session import cut_lineage

COLD_EVERY = 5  # fixed value: one slot in five is reserved for unseen items


def positive_tail(log: DataFrame, length: int, *extra: str) -> DataFrame:
    """Latest `length` complete plays per user with `pos` 0 = newest; repeats of an item stay."""
    positive = log.filter(F.col("label_complete") == 1).select(
        "user_id", "item_id", "timestamp", "event_id", *extra
    )
    newest = [F.desc("timestamp"), F.desc("event_id")]
    return top_n(positive, ["user_id"], newest, length, "pos").withColumn("pos", F.col("pos") - 1)


def seen_pairs(log: DataFrame, splits: Sequence[str] = ("train",)) -> DataFrame:
    return log.filter(F.col("split").isin(*splits)).select("user_id", "item_id").distinct()


def training_log(log: DataFrame, train_through: str = "train", panel: str = "full_val") -> DataFrame:
    """History up to `train_through`; `valid` is allowed for frozen test panels only."""
    if train_through not in ("train", "valid"):
        raise ValueError(f"unknown train_through: {train_through}")
    if train_through == "valid" and panel not in ("test", "full_test"):
        raise ValueError("train_through=valid needs a frozen test panel")
    splits = ["train", "valid"] if train_through == "valid" else ["train"]
    return log.filter(F.col("split").isin(*splits))


def retrieval_depth(k: int, dense_panel: bool) -> int:
    return max(5 * k, 500) if dense_panel else 5 * k


def only_allowed(df: DataFrame, allowed: DataFrame | None) -> DataFrame:
    return df if allowed is None else df.join(allowed.select("item_id"), "item_id", "left_semi")


def rank_lists(scored: DataFrame, keys: list[str], order: list[str], settle: bool = True) -> DataFrame:
    """Position `list_rank` of each item in its list, by ascending `order` columns."""
    return running_totals(scored, keys, order, {"list_rank": F.lit(1).cast("long")}, settle=settle)


def unseen_gaps(lists: DataFrame, seen: DataFrame, list_key: str) -> DataFrame:
    """Per seen item: `gap`, the number of unseen items ranked above it in its list."""
    placed = seen.join(lists.select(list_key, "item_id", "list_rank"), "item_id")
    # Ranks are dense integers, so rank blocks give evenly filled buckets of at most GROUP_LIMIT rows.
    block = F.floor((F.col("list_rank") - 1) / F.lit(GROUP_LIMIT))
    counted = running_totals(
        placed.select("user_id", list_key, "list_rank"),
        ["user_id", list_key],
        ["list_rank"],
        {"seen_above": F.lit(1).cast("long")},
        bucket=block,
    )
    return counted.withColumn("gap", F.col("list_rank") - F.col("seen_above"))


def first_unseen(
    lists: DataFrame, demand: DataFrame, gaps: DataFrame, list_key: str, extra: Sequence[str] = ()
) -> DataFrame:
    """The first `want` unseen items of each demanded list, with `p` = 1, 2, ...

    `lists` (list_key, item_id, list_rank), `demand` (user_id, list_key, want), `gaps` from
    unseen_gaps; `extra` columns come from either of the first two. The p-th unseen item has rank p plus the number of seen items with gap < p, so the
    answer costs `want` rows per user and list however long the list or the history is.
    """
    keys = ["user_id", list_key]
    carried = [name for name in extra if name in lists.columns]
    ahead = (
        gaps.join(demand.select(*keys, "want"), keys)
        .filter(F.col("gap") < F.col("want"))
        .groupBy(*keys, (F.col("gap") + 1).alias("p"))
        .agg(F.count("*").alias("_skipped"))
    )
    slots = demand.filter(F.col("want") > 0).withColumn(
        "p", F.explode(F.sequence(F.lit(1).cast("long"), F.col("want").cast("long")))
    )
    upto = W.partitionBy(*keys).orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    shift = F.sum(F.coalesce("_skipped", F.lit(0))).over(upto)
    return (
        slots.join(ahead, [*keys, "p"], "left")
        .withColumn("list_rank", F.col("p") + shift)
        .join(lists.select(list_key, "item_id", "list_rank", *carried), [list_key, "list_rank"])
        .select("user_id", list_key, "item_id", "p", *extra)
    )


WORD = 64  # ranks per bitmap word


def seen_words(lists: DataFrame, seen: DataFrame, users: DataFrame) -> DataFrame:
    """Bitmaps (user_id, word, bits) of the list ranks each user has seen; bit i of a word is rank 64 * word + i + 1.

    The words are sums of bits, so repeated pairs and hot users shrink before the shuffle.
    """
    placed = seen.select("user_id", "item_id").join(users.select("user_id"), "user_id", "left_semi").join(lists, "item_id")
    at = F.col("list_rank") - 1
    bit = F.expr(f"shiftleft(1L, CAST((list_rank - 1) % {WORD} AS INT))")
    return placed.groupBy("user_id", F.floor(at / F.lit(WORD)).cast("long").alias("word")).agg(F.bit_or(bit).alias("bits"))


def unset_ranks(words: DataFrame, users: DataFrame, total: int, k: int) -> DataFrame:
    """(user_id, p, list_rank): the first `k` ranks up to `total` whose bit is not set, numbered p = 1, 2, ...

    With n seen ranks the answer lies within the first k + n ranks, so a user costs (k + n) / 64 words.
    """
    if total <= 0 or k <= 0:
        return users.select("user_id", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("list_rank")).limit(0)
    taken = words.groupBy("user_id").agg(F.sum(F.bit_count("bits")).alias("n"))
    last = F.least((F.lit(k - 1) + F.coalesce("n", F.lit(0))) / F.lit(WORD), F.lit((total - 1) // WORD).cast("double"))
    asked = users.select("user_id").join(taken, "user_id", "left").select(
        "user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last).cast("long"))).alias("word")
    )
    before = W.partitionBy("user_id").orderBy("word").rowsBetween(W.unboundedPreceding, -1)
    held = asked.join(words, ["user_id", "word"], "left").withColumn("bits", F.coalesce("bits", F.lit(0).cast("long")))
    free = held.withColumn("free", F.col("word") * WORD - F.coalesce(F.sum(F.bit_count("bits")).over(before), F.lit(0)))
    unset = F.expr(f"filter(sequence(0, {WORD - 1}), i -> shiftright(bits, i) & 1L = 0 AND word * {WORD} + i < {total})")
    ranks = free.filter(F.col("free") < k).select("user_id", "word", "free", F.posexplode(F.slice(unset, F.lit(1), F.lit(k) - F.col("free"))).alias("at", "i"))
    return ranks.select("user_id", (F.col("free") + F.col("at") + 1).alias("p"), (F.col("word") * WORD + F.col("i") + 1).alias("list_rank"))


def list_quotas(k: int) -> tuple[int, int]:
    """(known, cold) slots of an interleaved list."""
    cold = max(1, k // COLD_EVERY)
    return k - cold, cold


def interleave_cold(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """Merge a user's known and cold items into at most `k` ranks.

    `df` has user_id, item_id, is_known. Quotas: max(1, k // 5) cold, the rest known. Every fifth slot
    goes to a cold item while both kinds last; the closed form below gives the slot directly.
    """
    known_quota, cold_quota = list_quotas(k)
    kept = top_n(df, ["user_id", "is_known"], order, k, "_i").filter(
        F.col("_i") <= F.when(F.col("is_known"), F.lit(known_quota)).otherwise(F.lit(cold_quota))
    )
    user = W.partitionBy("user_id")
    sized = kept.withColumns(
        {
            "_i": F.col("_i") - 1,
            "_cold": F.count_if(~F.col("is_known")).over(user),
            "_known": F.count_if(F.col("is_known")).over(user),
        }
    )
    slot = F.when(
        F.col("is_known"),
        F.col("_i") + F.least(F.col("_cold"), F.floor(F.col("_i") / (COLD_EVERY - 1)) + 1),
    ).otherwise(F.least(F.lit(COLD_EVERY) * F.col("_i"), F.col("_known") + F.col("_i")))
    return sized.withColumn("rank", (slot + 1).cast("int")).drop("_i", "_cold", "_known")


def _normalised(weights: dict[str, float]) -> list[float]:
    values = list(weights.values())
    if any(value < 0 for value in values) or sum(values) <= 0:
        raise ValueError("weights must be non-negative with a positive sum")
    return [value / sum(values) for value in values]


def quota_schedule(shares: Sequence[float], k: int) -> list[tuple[int, int]]:
    """(channel, position) of slots 1 to `k` while no list ends: the largest share * slot - taken, first channel on ties."""
    taken, out = [0] * len(shares), []
    for slot in range(1, k + 1):
        claims = [share * slot - n for share, n in zip(shares, taken)]
        best = claims.index(max(claims))
        taken[best] += 1
        out.append((best, taken[best]))
    return out


def quota_fuse(ranked: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """Merge the channels of `ranked` (user_id, item_id, rank, channel) by smooth weighted quotas.

    Each slot goes to the non-exhausted channel with the largest weight * slot - taken (first channel
    on ties); items already taken are skipped. A channel can give up at most `k` distinct items before
    the list is full, so only its first `k` distinct items are gathered.

    While no list ends, the channel of each slot follows from the weights alone. This schedule is computed once and
    joined to the list positions; it is the answer of every user whose scheduled items exist and differ. Only the other
    users are walked slot by slot, many users at a time.
    """
    shares = _normalised(weights)
    channels = list(weights)
    spark = ranked.sparkSession
    if k <= 0:
        return ranked.select("user_id", "item_id", F.lit(0).alias("rank")).limit(0)
    number = F.element_at(F.create_map(*[F.lit(x) for i, name in enumerate(channels) for x in (name, i)]), F.col("channel"))
    distinct = (
        ranked.filter(F.col("channel").isin(*channels))
        .groupBy("user_id", number.alias("ch"), "item_id")
        .agg(F.min("rank").alias("rank"))
    )
    heads = cut_lineage(top_n(distinct, ["user_id", "ch"], [F.asc("rank"), F.asc("item_id")], k, "n").select("user_id", "ch", "n", "item_id"))
    rows = [(c, n, slot) for slot, (c, n) in enumerate(quota_schedule(shares, k), 1)]
    schedule = spark.createDataFrame(rows, "ch int, n int, slot int")  # k rows
    # A user's scheduled items: at most k.
    placed = heads.join(F.broadcast(schedule), ["ch", "n"]).groupBy("user_id").agg(F.collect_list(F.struct("slot", "item_id")).alias("slots"))
    placed = cut_lineage(placed)
    clean = (F.size("slots") == k) & (F.size(F.array_distinct("slots.item_id")) == k)
    fitting = placed.filter(clean).select("user_id", F.inline("slots")).select("user_id", "item_id", F.col("slot").alias("rank"))
    others = heads.join(placed.filter(clean).select("user_id"), "user_id", "left_anti")
    lists = others.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ch", "n", "item_id"))).alias("list"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                user, item, slot = walk_quotas(batch.column("list"), shares, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("user_id").take(pa.array(user)), pa.array(item), pa.array(slot.astype(np.int32))], names=["user_id", "item_id", "rank"]
                )

    walked = lists.mapInArrow(walk, T.StructType([heads.schema["user_id"], T.StructField("item_id", T.LongType()), T.StructField("rank", T.IntegerType())]))
    return fitting.unionByName(walked)


def walk_quotas(lists: pa.Array, shares: Sequence[float], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, slot) of the fused lists. Each row of `lists` holds (ch, n, item_id) sorted; all rows advance together."""
    entries = lists.flatten()
    channel, item = (entries.field(name).to_numpy(zero_copy_only=False) for name in ("ch", "item_id"))
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    width = len(shares)
    end = np.searchsorted(row * width + channel, np.arange(len(lists) * width), side="right").reshape(-1, width)
    at = np.searchsorted(row * width + channel, np.arange(len(lists) * width)).reshape(-1, width)
    # Equal items of a row share a code.
    order = np.lexsort((item, row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (item[order][1:] != item[order][:-1]) | (row[order][1:] != row[order][:-1])
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(fresh) - 1
    taken = np.zeros(int(fresh.sum()) + 1, bool)
    code = np.append(code, len(taken) - 1)  # where a list has ended
    slots, share = np.zeros(at.shape), np.array(shares)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for slot in range(1, k + 1):
        while (stale := (at < end) & taken[code[np.where(at < end, at, -1)]]).any():
            at[stale] += 1
        live = at < end
        rows = np.flatnonzero(live.any(1))
        if not len(rows):
            break
        claims = np.where(live[rows], share * slot - slots[rows], -np.inf)
        best = claims.argmax(1)
        chosen = at[rows, best]
        taken[code[chosen]] = True
        slots[rows, best] += 1
        out.append((rows, item[chosen], np.full(len(rows), slot)))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none)


def to_lists(ranked: DataFrame) -> DataFrame:
    """One row per user with the ordered item array; only used at file sinks."""
    entry = F.struct("rank", "item_id")
    return ranked.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["item_id"]).alias("items")
    )


def from_lists(lists: DataFrame) -> DataFrame:
    return lists.select("user_id", F.posexplode("items").alias("rank", "item_id")).select(
        "user_id", "item_id", (F.col("rank") + 1).alias("rank")
    )
