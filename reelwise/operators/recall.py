"""Candidate retrieval from behaviour: popularity, item-to-item CF, category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwise.functions.columns import as_date, steady
from reelwise.functions.ordering import top_n
from reelwise.operators.ranked import (
    first_unseen,
    interleave_cold,
    list_quotas,
    only_allowed,
    positive_tail,
    rank_lists,
    seen_words,
    unseen_gaps,
    unset_ranks,
)
from reelwise.operators.tiles import linked_topk
from reelwise.session import cut_lineage

POSITION_DECAY = 0.9  # fixed value: weight of each older history position
MUCH_HELD = 100_000  # tails holding an item that one task takes; an item in more is summed in parts first


def popular_scores(
    log: DataFrame, decay: bool = False, half_life_days: float = 7, window_days: int | None = None
) -> DataFrame:
    """Item score: sum of 1 + complete + strong - short / 2.

    `window_days` keeps the last days, both ends included; `decay` multiplies by
    exp(-age / half_life_days), an e-folding time despite its name.
    """
    day = as_date(F.col("date"))
    if window_days is not None or decay:
        # The scalar is read once; item-day partial sums keep the shuffle at one row per item and day.
        last = log.agg(as_date(F.max("date"))).scalar()
        log = log.withColumn("_age", F.datediff(last, day))
        if window_days is not None:
            log = log.filter(F.col("_age") <= window_days - 1)
    weight = 1 + F.col("label_complete") + F.col("label_strong") - F.lit(0.5) * F.col("label_short")
    if decay:
        weight = weight * F.exp(-F.col("_age") / F.lit(float(half_life_days)))
    return log.groupBy("item_id").agg(F.sum(weight).alias("score"))


def popularity(log: DataFrame) -> DataFrame:
    return log.groupBy("item_id").agg(F.count("*").alias("cnt"))


def recommend_ranked(
    scores: DataFrame, users: DataFrame, seen: DataFrame, k: int, allowed: DataFrame | None = None
) -> DataFrame:
    """First `k` items of one global ranking that each user has not seen; `seen` may repeat pairs."""
    ordered = only_allowed(scores, allowed).select("item_id", (-steady("score")).alias("_order"))
    # A few numbers per item; ranking counts and sorts them.
    lists = cut_lineage(rank_lists(cut_lineage(ordered), [], ["_order", "item_id"], settle=False).select("item_id", "list_rank"))
    return unset_ranks(seen_words(lists, seen, users), users, lists.count(), k).join(lists, "list_rank").select(
        "user_id", "item_id", F.col("p").cast("int").alias("rank")
    )


def cf_history(log: DataFrame, history_length: int = 50, feedback: str = "complete") -> DataFrame:
    """History tail with the user-item weight: 1, or max(1 + strong - short / 2) over all positives.

    Written once, since similarity, counts and recommendation all read it.
    """
    history = positive_tail(log, history_length).select("user_id", "item_id", "pos")
    if feedback == "complete":
        return cut_lineage(history.withColumn("weight", F.lit(1.0)))
    if feedback != "multi_feedback":
        raise ValueError(f"unknown feedback: {feedback}")
    weights = (
        log.filter(F.col("label_complete") == 1)
        .groupBy("user_id", "item_id")
        .agg(F.max(1.0 + F.col("label_strong") - F.lit(0.5) * F.col("label_short")).alias("weight"))
    )
    return cut_lineage(history.join(weights, ["user_id", "item_id"]))


def cf_counts(history: DataFrame) -> DataFrame:
    """Number of users holding each item in their tail."""
    return history.select("user_id", "item_id").distinct().groupBy("item_id").agg(F.count("*").alias("cnt"))


def itemcf_similarity(history: DataFrame, neighbors: int = 200, iuf: bool = True) -> DataFrame:
    """Top neighbours (item_id, other_id, sim, rn) from co-occurrence in user tails.

    A user's tail has at most `history_length` distinct items, the operator's own parameter, so the
    pairs per user are bounded. Counts join the tails, not the pairs, and a tail goes as a whole, with its two arrays, to
    each of its items: pairs arise where they are summed and ranked, and are never shuffled. An item in more
    than MUCH_HELD tails is summed in parts, whose sums per pair meet in a second round.
    """
    counts = cf_counts(history)
    tails = (
        history.groupBy("user_id", "item_id")
        .agg(F.max("weight").alias("weight"))
        .join(counts, "item_id", "left")
        .groupBy("user_id")
        .agg(F.collect_list(F.struct("item_id", "weight", "cnt")).alias("items"))
    )
    tails = cut_lineage(tails)  # so that what was shuffled for them goes before they are sent
    user_weight = 1 / F.log1p(F.size("items") + 1) if iuf else F.lit(1.0)
    share = F.transform("items", lambda x: F.sqrt(x["weight"] / x["cnt"]))
    sent = tails.select(
        user_weight.alias("_u"),
        F.pmod(F.xxhash64("user_id"), F.lit(1 << 30)).alias("_hash"),
        F.transform("items", lambda x: x["item_id"]).alias("ids"),
        share.alias("shares"),
        F.explode("items").alias("a"),
    ).select(
        F.col("a.item_id").alias("item_id"),
        F.ceil(F.col("a.cnt") / F.lit(MUCH_HELD)).alias("_parts"),
        "_hash",
        (F.col("_u") * F.sqrt(F.col("a.weight") / F.col("a.cnt"))).alias("_pull"),
        "ids",
        "shares",
    ).filter("item_id IS NOT NULL")

    def sums(part: DataFrame, keys: list[str]) -> DataFrame:
        pairs = part.select(*keys, "_pull", "shares", F.posexplode("ids").alias("_at", "other_id")).filter("other_id <> item_id")
        return pairs.groupBy(*keys, "other_id").agg(F.sum(F.col("_pull") * F.col("shares")[F.col("_at")]).alias("sim"))

    nearest = lambda df: top_n(df, ["item_id"], [F.desc(steady("sim")), F.asc("other_id")], neighbors, "rn")
    few = sent.filter("_parts = 1").select("item_id", "_pull", "ids", "shares").repartition("item_id")
    many = sent.filter("_parts > 1").withColumn("_part", F.pmod(F.col("_hash"), F.col("_parts"))).repartition("item_id", "_part")
    rest = sums(many, ["item_id", "_part"]).groupBy("item_id", "other_id").agg(F.sum("sim").alias("sim"))
    return nearest(sums(few, ["item_id"])).unionByName(nearest(rest))


def itemcf_recommend(
    similarity: DataFrame,
    history: DataFrame,
    users: DataFrame,
    seen: DataFrame,
    k: int,
    decay: bool = True,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """Score = sum over the tail, newest first, of 0.9^pos * sim * weight; short lists are topped up
    by the items most users hold."""
    tail = history.join(users.select("user_id"), "user_id", "left_semi")
    fade = F.pow(F.lit(POSITION_DECAY), F.col("pos")) if decay else F.lit(1.0)
    # Collapse repeats first: one weight per (user, history item) before meeting the neighbours.
    pull = tail.groupBy("user_id", "item_id").agg(F.sum(fade * F.col("weight")).alias("_pull"))
    # Every block of users gets its tails and, once each, the neighbour lists of the items in them.
    tails = pull.filter("item_id IS NOT NULL").groupBy("user_id").agg(F.collect_list("item_id").alias("terms"), F.collect_list("_pull").alias("weights"))
    led_to = only_allowed(similarity.select(F.col("other_id").alias("item_id"), F.col("item_id").alias("_from"), "sim"), allowed)
    lists = led_to.groupBy("_from").agg(F.collect_list("item_id").alias("terms"), F.collect_list("sim").alias("weights")).withColumnRenamed("_from", "item_id")
    best = linked_topk(tails, lists, seen, k)

    counts = only_allowed(cf_counts(history), allowed)
    lists = rank_lists(
        counts.select("item_id", F.lit(0).alias("list_id"), (-F.col("cnt")).alias("_order")),
        [],
        ["_order", "item_id"],
    )
    found = best.groupBy("user_id").agg(F.count("*").alias("_found"))
    demand = (
        users.select("user_id")
        .join(found, "user_id", "left")
        .select(
            "user_id",
            F.lit(0).alias("list_id"),
            (F.lit(k) - F.coalesce("_found", F.lit(0))).alias("want"),
            F.coalesce("_found", F.lit(0)).alias("_found"),
        )
        .filter(F.col("want") > 0)
    )
    demand = cut_lineage(demand)  # mostly few: its size decides whether the pairs below are shuffled
    short = demand.select("user_id")
    blocked = (
        seen.union(best.select("user_id", "item_id")).join(short, "user_id", "left_semi")
    )
    filler = first_unseen(
        lists, demand, unseen_gaps(lists, blocked, "list_id"), "list_id", extra=["_found"]
    ).select(
        "user_id",
        "item_id",
        F.lit(None).cast("double").alias("score"),
        (F.col("_found") + F.col("p")).cast("int").alias("rank"),
    )
    return best.select("user_id", "item_id", "score", "rank").unionByName(filler)


def category_recall(
    log: DataFrame,
    items: DataFrame,
    users: DataFrame,
    seen: DataFrame,
    k: int,
    history_length: int = 50,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """Items of the user's categories, most watched first; unseen-by-anyone items included.

    Known and cold items are walked apart (category by user count, item by popularity), each to its own quota of the
    interleaved list, so a cold item is found however many known ones come before it. The sizes of the lists tell how
    many items each must supply: at most k rows per user exist at any point. An item with several rows counts in its
    smallest category.
    """
    catalog = items.groupBy("item_id").agg(F.min("first_category").alias("first_category"))
    eligible = only_allowed(catalog, allowed)
    tail = positive_tail(log, history_length).join(users.select("user_id"), "user_id", "left_semi")
    tastes = (
        tail.join(catalog, "item_id", "left")
        .groupBy("user_id", F.coalesce("first_category", F.lit(-1)).alias("first_category"))
        .agg(F.count("*").alias("n"))
    )
    by_taste = W.partitionBy("user_id").orderBy(F.desc("n"), F.asc("first_category"))
    tastes = tastes.withColumn("cat_rank", F.row_number().over(by_taste))

    is_known = F.col("cnt").isNotNull()
    lists = rank_lists(
        eligible.join(popularity(log), "item_id", "left").select(
            F.coalesce("first_category", F.lit(-1)).alias("first_category"),
            "item_id",
            (-F.coalesce("cnt", F.lit(0))).alias("_order"),
            is_known.alias("is_known"),
            # one list per category and kind
            (2 * F.coalesce("first_category", F.lit(-1)).cast("long") + is_known.cast("long")).alias("list_id"),
        ),
        ["list_id"],
        ["_order", "item_id"],
    )
    sizes = lists.groupBy("list_id", "first_category", "is_known").agg(F.count("*").alias("_size"))
    asked = seen.join(users.select("user_id"), "user_id", "left_semi")
    # Counted for the demand and walked for the answer: the joins and totals behind it run once.
    gaps = cut_lineage(unseen_gaps(lists, asked, "list_id").select("user_id", "list_id", "gap"))
    keys = ["user_id", "list_id"]
    taken = gaps.groupBy(*keys).agg(F.count("*").alias("_seen"))
    earlier = W.partitionBy("user_id", "is_known").orderBy("cat_rank").rowsBetween(W.unboundedPreceding, -1)
    known_quota, cold_quota = list_quotas(k)
    quota = F.when(F.col("is_known"), known_quota).otherwise(cold_quota)
    demand = (
        tastes.join(sizes, "first_category")
        .join(taken, keys, "left")
        .withColumn("_free", F.col("_size") - F.coalesce("_seen", F.lit(0)))
        .withColumn("_before", F.coalesce(F.sum("_free").over(earlier), F.lit(0)))
        .withColumn("want", F.least(F.col("_free"), quota - F.col("_before")))
        .filter(F.col("want") > 0)
        .select(*keys, "want", "cat_rank")
    )
    found = first_unseen(lists, demand, gaps, "list_id", extra=["cat_rank", "is_known"])
    return interleave_cold(found, k, [F.asc("cat_rank"), F.asc("p")]).select(
        "user_id", "item_id", "rank", "is_known"
    )
