"""Seeded, hash-keyed splits, samples and negative draws.

Every draw is a function of the seed and the row's own keys, so reruns, retries and other cluster
sizes select the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwise.functions.columns import hash32, unit_hash
from reelwise.functions.ordering import ordinal, smallest, top_n
from reelwise.session import cut_lineage


def hash_split(
    users: DataFrame,
    seed: int = 2026,
    fraction: float = 0.5,
    names: tuple[str, str] = ("full_val", "full_test"),
) -> DataFrame:
    """Stable user split: the first 64 bits of SHA-256("seed:user") against `fraction`.

    A user's side depends on nothing else, except that an empty side takes the nearest user. Fewer
    than two users raise.
    """
    limit = int(fraction * 2**64)
    threshold = "g" if limit >= 2**64 else f"{limit:016x}"  # "g" sorts after every hex digit
    key = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("user_id").cast("string")), 256), 1, 16)
    scored = users.select("user_id").distinct().withColumn("_key", key)
    summary = scored.agg(
        F.struct(
            F.count("*").alias("n"),
            F.count_if(F.col("_key") < threshold).alias("below"),
            F.min(F.struct("_key", "user_id")).alias("lowest"),
            F.max(F.struct("_key", "user_id")).alias("highest"),
        ).alias("s")
    )
    facts = F.col("_s")
    first = (
        F.when(facts["n"] < 2, F.raise_error("at least two users are needed for a split"))
        .when(facts["below"] == 0, F.col("user_id") == facts["lowest"]["user_id"])
        .when(facts["below"] == facts["n"], F.col("user_id") != facts["highest"]["user_id"])
        .otherwise(F.col("_key") < threshold)
    )
    return scored.withColumn("_s", summary.scalar()).select(
        "user_id", F.when(first, names[0]).otherwise(names[1]).alias("panel")
    )


def profile_users(
    users: DataFrame, panel_users: DataFrame, max_users: int, fraction: float, seed: int
) -> DataFrame:
    """Up to `max_users`: a fraction (at least 2) from the dense panel, the rest from the others."""
    panel = panel_users.select("user_id").distinct().withColumn("_h", hash32(seed, "user_id"))
    others = (
        users.select("user_id")
        .distinct()
        .join(panel, "user_id", "left_anti")
        .withColumn("_h", hash32(seed, "user_id"))
    )
    wanted = min(max_users, max(2, round(max_users * fraction)))
    taken = F.least(panel.agg(F.count("*")).scalar(), F.lit(wanted))
    chosen = smallest(panel, ["_h", "user_id"], taken)
    rest = smallest(others, ["_h", "user_id"], F.lit(max_users) - taken)
    return chosen.select("user_id").union(rest.select("user_id"))


def cap_rows(df: DataFrame, n: int, seed: int, id_cols: list[str]) -> DataFrame:
    """`n` uniformly chosen rows (all, when there are no more); `id_cols` identify a row."""
    keyed = df.withColumn("_h", hash32(seed, *id_cols))
    return smallest(keyed, ["_h", *id_cols], F.lit(n)).drop("_h")


def cap_users(users: DataFrame, n: int, seed: int) -> DataFrame:
    """Evaluation users fixed by a data seed, independent of any model seed."""
    return cap_rows(users.select("user_id").distinct(), n, seed, ["user_id"])


def cap_complete_users(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Whole histories of int(users * n / rows) users, at least one; everything when rows <= n."""
    sizes = df.agg(F.struct(F.count("*").alias("rows"), F.countDistinct("user_id").alias("users")).alias("s"))
    keep = F.when(F.col("_s.rows") <= n, F.col("_s.users")).otherwise(
        F.greatest(F.lit(1), F.floor(F.col("_s.users") * F.lit(n) / F.col("_s.rows")))
    )
    ranked = ordinal(
        df.select("user_id").distinct().withColumn("_h", hash32(seed, "user_id")), ["_h", "user_id"], "_ord"
    )
    chosen = ranked.withColumn("_s", sizes.scalar()).filter(F.col("_ord") <= keep).select("user_id")
    return df.join(chosen, "user_id", "left_semi")


def cap_negatives(candidates: DataFrame, cap: int, seed: int, keys: list[str] | None = None) -> DataFrame:
    """All positives of a group plus max(0, cap - positives) uniformly chosen negatives."""
    keys = keys or ["user_id", "date"]
    counts = candidates.groupBy(*keys).agg(F.sum(F.col("label").cast("long")).alias("_pos"))
    drawn = top_n(
        candidates.filter(F.col("label") == 0).withColumn("_h", hash32(seed, *keys, "item_id")),
        keys,
        [F.col("_h"), F.col("item_id")],
        cap,
        "_rn",
    )
    kept = (
        drawn.join(counts, keys)
        .filter(F.col("_rn") <= F.greatest(F.lit(0), F.lit(cap) - F.col("_pos")))
        .drop("_h", "_rn", "_pos")
    )
    return candidates.filter(F.col("label") == 1).unionByName(kept)


def exposure_weight(policy: str) -> Column:
    """Sampling weight of a feedback row; `popularity` is the item's row count, NULL when unknown."""
    if policy == "uniform":
        return F.lit(1.0)
    if policy == "popularity_biased":
        return F.log1p(F.coalesce("popularity", F.lit(0))) + F.lit(1e-3)
    if policy == "positive_biased":
        return F.when(F.col("label_complete") == 1, 5.0).otherwise(1.0)
    raise ValueError(f"unknown exposure policy: {policy}")


def sample_exposure(
    feedback: DataFrame, policy: str, density: float, popularity: DataFrame, seed: int
) -> DataFrame:
    """max(1, round(rows * density)) rows without replacement, weighted by the policy.

    Weighted draw by exponential keys: the rows with the smallest -ln(u)/w. `popularity` has
    (item_id, cnt).
    """
    weight = exposure_weight(policy)
    columns = feedback.columns
    if policy == "popularity_biased":
        feedback = feedback.join(
            popularity.select("item_id", F.col("cnt").alias("popularity")), "item_id", "left"
        )
    key = -F.log(unit_hash(seed, "user_id", "item_id")) / weight
    size = feedback.agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(density)))).scalar()
    keyed = feedback.withColumn("_key", key)
    return smallest(keyed, ["_key", "user_id", "item_id"], size).select(*columns)


def _indexed(known: DataFrame) -> DataFrame:
    """Known items with 0-based positions, overall and within their category, and both sizes."""
    known = cut_lineage(
        known.select("item_id", F.coalesce("first_category", F.lit(-1)).alias("first_category"))
    )
    sizes = known.groupBy("first_category").agg(F.count("*").alias("cat_size"))
    inside = ordinal(known, ["item_id"], "cat_pos", ["first_category"], settle=False)
    overall = ordinal(known, ["item_id"], "pos", settle=False).select("item_id", "pos")
    return cut_lineage(
        inside.join(overall, "item_id")
        .join(sizes, "first_category")
        .withColumns(
            {
                "pos": F.col("pos") - 1,
                "cat_pos": F.col("cat_pos") - 1,
                "size": known.agg(F.count("*")).scalar(),
            }
        )
    )


def draw_negatives(
    positives: DataFrame, known: DataFrame, seed: int, hard_ratio: float = 1.0
) -> DataFrame:
    """One negative per positive (user_id, item_id): with probability `hard_ratio` another known item
    of the same category, else a uniform known item.

    A hard negative never equals its positive while at least two known items exist; a category with a
    single known item falls back to all known items.
    """
    index = _indexed(known)
    base = positives.join(index, "item_id").withColumns(
        {
            "_hard": unit_hash(seed, F.lit("mix"), "user_id", "item_id") < F.lit(hard_ratio),
            "_draw": hash32(seed, F.lit("neg"), "user_id", "item_id"),
        }
    )

    def other(pos: str, size: str) -> Column:
        step = F.pmod(F.col("_draw"), F.greatest(F.col(size) - 1, F.lit(1)))
        return F.pmod(F.col(pos) + 1 + step, F.col(size))

    in_category = F.col("_hard") & (F.col("cat_size") > 1)
    base = base.withColumns(
        {
            "_in_cat": in_category,
            "_at": F.when(in_category, other("cat_pos", "cat_size"))
            .when(F.col("_hard"), other("pos", "size"))
            .otherwise(F.pmod("_draw", "size")),
        }
    )
    by_category = index.select(
        "first_category", F.col("cat_pos").alias("_at"), F.col("item_id").alias("negative_id")
    )
    overall = index.select(F.col("pos").alias("_at"), F.col("item_id").alias("negative_id"))
    out = ["user_id", "item_id", "negative_id", F.col("_hard").cast("int").alias("is_hard")]
    near = base.filter("_in_cat").join(by_category, ["first_category", "_at"]).select(*out)
    far = base.filter("not _in_cat").join(overall, "_at").select(*out)
    return near.unionByName(far)


def pairwise_samples(
    candidates: DataFrame,
    n_neg: int,
    seed: int,
    keys: list[str] | None = None,
    channel_scores: tuple[str, ...] = ("itemcf_rank_score", "content_rank_score", "tower_rank_score"),
) -> DataFrame:
    """Training pairs (keys, positive_id, negative_id, draw) within each group.

    Per positive: max(1, n_neg // 2) distinct negatives from the group's strongest
    `hard * positives` by best channel score, the rest uniform (distinct while enough negatives
    exist). Groups lacking either class yield nothing. Both kinds walk the pool in the order of a hash from a hashed
    start: draws of one positive are no neighbours in score order, and only n_neg rows per positive are produced.
    """
    keys = keys or ["user_id", "date"]
    hard = max(1, n_neg // 2)
    labelled = candidates.withColumn("_best", F.greatest(*channel_scores))
    counts = labelled.groupBy(*keys).agg(
        F.count_if(F.col("label_complete") == 1).alias("_p"),
        F.count_if(F.col("label_complete") == 0).alias("_n"),
    )
    counts = counts.filter((F.col("_p") > 0) & (F.col("_n") > 0))
    pool = F.least(F.col("_n"), F.lit(hard) * F.col("_p"))
    scored = ordinal(
        labelled.filter(F.col("label_complete") == 0).select(
            *keys, "item_id", (-F.col("_best")).alias("_weak"), hash32(seed, F.lit("mix"), *keys, "item_id").alias("_mix")
        ),
        ["_weak", "item_id"],
        "_ord",
        keys,
    ).join(counts.select(*keys, pool.alias("_pool")), keys)
    kinds = scored.withColumn("_kind", F.explode(F.when(F.col("_ord") <= F.col("_pool"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    negatives = ordinal(kinds.select(*keys, "_kind", "_mix", "item_id"), ["_mix", "item_id"], "_ord", [*keys, "_kind"]).select(
        *keys, "_kind", F.col("item_id").alias("negative_id"), (F.col("_ord") - 1).alias("_at")
    )
    picked = F.least(pool, F.lit(hard))
    step = F.when(
        F.col("draw") < picked,
        F.pmod(hash32(seed, F.lit("hard"), *keys, "item_id") + F.col("draw"), pool),
    ).otherwise(F.pmod(hash32(seed, F.lit("any"), *keys, "item_id") + F.col("draw"), F.col("_n")))
    draws = (
        labelled.filter(F.col("label_complete") == 1)
        .select(*keys, "item_id")
        .join(counts, keys)
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_neg - 1))))
        .withColumns({"_at": step, "_kind": F.when(F.col("draw") < picked, 0).otherwise(1)})
    )
    return draws.join(negatives, [*keys, "_kind", "_at"]).select(
        *keys, F.col("item_id").alias("positive_id"), "negative_id", "draw"
    )


def listwise_targets(candidates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of the groups with a positive, with the label divided by the group's label sum."""
    keys = keys or ["user_id", "date"]
    totals = (
        candidates.groupBy(*keys)
        .agg(F.sum("label_complete").alias("_sum"), F.count("*").alias("group_size"))
        .filter(F.col("_sum") > 0)
    )
    return (
        candidates.join(totals, keys)
        .withColumn("target", F.col("label_complete") / F.col("_sum"))
        .drop("_sum")
    )
