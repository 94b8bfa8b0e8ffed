"""Offline evaluation: truth, recall family, dense panel, replay, overlap, bootstrap, gates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwise.functions.columns import hash32, steady
from reelwise.functions.ordering import ordinal, top_n

KEYS = ["user_id", "date"]


def eval_cutoffs(primary: int) -> list[int]:
    """10 and the primary cutoff, plus 200 for deep lists so that runs stay comparable."""
    return sorted({10, primary} | ({200} if primary >= 200 else set()))


def ground_truth(
    log: DataFrame,
    split: str,
    label: str = "label_complete",
    keys: Sequence[str] = ("user_id", "date"),
    exclude: DataFrame | None = None,
) -> DataFrame:
    """Distinct positives (keys, item_id) of a split, minus the `exclude` (user_id, item_id) pairs."""
    rows = log.filter((F.col("split") == split) & (F.col(label) == 1)).select(*keys, "item_id").distinct()
    return rows if exclude is None else rows.join(exclude, ["user_id", "item_id"], "left_anti").select(*keys, "item_id")


def available_on_date(ranked: DataFrame, truth: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Each user's list on each of the user's dates, without items first seen later; first `k`.

    Items without a first-seen date are never available.
    """
    dated = ranked.join(
        items.select("item_id", "first_seen_date").filter(F.col("first_seen_date").isNotNull()), "item_id"
    )
    groups = truth.select(*KEYS).distinct()
    open_items = groups.join(dated, "user_id").filter(F.col("first_seen_date") <= F.col("date"))
    return top_n(
        open_items.withColumnRenamed("rank", "_r").drop("first_seen_date"),
        KEYS,
        [F.asc("_r"), F.asc("item_id")],
        k,
    ).drop("_r")


def _gain(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def _ideal(positives: Column, k: int) -> Column:
    """DCG of `positives` hits at the top of a list of `k`."""
    sums, total = [0.0], 0.0
    for place in range(1, k + 1):
        total += 1 / math.log2(place + 1)
        sums.append(total)
    table = F.array(*[F.lit(value) for value in sums])
    return F.element_at(table, (F.least(positives, F.lit(k)) + 1).cast("int"))


def recall_by_group(
    ranked: DataFrame, truth: DataFrame, ks: Sequence[int] | int, keys: Sequence[str] = ("user_id", "date")
) -> DataFrame:
    """Recall, NDCG and hit rate of every truth group; a group without a list scores 0."""
    ks = [ks] if isinstance(ks, int) else sorted(set(ks))
    joined = truth.join(ranked.select(*keys, "item_id", "rank"), [*keys, "item_id"], "left")
    hit = {k: F.col("rank") <= k for k in ks}
    sums = joined.groupBy(*keys).agg(
        F.count("*").alias("_pos"),
        *[F.count_if(hit[k]).alias(f"_hit_{k}") for k in ks],
        *[
            F.sum(F.when(hit[k], _gain(F.col("rank"))).otherwise(0.0)).alias(f"_dcg_{k}")
            for k in ks
        ],
    )
    out = []
    for k in ks:
        out += [
            (F.col(f"_hit_{k}") / F.col("_pos")).alias(f"recall_at_{k}"),
            (F.col(f"_dcg_{k}") / _ideal(F.col("_pos"), k)).alias(f"ndcg_at_{k}"),
            (F.col(f"_hit_{k}") > 0).cast("double").alias(f"hit_rate_at_{k}"),
        ]
    return sums.select(*keys, *out)


def recall_metrics(
    ranked: DataFrame,
    truth: DataFrame,
    popularity: DataFrame | None,
    catalog_size: Column,
    ks: Sequence[int] | int,
    keys: Sequence[str] = ("user_id", "date"),
) -> DataFrame:
    """One row: mean recall, hit rate and NDCG over truth groups, coverage, popularity of shown slots."""
    ks = [ks] if isinstance(ks, int) else sorted(set(ks))
    groups = recall_by_group(ranked, truth, ks, keys)
    names = [f"{m}_at_{k}" for k in ks for m in ("recall", "hit_rate", "ndcg")]
    means = groups.agg(
        *[F.coalesce(F.avg(name), F.lit(0.0)).alias(name) for name in names],
        F.countDistinct("user_id").alias("evaluated_users"),
        F.count("*").alias("evaluated_groups"),
    )
    shown = ranked.filter(F.col("rank") <= max(ks)).join(
        truth.select(*keys).distinct(), list(keys), "left_semi"
    )
    # One row per item and cutoff rank carries everything coverage and popularity need.
    per_item = shown.groupBy("item_id").agg(
        F.min("rank").alias("_best"), *[F.count_if(F.col("rank") <= k).alias(f"_n_{k}") for k in ks]
    )
    if popularity is None:
        per_item = per_item.withColumn("cnt", F.lit(0))
    else:
        per_item = per_item.join(popularity.select("item_id", "cnt"), "item_id", "left")
    log_count = F.log1p(F.coalesce("cnt", F.lit(0)))
    facts = []
    for k in ks:
        facts += [
            F.count_if(F.col("_best") <= k).alias(f"_cover_{k}"),
            F.coalesce(
                F.try_divide(F.sum(F.col(f"_n_{k}") * log_count), F.sum(f"_n_{k}")), F.lit(0.0)
            ).alias(f"_pop_{k}"),
        ]
    coverage = per_item.agg(F.struct(*facts).alias("s"))
    out = means.withColumns({"_c": coverage.scalar(), "_size": F.greatest(catalog_size, F.lit(1))})
    extra = []
    for k in ks:
        extra.append((F.col(f"_c._cover_{k}") / F.col("_size")).alias(f"coverage_at_{k}"))
        if popularity is not None:
            extra.append(F.col(f"_c._pop_{k}").alias(f"average_log_popularity_at_{k}"))
    return out.select(*means.columns, *extra)


def cold_truth(truth: DataFrame, known: DataFrame) -> DataFrame:
    return truth.join(known.select("item_id"), "item_id", "left_anti")


def cold_recall(
    ranked: DataFrame,
    truth: DataFrame,
    known: DataFrame,
    k: int,
    keys: Sequence[str] = ("user_id", "date"),
    prefix: str = "cold",
) -> DataFrame:
    """Recall over positives whose item is not `known`; groups without such positives do not count."""
    groups = recall_by_group(ranked, cold_truth(truth, known).select(*keys, "item_id"), k, keys)
    return groups.agg(
        F.coalesce(F.avg(f"recall_at_{k}"), F.lit(0.0)).alias(f"{prefix}_recall_at_{k}"),
        F.countDistinct("user_id").alias(f"{prefix}_evaluated_users"),
        F.count("*").alias(f"{prefix}_evaluated_groups"),
    )


def evaluation_context(
    log: DataFrame,
    items: DataFrame,
    evaluated: DataFrame,
    split: str,
    history_splits: Sequence[str],
    minimum_date: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(truth of the evaluated users from a date on, known items, catalog size at the last truth date)."""
    past = log.filter(F.col("split").isin(*history_splits))
    truth = ground_truth(log, split, exclude=past.select("user_id", "item_id").distinct())
    if minimum_date is not None:
        truth = truth.filter(F.col("date") >= minimum_date)
    truth = truth.join(evaluated.select("user_id").distinct(), "user_id", "left_semi")
    size = items.filter(F.col("first_seen_date") <= truth.agg(F.max("date")).scalar())
    return truth, past.select("item_id").distinct(), size.agg(F.count("*").alias("catalog_size"))


def rank_within(df: DataFrame, score: str, k: int, keys: Sequence[str] = ("user_id", "date")) -> DataFrame:
    """First `k` rows of each group by descending score, ties by item."""
    return top_n(df, list(keys), [F.desc(steady(score)), F.asc("item_id")], k)


def ranked_metrics_at(
    df: DataFrame,
    truth: DataFrame,
    known: DataFrame,
    catalog_size: Column,
    ks: Sequence[int],
    score: str = "score",
    keys: Sequence[str] = ("user_id", "date"),
) -> tuple[DataFrame, DataFrame]:
    """(one metric row, per-group table) for a scored candidate frame at several cutoffs.

    Rows are ranked once to the deepest cutoff; every cutoff is a conditional sum over that table.
    """
    ks = sorted(set(ks))
    top = rank_within(df, score, max(ks), keys)
    metrics = recall_metrics(top, truth, None, catalog_size, ks, keys)
    groups = truth.select(*keys).distinct().agg(F.count("*")).scalar()
    quality = []
    value = F.col("label_complete") + 0.5 * F.col("label_strong") - 0.5 * F.col("label_short")
    for k in ks:
        inside = F.col("rank") <= k
        quality += [
            F.sum(F.when(inside, F.col("label_complete").cast("long"))).alias(f"_hits_{k}"),
            *[
                F.avg(F.when(inside, F.col(f"label_{name}"))).alias(f"{name}_rate_at_{k}")
                for name in ("complete", "strong", "short")
            ],
            F.avg(F.when(inside, value)).alias(f"utility_at_{k}"),
        ]
    rates = top.agg(F.struct(*quality).alias("s")).scalar()
    cold = {
        k: cold_recall(top, truth, known, k, keys).select(F.struct("*").alias("s")).scalar() for k in ks
    }
    out = metrics.withColumns({"_q": rates, "_groups": groups, **{f"_cold_{k}": cold[k] for k in ks}})
    extra = []
    for k in ks:
        extra += [
            (F.col(f"_q._hits_{k}") / (F.col("_groups") * k)).alias(f"precision_at_{k}"),
            *[
                F.col(f"_q.{name}_at_{k}").alias(f"{name}_at_{k}")
                for name in ("complete_rate", "strong_rate", "short_rate", "utility")
            ],
            F.col(f"_cold_{k}.cold_recall_at_{k}").alias(f"cold_recall_at_{k}"),
        ]
    last = f"_cold_{ks[-1]}"
    extra += [F.col(f"{last}.cold_evaluated_{n}").alias(f"cold_evaluated_{n}") for n in ("users", "groups")]
    return out.select(*metrics.columns, *extra), recall_by_group(top, truth, ks, keys)


def merge_group_tables(tables: Sequence[DataFrame], keys: Sequence[str] = ("user_id", "date")) -> DataFrame:
    """Full outer join of per-group tables that were computed apart."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.join(table, list(keys), "full_outer")
    return merged


def channel_rates(df: DataFrame, ks: Sequence[int], score: str = "score") -> DataFrame:
    """Per cutoff: share of selected rows the tower found, and share only the tower found."""
    ks = sorted(set(ks))
    top = rank_within(df, score, max(ks))
    tower = F.col("tower_present") == 1
    alone = tower & (F.col("itemcf_present") == 0) & (F.col("content_present") == 0)
    out = []
    for k in ks:
        inside = F.col("rank") <= k
        out += [
            F.avg(F.when(inside, tower.cast("double"))).alias(f"tower_selected_rate_at_{k}"),
            F.avg(F.when(inside, alone.cast("double"))).alias(f"tower_unique_selected_rate_at_{k}"),
        ]
    return top.agg(*out)


def channel_overlap(
    base: Sequence[DataFrame], candidate: DataFrame, truth: DataFrame, items: DataFrame, k: int
) -> DataFrame:
    """How a candidate channel adds to the union of base channels, over truth groups at depth `k`."""
    union = None
    for ranked in base:
        part = available_on_date(ranked, truth, items, k).select(*KEYS, "item_id")
        union = part if union is None else union.union(part)
    union = union.withColumns({"_b": F.lit(1), "_c": F.lit(0), "_t": F.lit(0)})
    extra = available_on_date(candidate, truth, items, k).select(
        *KEYS, "item_id", F.lit(0).alias("_b"), F.lit(1).alias("_c"), F.lit(0).alias("_t")
    )
    wanted = truth.select(*KEYS, "item_id", F.lit(0).alias("_b"), F.lit(0).alias("_c"), F.lit(1).alias("_t"))
    per_item = (
        union.union(extra)
        .union(wanted)
        .groupBy(*KEYS, "item_id")
        .agg(*[(F.max(name) == 1).alias(name) for name in ("_b", "_c", "_t")])
    )
    b, c, t = F.col("_b"), F.col("_c"), F.col("_t")
    groups = per_item.groupBy(*KEYS).agg(
        F.count_if(b & c).alias("both"),
        F.count_if(b | c).alias("either"),
        F.count_if(c & ~b).alias("only"),
        F.count_if(c).alias("cand"),
        F.count_if(t).alias("pos"),
        F.count_if(b & t).alias("base_hits"),
        F.count_if((b | c) & t).alias("union_hits"),
    )
    base_recall = F.avg(F.col("base_hits") / F.col("pos"))
    union_recall = F.avg(F.col("union_hits") / F.col("pos"))
    return groups.agg(
        F.count("*").alias("evaluated_groups"),
        F.avg(F.col("both") / F.greatest("either", F.lit(1))).alias("mean_jaccard"),
        F.avg(F.col("only") / F.greatest("cand", F.lit(1))).alias("mean_unique_item_rate"),
        base_recall.alias(f"base_oracle_recall_at_{k}"),
        union_recall.alias(f"union_oracle_recall_at_{k}"),
        (union_recall - base_recall).alias(f"incremental_oracle_recall_at_{k}"),
        F.count_if(F.col("union_hits") > F.col("base_hits")).alias("groups_with_new_hit"),
    )


def dense_panel_metrics(
    ranked: DataFrame,
    feedback: DataFrame,
    catalog: DataFrame,
    k: int,
    popularity: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(one metric row, per-user table) against a panel with feedback for nearly every pair.

    A list is walked to its k-th usable item: items outside the catalog (invalid) and unobserved
    pairs are skipped and counted up to that point, repeats are dropped. Users without positives
    count as 0 and every panel user has the same weight.
    """
    users = feedback.groupBy("user_id").agg(F.count_if(F.col("label_complete") == 1).alias("_pos"))
    facts = ["label_complete", "label_strong", "label_short", "watch_ratio_clipped", "utility"]
    in_catalog = catalog.select("item_id", F.lit(True).alias("_in"))
    walked = (
        ranked.select("user_id", "item_id", "rank")
        .join(users.select("user_id"), "user_id", "left_semi")
        .join(in_catalog, "item_id", "left")
        .join(feedback.select("user_id", "item_id", *facts), ["user_id", "item_id"], "left")
    )
    usable = F.col("_in") & F.col("label_complete").isNotNull()
    first = (
        walked.filter(usable)
        .groupBy("user_id", "item_id")
        .agg(F.min_by(F.struct("rank", *facts), "rank").alias("r"))
        .select("user_id", "item_id", F.col("r.rank").alias("_at"), *[f"r.{name}" for name in facts])
    )
    shown = top_n(first, ["user_id"], [F.asc("_at")], k)
    stop = shown.filter(F.col("rank") == k).select("user_id", F.col("_at").alias("_stop"))
    skipped = (
        walked.filter(~F.coalesce(usable, F.lit(False)))
        .join(stop, "user_id", "left")
        .filter(F.col("_stop").isNull() | (F.col("rank") < F.col("_stop")))
        .agg(
            F.struct(
                F.count_if(F.col("_in").isNull()).alias("invalid"),
                F.count_if(F.col("_in")).alias("unobserved"),
            ).alias("s")
        )
    )
    if popularity is None:
        shown = shown.withColumn("cnt", F.lit(0))
    else:
        shown = shown.join(popularity.select("item_id", "cnt"), "item_id", "left")
    gain = F.when(F.col("label_complete") == 1, _gain(F.col("rank"))).otherwise(0.0)
    sums = shown.groupBy("user_id").agg(
        F.count("*").alias("_n"),
        F.sum(F.col("label_complete").cast("long")).alias("_hits"),
        F.sum(gain).alias("_dcg"),
        F.avg("label_complete").alias("_complete"),
        F.avg("label_strong").alias("_strong"),
        F.avg("label_short").alias("_short"),
        F.avg("watch_ratio_clipped").alias("_watch"),
        F.avg("utility").alias("_utility"),
        F.avg(F.log1p(F.coalesce("cnt", F.lit(0)))).alias("_logpop"),
    )
    hits, pos = F.coalesce("_hits", F.lit(0)), F.col("_pos")
    by_user = users.join(sums, "user_id", "left").select(
        "user_id",
        F.coalesce("_n", F.lit(0)).alias("recommended_count"),
        (hits / F.lit(k)).alias(f"precision_at_{k}"),
        F.when(pos > 0, hits / pos).otherwise(0.0).alias(f"recall_at_{k}"),
        (hits > 0).cast("double").alias(f"hit_rate_at_{k}"),
        F.when(pos > 0, F.coalesce("_dcg", F.lit(0.0)) / _ideal(pos, k)).otherwise(0.0).alias(f"ndcg_at_{k}"),
        *[
            F.coalesce(column, F.lit(0.0)).alias(f"{name}_at_{k}")
            for column, name in (
                ("_complete", "complete_rate"),
                ("_strong", "strong_rate"),
                ("_short", "short_rate"),
                ("_watch", "watch_ratio"),
                ("_utility", "utility"),
                ("_logpop", "average_log_popularity"),
            )
        ],
    )
    size = catalog.agg(F.count("*")).scalar()
    distinct_shown = shown.select("item_id").distinct().agg(F.count("*")).scalar()
    names = [name for name in by_user.columns if name != "user_id"]
    metrics = by_user.agg(*[F.avg(name).alias(name) for name in names], F.count("*").alias("evaluated_users"))
    metrics = metrics.withColumns(
        {
            f"coverage_at_{k}": distinct_shown / F.greatest(size, F.lit(1)),
            "catalog_size": size,
            "evaluated_pairs": feedback.agg(F.count("*")).scalar(),
            "_s": skipped.scalar(),
        }
    )
    return (
        metrics.withColumns(
            {
                "matrix_density": F.col("evaluated_pairs")
                / F.greatest(F.col("evaluated_users") * F.col("catalog_size"), F.lit(1)),
                "invalid_recommendations": F.col("_s.invalid"),
                "unobserved_recommendation_pairs": F.col("_s.unobserved"),
            }
        ).drop("_s"),
        by_user,
    )


def panel_truth(feedback: DataFrame) -> DataFrame:
    """Positives of the dense panel; seen items stay unless the caller removes them."""
    return feedback.filter(F.col("label_complete") == 1).select("user_id", "item_id").distinct()


def sparse_replay(ranked: DataFrame, sampled: DataFrame, catalog_size: Column, k: int) -> DataFrame:
    """Recall family against the truth of a sampled exposure, with the sample's own counts."""
    metrics = recall_metrics(ranked, panel_truth(sampled), None, catalog_size, k, ["user_id"])
    facts = sampled.agg(
        F.struct(
            F.count("*").alias("pairs"),
            F.countDistinct("user_id").alias("users"),
            F.count_if(F.col("label_complete") == 1).alias("positive"),
        ).alias("s")
    )
    return metrics.withColumn("_s", facts.scalar()).select(
        *metrics.columns,
        F.col("_s.pairs").alias("observed_pairs"),
        F.col("_s.users").alias("observed_users"),
        F.col("_s.positive").alias("observed_positive_pairs"),
        (F.col("_s.positive") / F.col("_s.pairs")).alias("observed_positive_rate"),
    )


def average_rank(value: str, keys: Sequence[str]) -> Column:
    """Rank with ties sharing the mean of their positions; for groups of model or run size."""
    below = W.partitionBy(*keys).orderBy(value)
    return F.rank().over(below) + (F.count("*").over(W.partitionBy(*keys, value)) - 1) / 2


def rank_consistency(summary: DataFrame, k: int) -> DataFrame:
    """Spearman correlation of full and sparse metrics over models, and each side's best model.

    `summary`: evaluation (full_exposure / sparse_replay), policy, density, experiment_id, metrics.
    """
    metrics = {"recall": f"recall_at_{k}", "ndcg": f"ndcg_at_{k}"}
    full = summary.filter(F.col("evaluation") == "full_exposure").select(
        "experiment_id", *[F.col(c).alias(f"{m}_full") for m, c in metrics.items()]
    )
    sparse = summary.filter(F.col("evaluation") == "sparse_replay").select(
        "policy", "density", "experiment_id", *[F.col(c).alias(f"{m}_sparse") for m, c in metrics.items()]
    )
    keys = ["policy", "density"]
    joined = sparse.join(full, "experiment_id")
    sides = [f"{m}_{s}" for m in metrics for s in ("full", "sparse")]
    ranked = joined.withColumns({f"_r_{side}": average_rank(side, keys) for side in sides})
    best = lambda side: F.min_by("experiment_id", F.struct(-F.col(side), F.col("experiment_id")))
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("models"),
        *[F.corr(f"_r_{m}_full", f"_r_{m}_sparse").alias(f"spearman_{m}") for m in metrics],
        *[best(f"{m}_{s}").alias(f"{s}_best_{m}") for m in metrics for s in ("full", "sparse")],
    )


def paired_bootstrap(
    a: DataFrame, b: DataFrame, metric: str, samples: int = 1000, seed: int = 2026, poisson: bool = True
) -> DataFrame:
    """Mean of b - a over shared users and the 95 % interval of `samples` resampled means.

    Each user gets a Poisson(1) weight per replicate, drawn where the row is and summed before the shuffle. Without
    `poisson` users are drawn by position with replacement; that shuffles one row per user and replicate, to where the
    drawn user is. The plan's size estimate does not see that every user is repeated `samples` times, so the join names
    its strategy; else the draws could be broadcast.
    """
    mean = lambda df, name: df.groupBy("user_id").agg(F.avg(metric).alias(name))
    paired = mean(a, "_a").join(mean(b, "_b"), "user_id").select(
        "user_id", (F.col("_b") - F.col("_a")).alias("diff")
    )
    replicate = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("b")
    if poisson:
        draws = paired.select("diff", "user_id", replicate).withColumn(
            "w", _poisson_one(hash32(seed, "b", "user_id"))
        )
        means = draws.groupBy("b").agg(F.try_divide(F.sum(F.col("w") * F.col("diff")), F.sum("w")).alias("m"))
    else:
        users = ordinal(paired, ["user_id"], "pos").select("diff", (F.col("pos") - 1).alias("pos"))
        n = paired.agg(F.count("*")).scalar()
        drawn = (
            users.select(F.col("pos").alias("slot"), n.alias("_n"), replicate)
            .withColumn("pos", F.pmod(hash32(seed, "b", "slot"), F.col("_n")))
            .select("b", "pos")
        )
        means = drawn.join(users.hint("shuffle_hash"), "pos").groupBy("b").agg(F.avg("diff").alias("m"))
    bounds = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return paired.agg(
        F.count("*").alias("paired_users"), F.avg("diff").alias("mean_difference")
    ).withColumn("_q", bounds.scalar()).select(
        "paired_users",
        "mean_difference",
        F.col("_q")[0].alias("ci_95_low"),
        F.col("_q")[1].alias("ci_95_high"),
    )


def _poisson_steps(most: int = 12) -> list[tuple[int, int]]:
    """(count, edge): a 32-bit draw below the edge, and not below an earlier one, means that count."""
    steps, mass, below = [], math.exp(-1), 0.0
    for count in range(most):
        below += mass
        steps.append((count, int(below * 2**32)))
        mass /= count + 1
    return steps


POISSON_STEPS = _poisson_steps()


def _poisson_one(draw: Column) -> Column:
    """Poisson(1) count from a 32-bit draw by inverting its distribution function."""
    column = F.lit(len(POISSON_STEPS))
    for count, edge in reversed(POISSON_STEPS):
        column = F.when(draw < edge, count).otherwise(column)
    return column


def challenger_gate(comparisons: DataFrame, baseline: str) -> DataFrame:
    """Mark challengers (experiment_id, recall, recall_ci_low, ndcg_ci_high) and name the winner.

    Eligible: recall interval above 0 and NDCG interval reaching 0. The winner has the best recall
    among the eligible ones, else the baseline stays.
    """
    eligible = (F.col("recall_ci_low") > 0) & (F.col("ndcg_ci_high") >= 0)
    marked = comparisons.withColumn("eligible", eligible)
    best = marked.filter("eligible").agg(
        F.min_by("experiment_id", F.struct(-F.col("recall"), F.col("experiment_id")))
    )
    return marked.withColumn("winner", F.coalesce(best.scalar(), F.lit(baseline)))


def quota_gate(comparisons: DataFrame) -> DataFrame:
    """Channel-quota gate: recall loss <= 2 %, coverage gain >= 5 %, oracle gain > 0 (relative)."""
    passed = (
        (F.col("recall") >= F.col("base_recall") * 0.98)
        & (F.col("coverage") >= F.col("base_coverage") * 1.05)
        & (F.col("oracle_gain") > 0)
    )
    return comparisons.withColumn("passed", passed)


def oov_metrics(ranked: DataFrame, truth: DataFrame, frame: DataFrame, train_items: DataFrame, k: int) -> DataFrame:
    """Recall over items absent from the training candidates, and the share of such frame rows."""
    known = train_items.select("item_id").distinct()
    flagged = frame.join(known.withColumn("_k", F.lit(True)), "item_id", "left")
    share = flagged.agg(F.avg(F.col("_k").isNull().cast("double"))).scalar()
    return cold_recall(ranked, truth, known, k, prefix="oov").withColumn("oov_row_rate", share)
