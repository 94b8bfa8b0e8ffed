"""Embedding recall, latent factors and feature vectors of users and items."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwise.functions.ordering import ordinal
from reelwise.operators.ranked import only_allowed, positive_tail
from reelwise.operators.text import content_vectors, text_postings, unit_vector, with_content
from reelwise.operators.tiles import dense_topk, linked_means
from reelwise.session import cut_lineage

# Numeric profile columns and hash width of the feature recall.
PROFILE_NUMBERS = [
    "is_lowactive_period",
    "is_live_streamer",
    "is_video_author",
    "follow_user_num",
    "fans_user_num",
    "friend_user_num",
    "register_days",
]
AUTHOR_BINS = 64


def embedding_topk(
    users: DataFrame, items: DataFrame, seen: DataFrame, k: int, allowed: DataFrame | None = None
) -> DataFrame:
    """Best `k` unseen allowed items by dot product; `users`/`items` carry a `vector` array."""
    return dense_topk(users, only_allowed(items, allowed), seen, k)


def mean_vectors(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Mean item vector per user over `pairs` (user_id, item_id), repeats counted; written once.

    A user's items form one row, as history tails do; see tiles.linked_means.
    """
    tails = pairs.groupBy("user_id").agg(F.collect_list("item_id").alias("terms"))
    # Counted, named and met by the vectors apart; the means are counted and placed.
    return cut_lineage(linked_means(cut_lineage(tails), items))


def als_recall(
    log: DataFrame,
    users: DataFrame,
    seen: DataFrame,
    k: int,
    rank: int = 32,
    iterations: int = 5,
    seed: int = 2026,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """Latent-factor recall from implicit feedback; ranks by the exact factor dot product."""
    positives = (
        log.filter(F.col("label_complete") == 1)
        .groupBy("user_id", "item_id")
        .agg(F.sum(F.lit(1.0)).cast("float").alias("plays"))
    )
    # The solver takes 32-bit ids: number users and items densely and map the factors back.
    user_codes = cut_lineage(ordinal(positives.select("user_id").distinct(), ["user_id"], "_u").withColumn("_u", F.col("_u").cast("int")))
    item_codes = cut_lineage(ordinal(positives.select("item_id").distinct(), ["item_id"], "_i").withColumn("_i", F.col("_i").cast("int")))
    als = ALS(
        rank=rank,
        maxIter=iterations,
        implicitPrefs=True,
        userCol="_u",
        itemCol="_i",
        ratingCol="plays",
        seed=seed,
    )
    model = als.fit(positives.join(user_codes, "user_id").join(item_codes, "item_id").select("_u", "_i", "plays"))
    factors = lambda df, code: df.select(F.col("id").alias(code), F.col("features").alias("vector"))
    known = factors(model.userFactors, "_u").join(user_codes, "_u").select("user_id", "vector")
    catalog = factors(model.itemFactors, "_i").join(item_codes, "_i").select("item_id", "vector")
    return embedding_topk(known.join(users.select("user_id"), "user_id", "left_semi"), catalog, seen, k, allowed)


def one_hot(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add `out`: one 0/1 entry per distinct value of `column`, in ascending order; all 0 for NULL."""
    codes = ordinal(df.select(F.col(column).alias("_value")).filter("_value IS NOT NULL").distinct(), ["_value"], "_code")
    codes = cut_lineage(codes)
    size = codes.agg(F.count("*").cast("int")).scalar()
    placed = df.join(codes, F.col(column) == F.col("_value"), "left").withColumn("_size", size)
    entries = F.when(F.col("_size") > 0, F.sequence(F.lit(1), F.col("_size"))).otherwise(F.array().cast("array<int>"))
    hot = F.transform(entries, lambda i: F.coalesce((i == F.col("_code")).cast("double"), F.lit(0.0)))
    return placed.withColumn(out, hot).drop("_value", "_code", "_size")


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace the columns by (x - mean) / sample deviation; a column without spread becomes 0."""
    moments = df.agg(F.struct(*[F.struct(F.mean(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns]).alias("_m"))
    with_moments = df.withColumn("_m", moments.scalar())
    scaled = {
        c: F.when(F.col("_m")[c]["s"] > 0, (F.col(c) - F.col("_m")[c]["m"]) / F.col("_m")[c]["s"]).otherwise(F.lit(0.0)) for c in columns
    }
    return with_moments.withColumns(scaled).drop("_m")


def item_feature_vectors(
    items: DataFrame, text_dim: int = 32, max_terms: int | None = None, oversample: int = 8, power: int = 2
) -> DataFrame:
    """Text components, category one-hot, hashed author one-hot and scaled log duration, per item."""
    content = content_vectors(text_postings(items, max_terms=max_terms), text_dim, oversample, power)
    facts = with_content(items, content, text_dim).select(
        "item_id",
        F.col("vector").alias("_text"),
        F.coalesce("first_category", F.lit(-1)).cast("string").alias("_cat"),
        F.pmod(F.coalesce("author_id", F.lit(-1)), F.lit(AUTHOR_BINS)).cast("int").alias("_author"),
        F.log1p(F.coalesce("video_duration", F.lit(0.0))).alias("_duration"),
    )
    author = F.transform(
        F.sequence(F.lit(0), F.lit(AUTHOR_BINS - 1)), lambda i: (i == F.col("_author")).cast("double")
    )
    return one_hot(standardised(cut_lineage(facts), ["_duration"]), "_cat", "_cat_v").select(
        "item_id", F.concat("_text", "_cat_v", author, F.array("_duration")).alias("vector")
    )


def user_feature_vectors(
    log: DataFrame, users: DataFrame, item_vectors: DataFrame, dim: int, history_length: int = 50
) -> DataFrame:
    """Mean history item vector followed by scaled profile numbers and activity one-hot.

    `history` is kept apart so that recall can compare users and items in the shared item space.
    """
    history = mean_vectors(positive_tail(log, history_length), item_vectors)
    zeros = F.array_repeat(F.lit(0.0), dim)
    profile = users.join(history, "user_id", "left").select(
        "user_id",
        F.coalesce("vector", zeros).alias("history"),
        *[F.coalesce(F.expr(f"try_cast({name} as double)"), F.lit(0.0)).alias(name) for name in PROFILE_NUMBERS],
        F.coalesce("user_active_degree", F.lit("UNKNOWN")).alias("_active"),
    )
    return one_hot(standardised(cut_lineage(profile), PROFILE_NUMBERS), "_active", "_active_v").select(
        "user_id", "history", F.concat("history", F.array(*PROFILE_NUMBERS), "_active_v").alias("vector")
    )


def feature_recall(
    log: DataFrame,
    item_vectors: DataFrame,
    users: DataFrame,
    seen: DataFrame,
    k: int,
    history_length: int = 50,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """Cosine of a user's mean history features with each item's features."""
    tail = positive_tail(log, history_length).join(users.select("user_id"), "user_id", "left_semi")
    wanted = mean_vectors(tail, item_vectors)
    return embedding_topk(
        wanted.select("user_id", unit_vector("vector").alias("vector")),
        item_vectors.select("item_id", unit_vector("vector").alias("vector")),
        seen,
        k,
        allowed,
    )
