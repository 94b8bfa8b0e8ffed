import pytest
from pyspark.sql import functions as F

from reelwise import schema as S
from reelwise.functions import columns as C
from reelwise.operators import prepare as P
from reelwise.operators import stats as ST

RAW = "user_id long, item_id long, date double, time string, timestamp double, watch_ratio double, play_duration long, video_duration long"


def raw(spark):
    return spark.createDataFrame(
        [
            (1, 10, 20200705.0, "2020-07-05 13:32:39.746", None, 2.5, 9000, 3600),
            (1, 11, 20200811.0, None, 1593927159.746, 1.0, 2999, 8000),
            (2, 12, 20200901.0, None, None, 0.2, 100, 50),
            (2, 13, None, None, 5.0, 0.2, 10, 50),
        ],
        RAW,
    )


def test_labels_split_and_time(spark):
    rows = {r.item_id: r for r in P.prepare_interactions(raw(spark)).collect()}
    assert set(rows) == {10, 11, 12}  # undated rows go
    assert [rows[i].split for i in (10, 11, 12)] == ["train", "valid", "test"]
    assert (rows[10].label_complete, rows[10].label_strong, rows[10].label_short) == (1, 1, 0)
    assert (rows[11].label_complete, rows[11].label_strong, rows[11].label_short) == (1, 0, 1)
    assert rows[12].label_short == 0  # 100 ms is not below min(3000, 50)
    assert (rows[10].hour, rows[10].weekday) == (13, 6)  # a Sunday
    assert rows[11].hour == 13  # Unix seconds shown in Shanghai time
    assert rows[12].hour == 12  # noon of the date


def test_time_ignores_the_session_zone(spark):
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert {r.hour for r in P.prepare_interactions(raw(spark)).collect()} == {13, 12}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_user_filter(spark):
    users = spark.createDataFrame([(2,)], "user_id long")
    assert [r.user_id for r in P.prepare_interactions(raw(spark), users).collect()] == [2]


def test_panel_keeps_undated_rows(spark):
    users = spark.createDataFrame([(2,)], "user_id long")
    rows = P.prepare_panel(raw(spark), users, "full_val").collect()
    assert len(rows) == 2
    assert {(r.date, r.split, r.hour, r.weekday) for r in rows} == {(20200905, "full_val", 12, 5)}
    assert P.panel_catalog(raw(spark)).count() == 4


def test_list_literals_and_text(spark):
    df = spark.createDataFrame(
        [("[8, 3]", "a", None), ("[]", "UNKNOWN", "b"), (None, None, None), ("oops", "x", "y UNKNOWN")],
        "feat string, t string, u string",
    )
    rows = df.select(
        P.first_of_list(F.col("feat")).alias("c"), P.list_length(F.col("feat")).alias("n"), P.joined_text(["t", "u"]).alias("s")
    ).collect()
    assert [r.c for r in rows] == [8, -1, -1, -1]
    assert [r.n for r in rows][:3] == [2, 0, 0]
    assert [r.s for r in rows] == ["a ", " b", " ", "x y "]


def test_item_dimension(spark):
    categories = spark.createDataFrame([(1, "[5]"), (2, "[]"), (3, None)], "item_id long, feat string")
    daily = spark.createDataFrame(
        [(1, 20200801, 7, "AD", 10.0), (1, 20200805, 8, "NORMAL", None), (2, 20200901, 9, "NORMAL", 4.0)],
        "item_id long, date int, author_id long, video_type string, video_duration double",
    )
    captions = spark.createDataFrame(
        [("1", "x", None, None, None, None, None), ("bad id", "y", None, None, None, None, None)],
        "item_id string, " + ", ".join(f"{n} string" for n in S.CAPTION_TEXTS),
    )
    log = spark.createDataFrame([(1, 6.0), (1, 8.0), (3, 2.0)], "item_id long, video_duration double")
    rows = {r.item_id: r for r in P.item_dimension(categories, daily, captions, log).collect()}
    assert (rows[1].first_category, rows[1].author_id, rows[1].first_seen_date) == (5, 8, 20200801)
    assert rows[1].video_duration == 7.0  # median of the log fills the missing value
    assert rows[1].content_text.strip() == "x"
    # first seen after the training end: the date stays, attributes take their defaults
    assert (rows[2].author_id, rows[2].video_type, rows[2].first_seen_date) == (-1, "UNKNOWN", 20200901)
    assert (rows[3].first_seen_date, rows[3].video_duration, rows[3].content_text) == (None, 2.0, "")


def test_strictly_past_statistics(spark, make_log):
    log = make_log([(1, 10, 20240101, 1.0), (1, 10, 20240101, 0.0), (1, 11, 20240102, 9.0), (2, 10, 20240103, 0.5)])
    rows = {r.event_id: r for r in ST.strict_past_stats(log).collect()}
    assert rows[0].user_interactions is None and rows[1].user_interactions is None  # same day is not past
    assert rows[2].user_interactions == 2 and rows[2].user_complete_rate == 0.5
    assert rows[2].item_interactions is None
    assert rows[3].item_interactions == 2 and rows[3].user_interactions is None


def test_attach_replaces_old_statistics(spark, make_log):
    log = make_log([(1, 10, 20240101, 9.0), (1, 11, 20240104, 1.0)])
    target = make_log([(1, 10, 20240104, 1.0)]).withColumn("user_old", F.lit(3)).withColumn("item_complete_rate", F.lit(9.0))
    row = ST.attach_past_stats(target, log).first()
    assert "user_old" not in row.asDict()
    assert (row.user_interactions, row.user_mean_watch_ratio, row.item_complete_rate) == (1, 5.0, 1.0)


def test_feature_catalogue():
    assert len(S.FEATURES) == 29 == len(set(S.FEATURES))
    assert len(set(S.FEATURES)) == len(S.FEATURES) and S.features() == S.FEATURES
    assert not set(S.features(prefix="tower_")) & {"tower_present", "tower_rank_score", "tower_age_cross"}
    assert set(S.FEATURES) - set(S.features(without=["user", "cross"])) == {*S.USER_FEATURES, *S.CROSS_FEATURES}
    assert S.pointwise_columns(["F1", "F3", "F1"]) == [*S.POINTWISE_GROUPS["F1"], "user_mean_watch_ratio"]


def test_hash_draws_are_even(spark):
    draws = spark.range(4000).select(C.unit_hash(1, "id").alias("u")).toPandas().u
    assert 0 < draws.min() and draws.max() < 1 and abs(draws.mean() - 0.5) < 0.02


def test_sketches_of_days_merge_to_any_range(spark):
    from reelwise.operators.profile import distinct_between, distinct_sketches, distinct_to_date

    log = spark.range(60_000).selectExpr("int(20240101 + id % 6) AS date", "id % 6 * 4000 + hash(id) % 9000 AS user_id")
    sketches = distinct_sketches(log.union(spark.sql("SELECT 20240103, CAST(NULL AS BIGINT)")), "user_id")
    for first, last in ((20240101, 20240106), (20240102, 20240104), (20240106, None), (None, 20240101)):
        exact = log.filter(f"date >= {first or 0} AND date <= {last or 99999999}").select("user_id").distinct().count()
        assert abs(distinct_between(sketches, first, last).first().approx / exact - 1) < 0.05
    assert distinct_between(sketches, 20250101).first().approx == 0
    rows = distinct_to_date(sketches).orderBy("date").collect()
    assert rows[0].approx == rows[0].approx_to_date and rows[-1].approx_to_date > 1.5 * rows[-1].approx
