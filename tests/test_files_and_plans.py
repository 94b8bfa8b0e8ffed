import pytest
from pyspark.sql import functions as F

from reelwise import schema as S
from reelwise.operators import profile as PF
from reelwise.operators import ranked as RK
from reelwise.operators import recall as RC
from reelwise.operators import stats as ST
from reelwise.plans.world import World
from reelwise.session import cut_lineage
from reelwise.sources import files as IO


def test_csv_sources(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(
        "user_id,video_id,play_duration,video_duration,time,date,timestamp,watch_ratio,extra\n"
        "1,5,100,200,2020-07-05 13:00:00,20200705.0,1593927159.7,0.5,x\n2,6,1,2,,,5,0.1,y\n"
    )
    rows = IO.read_interactions(spark, str(path), spark.createDataFrame([(1,)], "user_id long")).collect()
    assert [(r.user_id, r.item_id, r.date, r.watch_ratio) for r in rows] == [(1, 5, 20200705.0, 0.5)]
    captions = tmp_path / "c.csv"
    head = "video_id," + ",".join(S.CAPTION_TEXTS)
    captions.write_text(head + '\n1,"two\nlines, ""quoted""",b,c,d,e,f\n2,too,few\n3,a,b,c,d,e,f\n')
    got = {r.video_id: r.manual_cover_text for r in IO.read_tolerant_csv(spark, str(captions), S.RAW_CAPTIONS).collect()}
    assert got["1"] == 'two\nlines, "quoted"' and "3" in got and "2" not in got


def test_prepared_tables_and_stale_guard(spark, tmp_path, make_log):
    log = make_log([(1, 10, 20240101, 1.0), (1, 11, 20240120, 1.0)])
    path = str(tmp_path / "prepared")
    IO.write_prepared(log, path, "split")
    assert IO.read_prepared(spark, path).count() == 2
    with pytest.raises(Exception, match="stale"):
        IO.read_prepared(spark, path, version=99).collect()
    log.write.parquet(str(tmp_path / "bare"))
    with pytest.raises(ValueError):
        IO.read_prepared(spark, str(tmp_path / "bare"))


def test_ranked_lists_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 9, 1), (1, 4, 2), (2, 7, 1)], "user_id long, item_id long, rank int")
    IO.write_ranked_json(df, str(tmp_path / "lists"))
    got = IO.read_ranked_json(spark, str(tmp_path / "lists"))
    assert {tuple(r) for r in got.select("user_id", "item_id", "rank").collect()} == {(1, 9, 1), (1, 4, 2), (2, 7, 1)}


def test_run_records(spark, tmp_path):
    path = str(tmp_path / "runs")
    IO.append_run(spark.createDataFrame([("a", 0.5)], "experiment_id string, recall double"), path)
    IO.append_run(spark.createDataFrame([("b", 0.7)], "experiment_id string, ndcg double"), path)
    IO.append_run(spark.createDataFrame([("old", 0.7)], "experiment_id string, ndcg double"), path, version=1)
    rows = {r.experiment_id: r for r in IO.read_runs(spark, path).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].ndcg is None and rows["b"].recall is None
    assert len({r.run_id for r in rows.values()}) == 2
    IO.write_summary_csv(IO.read_runs(spark, path), str(tmp_path / "summary"))
    assert spark.read.option("header", True).csv(str(tmp_path / "summary")).count() == 2


def test_latest_run_and_verdicts(spark):
    runs = spark.createDataFrame(
        [("p", "e", 1, "2024-01-01", "r1", 0.1), ("p", "e", 1, "2024-01-02", "r2", 0.2), ("p", "e", 2, "2024-01-01", "r3", 0.4), (None, "e", 1, "2024-01-01", "r4", 0.9)],
        "panel string, experiment_id string, seed int, created_at_utc string, run_id string, recall double",
    )
    latest = PF.latest_runs(runs)
    assert {r.run_id for r in latest.collect()} == {"r2", "r3", "r4"}
    means = {r.panel: r for r in PF.seed_means(latest, ["panel", "experiment_id"], ["recall"]).collect()}
    assert means["p"].recall == pytest.approx(0.3) and means["p"].seed_count == 2 and means[None].recall == 0.9
    base = spark.createDataFrame([("recall", 0.1), ("ndcg", 0.5), ("coverage", 0.5), ("utility", 1.0)], "metric string, baseline double")
    run = spark.createDataFrame([(0.2, 0.4, 0.5)], "recall double, ndcg double, coverage double")
    got = {r.metric: r.verdict for r in PF.compare_to_baseline(run, base, ["recall", "ndcg", "coverage", "utility"]).collect()}
    assert got == {"recall": "up", "ndcg": "down", "coverage": "flat", "utility": "pending"}


def test_table_quality(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x")], "a int, b string")
    row = PF.table_quality(df, "t").first()
    assert (row.rows, row.columns, row.duplicate_rows, row.missing_cells, row.missing_cell_pct) == (4, 2, 2, 3, 37.5)


def test_rates_divide_safely(spark):
    df = spark.createDataFrame([(1, 10, 0)], "item_id long, show_cnt long, play_cnt long")
    for name in ("complete_play_cnt", "like_cnt", "comment_cnt", "follow_cnt", "share_cnt", "reduce_similar_cnt"):
        df = df.withColumn(name, F.lit(1))
    row = PF.daily_rates(df).first()
    assert row.play_rate == 0.0 and row.like_rate is None


FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned(spark):
    text = plan(World(spark, FOLDER).log.groupBy("item_id").count())
    assert "ts:" not in text and "event_type" not in text


def test_no_row_python_in_the_channels(spark):
    w = World(spark, FOLDER)
    frames = [
        ST.strict_past_stats(w.log),
        RC.recommend_ranked(RC.popular_scores(w.train), w.users, w.seen, 5),
        RC.itemcf_similarity(RC.cf_history(w.train, 10), 20),
        RC.category_recall(w.train, w.items, w.users, w.seen, 5, 10),
    ]
    for frame in frames:
        text = plan(frame)
        assert "BatchEvalPython" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_history_tail_is_cut_before_the_shuffle(spark):
    text = plan(RK.positive_tail(World(spark, FOLDER).train, 50))
    assert text.count("WindowGroupLimit") == 2  # partial and final


def test_statistics_window_runs_on_day_rows(spark):
    text = ST.strict_past_stats(World(spark, FOLDER).log)._jdf.queryExecution().optimizedPlan().toString()
    for part in text.split("Window [")[1:]:
        assert "Aggregate [" in part


def test_hot_join_keys_are_split(spark):
    """With small thresholds the adaptive plan splits a hot item's partition in the lookup join."""
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    }
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        rows = spark.range(0, 300_000, 1, 8).select(
            F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("item_id"), F.rand(1).alias("x")
        )
        items = spark.range(5000).select(F.col("id").alias("item_id"), (F.col("id") % 9).alias("first_category"))
        joined = rows.join(items, "item_id", "left")
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_written_tables_land_in_the_configured_folder(spark):
    df = cut_lineage(spark.range(10))
    assert df.count() == 10
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert folder in df.inputFiles()[0]
