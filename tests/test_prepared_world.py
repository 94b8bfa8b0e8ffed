"""A prepared world and category recall write what they read several times."""

from reelwise.operators import recall
from reelwise.plans.world import World

FOLDER = "/root/testdata/sf0.001"


def files_read(df):
    return {f.rsplit("/", 2)[-2] if "/table-" in f else f.rsplit("/", 1)[-1] for f in df.inputFiles()}


def test_frames_of_a_prepared_world_do_not_read_the_tables_again(spark):
    plain, prepared = World(spark, FOLDER), World(spark, FOLDER, prepared=True)
    for name in ("items", "seen", "truth", "users"):
        once, again = getattr(prepared, name), getattr(prepared, name)
        assert once is again
        assert "events.parquet" in " ".join(files_read(getattr(plain, name)))
        assert all(f.startswith("table-") for f in files_read(once)) and len(files_read(once)) == 1
        assert sorted(once.collect(), key=repr) == sorted(getattr(plain, name).collect(), key=repr)


def test_category_recall_counts_and_walks_written_gaps(spark, make_log, monkeypatch):
    log = make_log([(u, i, 20240101 + i % 9, 1.0) for u in range(4) for i in range(u, 9)])
    items = spark.createDataFrame([(i, i % 2) for i in range(20)], "item_id long, first_category int")
    kept, cut = [], recall.cut_lineage
    monkeypatch.setattr(recall, "cut_lineage", lambda df: kept.append(df.columns) or cut(df))
    seen = log.select("user_id", "item_id").distinct()
    assert recall.category_recall(log, items, log.select("user_id").distinct(), seen, 5).count()
    assert ["user_id", "list_id", "gap"] in kept
