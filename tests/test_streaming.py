from datetime import datetime, timedelta

from tierflow.plans.compare_joins import compare
from tierflow.streaming.replays import without_replays


def test_replays_within_the_watermark_go(spark, tmp_path):
    t = datetime(2026, 9, 1)
    rows = [("a", t), ("a", t + timedelta(hours=1)), ("b", t), ("b", t + timedelta(days=2))]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "txn_id string, txn_ts timestamp").coalesce(1).write.parquet(source)
    stream = without_replays(spark.readStream.schema("txn_id string, txn_ts timestamp").parquet(source))
    q = stream.writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r[0] for r in spark.table("fresh").collect()) == ["a", "b"]


def test_strategies_run_and_settings_come_back(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    assert set(compare(spark, facts=2000, dims=100, salts=4)) == {"merge", "merge_adaptive", "salted", "broadcast"}
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
