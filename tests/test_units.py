from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tierflow.functions.columns import convert, protect, row_digest, standardise
from tierflow.operators import balance, features, history, joins, rules
from tierflow.operators.dedupe import latest_per_key, without_replays
from tierflow.operators.joins import salted_join
from tierflow.plans.stages import GRAPH, STAGES, shift, trigger_date, walk
from tierflow.sources import store
from tierflow.spec import RuleSpec, parse


def test_latest_keeps_every_null_key(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), (None, 1), (None, 1)], "k string, v int")
    kept, surplus = latest_per_key(df, ["k"], [F.col("v").desc()])
    assert rows(kept) == [(None, 1), (None, 1), ("a", 2), ("b", 5)]
    assert rows(surplus) == [("a", 1)]


def test_ties_split_into_whole_halves(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 1, "y")], "k string, v int, w string")
    kept, surplus = latest_per_key(df, ["k"], [F.col("v")])
    assert sorted(rows(kept) + rows(surplus)) == rows(df)


def test_top_one_prunes_before_the_exchange(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    plan = latest_per_key(df, ["k"], [F.col("id")])[0]._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_replays(spark, rows):
    batch, seen = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(2,), (9,)], "k int")
    fresh, replayed = without_replays(batch, seen, ["k"])
    assert rows(fresh) == [(1,), (3,)] and rows(replayed) == [(2,)]


def test_codes_and_personal_fields(spark, rows):
    df = spark.createDataFrame([(" gbp ", "x "), (None, "y")], "currency string, note string")
    assert rows(standardise(df, ["currency", "absent"])) == [(None, "y"), ("GBP", "x ")]
    people = spark.createDataFrame([("1", " A@B.com", "07123456789", "Ann"), ("2", None, None, None), ("3", "a@b.com", "12", "Bo")], "id string, email string, phone string, name string")
    out = {r["id"]: r for r in protect(people, {"hash": ["email"], "mask": ["phone"], "drop": ["name"]}).collect()}
    assert out["1"]["email_hash"] == out["3"]["email_hash"] and out["2"]["email_hash"] is None
    assert [out[k]["phone_masked"] for k in "123"] == ["*******6789", None, "12"]
    assert set(out["1"].asDict()) == {"id", "email_hash", "phone_masked"}


def test_conversion(spark):
    df = spark.createDataFrame([(D("100.00"), "USD"), (D("1.00"), "XXX"), (D("1.00"), None), (None, "GBP")], "amount decimal(18,2), currency string")
    assert [r["amount_gbp"] for r in convert(df, {"GBP": 1.0, "USD": 0.79}).collect()] == [D("79.00"), None, None, None]


def test_digest_tells_null_from_empty(spark):
    df = spark.createDataFrame([(None, "a"), ("", "a")], "x string, y string")
    assert df.select(row_digest(["x", "y"]).alias("d")).distinct().count() == 2


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(spark, rows, how):
    left = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("z", 2), (None, 3)], "k string, i int")
    right = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("q", "w")], "k string, v string")
    assert rows(salted_join(left, right, "k", 4, how)) == rows(left.join(right, "k", how))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_large_right_side_is_merged_instead_of_broadcast(spark, rows, monkeypatch):
    """Found at 60 times sf0.1: 9 million rows were sent to the driver to be broadcast."""
    own = joins.strategy_session(spark, "broadcast")
    left = own.range(3000).select((F.col("id") % 700).alias("k"), "id")
    right = own.range(500).select(F.col("id").alias("k"), F.concat(F.lit("t"), "id").alias("t"), F.array("id").alias("a"))
    small = joins.strategy_join(left, right, "k", "broadcast")
    assert "BroadcastHashJoin" in plan_of(small)
    for limit in (1000, 500 * 96):  # by the rows alone, and only when their texts are measured
        monkeypatch.setattr(joins, "broadcast_bytes", lambda spark, limit=limit: limit)
        large = joins.strategy_join(left, right, "k", "broadcast")
        assert "SortMergeJoin" in plan_of(large) and "Broadcast" not in plan_of(large)
        assert rows(large) == rows(small)
    monkeypatch.setattr(joins, "broadcast_bytes", lambda spark: 500 * 128)
    assert joins.fits_broadcast(right) and joins.fits_broadcast(right.limit(0))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_the_repeated_side_of_a_salted_join_is_not_broadcast(spark, how):
    """Found at 60 times sf0.1: the planner took the right side for a sixteenth of its rows and broadcast 17 million."""
    left, right = spark.range(3000).select((F.col("id") % 700).alias("k"), "id"), spark.range(500).select(F.col("id").alias("k"))
    plan = plan_of(salted_join(left, right, "k", how=how))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_salted_join_refuses_right_rows(spark):
    with pytest.raises(ValueError):
        salted_join(spark.range(1), spark.range(1), "id", how="full")


def _rule(**kw):
    return RuleSpec(**kw)


RULES = [
    _rule(name="required", type="not_null", columns=("txn_id", "amount")),
    _rule(name="positive", type="range", column="amount", min=0.01),
    _rule(name="currency", type="accepted_values", column="currency", values=("GBP", "USD")),
    _rule(name="account", type="foreign_key", column="account_id", ref_table="accounts", ref_column="account_id"),
    _rule(name="small", type="expression", expr="amount < 1000", severity="warn"),
]


def _batch(spark):
    data = [("t1", "A", D("5.00"), "GBP"), ("t2", "A", D("5000.00"), "USD"), (None, "A", D("1.00"), "GBP"), ("t4", "A", D("-1.00"), "GBP"), ("t5", "A", D("1.00"), "XXX"), ("t6", "Z", D("1.00"), None)]
    return spark.createDataFrame(data, "txn_id string, account_id string, amount decimal(18,2), currency string")


def _refs(spark):
    return {"accounts": spark.createDataFrame([("A",), ("A",), (None,)], "account_id string")}


def test_halves_with_reasons(spark, rows):
    df = _batch(spark)
    with rules.divided(df, RULES, _refs(spark)) as parts:
        assert parts.total_rows == 6 and parts.rejected_rows == 4
        assert [r["txn_id"] for r in parts.valid.orderBy("txn_id").collect()] == ["t1", "t2"]
        assert parts.valid.columns == df.columns
        reasons = {r["txn_id"]: r["_dq_errors"] for r in parts.rejected.collect()}
        assert reasons == {None: ["required"], "t4": ["positive"], "t5": ["currency"], "t6": ["account"]}
        assert {r["rule"]: r["failed_rows"] for r in parts.report} == {"required": 1, "positive": 1, "currency": 1, "account": 1, "small": 1}
    judged = rules.judge(df, RULES, _refs(spark))
    assert [tuple(r) for r in rules.report(judged, RULES).collect()] == [tuple(r.values()) for r in parts.report]
    assert judged.where(F.size(rules.names(RULES, "warn")) > 0).count() == 1


def test_too_many_errors_stop_the_batch(spark):
    with pytest.raises(rules.TooManyErrors) as e, rules.divided(_batch(spark), RULES, _refs(spark), max_error_rate=0.1):
        pass
    assert len(e.value.report) == len(RULES)
    with rules.divided(_batch(spark), RULES, _refs(spark), max_error_rate=4 / 6, cache=False) as parts:  # only above
        assert parts.rejected_rows == 4


def test_unique_fails_all_and_empty_passes(spark):
    own = [_rule(name="u", type="unique", columns=("id",)), _rule(name="e", type="regex", column="email", pattern=r"^[^@\s]+@[^@\s]+$", severity="warn")]
    df = spark.createDataFrame([("1", "a@b"), ("1", "bad"), ("2", None), (None, "c@d"), (None, "e@f")], "id string, email string")
    with rules.divided(df, own) as parts:
        assert parts.rejected_rows == 4 and [r["failed_rows"] for r in parts.report] == [4, 1]
    with rules.divided(df.limit(0), own, max_error_rate=0.0) as parts:
        assert parts.total_rows == 0 and parts.report[0]["pass_rate"] == 1.0


def test_rules_are_checked_when_declared(spark):
    with pytest.raises(ValueError):
        _rule(name="x", type="no_such")
    with pytest.raises(ValueError):
        _rule(name="x", type="range")
    with pytest.raises(ValueError):
        rules.judge(_batch(spark), [RULES[3]], {})
    raw = {"sources": {}, "quality": {"d": {"rules": [{"name": "x", "type": "not_null", "columns": ["a"]}] * 2}}}
    with pytest.raises(ValueError):
        parse(raw)
    with pytest.raises(KeyError):
        parse({"sources": {}}).source("none")


def test_expression_uses_the_batch_time(spark):
    own = _rule(name="past", type="expression", expr="ts <= as_of()")
    df = spark.createDataFrame([(datetime(2026, 1, 1),), (datetime(2030, 1, 1),), (None,)], "ts timestamp")
    assert df.count() - rules.halves(rules.judge(df, [own], as_of=datetime(2027, 1, 1)), [own])[0].count() == 1


def test_balance(spark):
    df = spark.createDataFrame([(D("1.10"),), (D("2.20"),), (None,)], "amount decimal(18,2)")
    parts = [df.where("amount > 2"), df.where("amount <= 2 or amount is null")]
    assert balance.reconcile("d", df, parts, "amount").balanced
    with pytest.raises(balance.OutOfBalance):
        balance.reconcile("d", df, parts[:1], "amount")
    assert balance.reconcile("d", df.limit(0), [df.limit(0)], "amount").balanced


def _changes(spark, data):
    return spark.createDataFrame(data, "k string, city string, row_hash string, at timestamp")


def test_history(spark, rows):
    how = {"key": "k", "change_ts": "at"}
    d1, d2, d0 = datetime(2026, 1, 1), datetime(2026, 1, 2), datetime(2025, 1, 1)
    first = history.apply_changes(None, _changes(spark, [("a", "x", "h1", d1), ("b", "x", "h1", d1), ("c", "x", "h1", d1)]), batch_id="1", **how)
    assert first.counts()["insert"] == 3
    second = history.apply_changes(first.dimension, _changes(spark, [("a", "y", "h2", d2), ("b", "x", "h1", d2), ("c", "z", "h3", d0), ("n", "q", "h4", d2)]), batch_id="2", **how)
    assert second.counts() == {"insert": 1, "update": 1, "stale": 1, "same": 1, "untouched": 0}
    got = rows(second.dimension.select("k", "city", "effective_from", "effective_to", "is_current", "_batch_id"))
    assert got == [("a", "x", d1, d2, False, "1"), ("a", "y", d2, None, True, "2"), ("b", "x", d1, None, True, "1"), ("c", "x", d1, None, True, "1"), ("n", "q", d2, None, True, "2")]
    again = history.apply_changes(second.dimension, _changes(spark, [("a", "y", "h2", d2)]), batch_id="3", **how)
    assert rows(again.dimension) == rows(second.dimension)


def test_features_see_only_the_past(spark):
    t = [datetime(2026, 9, 1, 10, 0, 0), datetime(2026, 9, 1, 10, 30, 0), datetime(2026, 9, 2, 3, 0, 0), datetime(2026, 9, 2, 3, 0, 0)]
    data = [("t1", "A", "M", t[0], D("10.00"), "CARD", "GBP", "2026-09-01"), ("t2", "A", "M", t[1], D("50.00"), "CARD", "USD", "2026-09-01"), ("t3", "A", "N", t[2], D("30.00"), "CARD", "GBP", "2026-09-02"), ("t4", "A", "N", t[3], D("1.00"), "CARD", "GBP", "2026-09-02")]
    df = spark.createDataFrame(data, "txn_id string, account_id string, merchant_id string, txn_ts timestamp, amount_gbp decimal(18,2), channel string, currency string, ingest_date string")
    out = {r["txn_id"]: r for r in features.behaviour(df, 30).collect()}
    assert out["t1"]["amount_to_avg_ratio"] is None and out["t2"]["amount_to_avg_ratio"] == D("5.000")
    assert out["t2"]["txn_count_prev_1h"] == 1 and out["t3"]["txn_count_prev_1h"] == 0
    assert out["t3"]["spend_prev_24h_gbp"] == out["t4"]["spend_prev_24h_gbp"] == D("60.00")  # peers of a second don't see each other
    assert [out[f"t{k}"]["seconds_since_prev_txn"] for k in (1, 2, 4)] == [None, 1800, 0]
    assert [out[f"t{k}"]["is_first_txn_at_merchant"] for k in (1, 2, 3, 4)] == [True, False, True, False]
    assert out["t3"]["is_night_txn"] and not out["t1"]["is_night_txn"] and out["t2"]["is_foreign_currency"]
    assert features.behaviour(df, 30)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_store(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    assert store.read(spark, path) is None
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, ingest_date string")
    store.put_partition(df.where("x = 1"), path, {"ingest_date": "d1"})
    store.put_partition(df.where("x = 2"), path, {"ingest_date": "d2"})
    assert rows(store.read(spark, path).select("x")) == [(1,), (2,)]
    store.put_partition(df.where("x > 5"), path, {"ingest_date": "d2"})  # no rows: the old ones must go
    assert rows(store.read(spark, path).select("x")) == [(1,)]
    store.replace(store.read(spark, path).select((F.col("x") + 1).alias("x")), path)
    assert rows(store.read(spark, path)) == [(2,)]
    assert store.latest_snapshot(df.withColumn("ingest_date", F.lit("2026-01-02")), "2026-01-01").count() == 0


def test_the_graph_is_walked_in_parallel_with_retries():
    import threading

    seen, lock, both = [], threading.Lock(), threading.Barrier(2, timeout=20)

    def work(node):
        if node in ("b", "c"):
            both.wait()  # only if they run side by side
        with lock:
            seen.append(node)
        if node == "d" and seen.count("d") < 3:
            raise OSError("once more")

    walk({"b": ("a",), "c": ("a",), "d": ("b", "c"), "a": ()}, work, retries=2)
    assert seen[0] == "a" and set(seen[1:3]) == {"b", "c"} and seen[3:] == ["d", "d", "d"]
    tries = []

    def fails(node):
        tries.append(node)
        raise rules.TooManyErrors(1, 2, 0.1, [])

    with pytest.raises(rules.TooManyErrors):
        walk({"a": (), "b": ("a",)}, fails, retries=5)
    assert tries == ["a"]


def test_graph_and_trigger():
    assert STAGES[0] == "bronze" and STAGES[-1] == "gold" and set(STAGES) == set(GRAPH)
    assert shift("2026-03-01", -1) == "2026-02-28"
    assert trigger_date("landing/transactions/ingest_date=2026-09-01/_SUCCESS") == "2026-09-01"
    assert trigger_date("landing/transactions/ingest_date=2026-09-01/part-0") is None
