"""What must hold of any run over generated days, whatever the days hold."""

import dataclasses
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import tierflow.plans.stages as stages
from tierflow.operators.rules import TooManyErrors
from tierflow.plans.audit import report
from tierflow.sources import landing, store, synth
from tierflow.spec import load

SIZES = {"n_txns": 1500, "n_customers": 300, "n_accounts": 1200, "n_merchants": 20}


class Lake:
    """Layers in a folder of their own, in a session of their own."""

    def __init__(self, spark, folder, days, **sizes):
        self.spark, self.days = spark.newSession(), days
        stages.adopt(self.spark)
        self.spec = dataclasses.replace(load(str(Path(stages.__file__).with_name("banking.yaml"))), base_path=str(folder))
        synth.land(self.spark, self.spec, days, **(SIZES | sizes))

    def run(self, *days):
        for day in days:
            stages.run(self.spark, self.spec, day)
        return self

    def table(self, layer, name):
        return store.read(self.spark, self.spec.path(layer, name))

    def counts(self, layer, name):
        found = self.table(layer, name)
        return {} if found is None else {r[0]: r[1] for r in found.groupBy("ingest_date").count().collect()}

    def digest(self, layer, name):
        df = self.table(layer, name)
        df = df.select(*sorted(set(df.columns) - {"_ingest_ts", "_batch_id", "_source_file"}))
        return df.select(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    days = ["2026-02-27", "2026-02-28", "2026-03-01"]  # over the end of a month
    return Lake(spark, tmp_path_factory.mktemp("lake"), days).run(*days)


def test_every_line_that_was_delivered_is_in_one_place(lake):
    for day in lake.days:
        raw = landing.read_day(lake.spark, lake.spec, "transactions", day).cache()
        lines, bad = raw.count(), raw.where(F.col(landing.CORRUPT).isNotNull()).count()
        raw.unpersist()
        places = [("silver", "transactions"), ("quarantine", "transactions"), ("quarantine", "transactions_duplicates"), ("quarantine", "transactions_unparseable")]
        held = [lake.counts(*p).get(day, 0) for p in places]
        assert sum(held) == lines and held[3] == bad == synth.BAD_LINES
        assert lake.counts("bronze", "transactions")[day] == lines - bad


def test_money_is_conserved(lake):
    def total(layer, name):
        return lake.table(layer, name).agg(F.sum("amount")).first()[0] or 0

    out = [total("silver", "transactions"), total("quarantine", "transactions"), total("quarantine", "transactions_duplicates")]
    assert sum(out) == total("bronze", "transactions")
    spent = lake.table("silver", "transactions").where("status = 'COMPLETED'").join(lake.table("silver", "accounts").select("account_id"), "account_id")
    assert lake.table("gold", "customer_daily_spend").agg(F.sum("total_spend_gbp")).first()[0] == spent.agg(F.sum("amount_gbp")).first()[0]


def test_late_rows_reach_the_day_they_happened_on(lake):
    first, second = lake.days[:2]
    silver = lake.table("silver", "transactions").where("status = 'COMPLETED'").join(lake.table("silver", "accounts").select("account_id"), "account_id")
    late = silver.where(F.col("txn_date") < F.to_date("ingest_date"))
    assert late.count() > 0
    want = {str(r[0]): r[1] for r in silver.groupBy("txn_date").count().collect()}
    got = {r[0]: r[1] for r in lake.table("gold", "customer_daily_spend").groupBy("txn_date").agg(F.sum("txn_count")).collect()}
    assert got == want and min(got) < first <= second


def test_a_transaction_is_published_once(lake):
    silver = lake.table("silver", "transactions")
    assert silver.groupBy("txn_id").count().where("count > 1").isEmpty()
    again = lake.table("quarantine", "transactions_duplicates").join(silver.select("txn_id", F.col("ingest_date").alias("first")), "txn_id")
    assert again.where("ingest_date > first").count() > 0 and again.where("ingest_date = first").count() > 0


def test_a_customer_has_one_open_version_and_no_raw_fields(lake):
    dim = lake.table("silver", "customers_scd2")
    per = dim.groupBy("customer_id").agg(F.count_if("is_current").alias("open"), F.count(F.lit(1)).alias("n"))
    assert per.where("open <> 1").isEmpty() and per.where("n > 1").count() > 0
    ends = dim.where("not is_current").select("customer_id", F.col("effective_to").alias("at")).exceptAll(dim.select("customer_id", F.col("effective_from").alias("at")))
    assert ends.isEmpty()  # a version ends where the next begins
    assert not {"email", "phone", "first_name", "last_name"} & set(dim.columns)


def test_a_rerun_with_fewer_rows_takes_the_others_away(spark, tmp_path):
    day = "2026-05-05"
    lake = Lake(spark, tmp_path, [day]).run(day)
    names = [("silver", "transactions"), ("quarantine", "transactions"), ("gold", "txn_fraud_features")]
    before = [lake.digest(*n) for n in names]
    assert [lake.run(day).digest(*n) for n in names] == before
    synth.land(lake.spark, lake.spec, [day], **(SIZES | {"n_txns": 400}))
    lake.run(day)
    assert lake.counts("silver", "transactions")[day] < 410
    assert lake.table("gold", "txn_fraud_features").count() == lake.counts("silver", "transactions")[day]


def test_an_old_day_run_again_keeps_what_came_later(lake):
    names = [("silver", "transactions"), ("gold", "customer_daily_spend"), ("gold", "merchant_category_daily")]
    before = [lake.digest(*n) for n in names]
    lake.run(lake.days[1], lake.days[2])
    assert [lake.digest(*n) for n in names] == before


def test_a_report_prints_and_lines_are_json(lake, capsys, monkeypatch):
    import json

    from tierflow.plans import audit, show_audit

    monkeypatch.setattr(show_audit, "open_session", lambda *_: type("Kept", (), {"stop": lambda self: None, "__getattr__": lambda self, n: getattr(lake.spark, n)})())
    show_audit.main(["--run-date", lake.days[0], "--base-path", lake.spec.base_path])
    out = capsys.readouterr().out
    assert all(t in out for t in ("pipeline_runs", "dq_results", "reconciliation", "txn_account_exists"))
    record = audit.logging.LogRecord("x", 20, "f", 1, "done %d", (3,), None)
    record.context = {"rows": 5}
    line = json.loads(audit.JsonLines().format(record))
    assert line["message"] == "done 3" and line["rows"] == 5 and line["level"] == "INFO"


def test_the_trail_tells_what_happened(spark, tmp_path):
    day = "2026-06-01"
    lake = Lake(spark, tmp_path / "a", [day], n_accounts=4000)
    strict = {**lake.spec.quality, "accounts": dataclasses.replace(lake.spec.quality["accounts"], max_error_rate=0.0)}
    lake.spec = dataclasses.replace(lake.spec, quality=strict)
    with pytest.raises(TooManyErrors):
        lake.run(day)
    found = report(lake.spark, lake.spec, day)
    failed = found["pipeline_runs"].where("status = 'FAILED'").collect()
    assert [(r["stage"], r["dataset"]) for r in failed] == [("silver_reference", "accounts")]
    assert found["dq_results"].where("rule = 'acct_type_valid' and failed_rows > 0 and pass_rate < 1").count() == 1
    nothing = Lake(spark, tmp_path / "b", []).run(day)  # no feed came
    assert {r["status"] for r in report(nothing.spark, nothing.spec, day)["pipeline_runs"].collect()} == {"SUCCESS"}
    assert nothing.table("silver", "transactions") is None
