"""Queries over whole batches: the driver's tables delivered as three days of feeds, run through all layers.

Deliveries are arithmetic on ids, so the SQL can say what each layer must hold: rows sent twice, sent
again the day after, late, negative, of unknown accounts, in padded codes, and lines that don't parse.
"""

from __future__ import annotations

import dataclasses
import logging
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.plans import stages
from tierflow.plans.audit import logger
from tierflow.sources import landing, scratch, store
from tierflow.spec import PipelineSpec, load

DAYS = ("2026-09-01", "2026-09-02", "2026-09-03")
BAD_LINES = 2
_RUNS: dict[tuple[str, str], PipelineSpec] = {}

# What both languages read alike: a delivered transaction by its order.
_TXN = """
    SELECT concat('T', CAST(o_orderkey AS VARCHAR(20))) AS txn_id, concat('A', CAST(o_custkey AS VARCHAR(20))) AS account_id,
           concat('M', CAST(o_orderkey % 30 AS VARCHAR(20))) AS merchant_id,
           CAST(CASE WHEN o_orderkey % 110 = 9 THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18,2)) AS amount,
           CASE o_orderkey % 4 WHEN 0 THEN ' gbp' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'INR' END AS currency,
           CASE WHEN o_orderkey % 3 = 0 THEN 'ATM' ELSE 'ONLINE' END AS channel,
           CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'DECLINED' ELSE 'REVERSED' END AS status,
           o_orderkey AS k, o_custkey AS c, CAST(o_orderkey % 3 AS INT) AS day,
           CASE WHEN o_orderkey % 50 = 7 THEN 1 ELSE 0 END AS late
    FROM orders"""


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deliver(spark: SparkSession, spec: PipelineSpec, sf_dir: str) -> None:
    """Write the feeds of all days as the spec's sources want them."""
    orders, customer, nation = (_t(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    txns = spark.sql(_TXN.replace("FROM orders", "FROM {o}"), o=orders)
    at = lambda day: F.date_sub(F.lit(day).cast("date"), F.col("late").cast("int")).cast("timestamp") + F.make_interval(secs=F.col("k") * 37 % 86_400)
    person = customer.select(
        F.concat(F.lit("C"), "c_custkey").alias("customer_id"), F.col("c_name").alias("first_name"), F.lit("x").alias("last_name"),
        F.concat(F.lit("p"), "c_custkey", F.lit("@example.com")).alias("email"), F.lpad(F.col("c_custkey").cast("string"), 11, "0").alias("phone"),
        F.concat(F.lit("N"), "c_nationkey").alias("city"), F.lit("RETAIL").alias("segment"), F.col("c_custkey").alias("k"),
    )

    def put(df: DataFrame, source: str, day: str) -> None:
        own = spec.source(source)
        df.write.format(own.format).options(**own.options).save(f"{spec.path('landing', source)}/ingest_date={day}")

    for number, day in enumerate(DAYS):
        moved = person if not number else person.where(F.col("k") % (5 * number) == 0).withColumn("city", F.lit(f"Moved{number}"))
        put(moved.withColumn("updated_at", F.lit(f"{day} 06:00:00").cast("timestamp")).drop("k"), "customers", day)
        held = customer.where("c_custkey % 97 <> 0")
        put(held.select(F.concat(F.lit("A"), "c_custkey").alias("account_id"), F.concat(F.lit("C"), "c_custkey").alias("customer_id"), F.lit("CURRENT").alias("account_type"), F.lit("2020-01-01").cast("date").alias("opened_date"), F.lit("ACTIVE").alias("status")), "accounts", day)
        put(nation.select(F.concat(F.lit("M"), "n_nationkey").alias("merchant_id"), F.col("n_name").alias("merchant_name"), F.concat(F.lit("G"), "n_regionkey").alias("merchant_category"), F.lit("GB").alias("country")), "merchants", day)
        own = txns.where(F.col("day") == number).withColumn("txn_ts", at(day))
        own = own.unionByName(own.where("k % 40 = 3"))
        if number:
            own = own.unionByName(txns.where((F.col("day") == number - 1) & (F.col("k") % 60 == 5)).withColumn("txn_ts", at(DAYS[number - 1])))
        put(own.drop("k", "c", "day", "late"), "transactions", day)
        spark.range(BAD_LINES).select(F.format_string('{"txn_id": "broken%d', "id").alias("value")).coalesce(1).write.mode("append").text(f"{spec.path('landing', 'transactions')}/ingest_date={day}")


def lake(spark: SparkSession, sf_dir: str) -> tuple[SparkSession, PipelineSpec]:
    """A session with the layers' settings and the spec of the layers of sf_dir, run once for each application."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    stages.adopt(own)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        base = f"{scratch.root(spark)}/tierflow/flow-{uuid.uuid4().hex}"
        spec = dataclasses.replace(load(str(Path(stages.__file__).with_name("banking.yaml"))), base_path=base)
        deliver(own, spec, sf_dir)
        log = logger("tierflow")
        level = log.level
        log.setLevel(logging.WARNING)  # a query's caller may use stdout itself
        try:
            for day in DAYS:
                stages.run(own, spec, day)
        finally:
            log.setLevel(level)
        _RUNS[key] = spec
    return own, _RUNS[key]


def _table(spark: SparkSession, sf_dir: str, layer: str, name: str) -> DataFrame:
    own, spec = lake(spark, sf_dir)
    return store.read(own, spec.path(layer, name))


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "silver", "transactions").select("txn_id", "ingest_date", F.col("txn_date").cast("string").alias("txn_date"), "currency", "amount_gbp")


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "quarantine", "transactions").select("ingest_date", F.explode("_dq_errors").alias("reason"))
    return rows.groupBy("ingest_date", "reason").agg(F.count(F.lit(1)).alias("n"))


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "quarantine", "transactions_duplicates").groupBy("ingest_date").agg(F.count(F.lit(1)).alias("n"))


def gold_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "gold", "customer_daily_spend").select("customer_id", "txn_date", "txn_count", "total_spend_gbp", "atm_withdrawal_gbp")


def gold_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "gold", "merchant_category_daily").select("merchant_category", "txn_date", "txn_count", "total_spend_gbp")


def gold_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "gold", "txn_fraud_features").select("txn_id", "ingest_date", "is_first_txn_at_merchant", "is_foreign_currency")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "silver", "customers_scd2").select("customer_id", "city", F.col("effective_from").cast("date").cast("string").alias("since"), F.col("effective_to").cast("date").cast("string").alias("until"), "is_current", "phone_masked")


def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "audit", "reconciliation").select("run_date", "source_rows", "target_rows", "balanced")


def files(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """What reading the delivered files themselves gives: good and bad lines of each day."""
    own, spec = lake(spark, sf_dir)
    days = []
    for day in DAYS:
        raw = landing.read_day(own, spec, source, day)
        key = F.col(spec.source(source).primary_key[0])
        days.append(raw.select(F.lit(day).alias("ingest_date"), F.when(F.col(landing.CORRUPT).isNull(), key).alias("id"), F.col(landing.CORRUPT).isNull().alias("good"), F.col("_source_file").isNotNull().alias("named")))
    out = days[0]
    for more in days[1:]:
        out = out.unionByName(more)
    return out.groupBy("ingest_date", "good", "named").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


_DAY = "CASE {0} WHEN 0 THEN '2026-09-01' WHEN 1 THEN '2026-09-02' WHEN 2 THEN '2026-09-03' END"
_RATE = "CASE k % 4 WHEN 0 THEN CAST(1.0 AS DECIMAL(18,6)) WHEN 1 THEN CAST(0.79 AS DECIMAL(18,6)) WHEN 2 THEN CAST(0.85 AS DECIMAL(18,6)) ELSE CAST(0.0094 AS DECIMAL(18,6)) END"
_GOOD = f"""WITH t AS (SELECT *, {_DAY.format("day")} AS ingest_date, k % 110 <> 9 AS positive, c % 97 <> 0 AS known,
        strftime(CAST({_DAY.format("day")} AS DATE) - CAST(late AS INTEGER), '%Y-%m-%d') AS txn_date,
        CAST(CAST({_DAY.format("day")} AS DATE) - CAST(late AS INTEGER) AS TIMESTAMP) + to_seconds(k * 37 % 86400) AS ts,
        CAST(round(amount * {_RATE}, 2) AS DECIMAL(18,2)) AS amount_gbp FROM ({_TXN})),
    silver AS (SELECT * FROM t WHERE positive AND known)"""
_AGAIN = f"""{_GOOD}, bad AS (SELECT day, positive, known FROM t WHERE NOT (positive AND known)
    UNION ALL SELECT day + 1, positive, known FROM t WHERE NOT (positive AND known) AND k % 60 = 5 AND day < 2)"""

QUERIES = {
    "flow_silver": (silver, f"{_GOOD} SELECT txn_id, ingest_date, txn_date, upper(trim(currency)) AS currency, amount_gbp FROM silver"),
    "flow_quarantine": (quarantine, f"""{_AGAIN} SELECT {_DAY.format("day")} AS ingest_date, 'txn_amount_positive' AS reason, count(*) AS n FROM bad WHERE NOT positive GROUP BY 1
        UNION ALL SELECT {_DAY.format("day")}, 'txn_account_exists', count(*) FROM bad WHERE NOT known GROUP BY 1"""),
    "flow_duplicates": (duplicates, f"""{_GOOD} SELECT ingest_date, count(*) AS n FROM (SELECT ingest_date FROM t WHERE k % 40 = 3
        UNION ALL SELECT {_DAY.format("day + 1")} FROM silver WHERE k % 60 = 5 AND day < 2) GROUP BY 1"""),
    "flow_gold_daily": (gold_daily, f"""{_GOOD} SELECT concat('C', CAST(c AS VARCHAR(20))) AS customer_id, txn_date, count(*) AS txn_count, CAST(sum(amount_gbp) AS DECIMAL(28,2)) AS total_spend_gbp,
        CAST(sum(CASE WHEN channel = 'ATM' THEN amount_gbp ELSE 0 END) AS DECIMAL(28,2)) AS atm_withdrawal_gbp FROM silver WHERE status = 'COMPLETED' GROUP BY 1, 2"""),
    "flow_gold_category": (gold_category, f"""{_GOOD} SELECT CASE WHEN k % 30 < 25 THEN concat('G', CAST(n_regionkey AS VARCHAR(20))) ELSE 'UNKNOWN' END AS merchant_category, txn_date, count(*) AS txn_count,
        CAST(sum(amount_gbp) AS DECIMAL(28,2)) AS total_spend_gbp FROM silver LEFT JOIN nation ON k % 30 = n_nationkey WHERE status = 'COMPLETED' GROUP BY 1, 2"""),
    "flow_gold_features": (gold_features, f"""{_GOOD} SELECT txn_id, ingest_date,
        NOT EXISTS (SELECT 1 FROM silver o WHERE o.account_id = s.account_id AND o.merchant_id = s.merchant_id AND o.day <= s.day AND (o.ts, o.txn_id) < (s.ts, s.txn_id)) AS is_first_txn_at_merchant,
        upper(trim(currency)) <> 'GBP' AS is_foreign_currency FROM silver s"""),
    "flow_history": (history, """WITH v AS (SELECT c_custkey AS k, c_nationkey, 0 AS n FROM customer UNION ALL SELECT c_custkey, c_nationkey, 1 FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, c_nationkey, 2 FROM customer WHERE c_custkey % 10 = 0)
        SELECT concat('C', CAST(k AS VARCHAR(20))) AS customer_id, CASE n WHEN 0 THEN concat('N', CAST(c_nationkey AS VARCHAR(20))) ELSE concat('Moved', CAST(n AS VARCHAR(20))) END AS city,
        CASE n WHEN 0 THEN '2026-09-01' WHEN 1 THEN '2026-09-02' ELSE '2026-09-03' END AS since,
        CASE lead(n) OVER (PARTITION BY k ORDER BY n) WHEN 1 THEN '2026-09-02' WHEN 2 THEN '2026-09-03' END AS until,
        lead(n) OVER (PARTITION BY k ORDER BY n) IS NULL AS is_current, '*******' || right(lpad(CAST(k AS VARCHAR), 11, '0'), 4) AS phone_masked FROM v"""),
    "flow_balance": (balance, f"""{_GOOD}, sent AS (SELECT day FROM t UNION ALL SELECT day FROM t WHERE k % 40 = 3 UNION ALL SELECT day + 1 FROM t WHERE k % 60 = 5 AND day < 2)
        SELECT {_DAY.format("day")} AS run_date, count(*) AS source_rows, count(*) AS target_rows, true AS balanced FROM sent GROUP BY day"""),
    "landing_json": (lambda spark, sf_dir: files(spark, sf_dir, "transactions"), f"""{_GOOD}, sent AS (SELECT day, txn_id FROM t UNION ALL SELECT day, txn_id FROM t WHERE k % 40 = 3 UNION ALL SELECT day + 1, txn_id FROM t WHERE k % 60 = 5 AND day < 2)
        SELECT {_DAY.format("day")} AS ingest_date, true AS good, true AS named, count(*) AS n, count(DISTINCT txn_id) AS ids FROM sent GROUP BY day
        UNION ALL SELECT {_DAY.format("day")}, false, true, {BAD_LINES}, 0 FROM (VALUES (0), (1), (2)) d(day)"""),
    "landing_csv": (lambda spark, sf_dir: files(spark, sf_dir, "customers"), """SELECT '2026-09-01' AS ingest_date, true AS good, true AS named, count(*) AS n, count(DISTINCT c_custkey) AS ids FROM customer
        UNION ALL SELECT '2026-09-02', true, true, count(*), count(*) FROM customer WHERE c_custkey % 5 = 0
        UNION ALL SELECT '2026-09-03', true, true, count(*), count(*) FROM customer WHERE c_custkey % 10 = 0"""),
}
