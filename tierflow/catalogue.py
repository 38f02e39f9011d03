"""The named queries of the engine over the driver's tables, and the SQL that gives the same rows.

The tables have no currencies, channels, batches or defects, so those are derived from ids, alike in
both languages. Sums are exact decimals; averages are compared in integer cents, half up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow import flow
from tierflow.functions.columns import convert, protect, row_digest, standardise
from tierflow.operators import balance, features, history, marts
from tierflow.operators import rules as quality
from tierflow.operators.dedupe import latest_per_key, without_replays
from tierflow.operators.joins import salted_join, strategy_join, strategy_session
from tierflow.sources import landing, store, synth
from tierflow.spec import RuleSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

RATES = {"GBP": 1.0, "USD": 0.79, "EUR": 0.85, "INR": 0.0094}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(expr: str, values: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


# Orders as transactions; both languages read the same text.
_TXNS = f"""
    SELECT o_orderkey AS txn_id, o_custkey AS account_id, o_orderkey % 50 AS merchant_id,
           CAST(o_totalprice AS DECIMAL(18,2)) AS amount_gbp, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
           {_case("o_orderkey % 4", synth.CHANNELS)} AS channel,
           {_case("o_orderkey % 5", ["GBP", "USD", "EUR", "INR", "XXX"])} AS currency,
           CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'DECLINED' ELSE 'REVERSED' END AS status,
           o_orderdate AS txn_ts
    FROM orders"""
_EVENTS = """
    SELECT event_id AS txn_id, user_id AS account_id, event_type AS merchant_id, CAST(value AS DECIMAL(18,2)) AS amount_gbp,
           event_type AS channel, CASE WHEN event_id % 9 = 0 THEN 'USD' ELSE 'GBP' END AS currency,
           CASE WHEN event_id % 10 < 8 THEN 'COMPLETED' ELSE 'DECLINED' END AS status, ts AS txn_ts,
           CAST(CAST(ts AS DATE) + CAST(CASE WHEN event_id % 50 < 48 THEN 0 ELSE event_id % 2 + 1 END AS INT) AS VARCHAR(10)) AS ingest_date
    FROM events"""


def _sql(spark: SparkSession, sf_dir: str, table: str, text: str) -> DataFrame:
    """Run a shared text over one table of sf_dir, without a name in the session's catalogue."""
    return spark.sql(text.replace(f"FROM {table}", "FROM {source}"), source=_t(spark, sf_dir, table))


def _txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "orders", _TXNS)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "events", _EVENTS)


_CENTS = "CAST(CAST({0} AS DECIMAL(38,2)) * 100 AS HUGEINT)"


# marts


@query(
    "daily_spend",
    f"""WITH txns AS ({_TXNS}), accounts AS (SELECT c_custkey AS account_id, c_nationkey AS customer_id FROM customer)
    SELECT customer_id, strftime(txn_ts, '%Y-%m-%d') AS txn_date, count(*) AS txn_count,
           CAST(sum(amount_gbp) AS DECIMAL(28,2)) AS total_spend_gbp,
           CAST((2 * {_CENTS.format("sum(amount_gbp)")} + count(*)) // (2 * count(*)) AS BIGINT) AS avg_cents,
           max(amount_gbp) AS max_txn_gbp,
           CAST(sum(CASE WHEN channel = 'ATM' THEN amount_gbp ELSE 0 END) AS DECIMAL(28,2)) AS atm_withdrawal_gbp,
           CAST(sum(CASE WHEN channel = 'ONLINE' THEN amount_gbp ELSE 0 END) AS DECIMAL(28,2)) AS online_spend_gbp,
           count(DISTINCT merchant_id) AS distinct_merchants
    FROM txns JOIN accounts USING (account_id) WHERE status = 'COMPLETED' GROUP BY 1, 2""",
)
def daily_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_nationkey").alias("customer_id"))
    out = marts.customer_daily(_txns(spark, sf_dir).where("status = 'COMPLETED'"), accounts)
    return out.withColumn("avg_cents", (F.col("avg_txn_gbp") * 100).cast("long")).drop("avg_txn_gbp")


_CATEGORY = """WITH dim AS (SELECT p_partkey AS merchant_id, p_brand AS merchant_category FROM part WHERE p_partkey % 10 <> 0),
    txns AS (SELECT l_partkey AS merchant_id, l_suppkey AS account_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount_gbp, l_shipdate AS txn_ts FROM lineitem)
    SELECT coalesce(merchant_category, 'UNKNOWN') AS merchant_category, strftime(txn_ts, '%Y-%m-%d') AS txn_date, count(*) AS txn_count,
           CAST(sum(amount_gbp) AS DECIMAL(28,2)) AS total_spend_gbp, count(DISTINCT account_id) AS approx_unique_accounts
    FROM txns LEFT JOIN dim USING (merchant_id) GROUP BY 1, 2"""


def _category(spark: SparkSession, sf_dir: str, exact: bool) -> DataFrame:
    dim = _t(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("merchant_id"), F.col("p_brand").alias("merchant_category"))
    txns = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("merchant_id"), F.col("l_suppkey").alias("account_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount_gbp"), F.col("l_shipdate").alias("txn_ts"))
    return marts.category_daily(txns, dim, exact=exact)


@query("category_daily", _CATEGORY)
def category_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _category(spark, sf_dir, True)


@query("category_daily_approx")
def category_daily_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _category(spark, sf_dir, False)


_ERROR = _CATEGORY.split("SELECT coalesce")[0]


@query("category_daily_error", f"{_ERROR} SELECT coalesce(merchant_category, 'UNKNOWN') AS merchant_category, strftime(txn_ts, '%Y-%m-%d') AS txn_date, count(DISTINCT account_id) AS accounts, true AS within FROM txns LEFT JOIN dim USING (merchant_id) GROUP BY 1, 2")
def category_daily_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate count of every group against the exact one: within five of its standard errors (5 %)."""
    exact, near = (_category(spark, sf_dir, e).select("merchant_category", "txn_date", F.col("approx_unique_accounts").alias(n)) for e, n in ((True, "accounts"), (False, "near")))
    within = F.abs(F.col("near") - F.col("accounts")) <= F.greatest(F.lit(1.0), 0.25 * F.col("accounts"))
    return exact.join(near, ["merchant_category", "txn_date"]).withColumn("within", within).drop("near")


@query("late_touched_dates", f"WITH txns AS ({_EVENTS}) SELECT DISTINCT CAST(txn_ts AS DATE) AS event_date FROM txns WHERE ingest_date = '2024-01-15'")
def late_touched_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.touched_dates(_events(spark, sf_dir), "2024-01-15")


_LATE = f"""WITH txns AS ({_EVENTS}), days AS (SELECT DISTINCT CAST(txn_ts AS DATE) AS d FROM txns WHERE ingest_date = '2024-01-15')
    SELECT strftime(txn_ts, '%Y-%m-%d') AS txn_date, count(*) AS txn_count, CAST(sum(amount_gbp) AS DECIMAL(28,2)) AS total_spend_gbp
    FROM txns WHERE status = 'COMPLETED' AND CAST(txn_ts AS DATE) IN (SELECT d FROM days)"""


def _recomputed(spark: SparkSession, sf_dir: str, backfill: bool) -> DataFrame:
    rows = marts.touched(_events(spark, sf_dir), "2024-01-15", backfill=backfill)
    return rows.groupBy(F.date_format("txn_ts", "yyyy-MM-dd").alias("txn_date")).agg(F.count(F.lit(1)).alias("txn_count"), F.sum("amount_gbp").cast("decimal(28,2)").alias("total_spend_gbp"))


@query("late_recompute", f"{_LATE} AND ingest_date <= '2024-01-15' GROUP BY 1")
def late_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recomputed(spark, sf_dir, False)


@query("late_recompute_backfill", f"{_LATE} GROUP BY 1")
def late_recompute_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recomputed(spark, sf_dir, True)


# features


@query(
    "activity_features",
    f"""WITH txns AS (SELECT *, epoch_us(txn_ts) // 1000000 AS s FROM ({_EVENTS}))
    SELECT txn_id, account_id,
           count(*) OVER (PARTITION BY account_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS txn_count_prev_1h,
           count(*) OVER (PARTITION BY account_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS txn_count_prev_24h,
           CAST(coalesce(sum(amount_gbp) OVER (PARTITION BY account_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(28,2)) AS spend_prev_24h_gbp,
           CAST(s - lag(s) OVER (PARTITION BY account_id ORDER BY s, txn_id) AS BIGINT) AS seconds_since_prev_txn,
           row_number() OVER (PARTITION BY account_id, merchant_id ORDER BY txn_ts, txn_id) = 1 AS is_first_txn_at_merchant,
           hour(txn_ts) BETWEEN 0 AND 5 AS is_night_txn, currency <> 'GBP' AS is_foreign_currency
    FROM txns""",
)
def activity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.behaviour(_events(spark, sf_dir))
    return out.select("txn_id", "account_id", "txn_count_prev_1h", "txn_count_prev_24h", F.col("spend_prev_24h_gbp").cast("decimal(28,2)"), "seconds_since_prev_txn", "is_first_txn_at_merchant", "is_night_txn", "is_foreign_currency")


_FRAME = "OVER (PARTITION BY account_id ORDER BY s RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING)"


@query(
    "activity_averages",
    f"""WITH txns AS (SELECT *, epoch_us(txn_ts) // 1000000 AS s, CAST(amount_gbp * 100 AS BIGINT) AS c FROM ({_EVENTS})),
    w AS (SELECT txn_id, c, sum(c) {_FRAME} AS t, count(*) {_FRAME} AS n FROM txns)
    SELECT txn_id, CAST(CASE WHEN n > 0 THEN sign(t) * ((2 * abs(t) + n) // (2 * n)) END AS BIGINT) AS avg_cents FROM w""",
)
def activity_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.behaviour(_events(spark, sf_dir)).select("txn_id", (F.col("avg_amount_prev_30d_gbp") * 100).cast("long").alias("avg_cents"))


# The mean is a decimal of six digits; the ratio is rounded to three, half away from zero.
_MEAN6 = "sign(t) * ((2 * abs(t) * 10000 + n) // (2 * n))"
_THOUSANDTHS = "CAST(c AS HUGEINT) * 10000000"


@query(
    "activity_ratio",
    f"""WITH txns AS (SELECT *, epoch_us(txn_ts) // 1000000 AS s, CAST(amount_gbp * 100 AS BIGINT) AS c FROM ({_EVENTS})),
    w AS (SELECT txn_id, c, CAST(sum(c) {_FRAME} AS HUGEINT) AS t, CAST(count(*) {_FRAME} AS HUGEINT) AS n FROM txns),
    m AS (SELECT txn_id, c, CASE WHEN n > 0 AND t <> 0 THEN {_MEAN6} END AS mean FROM w)
    SELECT txn_id, CAST(CASE WHEN mean <> 0 THEN sign(c) * sign(mean) * ((2 * abs({_THOUSANDTHS}) + abs(mean)) // (2 * abs(mean))) END AS BIGINT) AS ratio_thousandths FROM m""",
)
def activity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.behaviour(_events(spark, sf_dir)).select("txn_id", (F.col("amount_to_avg_ratio") * 1000).cast("long").alias("ratio_thousandths"))


# duplicates and replays

_RANKED = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem)"
_KEYS = ["l_orderkey", "l_linenumber"]


def _deduped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    order = [F.col("l_shipdate").desc(), *map(F.col, ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))]
    kept, surplus = latest_per_key(_t(spark, sf_dir, "lineitem"), _KEYS, order)
    return tuple(x.select(*_KEYS, "l_partkey", "l_suppkey", "l_shipdate") for x in (kept, surplus))


@query("dedupe_kept", f"{_RANKED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM r WHERE rn = 1")
def dedupe_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deduped(spark, sf_dir)[0]


@query("dedupe_surplus", f"{_RANKED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM r WHERE rn > 1")
def dedupe_surplus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deduped(spark, sf_dir)[1]


# The batch is one day's events and a tenth of the three days before, sent again.
_REPLAY = f"""WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events),
    published AS (SELECT event_id FROM e WHERE day >= DATE '2024-01-12' AND day < DATE '2024-01-15'),
    batch AS (SELECT event_id, user_id FROM e WHERE day = DATE '2024-01-15' OR (day >= DATE '2024-01-12' AND day < DATE '2024-01-15' AND event_id % 10 = 0))
    SELECT event_id, user_id FROM batch WHERE event_id {{}} (SELECT event_id FROM published)"""


def _replayed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("day"))
    before = (F.col("day") >= F.lit("2024-01-12").cast("date")) & (F.col("day") < F.lit("2024-01-15").cast("date"))
    batch = e.where((F.col("day") == F.lit("2024-01-15").cast("date")) | (before & (F.col("event_id") % 10 == 0)))
    return without_replays(batch.drop("day"), e.where(before), ["event_id"])


@query("replay_fresh", _REPLAY.format("NOT IN"))
def replay_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir)[0]


@query("replay_dropped", _REPLAY.format("IN"))
def replay_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir)[1]


# rules

_FAIL = {
    "not_null": (RuleSpec("r", "not_null", columns=("seg", "c_acctbal")), "seg IS NULL OR c_acctbal IS NULL"),
    "range": (RuleSpec("r", "range", column="bal", min=0, max=5000), "coalesce(bal < 0 OR bal > 5000, false)"),
    "accepted": (RuleSpec("r", "accepted_values", column="seg", values=("BUILDING", "MACHINERY")), "seg IS NOT NULL AND seg NOT IN ('BUILDING', 'MACHINERY')"),
    "regex": (RuleSpec("r", "regex", column="c_name", pattern="[02468]$"), "NOT regexp_matches(c_name, '[02468]$')"),
    "expression": (RuleSpec("r", "expression", expr="bal > 100 or seg = 'BUILDING'"), "NOT coalesce(bal > 100 OR seg = 'BUILDING', true)"),
    "unique": (RuleSpec("r", "unique", columns=("c_nationkey", "seg")), "count(*) OVER (PARTITION BY c_nationkey, seg) > 1"),
    "foreign_key": (RuleSpec("r", "foreign_key", column="c_nationkey", ref_table="nation", ref_column="n_nationkey"), "c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0)"),
}
_CUST = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS seg, CASE WHEN c_custkey % 17 <> 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END AS bal FROM customer"


def _cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "customer", _CUST)


def _refs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"nation": _t(spark, sf_dir, "nation").where("n_regionkey <> 0")}


def _rule(rule: RuleSpec) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        judged = quality.judge(_cust(spark, sf_dir), [rule], _refs(spark, sf_dir))
        return judged.where(quality.rejects([rule])).select("c_custkey", "c_nationkey")

    return run


for _name, (_spec, _where) in _FAIL.items():
    query(f"rule_{_name}", f"SELECT c_custkey, c_nationkey FROM (SELECT *, {_where} AS bad FROM ({_CUST})) WHERE bad")(_rule(_spec))

_RULES = [
    RuleSpec("required", "not_null", columns=("seg",)),
    RuleSpec("in_range", "range", column="bal", min=-500, max=9000),
    RuleSpec("segment_known", "accepted_values", severity="warn", column="seg", values=("BUILDING", "MACHINERY", "AUTOMOBILE")),
    RuleSpec("nation_known", "foreign_key", column="c_nationkey", ref_table="nation", ref_column="n_nationkey"),
]
_JUDGED = f"""WITH j AS (SELECT *, seg IS NULL AS required, coalesce(bal < -500 OR bal > 9000, false) AS in_range,
    seg IS NOT NULL AND seg NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AS segment_known,
    c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0) AS nation_known FROM ({_CUST}))"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_cust(spark, sf_dir), _RULES, _refs(spark, sf_dir))


@query("dq_valid", f"{_JUDGED} SELECT c_custkey, bal FROM j WHERE NOT (required OR in_range OR nation_known)")
def dq_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.halves(_judged(spark, sf_dir), _RULES)[0].select("c_custkey", "bal")


@query(
    "dq_rejected",
    f"""{_JUDGED} SELECT c_custkey, array_to_string(list_filter([CASE WHEN required THEN 'required' END, CASE WHEN in_range THEN 'in_range' END,
    CASE WHEN nation_known THEN 'nation_known' END], lambda x: x IS NOT NULL), ',') AS reasons FROM j WHERE required OR in_range OR nation_known""",
)
def dq_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.halves(_judged(spark, sf_dir), _RULES)[1].select("c_custkey", F.array_join("_dq_errors", ",").alias("reasons"))


@query(
    "dq_rule_stats",
    f"{_JUDGED} " + " UNION ALL ".join(f"SELECT '{r.name}' AS rule, '{r.type}' AS rule_type, '{r.severity}' AS severity, count(*) FILTER ({r.name}) AS failed_rows, count(*) AS total_rows FROM j" for r in _RULES),
)
def dq_rule_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_judged(spark, sf_dir), _RULES).drop("pass_rate")


@query("breaker_rate", f"{_JUDGED} SELECT count(*) AS total, count(*) FILTER (required OR in_range OR nation_known) AS rejected, count(*) FILTER (required OR in_range OR nation_known) * 100 > 5 * count(*) AS tripped FROM j")
def breaker_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = quality.tally(_judged(spark, sf_dir), _RULES)
    return one.select("total", "rejected", (F.col("rejected") * 100 > F.col("total") * 5).alias("tripped"))


# reconciliation


@query(
    "recon_balance",
    f"""WITH t AS ({_TXNS}) SELECT 'source' AS side, count(*) AS rows, CAST(sum(amount) AS DECIMAL(38,2)) AS amount FROM t
    UNION ALL SELECT 'target', count(*), CAST(sum(amount) AS DECIMAL(38,2)) FROM t WHERE txn_id % 7 <> 3""",
)
def recon_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _txns(spark, sf_dir)
    return balance.profile(t, [t.where(F.col("txn_id") % 7 == k) for k in (0, 1, 2, 4, 5, 6)], "amount")


# history

_SCD = """WITH dim AS (SELECT c_custkey, c_mktsegment AS seg, TIMESTAMP '2024-01-10 00:00:00' AS f FROM customer WHERE c_custkey % 10 <> 0),
    ch AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS seg,
                  CASE WHEN c_custkey % 6 = 0 THEN TIMESTAMP '2024-01-05 00:00:00' ELSE TIMESTAMP '2024-01-20 00:00:00' END AS f FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0),
    m AS (SELECT coalesce(dim.c_custkey, ch.c_custkey) AS c_custkey, dim.seg AS os, ch.seg AS ns, dim.f AS ofrom, ch.f AS nfrom,
          CASE WHEN ch.c_custkey IS NULL THEN 'untouched' WHEN dim.c_custkey IS NULL THEN 'insert' WHEN dim.seg = ch.seg THEN 'same' WHEN ch.f > dim.f THEN 'update' ELSE 'stale' END AS action
          FROM dim FULL JOIN ch ON dim.c_custkey = ch.c_custkey)"""


def _history(spark: SparkSession, sf_dir: str) -> history.History:
    c = _t(spark, sf_dir, "customer")
    old = c.where("c_custkey % 10 <> 0").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.lit("2024-01-10 00:00:00").cast("timestamp").alias("updated_at"))
    new = c.where("c_custkey % 2 = 0 or c_custkey % 3 = 0").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 3 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("seg"),
        F.when(F.col("c_custkey") % 6 == 0, F.lit("2024-01-05 00:00:00")).otherwise("2024-01-20 00:00:00").cast("timestamp").alias("updated_at"),
    )
    old, new = (x.withColumn("row_hash", row_digest(["seg"])) for x in (old, new))
    first = history.apply_changes(None, old, key="c_custkey", change_ts="updated_at", batch_id="b1").dimension
    return history.apply_changes(first, new, key="c_custkey", change_ts="updated_at", batch_id="b2")


@query(
    "scd2_dimension",
    f"""{_SCD} SELECT c_custkey, os AS seg, ofrom AS effective_from, CASE WHEN action = 'update' THEN nfrom END AS effective_to, action <> 'update' AS is_current, 'b1' AS batch FROM m WHERE action <> 'insert'
    UNION ALL SELECT c_custkey, ns, nfrom, NULL, true, 'b2' FROM m WHERE action IN ('insert', 'update')""",
)
def scd2_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _history(spark, sf_dir).dimension
    return d.select("c_custkey", "seg", F.col("effective_from").cast("timestamp_ntz").alias("effective_from"), F.col("effective_to").cast("timestamp_ntz").alias("effective_to"), "is_current", F.col("_batch_id").alias("batch"))


@query("scd2_counts", f"{_SCD} SELECT action, count(*) AS n FROM m GROUP BY 1")
def scd2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).actions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


# columns


@query("row_digest", "SELECT c_custkey, sha256(concat_ws('||', coalesce(c_name, '~'), coalesce(CAST(nullif(c_nationkey, 3) AS VARCHAR), '~'), coalesce(c_mktsegment, '~'))) AS row_hash FROM customer")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").withColumn("c_nationkey", F.nullif(F.col("c_nationkey"), F.lit(3)))
    return c.select("c_custkey", row_digest(["c_name", "c_nationkey", "c_mktsegment"]).alias("row_hash"))


@query(
    "pii_masked",
    """SELECT c_custkey, sha256(lower(trim(c_name))) AS c_name_hash,
    CASE WHEN c_custkey % 11 <> 0 THEN repeat('*', greatest(length(c_mktsegment) - 4, 0)) || right(c_mktsegment, 4) END AS seg_masked FROM customer""",
)
def pii_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("seg"))
    return protect(c, {"hash": ["c_name"], "mask": ["seg"], "drop": ["c_acctbal"]})


@query(
    "fx_convert",
    f"""WITH t AS ({_TXNS}) SELECT txn_id, currency, CAST(round(amount * CASE currency WHEN 'GBP' THEN CAST(1.0 AS DECIMAL(18,6)) WHEN 'USD' THEN CAST(0.79 AS DECIMAL(18,6))
    WHEN 'EUR' THEN CAST(0.85 AS DECIMAL(18,6)) WHEN 'INR' THEN CAST(0.0094 AS DECIMAL(18,6)) END, 2) AS DECIMAL(18,2)) AS base_amount FROM t""",
)
def fx_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert(_txns(spark, sf_dir), RATES, out="base_amount").select("txn_id", "currency", "base_amount")


@query("standardised", f"WITH t AS ({_TXNS}) SELECT txn_id, upper(trim('  ' || lower(currency) || ' ')) AS currency, lower(channel) AS note FROM t")
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _txns(spark, sf_dir).select("txn_id", F.concat(F.lit("  "), F.lower("currency"), F.lit(" ")).alias("currency"), F.lower("channel").alias("note"))
    return standardise(raw, ["currency", "not_a_column"])


@query("latest_snapshot", "WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS ingest_date FROM orders) SELECT * FROM o WHERE ingest_date = (SELECT max(ingest_date) FROM o WHERE ingest_date <= '1998-03-03')")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("ingest_date"))
    return store.latest_snapshot(o, "1998-03-03")


# joins


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    return left, _t(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("k"), "p_brand")


_JOINED = "SELECT p_brand, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS q FROM lineitem {} JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 0) ON l_partkey = p_partkey GROUP BY 1"


def _by_brand(df: DataFrame) -> DataFrame:
    return df.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))


@query("salted_inner", _JOINED.format(""))
def salted_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_brand(salted_join(*_sides(spark, sf_dir), "k"))


@query("salted_left", _JOINED.format("LEFT"))
def salted_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_brand(salted_join(*_sides(spark, sf_dir), "k", how="left"))


_STATUS = "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"


def _strategy(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = strategy_session(spark, name)
        left = _t(own, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("decimal(18,2)").alias("q"))
        right = _t(own, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
        return strategy_join(left, right, "k", name).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))

    return run


for _name in ("merge", "merge_adaptive", "broadcast", "salted"):
    query(f"join_{_name}", _STATUS)(_strategy(_name))


# landing

_BAD = "o_orderkey % 5"


def _lines(fmt: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        if fmt == "json":
            good = F.format_string('{"id": %d, "cust": %d}', "o_orderkey", "o_custkey")
            bad = F.when(F.col("o_orderkey") % 10 == 0, F.lit('{"id": ')).otherwise(F.format_string('{"id": %d, "cust": "abc"}', "o_orderkey"))
        else:
            good = F.format_string("%d,%d", "o_orderkey", "o_custkey")
            bad = F.when(F.col("o_orderkey") % 10 == 0, F.format_string("%d,x", "o_orderkey")).otherwise(F.format_string("%d,1,2", "o_orderkey"))
        lines = o.select(F.col("o_orderkey").alias("line"), F.when(F.col("o_orderkey") % 5 == 0, bad).otherwise(good).alias("value"))
        parsed = landing.parse_lines(lines, "value", f"id BIGINT, cust BIGINT, {landing.CORRUPT} STRING", fmt)
        good_rows, bad_rows = landing.split_corrupt(parsed)
        return good_rows.select("line", F.lit(True).alias("good"), "cust").unionByName(bad_rows.select("line", F.lit(False).alias("good"), F.lit(None).cast("long").alias("cust")))

    return run


_SPLIT = f"SELECT o_orderkey AS line, {_BAD} <> 0 AS good, CASE WHEN {_BAD} <> 0 THEN o_custkey END AS cust FROM orders"
for _name in ("json", "csv"):
    query(f"corrupt_split_{_name}", _SPLIT)(_lines(_name))


_SIZES = {"customers": 500, "accounts": 800, "merchants": 50}


@query("synth_transactions")
def synth_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _SIZES | {"transactions": _t(spark, sf_dir, "orders").count()}
    return synth.transactions(spark, sizes, "2026-09-02", 1, "2026-09-01")


# Shares of generated rows, in ten-thousandths, with the bounds that they lie in.
_SHARES = {"hot": (2300, 3000), "late": (120, 280), "gbp": (8500, 9100), "completed": (9200, 9600), "cheap": (4500, 5500)}


@query("synth_shares", " UNION ALL ".join(f"SELECT '{n}' AS share, true AS within" for n in _SHARES))
def synth_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of codes, defects and amounts of generated transactions against what was declared, over 50,000 rows and more."""
    sizes = _SIZES | {"transactions": 50_000 + _t(spark, sf_dir, "orders").count()}
    tests = {
        "hot": F.col("merchant_id") == "M000000000", "late": F.col("txn_ts") < F.lit("2026-09-02").cast("timestamp"), "gbp": F.upper(F.trim("currency")) == "GBP",
        "completed": F.col("status") == "COMPLETED", "cheap": F.col("amount") < synth.MEDIAN,
    }
    one = synth.transactions(spark, sizes, "2026-09-02", 0).agg(*(F.avg(t.cast("int")).alias(n) for n, t in tests.items()))
    each = F.array(*(F.struct(F.lit(n).alias("share"), (F.col(n) * 10_000).between(*_SHARES[n]).alias("within")) for n in tests))
    return one.select(F.explode(each).alias("r")).select("r.*")


for _name, (_run, _sql_text) in flow.QUERIES.items():
    query(_name, _sql_text)(_run)
