"""The stages of a batch, their graph, and the runner. State passes between stages through tables only."""

from __future__ import annotations

import argparse
import re
import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from contextlib import contextmanager
from datetime import date, datetime, timedelta
from graphlib import TopologicalSorter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.functions.columns import convert, protect, row_digest, standardise
from tierflow.operators import balance, features, history, marts, rules
from tierflow.operators.dedupe import latest_per_key, without_replays
from tierflow.plans.audit import Metrics, Trail, new_batch_id
from tierflow.session import adopt, open_session
from tierflow.sources import landing, store
from tierflow.spec import PipelineSpec, load

# The code columns that are trimmed and upper-cased.
CODES = {"accounts": ["account_type", "status"], "merchants": ["merchant_category", "country"], "customers": ["segment"], "transactions": ["currency", "channel", "status"]}

#: Stage to the stages that must be done before.
GRAPH = {
    "bronze": (),
    "silver_reference": ("bronze",),
    "silver_customers": ("bronze",),
    "silver_transactions": ("silver_reference",),
    "gold": ("silver_transactions", "silver_customers"),
}
STAGES = tuple(TopologicalSorter(GRAPH).static_order())


def shift(day: str, days: int) -> str:
    return (date.fromisoformat(day) + timedelta(days=days)).isoformat()


class Batch:
    """One run date's work; the methods named as the stages are the stages."""

    def __init__(self, spark: SparkSession, spec: PipelineSpec, run_date: str, batch_id: str | None = None, as_of: datetime | None = None):
        self.spark, self.spec, self.day = adopt(spark), spec, run_date
        self.batch_id = batch_id or new_batch_id()
        self.trail = Trail(spark, spec, run_date, self.batch_id)
        #: Nothing may be dated after the end of the run date; a rerun judges alike.
        self.as_of = as_of or datetime.fromisoformat(shift(run_date, 1))

    def path(self, layer: str, table: str) -> str:
        return self.spec.path(layer, table)

    def day_of(self, layer: str, table: str) -> DataFrame | None:
        found = store.read(self.spark, self.path(layer, table))
        return None if found is None else store.partition(found, self.day)

    def put_day(self, df: DataFrame, layer: str, table: str) -> DataFrame:
        """Write the day's partition and give back what a reader finds there."""
        store.put_partition(df, self.path(layer, table), {"ingest_date": self.day})
        fields = df.drop("ingest_date").schema
        return store.read_or_empty(self.spark, f"{self.path(layer, table)}/ingest_date={self.day}", fields)

    # bronze

    def bronze(self) -> None:
        for name in self.spec.sources:
            with self.trail.work("bronze", name) as m:
                self.ingest(name, m)

    def ingest(self, name: str, m: Metrics) -> None:
        raw = landing.read_day(self.spark, self.spec, name, self.day)
        if raw is None:
            return
        raw = landing.with_lineage(raw, self.batch_id).persist()
        try:
            good, bad = landing.split_corrupt(raw)
            m.rows_in, m.rows_quarantined = raw.count(), bad.count()
            m.rows_out = m.rows_in - m.rows_quarantined
            self.put_day(bad, "quarantine", f"{name}_unparseable")
            self.put_day(good, "bronze", name)
        finally:
            raw.unpersist()

    # silver

    @contextmanager
    def judged(self, name: str, df: DataFrame, refs: dict[str, DataFrame] | None = None) -> Iterator[rules.Parts]:
        quality = self.spec.rules_of(name)
        try:
            with rules.divided(df, quality.rules, refs, max_error_rate=quality.max_error_rate, as_of=self.as_of) as parts:
                self.trail.rules(name, parts.report)
                yield parts
        except rules.TooManyErrors as e:
            self.trail.rules(name, e.report)  # what stopped the batch is on record
            raise

    def silver_reference(self) -> None:
        for name in ("accounts", "merchants"):
            with self.trail.work("silver_reference", name) as m:
                bronze = store.read(self.spark, self.path("bronze", name))
                if bronze is None:
                    continue
                snapshot = store.latest_snapshot(bronze, self.day).drop("ingest_date")
                with self.judged(name, standardise(snapshot, CODES[name])) as parts:
                    m.rows_in, m.rows_quarantined = parts.total_rows, parts.rejected_rows
                    m.rows_out = m.rows_in - m.rows_quarantined
                    store.replace(parts.valid.withColumn("_snapshot_date", F.lit(self.day)), self.path("silver", name))
                    self.put_day(parts.rejected, "quarantine", name)

    def silver_customers(self) -> None:
        own = self.spec.source("customers")
        with self.trail.work("silver_customers", "customers") as m:
            batch = self.day_of("bronze", "customers")
            if batch is None:
                return
            latest, surplus = latest_per_key(standardise(batch.drop("ingest_date"), CODES["customers"]), own.primary_key, [F.col(own.change_ts).desc(), F.col("_ingest_ts").desc()])
            self.put_day(surplus, "quarantine", "customers_superseded")
            with self.judged("customers", latest) as parts:
                m.rows_in, m.rows_quarantined = parts.total_rows, parts.rejected_rows
                self.put_day(parts.rejected, "quarantine", "customers")
                changes = protect(parts.valid.withColumn("row_hash", row_digest(own.tracked)), self.spec.pii.get("customers", {}))
                changes = changes.drop("_ingest_ts", "_source_file", "_batch_id")
                path = self.path("silver", "customers_scd2")
                now = store.read(self.spark, path)
                done = history.apply_changes(now, changes, key=own.primary_key[0], change_ts=own.change_ts, batch_id=self.batch_id)
                counts = done.counts()
                m.rows_out = counts["insert"] + counts["update"]
                store.replace(done.dimension, path)

    def silver_transactions(self) -> None:
        own = self.spec.source("transactions")
        with self.trail.work("silver_transactions", "transactions") as m:
            batch = self.day_of("bronze", "transactions")
            if batch is None:
                return
            batch = batch.drop("ingest_date")
            clean = standardise(batch, CODES["transactions"])
            kept, surplus = latest_per_key(clean, own.primary_key, [F.col("_ingest_ts").desc(), F.col("_source_file").desc()])
            published = store.read(self.spark, self.path("silver", "transactions"))
            replayed = surplus.where(F.lit(False))
            if published is not None:
                window = (F.col("ingest_date") >= shift(self.day, -self.spec.late_days)) & (F.col("ingest_date") < self.day)
                kept, replayed = without_replays(kept, published.where(window), own.primary_key)
            refs = {n: t for n in ("accounts", "merchants") if (t := store.read(self.spark, self.path("silver", n))) is not None}
            with self.judged("transactions", kept, refs) as parts:
                silver = convert(parts.valid, self.spec.rates).withColumn("txn_date", F.col(own.event_ts).cast("date"))
                targets = [
                    self.put_day(silver, "silver", "transactions"),
                    self.put_day(parts.rejected, "quarantine", "transactions"),
                    self.put_day(surplus.unionByName(replayed), "quarantine", "transactions_duplicates"),
                ]
                m.rows_quarantined, m.rows_out = parts.rejected_rows, parts.total_rows - parts.rejected_rows
            result = balance.reconcile("transactions", batch, [t.select("amount") for t in targets], "amount", strict=False)
            m.rows_in = result.source_rows
            self.trail.balance(result)  # on record before it stops the run
            if not result.balanced:
                raise balance.OutOfBalance(result)

    # gold

    def gold(self) -> None:
        txns = store.read(self.spark, self.path("silver", "transactions"))
        if txns is None:
            return
        first = store.partition(txns, self.day).agg(F.min("txn_date")).first()[0]
        today = F.col("ingest_date") == self.day
        recent = txns.where(F.lit(False)) if first is None else marts.touched(txns.where(F.col("ingest_date") >= first.isoformat()), self.day)
        for table, source, build in (("customer_daily_spend", "accounts", marts.customer_daily), ("merchant_category_daily", "merchants", marts.category_daily)):
            with self.trail.work("gold", table) as m:
                dim = store.read(self.spark, self.path("silver", source))
                if dim is not None:
                    out = build(recent, dim).persist()
                    try:
                        m.rows_out = out.count()
                        store.overwrite(out, self.path("gold", table), ("txn_date",))
                    finally:
                        out.unpersist()
        with self.trail.work("gold", "txn_fraud_features") as m:
            days = self.spec.lookback_days + self.spec.late_days
            past = txns.where((F.col("ingest_date") >= shift(self.day, -days)) & (F.col("ingest_date") <= self.day))
            made = self.put_day(features.behaviour(past, self.spec.lookback_days).where(today), "gold", "txn_fraud_features")
            m.rows_out = made.count()


def walk(graph: Mapping[str, tuple[str, ...]], work: Callable[[str], None], *, parallel: int = 2, retries: int = 0, wait_s: float = 0.0) -> None:
    """Work on each node once all before it are done, up to `parallel` at a time; a node that fails is tried again.

    After a node's last failure nothing new is begun, and what is under way is waited for.
    """
    order, doing = TopologicalSorter(graph), {}
    order.prepare()

    def tried(node: str) -> None:
        for left in reversed(range(retries + 1)):
            try:
                return work(node)
            except NO_RETRY:
                raise
            except Exception:
                if not left:
                    raise
                time.sleep(wait_s)

    with ThreadPoolExecutor(parallel) as pool:
        while order.is_active():
            doing |= {pool.submit(tried, n): n for n in order.get_ready()}
            for done in wait(doing, return_when=FIRST_COMPLETED).done:
                done.result()
                order.done(doing.pop(done))


#: What the same data would give again.
NO_RETRY = (rules.TooManyErrors, balance.OutOfBalance)


def run(spark: SparkSession, spec: PipelineSpec, run_date: str, stage: str = "all", batch_id: str | None = None, *, parallel: int = 2, retries: int = 0, wait_s: float = 0.0) -> str:
    """Run one stage or all, as the graph allows; returns the batch id. A stage can be run again, so it can be retried."""
    if stage != "all" and stage not in GRAPH:
        raise ValueError(f"unknown stage {stage}; one of all, {', '.join(STAGES)}")
    batch = Batch(spark, spec, run_date, batch_id)
    graph = GRAPH if stage == "all" else {stage: ()}
    walk(graph, lambda name: getattr(batch, name)(), parallel=parallel, retries=retries, wait_s=wait_s)
    return batch.batch_id


def trigger_date(key: str) -> str | None:
    """The run date that a landed object starts a run for: that of a day's success marker; else None."""
    found = re.search(r"ingest_date=(\d{4}-\d{2}-\d{2})/", key)
    return found[1] if found and key.endswith("_SUCCESS") else None


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tierflow", description="Run one date's batch.")
    p.add_argument("--run-date", required=True)
    p.add_argument("--stage", default="all", choices=["all", *STAGES])
    p.add_argument("--config", default=None)
    p.add_argument("--base-path", default=None)
    p.add_argument("--batch-id", default=None)
    p.add_argument("--parallel", type=int, default=2)
    p.add_argument("--retries", type=int, default=2)
    p.add_argument("--wait-s", type=float, default=60.0)
    args = p.parse_args(argv)
    location = args.config or str(Path(__file__).with_name("banking.yaml"))
    spark = open_session("tierflow")
    try:
        spec = load(location, args.base_path, spark)
        spark.conf.set("spark.sql.shuffle.partitions", spec.shuffle_partitions)
        run(spark, spec, args.run_date, args.stage, args.batch_id, parallel=args.parallel, retries=args.retries, wait_s=args.wait_s)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
