"""The run log: structured lines on stdout, one audited row for each piece of work."""

from __future__ import annotations

import json
import logging
import sys
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from tierflow.sources import store
from tierflow.spec import PipelineSpec

RUNS = "batch_id string, run_date string, stage string, dataset string, status string, rows_in long, rows_out long, rows_quarantined long, duration_s double, error string, started_at timestamp"
RESULTS = "batch_id string, run_date string, dataset string, rule string, rule_type string, severity string, failed_rows long, total_rows long, pass_rate double, checked_at timestamp"
BALANCES = "batch_id string, run_date string, dataset string, source_rows long, target_rows long, source_amount string, target_amount string, balanced boolean"


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        line = {"ts": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            line["error"] = self.formatException(record.exc_info)
        return json.dumps(line | getattr(record, "context", {}), default=str)


def logger(name: str) -> logging.Logger:
    out = logging.getLogger(name)
    if not out.handlers:
        handler = logging.StreamHandler(sys.stdout)
        handler.setFormatter(JsonLines())
        out.addHandler(handler)
        out.setLevel(logging.INFO)
        out.propagate = False
    return out


def new_batch_id() -> str:
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"


@dataclass
class Metrics:
    rows_in: int = 0
    rows_out: int = 0
    rows_quarantined: int = 0


class Trail:
    """Appends to the audit tables of one batch; a table's files lie in a folder for each writer."""

    def __init__(self, spark: SparkSession, spec: PipelineSpec, run_date: str, batch_id: str):
        self.spark, self.spec, self.run_date, self.batch_id = spark, spec, run_date, batch_id
        self.log = logger("tierflow")

    def put(self, table: str, rows: list[tuple], schema: str, dataset: str) -> None:
        """One file: these are a few rows from the driver, apart from those of parallel stages."""
        df = self.spark.createDataFrame(rows, schema).coalesce(1)
        df.drop("dataset").write.mode("append").parquet(f"{self.spec.path('audit', table)}/dataset={dataset}")

    def rules(self, dataset: str, report: list[dict]) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        rows = [(self.batch_id, self.run_date, dataset, *r.values(), now) for r in report]
        if rows:
            self.put("dq_results", rows, RESULTS, dataset)

    def balance(self, b) -> None:
        self.put("reconciliation", [(self.batch_id, self.run_date, b.dataset, b.source_rows, b.target_rows, str(b.source_amount), str(b.target_amount), b.balanced)], BALANCES, b.dataset)

    @contextmanager
    def work(self, stage: str, dataset: str) -> Iterator[Metrics]:
        """Time the work and leave a row, also when it fails; a failing log never hides the failure."""
        metrics, began, status, error = Metrics(), time.time(), "SUCCESS", None
        try:
            yield metrics
        except BaseException as e:
            status, error = "FAILED", f"{type(e).__name__}: {e}"[:2000]
            raise
        finally:
            took = round(time.time() - began, 3)
            row = (self.batch_id, self.run_date, stage, dataset, status, metrics.rows_in, metrics.rows_out, metrics.rows_quarantined, took, error, datetime.fromtimestamp(began, timezone.utc).replace(tzinfo=None))
            context = {"batch_id": self.batch_id, "run_date": self.run_date, "stage": stage, "dataset": dataset, "status": status, "duration_s": took}
            self.log.info("stage done", extra={"context": context})
            try:
                self.put("pipeline_runs", [row], RUNS, dataset)
            except Exception:
                self.log.exception("the run couldn't be logged", extra={"context": context})


def report(spark: SparkSession, spec: PipelineSpec, run_date: str) -> dict:
    """The audit rows of a run date, as frames in order."""
    orders = {"pipeline_runs": ["started_at"], "dq_results": ["dataset", "rule"], "reconciliation": ["dataset"]}
    out = {}
    for table, order in orders.items():
        found = store.read(spark, spec.path("audit", table))
        if found is not None:
            out[table] = found.where(found["run_date"] == run_date).orderBy(*order)
    return out
