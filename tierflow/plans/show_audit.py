"""Print the audit rows of a run date: `python -m tierflow.plans.show_audit --run-date D`."""

from __future__ import annotations

import argparse
from pathlib import Path

from tierflow.plans.audit import report
from tierflow.session import open_session
from tierflow.spec import load


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--run-date", required=True)
    p.add_argument("--config", default=str(Path(__file__).with_name("banking.yaml")))
    p.add_argument("--base-path", default=None)
    a = p.parse_args(argv)
    spark = open_session("show-audit", 4)
    for table, df in report(spark, load(a.config, a.base_path, spark), a.run_date).items():
        print(table)
        df.drop("batch_id", "run_date").show(100, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
