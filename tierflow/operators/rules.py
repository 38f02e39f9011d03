"""Declared quality rules: each type is a registered test, a batch is judged by all of them in one plan.

A test makes a boolean column, true where a row fails; a test that depends on other rows or tables asks
the plan for a mark, which is a join to a small table of keys. judge() leaves the numbers of the rules
that a row fails in one array column, from which names, counts and both halves are derived.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.spec import RuleSpec

FAILED = "_dq"
TESTS: dict[str, Callable[[RuleSpec, "_Plan"], Column]] = {}


class TooManyErrors(RuntimeError):
    """More rows failed than the batch may have; `report` has a row for each rule."""

    def __init__(self, rejected: int, total: int, limit: float, report: list[dict]):
        super().__init__(f"{rejected} of {total} rows failed; the limit is {limit:.2%}")
        self.report = report


def test(kind: str):
    def put(f):
        TESTS[kind] = f
        return f

    return put


class _Plan:
    """A frame that grows by the marks that tests ask for."""

    def __init__(self, df: DataFrame, refs: Mapping[str, DataFrame], as_of: datetime | None):
        self.df, self.given, self.refs, self.marks = df, df, refs, []
        self.as_of = as_of or datetime.now(timezone.utc)

    def mark(self, columns: Sequence[str], keys: DataFrame) -> Column:
        """A column that is true where a row's values of `columns` are, nulls alike, a row of `keys` (distinct).

        Whether the keys are broadcast is left to their size.
        """
        own = f"_mark{len(self.marks)}"
        names = [f"{own}_{i}" for i in range(len(columns))]
        on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(n)) for c, n in zip(columns, names)))
        self.df = self.df.join(keys.toDF(*names).withColumn(own, F.lit(True)), on, "left").drop(*names)
        self.marks.append(own)
        return F.col(own).isNotNull()


@test("not_null")
def _(rule: RuleSpec, plan: _Plan) -> Column:
    return F.greatest(*(F.col(c).isNull() for c in (*rule.columns, rule.columns[0])))


@test("range")
def _(rule: RuleSpec, plan: _Plan) -> Column:
    c, inside = F.col(rule.column), F.lit(True)
    inside = inside if rule.min is None else inside & (c >= F.lit(rule.min))
    inside = inside if rule.max is None else inside & (c <= F.lit(rule.max))
    return c.isNotNull() & ~inside


@test("accepted_values")
def _(rule: RuleSpec, plan: _Plan) -> Column:
    return ~F.coalesce(F.col(rule.column).isin(*rule.values), F.col(rule.column).isNull())


@test("regex")
def _(rule: RuleSpec, plan: _Plan) -> Column:
    return F.regexp_count(rule.column, F.lit(rule.pattern)) == 0


@test("expression")
def _(rule: RuleSpec, plan: _Plan) -> Column:
    """It may say `as_of()`: the batch's own time, a literal, so that a rerun judges alike."""
    return F.expr(rule.expr.replace("as_of()", f"timestamp '{plan.as_of:%Y-%m-%d %H:%M:%S}'")) == F.lit(False)


@test("unique")
def _(rule: RuleSpec, plan: _Plan) -> Column:
    """Every row of a key that occurs more than once fails, null keys alike: keys are counted where rows lie."""
    again = plan.given.groupBy(*rule.columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return plan.mark(rule.columns, again)


@test("foreign_key")
def _(rule: RuleSpec, plan: _Plan) -> Column:
    """A value that isn't null and that the reference doesn't have."""
    if rule.ref_table not in plan.refs:
        raise ValueError(f"rule {rule.name}: no reference table {rule.ref_table}")
    known = plan.refs[rule.ref_table].select(rule.ref_column).dropna().distinct()
    return F.col(rule.column).isNotNull() & ~plan.mark([rule.column], known)


def judge(df: DataFrame, rules: Sequence[RuleSpec], refs: Mapping[str, DataFrame] | None = None, as_of: datetime | None = None) -> DataFrame:
    """df with _dq: the numbers of the rules that a row fails, in the rules' order; null test results pass."""
    plan, failed = _Plan(df, refs or {}, as_of), []
    for k, rule in enumerate(rules):
        if rule.type not in TESTS:
            raise ValueError(f"unknown rule type {rule.type}")
        failed.append(F.when(TESTS[rule.type](rule, plan), F.lit(k)))
    found = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<int>")
    return plan.df.withColumn(FAILED, found).drop(*plan.marks)


def _numbers(rules: Sequence[RuleSpec], severity: str) -> list[int]:
    return [k for k, r in enumerate(rules) if r.severity == severity]


def rejects(rules: Sequence[RuleSpec]) -> Column:
    """Whether a judged row fails a rule of severity error; warnings don't reject."""
    return F.exists(FAILED, lambda k: k.isin(_numbers(rules, "error"))) if _numbers(rules, "error") else F.lit(False)


def names(rules: Sequence[RuleSpec], severity: str = "error") -> Column:
    """The names of the rules of a severity that a judged row fails."""
    own = F.array(*(F.lit(r.name) for r in rules)) if rules else F.array().cast("array<string>")
    mine = F.filter(FAILED, lambda k: k.isin(_numbers(rules, severity))) if _numbers(rules, severity) else F.array().cast("array<int>")
    return F.transform(mine, lambda k: F.get(own, k))


def halves(judged: DataFrame, rules: Sequence[RuleSpec]) -> tuple[DataFrame, DataFrame]:
    """(valid as it came, rejected with _dq_errors)."""
    bad = rejects(rules)
    return judged.where(~bad).drop(FAILED), judged.where(bad).withColumn("_dq_errors", names(rules)).drop(FAILED)


def tally(judged: DataFrame, rules: Sequence[RuleSpec]) -> DataFrame:
    """One row: total, rejected, and an array of each rule's failures."""
    each = [F.count_if(F.array_contains(FAILED, k)) for k in range(len(rules))]
    return judged.agg(F.count(F.lit(1)).alias("total"), F.count_if(rejects(rules)).alias("rejected"), (F.array(*each) if each else F.array().cast("array<bigint>")).alias("failed"))


def report(judged: DataFrame, rules: Sequence[RuleSpec]) -> DataFrame:
    """(rule, rule_type, severity, failed_rows, total_rows, pass_rate): a row for each rule; an empty batch passes."""
    own = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.type).alias("rule_type"), F.lit(r.severity).alias("severity")) for r in rules]
    rows = F.explode(F.arrays_zip(F.array(*own).alias("about"), F.col("failed")) if own else F.array()).alias("r")
    rate = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(1 - F.col("failed_rows") / F.col("total"))
    flat = tally(judged, rules).select(rows, "total").select("r.about.*", F.col("r.failed").alias("failed_rows"), "total")
    return flat.select("rule", "rule_type", "severity", "failed_rows", F.col("total").alias("total_rows"), rate.alias("pass_rate"))


class Parts(NamedTuple):
    """A batch divided by its rules: both halves (lazy), their counts and the rules' report."""

    valid: DataFrame
    rejected: DataFrame
    total_rows: int
    rejected_rows: int
    report: list[dict]


def pass_rate(failed: int, total: int) -> float:
    return (total - failed) / total if total else 1.0


@contextmanager
def divided(df: DataFrame, rules: Sequence[RuleSpec], refs: Mapping[str, DataFrame] | None = None, *, max_error_rate: float = 1.0, as_of: datetime | None = None, cache: bool = True) -> Iterator[Parts]:
    """Judge a batch once and give its Parts; raises TooManyErrors above the allowed share.

    The judged rows are cached while the block runs, and let go at its end, whatever happens in it.
    """
    judged = judge(df, rules, refs, as_of)
    judged = judged.persist() if cache else judged
    try:
        total, rejected, failed = tally(judged, rules).first()
        rows = [{"rule": r.name, "rule_type": r.type, "severity": r.severity, "failed_rows": n, "total_rows": total, "pass_rate": pass_rate(n, total)} for r, n in zip(rules, failed)]
        if total and rejected / total > max_error_rate:
            raise TooManyErrors(rejected, total, max_error_rate, rows)
        yield Parts(*halves(judged, rules), total, rejected, rows)
    finally:
        if cache:
            judged.unpersist()
