"""Mixing sources to target weights by a temperature.

The weight of a source is its share of tokens to the power of an exponent, normalised. The exponent
is found by bisection: the largest from 0 (equal weights) to 1 (the sources' own shares) that meets a
target entropy, or the smallest whose repetition stays within a limit. The weights are realised in
full: source i has a budget of w_i * total tokens, its documents are put in order by a hash, passes over
it follow each other, and the documents whose first token lies inside the budget are taken.

All sources' streams are cut into blocks of `block` tokens, each with every source's share, and a block's
rows are permuted anew in each pass. The copies of a document are a whole pass apart; a block is at most
a third of the shortest pass, so they are never in one block or in neighbouring ones.

Weights come from sums by source that stay a table: the bisection asks it for sums of powers, several
exponents at once, and weights are joined to the rows, by broadcast where they are found to be few, else
on salted keys. So there may be any number of sources. Positions are distributed prefix sums: a source
is cut by its hash into slices of about `slice_rows` rows, slices are summed, and a row's position is its
slice's offset plus the sum before it in the slice; so no task has to hold a source. Equal rows (id,
source, tokens) are counted before that, so repeats are one row of a slice however many they are.

Tokens are words: runs of other characters than \\x20 and \\x09-\\x0D, one at least for each row.
Defined results: null source is the source named ""; null text has one token; repeated rows have
one hash and one place, and are all taken alike; an empty table gives no rows;
extra columns are kept by mixed_documents() and ignored by mix().
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import few, forget, settle

SALTS = 16
#: Bisection steps answered by one aggregation, and such aggregations at most.
AT_ONCE, ROUNDS = 4, 15


class Sources:
    """The sums by source, settled: (mix_source, tokens, rows)."""

    def __init__(self, sums: DataFrame):
        self.sums = sums
        r = sums.agg(F.count(F.lit(1)), F.min("tokens"), F.max("tokens")).first()
        self.n, self.least, self.most = r[0], r[1], r[2]

    def share(self) -> Column:
        return F.col("tokens") / F.lit(float(self.most))

    def powers(self, exponents: list[float]) -> list[tuple[float, float]]:
        """For each exponent a the sums of x^a and of x^a log x, x a source's tokens over the largest's."""
        x = self.share()
        row = self.sums.agg(*(c for k, a in enumerate(exponents) for c in (F.sum(F.pow(x, F.lit(a))).alias(f"z{k}"), F.sum(F.pow(x, F.lit(a)) * F.log(x)).alias(f"l{k}")))).first()
        return [(row[f"z{k}"], row[f"l{k}"]) for k in range(len(exponents))]

    def entropies(self, exponents: list[float]) -> list[float]:
        return [math.log(z) - a * part / z for a, (z, part) in zip(exponents, self.powers(exponents))]

    def repetitions(self, exponents: list[float], budget: float | None) -> list[float]:
        """The largest number of passes over a source; without a budget, of that which takes all once."""
        low = self.least / self.most
        if budget is None:
            return [low ** (a - 1) for a in exponents]
        return [budget / self.most * low ** (a - 1) / z for a, (z, _) in zip(exponents, self.powers(exponents))]


def bisect(true_below: Callable[[list[float]], list[bool]]) -> tuple[float, float]:
    """(lo, hi) around the place in [0, 1] up to which the test holds; the points of AT_ONCE steps are asked at once."""
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        inner = [lo + (hi - lo) * k / 2**AT_ONCE for k in range(1, 2**AT_ONCE)]
        holds = true_below(inner)
        upto = holds.index(False) if False in holds else len(holds)
        points = [lo, *inner, hi]
        lo, hi = points[upto], points[upto + 1]
    return lo, hi


def find_exponent(sources: Sources, *, target_entropy: float | None = None, max_passes: float | None = None, budget: float | None = None) -> float:
    """By bisection over [0, 1]; entropy falls and repetition falls as the exponent grows."""

    def flat(exponents: list[float]) -> list[bool]:
        return [e >= target_entropy for e in sources.entropies(exponents)]

    def within(exponents: list[float]) -> list[bool]:
        return [max_passes is None or r <= max_passes * (1 + 1e-12) for r in sources.repetitions(exponents, budget)]

    if target_entropy is not None:  # the largest exponent that is flat enough
        a = 1.0 if flat([1.0])[0] else bisect(flat)[0]
        if within([a])[0]:
            return a
    if within([0.0])[0]:
        return 0.0
    return bisect(lambda e: [not ok for ok in within(e)])[1]  # the smallest exponent within the limit


def plan(sources: Sources, *, target_entropy: float | None, max_passes: float | None, budget: int | None) -> tuple[float, float, float]:
    """Exponent, sum of powers and budget in tokens; the default budget is the least that takes each document once."""
    a = find_exponent(sources, target_entropy=target_entropy, max_passes=max_passes, budget=budget)
    z = sources.powers([a])[0][0]
    return a, z, float(budget) if budget is not None else sources.most * z


def n_tokens() -> Column:
    return F.greatest(F.coalesce(F.regexp_count("text", F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long"), F.lit(1).cast("long"))


def place() -> Column:
    """The hash that puts a source's rows in order."""
    return F.xxhash64(F.lit("place"), F.col("doc_id").cast("long"), "mix_source", "mix_tokens")


def slice_of() -> Column:
    return F.shiftright((F.shiftright("mix_hash", 32) + F.lit(1 << 31)) * F.col("slices"), 32).cast("int")


def with_goals(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows with their source's goals: broadcast if few, else joined on salted keys, as one source may have most rows."""
    small = few(goals)
    if small is not goals:
        return rows.join(small, "mix_source")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = rows.withColumn("salt", F.pmod(F.col("mix_hash"), F.lit(SALTS)).cast("int"))
    return salted.join(goals.select("*", salt), ["mix_source", "salt"]).drop("salt")


def source_of(c: str = "source") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


class Mix:
    """The tables that decide a mix: goals by source, offsets by slice, the rows with their first positions."""

    def __init__(self, docs: DataFrame, *, target_entropy: float | None, max_passes: float | None, budget: int | None, block: int, slice_rows: int):
        slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_of().alias("mix_source"), n_tokens().alias("mix_tokens"))
        slim = slim.groupBy("doc_id", "mix_source", "mix_tokens").agg(F.count(F.lit(1)).alias("copies"))
        self.slim = slim = settle(slim.withColumn("mix_hash", place()), "tokens")
        sums = settle(slim.groupBy("mix_source").agg(F.sum(F.col("mix_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("rows")), "sums")
        sources = Sources(sums)
        goals = sums.select("mix_source", *(F.lit(None).cast(t).alias(c) for c, t in (("mix_weight", "double"), ("goal", "long"), ("span", "double"))), F.col("tokens").alias("total"), F.lit(1).cast("long").alias("slices"))
        if sources.n:
            a, z, whole = plan(sources, target_entropy=target_entropy, max_passes=max_passes, budget=budget)
            # a source's pass, in tokens of the whole mix, is its tokens over its weight: shortest for the least source
            shortest = sources.least * z / (sources.least / sources.most) ** a
            cut = max(1.0, min(float(block), shortest / 3))
            weight = F.pow(sources.share(), F.lit(a)) / F.lit(z)
            goals = sums.select(
                "mix_source", weight.alias("mix_weight"), F.ceil(weight * whole - 1e-6).cast("long").alias("goal"),  # in whole tokens
                (weight * cut).alias("span"), F.col("tokens").alias("total"),
                F.greatest(F.ceil(F.col("rows") / F.lit(slice_rows)), F.lit(1)).cast("long").alias("slices"),
            )
            self.whole, self.blocks = whole, math.ceil(whole / cut)
        else:
            self.whole, self.blocks = 0.0, 1
        self.goals = settle(goals, "goals")
        self.drawn = with_goals(slim, self.goals).withColumn("slice", slice_of())
        key = ["mix_source", "slice"]
        parts = self.drawn.groupBy(*key).agg(F.sum(F.col("mix_tokens") * F.col("copies")).alias("in_slice"))
        before = Window.partitionBy("mix_source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        # a row for each `slice_rows` rows of a source
        self.offsets = settle(parts.select(*key, "in_slice", F.coalesce(F.sum("in_slice").over(before), F.lit(0)).alias("offset")), "offsets")
        forget(sums)

    def placed(self) -> DataFrame:
        """The rows with `at`, the tokens of their source before them in a pass."""
        key = ["mix_source", "slice"]
        inside = Window.partitionBy(*key).orderBy("mix_hash").rangeBetween(Window.unboundedPreceding, 0)  # rows of one hash have one place
        own = F.col("mix_tokens") * F.col("copies")
        run = F.sum(own).over(inside) - F.sum(own).over(Window.partitionBy(*key, "mix_hash"))
        return self.drawn.withColumn("run", run).join(self.offsets, key).withColumn("at", (F.col("offset") + F.col("run")).cast("long"))


def passes() -> Column:
    """The passes in which a row that stands at `at`, before the goal, is taken."""
    return F.explode(F.sequence(F.lit(0), F.expr("(goal - at - 1) div total").cast("int"))).alias("mix_pass")


def mix(docs: DataFrame, *, target_entropy: float | None = None, max_passes: float | None = 2.0, budget: int | None = None, block: int = 1_000_000, slice_rows: int = 5_000) -> DataFrame:
    """The rows taken: doc_id, mix_source, mix_tokens, mix_weight, mix_pass, mix_position, mix_block, mix_order.

    mix_position is the row's first token in its source's stream, mix_block the block it falls in,
    mix_order a hash by which rows of a block are permuted.
    """
    m = Mix(docs, target_entropy=target_entropy, max_passes=max_passes, budget=budget, block=block, slice_rows=slice_rows)
    taken = m.placed().where(F.col("at") < F.col("goal")).select("*", passes())
    taken = taken.withColumn("mix_position", F.col("mix_pass") * F.col("total") + F.col("at"))
    taken = taken.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return taken.select(
        "doc_id", "mix_source", "mix_tokens", "mix_weight", "mix_pass", "mix_position",
        F.floor(F.col("mix_position") / F.col("span")).cast("long").alias("mix_block"), order_of(F.col("doc_id"), F.col("mix_pass")).alias("mix_order"),
    )


def order_of(doc_id: Column, mix_pass: Column) -> Column:
    return F.xxhash64(F.lit("order"), doc_id, mix_pass)


def mixed_documents(docs: DataFrame, *, target_entropy: float | None = None, max_passes: float | None = 2.0, budget: int | None = None, block: int = 1_000_000, slice_rows: int = 5_000, task_tokens: int = 20_000_000) -> DataFrame:
    """The documents themselves, each as often as mix() takes it, block by block in the blocks' permuted order.

    What mix() takes of a pass are the rows up to a hash, so a source's last hash decides over each row;
    blocks are cut at the same places but for rows inside a slice, whose position is interpolated by their
    hash. So the documents are moved once, to the task of their block.
    """
    m = Mix(docs, target_entropy=target_entropy, max_passes=max_passes, budget=budget, block=block, slice_rows=slice_rows)
    # rows of the pass that the budget ends in: those up to this hash (none: the budget ends between passes)
    ends = m.placed().withColumn("full", F.floor(F.col("goal") / F.col("total")))
    last = ends.groupBy("mix_source").agg(F.max(F.when(F.col("full") * F.col("total") + F.col("at") < F.col("goal"), F.col("mix_hash"))).alias("last"))
    goals = settle(m.goals.join(last, "mix_source"), "cuts")
    # the row travels as one column, so its other columns may have any names
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    slim = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), source_of().alias("mix_source"), n_tokens().alias("mix_tokens")).withColumn("mix_hash", place())
    placed = with_goals(slim, goals).withColumn("slice", slice_of()).join(few(m.offsets), ["mix_source", "slice"])
    times = F.floor(F.col("goal") / F.col("total")) + F.coalesce(F.col("mix_hash") <= F.col("last"), F.lit(False)).cast("int")
    low = F.shiftright("mix_hash", 32) + F.lit(1 << 31)  # 0 to 2^32, of which a slice has an equal part
    inside = low * F.col("slices") / F.lit(float(1 << 32)) - F.col("slice")
    at = F.col("offset") + inside * F.col("in_slice")
    taken = placed.where(times > 0).select("row", "doc_id", "total", "span", at.alias("at"), F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))).alias("mix_pass"))
    b = F.floor((F.col("mix_pass") * F.col("total") + F.col("at")) / F.col("span")).cast("long")
    taken = taken.select("row", b.alias("b"), order_of(F.col("doc_id"), F.col("mix_pass")).alias("o"))
    n = min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(m.whole / task_tokens)), m.blocks)
    # a task has blocks that follow each other, so that copies in it keep their distance
    task = F.least(F.floor(F.col("b") * n / F.lit(m.blocks)), F.lit(n - 1)).cast("int")
    return taken.repartitionById(n, task).sortWithinPartitions("b", "o").select("row.*")
