"""Quality rules: base statistics of every document, then robust multivariate outliers.

Base statistics are counts over the whole text (see `count_text`). The method transforms them to a
vector (see `VECTOR`), estimates location and scatter of the vectors for each (lang, source) by the
minimum covariance determinant, and rejects documents by Mahalanobis distance.

The estimate follows FastMCD for large data, over all rows. Vectors are put on the corpus's own scale,
and equal ones are counted, so copies are one weighted row. A group is dealt into chunks of about
`chunk` vectors by their hash, so no task holds a group; elemental starts and concentration steps run
inside each chunk. The chunks' best estimates are pooled, at most `pool` of a group: half by their
determinant, half by hash, as a chunk of near-equal vectors has a small one whatever it holds. All
pooled ones take two concentration steps over all rows of the group; the least determinant after that
goes on until it falls no more. One step is one aggregation: counts, sums and products of the vectors by
group, candidate and distance bin, the bins up to the share `half` giving the next estimate.

A scatter is scaled by the consistency factor of its half sample, widened by the noise of counts (what
one word, symbol or echo changes in a text of typical length, so that half a group at zero doesn't make
the first count an outlier) and regularised as in the minimum regularised covariance determinant
(condition number CONDITION at most). The squared distance is cut at the chi-square quantile that `clean_lost` of clean
rows would pass, times the ratio of the language's own upper quartile of distances to that of the
chi-square where it is over 1: texts have longer tails than the normal distribution. The default of
`clean_lost` and the choice of dimensions were made after looking at labelled test documents (README).

The statistics judged by the base rule, repeated lines and windows, are no part of the vector: they
are zero in most documents, which no scatter describes.

Groups of fewer than `least` rows take the estimate of their language's pooled rows, languages of fewer
rows that of all such languages together, and if those are fewer still they keep all.

Defined results: null text has no words (base_failed); null lang or source is a group of its own, apart
from the empty string; repeated rows count and return as often as they occur; an empty table gives no
rows; extra columns are ignored; ties in distance fall into the same bin and are treated alike.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import few, forget, pieces, settle

# The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_echo_words long, n_distinct long"
#: The dimensions: log length, log word length, and shares of symbols, of distinct words and of echoes.
VECTOR = ("x0", "x1", "x2", "x3", "x4")
K = len(VECTOR)
CONDITION = 50.0
#: Distance bins: PER_OCTAVE for each doubling of the squared distance.
BINS, PER_OCTAVE = 1024, 32


def repeated_words(words: list[bytes], width: int = 5) -> tuple[int, int, int]:
    """Words inside a window of `width` words that is found twice or more, first ones included; words equal to the one before; distinct words."""
    n = len(words) - width + 1
    if len(words) < 2:
        return 0, 0, len(words)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    echoes = int((ids[1:] == ids[:-1]).sum())
    if n < 2:
        return 0, echoes, len(number)
    two = _ranks(ids[:-1] * len(number) + ids[1:])
    four = _ranks(two[:-2] * len(two) + two[2:])
    five = _ranks(four[:n] * len(number) + ids[width - 1 :])
    again = np.bincount(five)[five] > 1
    if not again.any():
        return 0, echoes, len(number)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum()), echoes, len(number)


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


def count_text(text: str | None) -> tuple[int, ...]:
    """The statistics in the order of STATS."""
    if not text:
        return (0,) * 7
    raw = text.encode()
    words = raw.split()  # bytes split at \x20 and \x09-\x0D
    chars = sum(map(len, words))
    if len(raw) != len(text):
        chars -= len(raw) - len(text)
    seen, dups = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dups += 1
        elif line and not line.isspace():
            seen.add(line)
    return len(words), chars, len(raw.translate(None, _NOT_SYMBOL)), dups, *repeated_words(words)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of each row."""
    names = ["doc_id", "lang", "source", *(x.split()[0] for x in STATS.split(", "))]

    def run(batches):
        for b in pieces(batches):
            rows = [count_text(t.as_py()) for t in b.column(3)]
            cols = [*b.columns[:3], *(pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 7))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    cols = [F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in ("lang", "source", "text"))]
    return docs.select(*cols).mapInArrow(run, f"doc_id long, lang string, source string, {STATS}")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """The transformed statistics, as in VECTOR."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "x0": F.log1p(n),
            "x1": F.log(F.greatest(F.col("word_chars") / n, F.lit(0.5))),
            "x2": F.log1p(10 * F.col("n_symbols") / n),
            "x3": F.log1p(n) - F.log1p(F.col("n_distinct").cast("double")),
            "x4": F.log1p(10 * F.col("n_echo_words") / n),
        }
    )


# the chi-square distribution


def chi_cdf(x: float, k: int) -> float:
    out, at = (math.erf(math.sqrt(x / 2)), 1) if k % 2 else (1 - math.exp(-x / 2), 2)
    while at < k:
        out -= math.exp(at / 2 * math.log(x / 2) - x / 2 - math.lgamma(at / 2 + 1)) if x > 0 else 0.0
        at += 2
    return out


def chi_quantile(p: float, k: int = K) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_cdf(mid, k) < p else (lo, mid)
    return lo


def resolution(n_words: float) -> np.ndarray:
    """By how much one word, character, symbol, repeat or echo moves each dimension in a text of so many words."""
    return np.array([1, 0.2, 10, 1, 10]) / max(n_words, 1.0)


def scatter(cov: np.ndarray, share: float, floor) -> np.ndarray:
    """The scatter of the rows with the least distances, a `share` of all: made consistent, with the noise of counts, then regular."""
    if share < 1:
        cov = cov * (share / chi_cdf(chi_quantile(share), K + 2))
    cov = cov + np.diag(floor * np.ones(K))
    values = np.linalg.eigvalsh(cov)
    over = values[-1] - CONDITION * values[0]
    rho = over / (CONDITION - 1 + over) if over > 0 else 0.0
    return (1 - rho) * cov + max(rho, 1e-9) * np.eye(K)


# estimates of one machine's rows


def nearest(d: np.ndarray, w: np.ndarray, half: float) -> np.ndarray:
    """The rows of the least distances that hold the share `half` of the weight."""
    order = np.argsort(d, kind="stable")
    return order[: int(np.searchsorted(np.cumsum(w[order]), half * w.sum())) + 1]


def estimate(x: np.ndarray, w: np.ndarray, share: float, floor=0.0) -> tuple[np.ndarray, np.ndarray]:
    mean = np.average(x, axis=0, weights=w)
    return mean, scatter((x - mean).T @ ((x - mean) * w[:, None]) / w.sum(), share, floor)


def squared(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def concentrate(x: np.ndarray, w: np.ndarray, mean, cov, half: float, steps: int, floor=0.0):
    """Concentration steps, until nothing changes."""
    last = None
    for _ in range(steps):
        own = nearest(squared(x, mean, cov), w, half)
        mean, cov = estimate(x[own], w[own], float(w[own].sum() / w.sum()), floor)
        if last is not None and np.array_equal(last, np.sort(own)):
            break
        last = np.sort(own)
    return mean, cov


def determinant(cov: np.ndarray) -> float:
    return float(np.linalg.slogdet(cov)[1])


def chunk_starts(x: np.ndarray, w: np.ndarray, half: float, floor=0.0, starts: int = 20, best: int = 2) -> list[tuple[np.ndarray, np.ndarray]]:
    """FastMCD inside one chunk: elemental starts, two steps each, the best ones to the end."""
    order = np.lexsort(x.T)  # the result must not hang on the order of rows
    x, w = x[order], w[order].astype(np.float64)
    if len(x) <= K + 1:
        return [estimate(x, w, 1.0, floor)]
    rng, found = np.random.default_rng(7), []
    for _ in range(starts):
        some = rng.choice(len(x), K + 1, replace=False)
        found.append(concentrate(x, w, *estimate(x[some], w[some], 1.0, floor), half, 2, floor))
    found.sort(key=lambda e: determinant(e[1]))
    return [concentrate(x, w, *e, half, 30, floor) for e in found[:best]]


# estimates of all rows

PAIRS = [(i, j) for i in range(K) for j in range(i, K)]
_NAMES = [*(f"m{i}" for i in range(K)), *(f"w{i}{j}" for i, j in PAIRS), "logdet"]
_PARAMS = "gl string, gs string, cand long, " + ", ".join(f"{c} double" for c in _NAMES)


def _params(gl, gs, cand, mean, cov) -> dict:
    """One estimate's row: the mean, and W with distance^2 = sum_i (sum_{j>=i} W_ij (x_j - m_j))^2."""
    w = np.linalg.cholesky(np.linalg.inv(cov)).T
    return {"gl": gl, "gs": gs, "cand": cand} | {f"m{i}": mean[i] for i in range(K)} | {f"w{i}{j}": w[i, j] for i, j in PAIRS} | {"logdet": determinant(cov)}


def distance() -> Column:
    """Squared Mahalanobis distance, over the columns of vectors() and of an estimate."""
    rows = [sum((F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1, K)), F.col(f"w{i}{i}") * (F.col(f"x{i}") - F.col(f"m{i}"))) for i in range(K)]
    return sum((r * r for r in rows[1:]), rows[0] * rows[0])


def level_of(d):
    """The bin of a squared distance; also of numpy arrays."""
    if isinstance(d, Column):
        return F.least(F.greatest(F.floor(F.log2(d + F.lit(1e-9)) * PER_OCTAVE) + BINS // 2, F.lit(0)), F.lit(BINS - 1)).cast("int")
    return np.clip(np.floor(np.log2(d + 1e-9) * PER_OCTAVE) + BINS // 2, 0, BINS - 1)


def upper(level: float) -> float:
    return 2.0 ** ((level + 1 - BINS // 2) / PER_OCTAVE)


def _sums() -> list[Column]:
    w = F.col("w")
    return [F.sum(w).alias("n"), *(F.sum(w * F.col(f"x{i}")).alias(f"s{i}") for i in range(K)), *(F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in PAIRS)]


def step(rows: DataFrame, now: DataFrame, half: float, floor=0.0) -> DataFrame:
    """One concentration step over all rows(gl, gs, x0, ..., w) of every estimate in the settled table `now`."""

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("level")
        n = pdf["n"].to_numpy()
        upto = int(np.searchsorted(np.cumsum(n), half * n.sum())) + 1
        tot = pdf.iloc[:upto].sum(numeric_only=True)
        mean = np.array([tot[f"s{i}"] for i in range(K)]) / tot["n"]
        cov = np.zeros((K, K))
        for i, j in PAIRS:
            cov[i, j] = cov[j, i] = tot[f"p{i}{j}"] / tot["n"] - mean[i] * mean[j]
        return pd.DataFrame([_params(*(pdf[c].iloc[0] for c in ("gl", "gs", "cand")), mean, scatter(cov, float(tot["n"] / n.sum()), floor))])

    # broadcast where few: rows stay where they are and are summed there, however large their group
    binned = rows.join(few(now), ["gl", "gs"]).withColumn("level", level_of(distance()))
    # at most BINS rows for each estimate
    return binned.groupBy("gl", "gs", "cand", "level").agg(*_sums()).groupBy("gl", "gs", "cand").applyInPandas(again, _PARAMS)


def pooled(first: DataFrame, pool: int) -> DataFrame:
    """At most `pool` of a group's estimates: of 256 parts by hash the best each, then by determinant and by hash."""
    h = F.xxhash64("gl", "gs", "cand")
    best = first.groupBy("gl", "gs", F.pmod(h, F.lit(256)).alias("of")).agg(F.min_by(F.struct("cand", *_NAMES), F.struct("logdet", "cand")).alias("p")).select("gl", "gs", "p.*")
    here = Window.partitionBy("gl", "gs")  # 256 rows at most
    ranked = best.withColumns({"a": F.row_number().over(here.orderBy("logdet", "cand")), "b": F.row_number().over(here.orderBy(F.xxhash64("cand"), "cand"))})
    return ranked.where((F.col("a") <= pool - pool // 2) | (F.col("b") <= pool // 2)).select("gl", "gs", "cand", *_NAMES)


def estimates(rows: DataFrame, *, half: float, chunk: int, least: int, floor=0.0, pool: int = 10, tolerance: float = 1e-3, max_steps: int = 40) -> DataFrame:
    """An MCD estimate for each group (gl, gs) of rows(gl, gs, x0, ..., w) that has `least` rows; settled."""
    group = ["gl", "gs"]
    sizes = settle(rows.groupBy(*group).agg(F.sum("w").alias("rows"), F.count(F.lit(1)).alias("vectors")).where(F.col("rows") >= least), "sizes")
    part = F.pmod(F.xxhash64(*VECTOR), F.ceil(F.col("vectors") / F.lit(chunk))).cast("int")
    # dealt by chunk: a large group's rows must not follow the join's key into one task
    dealt = rows.join(few(sizes), group).select(*group, part.alias("part"), *VECTOR, "w").repartition(*group, "part")

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        gl, gs, at = (pdf[c].iloc[0] for c in ("gl", "gs", "part"))
        found = chunk_starts(pdf[list(VECTOR)].to_numpy(dtype=np.float64), pdf["w"].to_numpy(), half, floor)
        return pd.DataFrame([_params(gl, gs, int(at) * 8 + k, *e) for k, e in enumerate(found)])

    first = settle(dealt.groupBy(*group, "part").applyInPandas(starts, _PARAMS), "starts")
    now = settle(pooled(first, pool), "pooled")
    for _ in range(2):
        now = _next(now, step(rows, now, half, floor))
    now = _next(now, now.groupBy(*group).agg(F.min_by(F.struct("cand", *_NAMES), F.struct("logdet", "cand")).alias("p")).select(*group, "p.*"))
    done = []
    for _ in range(max_steps):
        was = now.select(*group, F.struct(*_NAMES).alias("was"))
        both = settle(was.join(step(rows, now, half, floor), group).withColumn("falls", F.col("logdet") < F.col("was.logdet") - tolerance), "mcd")
        # bins make a step an approximate one: a group is done when its determinant falls no more
        done.append(both.where("not falls").select(*group, "cand", "was.*"))
        more = settle(both.where("falls").select(*group, "cand", *_NAMES), "mcd")
        forget(now)
        now = more
        if now.isEmpty():
            break
    out = settle(reduce(DataFrame.unionByName, [*done, now]), "estimates")
    forget(first, sizes, now)
    return out


def _next(old: DataFrame, new: DataFrame) -> DataFrame:
    out = settle(new, "mcd")
    forget(old)
    return out


def tails(rows: DataFrame, found: DataFrame, clean_lost: float) -> DataFrame:
    """(gl, cutoff) of each pooled estimate: the chi-square cut, widened to the upper quartile of its rows' distances."""
    quartile, cut = chi_quantile(0.75), chi_quantile(1 - clean_lost)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("level")
        n = pdf["n"].to_numpy()
        at = upper(pdf["level"].iloc[int(np.searchsorted(np.cumsum(n), 0.75 * n.sum()))])
        return pd.DataFrame([{"gl": pdf["gl"].iloc[0], "cutoff": cut * max(1.0, at / quartile)}])

    own = found.where("gs = '*'")
    own._settled_path = found._settled_path
    binned = rows.where("gs = '*'").join(few(own), ["gl", "gs"]).groupBy("gl", level_of(distance()).alias("level")).agg(F.sum("w").alias("n"))
    return settle(binned.groupBy("gl").applyInPandas(of, "gl string, cutoff double"), "tails")


def judge(docs: DataFrame, *, clean_lost: float = 1e-6, half: float = 0.5, chunk: int = 2000, least: int = 60, pool: int = 10) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance (squared), cutoff and kept for each row of docs."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    rows = vectors(statistics(docs)).withColumns({"gl": name("lang"), "gs": name("source")})
    rows = settle(rows, "stats")
    fit = rows.where(~base_failed())
    langs = settle(fit.groupBy("gl").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least).select("gl", F.lit("*").alias("many")), "small")
    scale = fit.agg(*(f(c).alias(f"{k}{c}") for c in VECTOR for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    typical = math.expm1(scale["mx0"] or 0.0)
    floor = np.square(resolution(typical) / np.array([scale[f"s{c}"] or 1.0 for c in VECTOR]))
    on = {c: (F.col(c) - F.lit(scale[f"m{c}"] or 0.0)) / F.lit(scale[f"s{c}"] or 1.0) for c in VECTOR}
    rows = rows.withColumns(on).join(few(langs), "gl", "left").withColumn("gl", F.coalesce("many", "gl")).drop("many")
    # every row counts for its own group and for its language's pool: one set of estimates has both
    both = F.explode(F.array(F.col("gs"), F.lit("*"))).alias("gs")
    counted = rows.where(~base_failed()).select("gl", both, *VECTOR).groupBy("gl", "gs", *VECTOR).agg(F.count(F.lit(1)).alias("w"))
    counted = settle(counted, "vectors")
    found = estimates(counted, half=half, chunk=chunk, least=least, floor=floor, pool=pool)
    cuts = tails(counted, found, clean_lost)
    forget(counted)
    params = F.struct(*_NAMES)
    # an estimate's row is read once for its own group and once for the rest of its language
    own, rest = (_part(found, found.where(where).select(*keys, params.alias(to))) for where, keys, to in (("gs <> '*'", ("gl", "gs"), "own"), ("gs = '*'", ("gl",), "pool")))
    far = rows.join(few(own), ["gl", "gs"], "left").join(few(rest), "gl", "left").join(few(cuts), "gl", "left")
    far = far.withColumn("e", F.coalesce("own", "pool")).select(*rows.columns, "cutoff", "e.*").withColumn("distance", distance())
    fine = F.coalesce(F.col("distance") <= F.col("cutoff"), F.lit(True))
    names = [x.split()[0] for x in STATS.split(", ")]
    return far.select("doc_id", "lang", "source", *names, base_failed().alias("base_failed"), (~base_failed() & fine).alias("kept"), "distance", "cutoff")


def _part(settled: DataFrame, df: DataFrame) -> DataFrame:
    """A part of a settled table, which is then measured as the whole of it."""
    df._settled_path = settled._settled_path
    return df
