"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of two hashed embeddings, of the word and of its first letters. Filters
of several widths slide over the word vectors of the whole text, the largest response of each filter
is kept, and a logistic unit scores the pooled responses. Embeddings start from the log-odds of the
words among toxic and other training texts in one dimension and small random values in the rest;
all weights are then trained by Adam. A part of the training rows, kept aside, scales the logits at
the labels' own share of toxic rows, so that the best common threshold is 0.7, and sets a threshold
for each language.

The score depends on the text alone. The fit uses a bounded sample of labelled rows: at most
`toxic_rows` and `other_rows` of the labels, smallest hash of the id first, each id's text once, and
`max_chars` characters, passing over texts that don't fit in any more; the model's size is fixed, so
it can be broadcast. Scoring is one map over the input, no shuffle. Very long texts are read in parts
and pooled over overlapping windows, so a worker holds the vectors of WINDOW words at most.

Defined results: null and empty texts get the score of a text without words; without labelled
training rows of both kinds every score is the share of toxic ones among them (0 without any), with
a warning; rows with a null label are left out of the fit; an id with several texts is fitted on that
of the smallest hash; an id labelled both ways counts as both; repeated rows return as often as they
occur; a null lang has the common threshold; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import pieces


BUCKETS, DIM, FILTERS, WIDTHS, STEM = 1 << 17, 16, 12, (1, 2, 3), 6
POINT = 0.7
#: Words whose vectors are held at once; bytes of a text that are split at once.
WINDOW, PART = 100_000, 1 << 20
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, lang string, threshold double, rejected boolean"

#: Bytes that end a word: all of ASCII but the letters (texts are lower-cased before).
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Words(dict):
    """A word's pair of embedding rows, kept for words seen before (bounded)."""

    def __missing__(self, w: bytes) -> int:
        stem = w.decode(errors="ignore")[:STEM].encode()
        out = self[w] = (zlib.crc32(w) % BUCKETS) * BUCKETS + zlib.crc32(stem, 1) % BUCKETS
        return out

    def rows(self, text: str | None) -> np.ndarray:
        """(words, 2): rows of the two embedding tables."""
        raw, at, found = (text or "").lower().encode().translate(_LETTERS), 0, []
        while at < len(raw) or not found:
            end = raw.find(b" ", at + PART) if at + PART < len(raw) else -1
            end = end if end >= 0 else len(raw)
            if len(self) > 400_000:
                self.clear()
            ws = raw[at:end].split()
            k = np.fromiter(map(self.__getitem__, ws), dtype=np.int64, count=len(ws))
            found.append(np.stack([k // BUCKETS, k % BUCKETS], axis=1).astype(np.int32))
            at = end
        return found[0] if len(found) == 1 else np.concatenate(found)


class Model:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.05).astype(np.float32)
        self.embed = [small(BUCKETS, DIM), small(BUCKETS, DIM)]
        for e in self.embed:
            e[:, 0] = 0
        self.conv = {k: small(k, DIM, FILTERS) for k in WIDTHS}
        for w in self.conv.values():
            w[0, 0, :] += np.linspace(0.5, 1.5, FILTERS, dtype=np.float32)
        self.bias = {k: np.zeros(FILTERS, dtype=np.float32) for k in WIDTHS}
        self.out = np.full(FILTERS * len(WIDTHS), 0.05, dtype=np.float32)
        self.out_bias = np.zeros(1, dtype=np.float32)
        self.scale, self.shift, self.constant = 1.0, 0.0, None
        self.thresholds: dict[str | None, float] = {}

    def params(self) -> list[np.ndarray]:
        return [*self.embed, *(self.conv[k] for k in WIDTHS), *(self.bias[k] for k in WIDTHS), self.out, self.out_bias]

    def forward(self, docs: list[np.ndarray], trace: bool = False, within: int | None = None):
        """Pooled responses of each text, of its first `within` places; with trace, also the place of each maximum."""
        pad = max(WIDTHS) - 1
        sizes = np.array([max(len(d), 1) for d in docs])  # a text without words has one place, of zeros
        starts = np.concatenate([[0], np.cumsum(sizes + pad)[:-1]])
        rows = np.concatenate([np.concatenate([d, np.full((pad + (not len(d)), 2), -1, dtype=np.int32)]) for d in docs])
        x = self.embed[0][rows[:, 0]] + self.embed[1][rows[:, 1]]
        x[rows[:, 0] < 0] = 0
        n = len(rows)
        ends = starts + (sizes if within is None else np.minimum(sizes, within))
        pooled, places = [], []
        for k in WIDTHS:
            y = np.broadcast_to(self.bias[k], (n, FILTERS)).copy()
            for j in range(k):
                y[: n - j] += x[j:] @ self.conv[k][j]
            if trace:
                at = np.stack([s + y[s:e].argmax(axis=0) for s, e in zip(starts, ends)])
                places.append(at)
                best = y[at, np.arange(FILTERS)]
            else:
                best = np.maximum.reduceat(y, np.stack([starts, ends], axis=1).ravel()[: 2 * len(docs)] if ends[-1] < n else np.stack([starts, ends], axis=1).ravel()[:-1])[::2]
            pooled.append(np.maximum(best, 0))
        return np.concatenate(pooled, axis=1), (x, rows, places)

    def pooled(self, doc: np.ndarray, words: int) -> np.ndarray:
        """Pooled responses of a long text: the maxima over windows, each with the words that its last filters reach."""
        pad, best = max(WIDTHS) - 1, None
        for at in range(0, len(doc), words):
            part = doc[at : at + words + pad]
            whole = at + words + pad >= len(doc)
            # filters that would run over the window's end start in the next one
            got = self.forward([part])[0] if whole else self.forward([part], within=words)[0]
            best = got if best is None else np.maximum(best, got)
            if whole:
                break
        return best

    def logits(self, docs: list[np.ndarray], words: int = WINDOW) -> np.ndarray:
        out, part, size = [], [], 0

        def close() -> None:
            if part:
                out.append(self.forward(part)[0] @ self.out + self.out_bias)
                part.clear()

        for d in docs:
            if len(d) > words:
                close()
                out.append(self.pooled(d, words) @ self.out + self.out_bias)
                size = 0
                continue
            part.append(d)
            size += len(d)
            if size >= words:
                close()
                size = 0
        close()
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(docs), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(docs).astype(np.float64) + self.shift, -50, 50)))

    def gradients(self, docs: list[np.ndarray], y: np.ndarray) -> list:
        """In the order of params(); of the embeddings (rows, their gradients): most rows have none."""
        pooled, (x, rows, places) = self.forward(docs, trace=True)
        z = pooled @ self.out + self.out_bias
        dz = (1 / (1 + np.exp(-z)) - y) / len(docs)
        d_pool = dz[:, None] * self.out * (pooled > 0)
        g_conv, g_bias, touched, moves = [], [], ([], []), []
        for i, k in enumerate(WIDTHS):
            d = d_pool[:, i * FILTERS : (i + 1) * FILTERS]
            g = np.zeros_like(self.conv[k])
            for j in range(k):
                at = np.minimum(places[i] + j, len(rows) - 1)
                inside = (places[i] + j < len(rows)) & (rows[at, 0] >= 0)
                dd = d * inside
                g[j] = np.einsum("bf,bfd->df", dd, x[at])
                moves.append((dd[:, :, None] * self.conv[k][j].T[None]).reshape(-1, DIM))
                for t in (0, 1):
                    touched[t].append(np.where(inside, rows[at, t], 0).ravel())
            g_conv.append(g)
            g_bias.append(d.sum(axis=0))
        moves, g_embed = np.concatenate(moves), []
        for t in (0, 1):
            own, place = np.unique(np.concatenate(touched[t]), return_inverse=True)
            g = np.zeros((len(own), DIM), dtype=moves.dtype)
            np.add.at(g, place, moves)
            g_embed.append((own, g))
        return [*g_embed, *g_conv, *g_bias, pooled.T @ dz, dz.sum(keepdims=True)]


def fit(texts: list[str], toxic: np.ndarray, langs: list[str | None], share: float, *, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Model:
    """A calibrated model; share is the part of toxic rows among all that could have been sampled."""
    model, words = Model(seed), Words()
    if not len(toxic) or toxic.min() == toxic.max():
        warnings.warn("toxicity: no labelled rows of both kinds to fit on, every score is one number", stacklevel=2)
        model.constant = float(toxic.mean()) if len(toxic) else 0.0
        return model
    docs = [words.rows(t) for t in texts]
    aside = np.arange(len(docs)) % 4 == 3  # the rows come in the order of a hash
    for t in (0, 1):
        n = np.zeros((2, BUCKETS))
        for d, y in zip((d for d, a in zip(docs, aside) if not a), toxic[~aside]):
            n[int(y), np.unique(d[:, t])] += 1
        ys = toxic[~aside]
        odds = np.log((n[1] + 0.5) / (ys.sum() + 1)) - np.log((n[0] + 0.5) / ((1 - ys).sum() + 1))
        model.embed[t][:, 0] = np.where(n.sum(axis=0) > 0, odds * (n.sum(axis=0) / (n.sum(axis=0) + 3)), 0) / 2
    rng, now = np.random.default_rng(seed), model.params()
    m, v = [np.zeros_like(p) for p in now], [np.zeros_like(p) for p in now]
    own, step = np.flatnonzero(~aside), 0
    apart, y_apart = [d for d, a in zip(docs, aside) if a], toxic[aside]
    best, kept = rank_quality(model.logits(apart), y_apart), [p.copy() for p in now]
    epochs = max(epochs, -(-60 * batch // max(len(own), 1)))  # small samples need more rounds
    for _ in range(epochs):
        order = rng.permutation(own)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            step += 1
            for i, g in enumerate(model.gradients([docs[k] for k in some], toxic[some].astype(np.float32))):
                at, g = g if isinstance(g, tuple) else (slice(None), g)  # rows without a gradient rest
                m[i][at] += 0.1 * (g - m[i][at])
                v[i][at] += 0.001 * (g * g - v[i][at])
                now[i][at] -= (rate * (m[i][at] / (1 - 0.9**step)) / (np.sqrt(v[i][at] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        if (q := rank_quality(model.logits(apart), y_apart)) > best:
            best, kept = q, [p.copy() for p in now]
    for p, k in zip(now, kept):  # the weights of the best round, the start included
        p[...] = k
    calibrate(model, model.logits(apart).astype(np.float64), y_apart, [x for x, a in zip(langs, aside) if a], share)
    return model


def rank_quality(z: np.ndarray, y: np.ndarray) -> float:
    """Share of toxic and other pairs in the right order (ties half)."""
    a, b = z[y == 1], np.sort(z[y == 0])
    return float((np.searchsorted(b, a, "left") + np.searchsorted(b, a, "right")).mean() / 2 / max(len(b), 1)) if len(a) else 0.0


def calibrate(model: Model, z: np.ndarray, y: np.ndarray, langs: list[str | None], share: float) -> None:
    """Scale logits to probabilities, rows weighted to the true share; a threshold for each language."""
    if not len(y) or y.min() == y.max():
        return
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    mid, spread = float(np.average(z, weights=weight)), float(z.std()) + 1e-9
    u = (z - mid) / spread
    # the loss is convex in slope and shift: damped Newton, with a weak pull of the slope to 1
    ab = np.array([1.0, 0.0])

    def loss(ab):
        t = ab[0] * u + ab[1]
        return (weight * (np.logaddexp(0, t) - goal * t)).sum() + 5e-3 * (ab[0] - 1) ** 2

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab[0] * u + ab[1], -50, 50)))
        g, h = weight * (p - goal), weight * p * (1 - p) + 1e-9
        hess = np.array([[(h * u * u).sum() + 1e-2, (h * u).sum()], [(h * u).sum(), h.sum() + 1e-6]])
        step, size = np.linalg.solve(hess, [(g * u).sum() + 1e-2 * (ab[0] - 1), g.sum()]), 1.0
        while size > 1e-4 and loss(ab - size * step) > loss(ab):
            size /= 2
        ab = ab - size * step
    model.scale = max(float(ab[0]), 1e-3) / spread
    model.shift = float(ab[1]) - model.scale * mid

    def best(p: np.ndarray, pick: np.ndarray, low: float) -> float:
        """The threshold from `low` to 0.9 with the largest weighted F1; the middle of equal ones."""
        grid = np.linspace(low, 0.9, 71)
        hit = [weight[pick & (p >= t) & (y == 1)].sum() for t in grid]
        miss = [weight[pick & (p >= t) & (y == 0)].sum() for t in grid]
        f1 = 2 * np.array(hit) / (np.array(hit) + np.array(miss) + weight[pick & (y == 1)].sum() + 1e-12)
        return float(np.median(grid[np.isclose(f1, f1.max())]))

    def scaled() -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -50, 50)))

    # the best common threshold is moved to POINT, where scores are cut
    every = np.ones(len(y), dtype=bool)
    t = best(scaled(), every, 0.2)
    model.shift += float(np.log(POINT / (1 - POINT)) - np.log(t / (1 - t)))
    p = scaled()
    langs = np.array([x or "" for x in langs])
    model.thresholds[None] = POINT
    for x in sorted(set(langs.tolist()) - {""}):
        pick = langs == x
        if (y[pick] == 1).sum() >= 10 and (y[pick] == 0).sum() >= 10:
            model.thresholds[x] = best(p, pick, 0.5)


def train(docs: DataFrame, labels: DataFrame, *, toxic_rows: int = 2000, other_rows: int = 4000, max_chars: int = 40_000_000) -> Model:
    """Fit on labelled rows outside the held-out third: see the module's text for the sample."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = []
    for kind in (0, 1):
        picked += [(r["doc_id"], kind) for r in known.where(F.col("toxic") == kind).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(toxic_rows if kind else other_rows).collect()]
    if not picked:
        return fit([], np.zeros(0), [], 0.0)
    sample = docs.sparkSession.createDataFrame(picked, "doc_id long, toxic int")
    ids = F.broadcast(sample.select("doc_id").distinct())  # at most toxic_rows + other_rows
    # an id's rows meet in partial minima where they lie: one text for each id, however often it occurs
    text = F.struct(F.xxhash64("text"), F.length("text").alias("n"), F.col("text"), F.col("lang"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).join(ids, "doc_id")
    sizes = {r["doc_id"]: r["n"] or 0 for r in rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.length("text").alias("n"))).alias("m")).select("doc_id", "m.n").collect()}
    order = {r["doc_id"]: k for k, r in enumerate(sample.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").collect())}
    kept, size = set(), 0
    for i in sorted(sizes, key=order.__getitem__):
        if size + sizes[i] <= max_chars:  # a text that doesn't fit is passed over
            kept.add(i)
            size += sizes[i]
    if not kept:
        return fit([], np.zeros(0), [], 0.0)
    own = docs.sparkSession.createDataFrame([(i,) for i in kept], "doc_id long")
    found = rows.join(F.broadcast(own), "doc_id").groupBy("doc_id").agg(F.min(text).alias("m")).select("doc_id", "m.text", "m.lang")
    got = found.join(F.broadcast(sample), "doc_id").withColumn("h", F.xxhash64("doc_id")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending"), ("toxic", "ascending")])
    total = sum(counts.values())
    return fit(got["text"].to_pylist(), got["toxic"].to_numpy().astype(np.int64), got["lang"].to_pylist(), counts.get(1, 0) / total)


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = POINT, **sample) -> DataFrame:
    """Rows as in SCHEMA for each row of docs(doc_id, text, lang).

    predicted is by the one threshold, rejected by the threshold of the row's language.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **sample))
    spread = model.value.thresholds

    def run(batches):
        words = Words()
        for b in pieces(batches):
            texts = b.column(2)
            s = model.value.scores([words.rows(t.as_py()) for t in texts]) if len(texts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), b.column(3)], names=["doc_id", "held_out", "score", "lang"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"), F.col("lang").cast("string"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double, lang string")
    own = F.lit(float(spread.get(None, threshold)))
    for lang, t in spread.items():
        if lang is not None:
            own = F.when(F.col("lang") == lang, F.lit(t)).otherwise(own)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "lang", own.alias("threshold"), (F.col("score") >= own).alias("rejected"))


def without_toxic(docs: DataFrame, labels: DataFrame, **sample) -> DataFrame:
    """The rows of docs, all columns, that score() wouldn't reject: one map over docs."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **sample))
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        words, limits = Words(), model.value.thresholds
        common = limits.get(None, POINT)
        for b in pieces(batches):
            s = model.value.scores([words.rows(t.as_py()) for t in b.column(text)]) if b.num_rows else np.zeros(0)
            yield b.filter(pa.array(s < np.array([limits.get(x, common) for x in b.column(lang).to_pylist()], dtype=np.float64), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
