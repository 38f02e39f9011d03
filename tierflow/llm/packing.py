"""Vector bin packing of tokenised examples into fixed-length sequences.

Every example has three demands: tokens, segments (1) and loss-bearing tokens. A sequence has a
limit on each. The dot-product heuristic fills one sequence at a time: of the waiting pieces that
fit, it takes the one whose demand vector, over the limits, has the largest dot product with what
the sequence still has free, so that token-heavy, segment-heavy and loss-heavy pieces balance each
other. When nothing that waits fits and the gap is worth a cut, a waiting piece is cut to fill it: a
piece is a run of an example's ids, and each id lies in exactly one piece. Pieces of one doc_id share
a sequence only where nothing else fits.

Loss-bearing tokens are given by the example: pack_examples() takes ids with a loss mask (as chat
formatting makes them), pack() tokenises texts, whose `prompt` column, if named, comes before the text
and bears no loss. Plain documents bear loss on all ids but the first, which nothing predicts; on them
the loss limit of a whole sequence never binds, and only tokens and segments do.

The first pass is a map: a task keeps at most `pool` waiting pieces, however large its partition is,
and closes sequences as the pool fills; what is left at its end and doesn't fill a sequence (at least
`full` of it) is handed on with its ids. The second pass packs these tails together, in tasks of about
`tail_tokens` ids, so padding doesn't grow with the number of partitions. Between them the pieces are a
written table: a lost executor repeats a task, and its result, on the same split, is the same.

Defined results: null text is the empty text (its only id is the end id); repeated rows are packed
as often as they occur; a null doc_id stays null; a null prompt is empty; an empty table gives no rows;
extra columns are ignored; an example longer than a sequence is cut into whole sequences and a rest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import pieces, settle
from .tokens import default_vocabulary, encoder

#: Rows of the result: one per piece; ids only where they are asked for.
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"
#: Rows between the passes: pieces of closed sequences, or tails (sequence_id null) with their ids and masks.
BETWEEN = f"{SCHEMA}, ids binary, mask binary"
#: Sequences of one partition have ids from partition * 2^36 on, those of the second pass from 2^62 on.
PER_PARTITION, SECOND = 1 << 36, 1 << 62


class Packer:
    """Fills sequences from a bounded pool of pieces (key, start, ids, mask); key is (doc_id, tokens of the example).

    Sequences of less than `full` of the token limit go to `tails` at the end, or are closed too (full=0).
    """

    def __init__(self, limits: tuple[int, int, int], pool: int, first_id: int, least_cut: int, full: float = 0.0, keep_ids: bool = False):
        self.limits = np.array(limits, dtype=np.float64)
        self.tokens, self.segments, self.losses = limits
        self.pool, self.next_id, self.least_cut = pool, first_id, least_cut
        self.full, self.keep_ids = full, keep_ids
        self.items: list = []
        self.out: list = []
        self.tails: list = []

    def emit(self, members: list) -> None:
        at = 0
        for (doc, total), start, ids, mask in members:
            n = len(ids)
            self.out.append((doc, start, n, zlib.crc32(ids), total, int(mask.sum()), self.next_id, at, ids.tobytes() if self.keep_ids else None, None))
            at += n
        self.next_id += 1

    def add(self, key: tuple, ids: np.ndarray, mask: np.ndarray, start: int = 0) -> None:
        """mask is 0 or 1 for each id; whole sequences are cut off at once."""
        at, n = 0, len(ids)
        while n - at >= self.tokens and mask[at : at + self.tokens].sum() <= self.losses:
            self.emit([(key, start + at, ids[at : at + self.tokens], mask[at : at + self.tokens])])
            at += self.tokens
        while at < n:  # a piece that waits fits into an empty sequence
            upto = at + self.room(mask[at:], self.tokens, self.losses)
            self.items.append((key, start + at, ids[at:upto], mask[at:upto]))
            at = upto
        if len(self.items) >= self.pool:
            self.fill(self.pool // 2)

    @staticmethod
    def room(mask: np.ndarray, tokens: float, losses: float) -> int:
        """How many ids of a piece fit into so many tokens and loss-bearing tokens."""
        some = mask[: int(tokens)]
        return int(np.searchsorted(np.cumsum(some, dtype=np.int64), int(losses), side="right")) if int(losses) < len(some) else len(some)

    def fill(self, leave: int, last: bool = False) -> None:
        """Close sequences until at most `leave` pieces wait."""
        if len(self.items) <= leave:
            return
        need = np.array([(len(i), 1, m.sum()) for _, _, i, m in self.items], dtype=np.float64)
        docs = np.array([hash(k[0]) for k, _, _, _ in self.items])
        waits = np.ones(len(need), dtype=bool)
        left = len(need)
        while left > leave:
            free, members, met = self.limits.copy(), [], []
            while left:
                fits = np.flatnonzero(waits & (need <= free).all(axis=1))
                if len(met) and len(fits):
                    other = fits[~np.isin(docs[fits], met)]
                    fits = other if len(other) else fits
                if len(fits):
                    best = fits[np.argmax((need[fits] / self.limits) @ (free / self.limits))]
                    members.append(self.items[best])
                    met.append(docs[best])
                    free -= need[best]
                    waits[best] = False
                    left -= 1
                    if free[0] == 0:
                        break
                    continue
                if min(free[0], free[2]) >= self.least_cut and free[1] >= 1:
                    best = np.flatnonzero(waits)[np.argmax(need[waits, 0])]
                    key, start, ids, mask = self.items[best]
                    upto = self.room(mask, free[0], free[2])
                    if 0 < upto < len(ids):
                        members.append((key, start, ids[:upto], mask[:upto]))
                        self.items[best] = (key, start + upto, ids[upto:], mask[upto:])
                        need[best] = (len(ids) - upto, 1, mask[upto:].sum())
                break
            if last and self.tokens - free[0] < self.full * self.tokens:
                self.tails += members
            else:
                self.emit(members)
        self.items = [x for x, w in zip(self.items, waits) if w]

    def finish(self) -> None:
        self.fill(0, last=True)
        for (doc, total), start, ids, mask in self.tails:
            self.out.append((doc, start, len(ids), zlib.crc32(ids), total, int(mask.sum()), None, None, ids.tobytes(), np.packbits(mask).tobytes()))
        self.tails = []


def _rows(out: list) -> pa.RecordBatch:
    names = [x.split()[0] for x in BETWEEN.split(", ")]
    kinds = [pa.int64()] * 8 + [pa.binary()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(names), kinds)], names=names)


def plain_mask(n: int, prompt: int = 0) -> np.ndarray:
    """Nothing predicts an example's first id, and a prompt is not learnt: all other ids bear loss."""
    mask = np.ones(n, dtype=np.uint8)
    mask[: max(prompt, 1)] = 0
    return mask


def _packed(rows: DataFrame, read, limits: tuple[int, int, int], *, pool: int, least_cut: int, full: float, with_ids: bool, tail_tokens: int) -> DataFrame:
    """Both passes; read(batch) gives (doc_id, ids, mask) of its rows."""

    def first(batches):
        packer = Packer(limits, pool, TaskContext.get().partitionId() * PER_PARTITION, least_cut, full, with_ids)
        for b in pieces(batches):
            for doc, ids, mask in read(b):
                packer.add((doc, len(ids)), ids, mask)
                if len(packer.out) >= 2_000:
                    yield _rows(packer.out)
                    packer.out = []
        packer.finish()
        yield _rows(packer.out)

    def second(batches):
        packer = Packer(limits, pool, SECOND + TaskContext.get().partitionId() * PER_PARTITION, least_cut, 0.0, with_ids)
        for b in pieces(batches):
            cols = b.to_pydict()
            for doc, start, total, ids, mask in zip(*(cols[c] for c in ("doc_id", "start", "doc_tokens", "ids", "mask"))):
                own = np.frombuffer(ids, dtype="<u4")
                packer.add((doc, total), own, np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=len(own)), start)
                if len(packer.out) >= 2_000:
                    yield _rows(packer.out)
                    packer.out = []
        packer.finish()
        yield _rows(packer.out)

    done = settle(rows.mapInArrow(first, BETWEEN), "packed")
    tails = done.where("sequence_id is null")
    n = max(1, -(-(tails.agg(F.sum("length")).first()[0] or 0) // tail_tokens))
    keys = ["doc_id", "start", "length", "ids_crc32"]
    dealt = tails.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "mask").repartition(n, *keys).sortWithinPartitions(*keys)
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
    return done.where("sequence_id is not null").select(*names).unionByName(dealt.mapInArrow(second, BETWEEN).select(*names))


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    *,
    prompt: str | None = None,
    sequence: int = 2048,
    segments: int = 256,
    loss_tokens: int | None = None,
    end_id: int = 1,
    pool: int = 1024,
    least_cut: int = 16,
    full: float = 0.99,
    with_ids: bool = False,
    tail_tokens: int = 4_000_000,
) -> DataFrame:
    """Pieces of all rows of docs(doc_id, text): see the module's text; rows as in SCHEMA, with_ids also their ids (little-endian 32-bit)."""
    vocabulary = vocabulary or default_vocabulary()

    def read(b):
        enc = encoder(vocabulary)
        end = np.array([end_id], dtype="<u4")
        for doc, text, before in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            lead = before.as_py()
            lead = enc.encode(lead) if lead else np.zeros(0, dtype="<u4")
            ids = np.concatenate([lead, enc.encode(text.as_py() or ""), end])
            yield doc, ids, plain_mask(len(ids), len(lead))

    lead = F.col(f"`{prompt}`") if prompt else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), lead.cast("string").alias("prompt"))
    limits = (sequence, segments, loss_tokens or sequence)
    return _packed(rows, read, limits, pool=pool, least_cut=least_cut, full=full, with_ids=with_ids, tail_tokens=tail_tokens)


def pack_examples(
    examples: DataFrame, *, sequence: int = 2048, segments: int = 256, loss_tokens: int | None = None, pool: int = 1024, least_cut: int = 16, full: float = 0.99, with_ids: bool = False, tail_tokens: int = 4_000_000
) -> DataFrame:
    """As pack(), of examples(doc_id, ids, loss): ids as little-endian 32-bit numbers, loss a byte (0 or 1) for each; null is no ids."""

    def read(b):
        for doc, ids, loss in zip(*(b.column(k).to_pylist() for k in range(3))):
            yield doc, np.frombuffer(ids or b"", dtype="<u4"), np.frombuffer(loss or b"", dtype=np.uint8)

    rows = examples.select(F.col("doc_id").cast("long"), F.col("ids").cast("binary"), F.col("loss").cast("binary"))
    return _packed(rows, read, (sequence, segments, loss_tokens or sequence), pool=pool, least_cut=least_cut, full=full, with_ids=with_ids, tail_tokens=tail_tokens)
