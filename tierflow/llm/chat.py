"""Chat formatting by token-level assembly.

Each turn is encoded in segments of its own (role, text), so no text can merge with a marker, and
reserved ids that the vocabulary doesn't use are spliced between them:

    START role SEP text END

Texts keep no control string: `<|` inside a role or text is written with a backslash between its two
characters (and one more where there are some already), which unescape() takes out again. The loss
mask is the prefix sum of +1 where an assistant's text starts and -1 where it ends. A turn is a row
of the result, with its place in the conversation by a prefix sum of the turns' lengths, so that a
conversation of any length is spread over rows and no task has to hold it.

Turns of a conversation are ordered by turn, then role and text (ties, nulls first). Ids travel as bytes,
two for each where the vocabulary allows; a text travels beside them only where its turn and role occur
again in the conversation, as those are found by a count first.
Defined results: null role or text is empty; a null conv_id or turn is a value like any other;
repeated rows are repeated turns; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import few, pieces, settle
from .tokens import default_vocabulary, encoder

#: Markers, as ids above the vocabulary's last and as text.
MARKERS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No `<|` is left; unescape() gives the text back."""
    return _ESCAPE.sub(lambda m: "<\\" + m[1] + "|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "<" + m[1] + "|", text)


def assemble(enc, role: str, text: str, loss_roles: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of one turn."""
    start, sep, end = (np.array([enc.size + k], dtype="<u4") for k in range(len(MARKERS)))
    parts = [start, enc.encode(escape(role)), sep, enc.encode(escape(text)), end]
    at = np.cumsum([0, *map(len, parts)])
    change = np.zeros(at[-1] + 1, dtype=np.int8)
    if role in loss_roles:
        change[at[3]] += 1
        change[at[4]] -= 1
    return np.concatenate(parts), np.cumsum(change[:-1], dtype=np.int8)


def id_type(vocabulary: str) -> str:
    """How ids are kept: little-endian, in 2 bytes if the vocabulary and the markers fit, else in 4."""
    return "<u2" if encoder(vocabulary).size + len(MARKERS) <= 1 << 16 else "<u4"


def format_chat(turns: DataFrame, vocabulary: str | None = None, *, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, place, start, ids, loss) for each row of turns(conv_id, turn, role, text).

    place numbers a conversation's turns from 0, start is the offset of the turn's first id in it; ids are
    bytes as of id_type(), loss a byte for each id; the rows of a conversation are in one partition, in order.
    """
    vocabulary = vocabulary or default_vocabulary()
    kind = id_type(vocabulary)
    cols = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")]
    slim = turns.select(*cols)
    # (conversation, turn, role) that occur more than once: ties that the text decides
    ties = slim.groupBy("conv_id", "turn", "role").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("conv_id", "turn", "role").alias("h")).distinct()
    ties = settle(ties, "ties")
    h = F.xxhash64("conv_id", "turn", "role")
    tied = F.lit(False) if ties.isEmpty() else F.col("h").isNotNull()
    marked = slim if ties.isEmpty() else slim.withColumn("_h", h).join(few(ties), F.col("_h") == F.col("h"), "left")
    marked = marked.select(*(F.col(c) for c in ("conv_id", "turn", "role", "text")), tied.alias("tied"))

    def run(batches):
        enc = encoder(vocabulary)
        for b in pieces(batches):
            texts, tie = b.column(3).to_pylist(), b.column(4).to_pylist()
            both = [assemble(enc, r or "", t or "", loss_roles) for r, t in zip(b.column(2).to_pylist(), texts)]
            ids = pa.array([i.astype(kind).tobytes() for i, _ in both], pa.binary())
            loss = pa.array([m.tobytes() for _, m in both], pa.binary())
            size = pa.array([len(i) for i, _ in both], pa.int64())
            kept = pa.array([t if own else None for t, own in zip(texts, tie)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], kept, ids, loss, size], names=["conv_id", "turn", "role", "text", "ids", "loss", "size"])

    made = marked.mapInArrow(run, "conv_id long, turn long, role string, text string, ids binary, loss binary, size long")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return made.select("conv_id", "turn", (F.row_number().over(w) - 1).cast("long").alias("place"), (F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"), "ids", "loss")


def examples(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, loss) of format_chat(): a row a turn, with ids of 4 bytes, as packing takes them."""
    kind = id_type(vocabulary or default_vocabulary())

    def run(batches):
        for b in pieces(batches):
            wide = [np.frombuffer(x, dtype=kind).astype("<u4").tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(wide, pa.binary()), b.column(2)], names=["doc_id", "ids", "loss"])

    return formatted.select("conv_id", "ids", "loss").mapInArrow(run, "doc_id long, ids binary, loss binary")


class _Reader:
    """Digests of one conversation, fed with the ids and masks of its turns in order."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss_chars, self.tokens = conv_id, 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, enc, ids: np.ndarray, loss: np.ndarray) -> None:
        start, sep, end = (enc.size + k for k in range(len(MARKERS)))
        marks = np.flatnonzero(ids >= enc.size)
        if ids[marks].tolist() != [start, sep, end] or marks[0] or marks[2] != len(ids) - 1:
            raise ValueError(f"conversation {self.conv_id}: a turn's markers are not in place")
        role, text = enc.decode(ids[1 : marks[1]]), enc.decode(ids[marks[1] + 1 : marks[2]])
        if "<|" in role + " " + text:
            raise ValueError(f"conversation {self.conv_id}: a control string is in a text")
        learnt = unescape(enc.decode(ids[loss != 0]))
        self.turns += 1
        self.tokens += len(ids)
        self.chars += len(role) + len(text) + sum(map(len, MARKERS))
        self.loss_chars += len(learnt)
        self.loss.update(learnt.encode())
        self.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def read_back(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row as in READ for each conversation of format_chat(): its turns are read in order, one at a time."""
    vocabulary = vocabulary or default_vocabulary()
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def rows(done: list) -> pa.RecordBatch:
        cols = zip(*done) if done else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def run(batches):
        enc, now, done, kind = encoder(vocabulary), None, [], id_type(vocabulary)
        for b in pieces(batches):
            for conv, place, ids, loss in zip(*(b.column(k).to_pylist() for k in range(4))):
                if place == 0:
                    if now:
                        done.append(now.row())
                    now = _Reader(conv)
                now.feed(enc, np.frombuffer(ids, dtype=kind).astype(np.int64), np.frombuffer(loss, dtype=np.int8))
            yield rows(done)
            done = []
        if now:
            done.append(now.row())
        yield rows(done)

    return formatted.select("conv_id", "place", "ids", "loss").mapInArrow(run, READ)
