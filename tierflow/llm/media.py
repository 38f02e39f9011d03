"""Media columns: payloads kept losslessly as 8-bit audio, in content-defined chunks stored once.

A payload becomes a mono 8-bit WAV file, sample for byte. The file is cut where a rolling gear hash
of the last 32 bytes has `AVERAGE_BITS` zero top bits (pieces of LEAST to MOST bytes), so equal
passages give equal chunks wherever they stand. Chunks are known by their SHA-256:

1. A pass over the payloads gives the digests; an aggregation finds those that occur more than once.
2. A bitmap of fixed size (2^SLOT_BITS bits) over digest prefixes tells the writers which chunks may
   be shared. A false hit only sends a chunk the longer way; nothing depends on it.
3. The second pass writes each object's recipe (chunk sizes and digests in order). A chunk that can't
   be shared is kept with its object; the others go to the chunk store, deduplicated by digest.
4. Reading back joins recipes with the chunk store by digest, puts each file together in order and
   verifies its digest; features are computed from the samples. An object is read once for all its
   copies, as those consist of shared chunks alone; the length before padding stays each row's own.

Most bytes never cross a shuffle: only shared chunks do. An object with very many copies is counted
first, and its copies meet their values on salted keys, so they don't meet in one task.

Defined results: null text is the empty payload (192 spaces); repeated rows and equal texts have
equal values; a null doc_id stays null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop_path, few, pieces, scratch_path, settle

UNIT, RATE = 192, 8000
LEAST, AVERAGE_BITS, MOST = 256, 10, 8192
SLOT_BITS, BLOCK_BITS = 25, 15
#: Copies of an object that may share a key.
SHARED_KEY = 100


def gear_table() -> np.ndarray:
    """256 mixed 32-bit numbers, by the rule of splitmix64 on the byte's value."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for s in (1, 2, 4, 8, 16):  # h[i] = sum of gear[data[i - k]] << k for k < 32
        h[s:] += h[:-s] << np.uint32(s)
    out, start, n = [], 0, len(data)
    for at in (np.flatnonzero(h < np.uint32(1 << (32 - AVERAGE_BITS))) + 1).tolist():
        while at - start > MOST:
            start += MOST
            out.append(start)
        if at - start >= LEAST:
            out.append(at)
            start = at
    while n - start > MOST:
        start += MOST
        out.append(start)
    if start < n:
        out.append(n)
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the number of bytes before padding."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" "), len(raw)


def to_wav(payload: bytes) -> bytes:
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def from_wav(media: bytes) -> bytes:
    n = struct.unpack("<I", media[40:44])[0]
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data" or len(media) != 44 + n:
        raise ValueError("not a file of to_wav()")
    return media[44:]


def features(payload: bytes) -> str:
    """Mean, root mean square and mean crossings of the samples around the middle value."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    return f"mean={x.sum() / len(x):.6f};rms={float(np.sqrt((x * x).sum() / len(x))):.6f};crossings={int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())}"


def chunks_of(media: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of the chunks in order."""
    ends = cuts(media)
    return [(hashlib.sha256(c := media[a:b]).digest(), c) for a, b in zip([0, *ends], ends)]


def slots(digests: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(d[:4], "big") >> (32 - SLOT_BITS) for d in digests], dtype=np.int64)


def shared_bitmap(docs: DataFrame) -> np.ndarray:
    """Bits of the slots of all digests that occur more than once."""

    def digests(batches):
        for b in pieces(batches):
            found = [d for t in b.column(0) for d, _ in chunks_of(to_wav(payload_of(t.as_py())[0]))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["digest"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(digests, "digest binary").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    slot = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - SLOT_BITS)
    marked = counted.where("n > 1").select(F.shiftright(slot, BLOCK_BITS).cast("int").alias("block"), slot.alias("slot"))

    def block(t: pa.Table) -> pa.Table:
        bits = np.zeros(1 << BLOCK_BITS, dtype=np.uint8)
        bits[t["slot"].to_numpy() & ((1 << BLOCK_BITS) - 1)] = 1
        return pa.table({"block": t["block"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros((1 << (SLOT_BITS - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), dtype=np.uint8)
    for r in marked.distinct().groupBy("block").applyInArrow(block, "block int, bits binary").collect():  # 4 MB in all
        out[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.ravel()


STORED = "shared int, doc_id long, n_bytes long, media_sha256 string, sizes array<int>, digests array<binary>, kept binary, lot int"
DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def write_store(docs: DataFrame, path: str) -> None:
    """Objects and shared chunks, in folders by `shared`: 0 objects with chunks of their own, 1 with
    some shared, 2 all shared, 3 chunks (digest in media_sha256's place, as hexadecimal digits)."""
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(shared_bitmap(docs))
    names = [x.split()[0] for x in STORED.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.int32()]

    def run(batches):
        bits, sent, lot = bitmap.value, set(), 0
        for b in pieces(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                payload, n = payload_of(text.as_py())
                media = to_wav(payload)
                parts = chunks_of(media)
                at = slots([d for d, _ in parts])
                may = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
                sizes = [-len(c) if s else len(c) for (_, c), s in zip(parts, may)]  # negative: in the chunk store
                for (d, c), s in zip(parts, may):
                    if s and d not in sent:
                        if len(sent) > 100_000:
                            sent.clear()
                        sent.add(d)
                        rows.append((3, None, None, d.hex(), [], [], c, None))
                kept = b"".join(c for (_, c), s in zip(parts, may) if not s)
                kind = 0 if not may.any() else 2 if may.all() else 1
                rows.append((kind, doc, n, hashlib.sha256(media).hexdigest(), sizes, [d for (d, _), s in zip(parts, may) if s], kept, lot))
                lot = (lot + 1) % 4096  # deals an object's copies over keys where they are joined
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names=names)

    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, STORED).write.option("compression", "zstd").partitionBy("shared").parquet(path)


def rebuild(rows: DataFrame) -> DataFrame:
    """Digests and features of rows(doc_id, n_bytes, media_sha256, sizes, kept, fetched): the stored bytes, put together and verified."""
    names = ["doc_id", *(x.split()[0] for x in DIGESTS.split(", "))]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in pieces(batches):
            out = []
            cols = b.columns
            for k in range(b.num_rows):
                doc, n, sha, sizes = (cols[i][k].as_py() for i in range(4))
                kept, fetched = cols[4][k].as_py(), cols[5][k].as_py() or []
                lent, at, parts = iter(c["data"] for c in fetched), 0, []
                for size in sizes:
                    if size < 0:
                        parts.append(next(lent))
                    else:
                        parts.append(kept[at : at + size])
                        at += size
                media = b"".join(parts)
                if hashlib.sha256(media).hexdigest() != sha:
                    raise ValueError(f"document {doc}: the stored chunks don't give its file")
                payload = from_wav(media)
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), sha, features(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(names), kinds)], names=names)

    return rows.select("doc_id", "n_bytes", "media_sha256", "sizes", "kept", "fetched").mapInArrow(run, f"doc_id long, {DIGESTS}")


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id and DIGESTS for each row of docs(doc_id, text), read back from the store."""
    spark = docs.sparkSession
    path = scratch_path(spark, "media")
    write_store(docs, path)
    stored = spark.read.schema(STORED).parquet(path)
    store = settle(stored.where("shared = 3").groupBy(F.col("media_sha256").alias("digest")).agg(F.first("kept").alias("data")), "chunks")
    drop_path(spark, f"{path}/shared=3")
    fetch = "array<struct<place:int,data:binary>>"
    plain = rebuild(stored.where("shared = 0").withColumn("fetched", F.lit(None).cast(fetch)))

    whole = stored.where("shared = 2").groupBy("media_sha256").agg(F.first(F.struct("n_bytes", "sizes", "digests", "kept")).alias("o")).select(F.lit(None).cast("long").alias("doc_id"), "media_sha256", "o.*")
    whole = whole.withColumn("whole", F.lit(True))
    part = stored.where("shared = 1").select("doc_id", "media_sha256", "n_bytes", "sizes", "digests", "kept", F.lit(False).alias("whole"))
    some = whole.unionByName(part)
    asked = some.select("media_sha256", F.posexplode("digests").alias("place", "d")).select("media_sha256", "place", F.lower(F.hex("d")).alias("digest"))
    asked = settle(asked.distinct(), "asked")
    got = asked.join(store, "digest").groupBy("media_sha256").agg(F.sort_array(F.collect_list(F.struct("place", "data"))).alias("fetched"))
    ready = some.join(got, "media_sha256")
    values = [x.split()[0] for x in DIGESTS.split(", ")]
    # n_bytes is each row's own: texts that differ only in trailing spaces have one file
    one = settle(rebuild(ready.where("whole")).select(*values).drop("n_bytes"), "built")
    copies = stored.where("shared = 2").select("doc_id", "n_bytes", "media_sha256", "lot")
    many = copies.groupBy("media_sha256").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARED_KEY)).cast("int").alias("salts")).where("salts > 1")
    many = few(settle(many, "copied"))
    salts = F.coalesce(F.col("salts"), F.lit(1))
    salted = copies.join(many, "media_sha256", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "lot"), salts).cast("int")).drop("salts", "lot")
    spread = one.join(many, "media_sha256", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    named = salted.join(spread, ["media_sha256", "salt"])
    return plain.unionByName(rebuild(ready.where("not whole"))).unionByName(named.select("doc_id", *values))
