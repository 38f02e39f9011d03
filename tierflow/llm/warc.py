"""WARC archives of pages, their capture index, and its external merge.

write_archives() writes one record for each page: a response with the payload, or, for a payload of
at least `least` bytes that a smaller page_id has as well, a revisit that refers to that response.
Records are text rows ended by the format's own CRLF CRLF, so Spark's committed text writer makes
the archives, in any file system that Spark reaches. Pages are written by size class, with so many
records to a file that none holds more than ARCHIVE bytes of payload (a larger page has one to itself).
Archives are whole-file gzip members; with compression "none" an index row's offset is its place in the file.

read_archives() unpacks an archive as a stream, record by record, by their content lengths, and gives
its index rows as a locally sorted run. The runs are a written table, and merge_runs() merges them from
there, as external sorting does: they are dealt by range of (URL key, timestamp, page_id, archive,
offset), and the pieces of a range's runs go through a loser tree. These keys are unique, so a range
holds about `range_rows` index rows however often a capture is repeated, and a task one range.

Equal payloads are found on slim rows (id and digest), with partial minima before the shuffle; pages
meet their verdict by id, so a payload that a third of all pages share doesn't meet in one task.

Defined results: null html is the empty payload; a null page_id is never the smallest if there is
another; rows that share the smallest page_id and payload are all responses; a null url has no
target header and the empty key; control characters and spaces in a url are percent-encoded; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import forget, scratch_path, settle

CRLF = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# The format's profile for revisits of an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Captures without a time of their own are taken to be seconds apart, by page_id, from this one on.
FIRST = 1_704_067_200

#: Payload bytes of an archive, and the size classes of pages: each one's largest page.
ARCHIVE, CLASSES = 256 << 20, (64 << 10, 1 << 20, 16 << 20, None)

INDEX = "url_key string, ts string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long"


def verdicts(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose record is a revisit."""
    slim = pages.where(F.col("bytes") >= least).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    shared = settle(first.where("n > 1 and refers_to is not null").select("digest", "refers_to"), "shared")
    return settle(slim.join(shared, "digest").where("page_id is null or page_id <> refers_to").distinct(), "revisits")


def with_payload(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))


def write_archives(pages: DataFrame, *, least: int = 100, compression: str = "gzip") -> str:
    """Write a record for each row of pages(page_id, url, html); returns the archives' folder."""
    spark = pages.sparkSession
    rows = with_payload(pages)
    slim = settle(rows.select("page_id", "digest", "bytes"), "digests")
    known = verdicts(slim, least).withColumnsRenamed({"page_id": "known_id", "digest": "known_digest"})
    rows = rows.join(known, F.col("page_id").eqNullSafe(F.col("known_id")) & (F.col("digest") == F.col("known_digest")), "left")
    own = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    safe = F.regexp_replace(F.regexp_replace("url", " ", "%20"), r"[\x00-\x1f\x7f]", "%00")
    block = F.when(F.col("refers_to").isNull(), F.concat(F.lit(HTTP), "payload")).otherwise(F.lit(HTTP))
    at = F.date_format(F.timestamp_seconds(F.lit(FIRST) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), own, F.lit(">")),
        F.concat(F.lit("WARC-Date: "), at),
        F.concat(F.lit("WARC-Target-URI: "), safe),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
        F.when(F.col("refers_to").isNotNull(), F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest"),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)  # concat_ws leaves nulls out
    path = scratch_path(spark, "warc")
    least_of = dict(zip(CLASSES, (None, *CLASSES)))
    within = {top: F.lit(True) if low is None else F.col("bytes") > low for top, low in least_of.items()}
    within = {top: test if top is None else test & (F.col("bytes") <= top) for top, test in within.items()}
    found = slim.agg(*(F.count_if(test).alias(str(k)) for k, test in enumerate(within.values()))).first()
    for k, (top, test) in enumerate(within.items()):
        if found[k] or k == 0:  # an empty table has an empty folder
            records = ARCHIVE // top if top else 1
            out = rows.where(test).select(record.alias("value")).write.mode("append").option("lineSep", CRLF + CRLF)
            out.option("compression", compression).option("maxRecordsPerFile", records).text(path)
    forget(slim)
    return path


def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query, lower-cased; no scheme, port, www or fragment."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + ("?" + parts.query.lower() if parts.query else "")


class Stream:
    """The unpacked bytes of an archive, of which only those between the reader and what it has asked for are held."""

    def __init__(self, data, packed: bool, step: int = 1 << 20):
        self.rest, self.packed, self.step = memoryview(data), packed, step
        self.inflate = zlib.decompressobj(31)
        self.held, self.at = bytearray(), 0

    def more(self) -> bool:
        """Unpack some more; False at the end."""
        if not len(self.rest):
            return False
        if not self.packed:
            self.held += self.rest[: self.step]
            self.rest = self.rest[self.step :]
            return True
        self.held += self.inflate.decompress(self.rest[: self.step])
        used = min(self.step, len(self.rest)) - len(self.inflate.unused_data)
        self.rest = self.rest[used:]
        if self.inflate.eof:  # of a member; another may follow
            self.held += self.inflate.flush()
            self.inflate = zlib.decompressobj(31)
        return True

    def find(self, mark: bytes) -> int:
        seen = 0
        while (k := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self.more():
                return -1
        return k

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        self.at += len(out)
        return out


def parse(data, packed: bool = False):
    """(offset, headers, block) of each record of the bytes of an archive."""
    stream = Stream(data, packed)
    while stream.held or stream.more():
        if not stream.held:
            continue
        at, end = stream.at, stream.find(b"\r\n\r\n")
        if end < 0:
            raise ValueError(f"the record at {at} has no end of its headers")
        first, *lines = stream.take(end + 4)[:-4].decode().split(CRLF)
        if first != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        block = stream.take(int(headers["Content-Length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where its length says")
        yield at, headers, block


def _number(urn: str | None) -> int | None:
    return None if urn in (None, "<urn:page:null>") else int(urn[len("<urn:page:") : -1])


def index_row(archive: str, at: int, headers: dict, block: bytes) -> tuple:
    kind, digest, size = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["WARC-Payload-Length"])
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
            raise ValueError(f"{archive}: the payload at {at} is not what its header says")
    url = headers.get("WARC-Target-URI")
    return url_key(url) if url else "", headers["WARC-Date"], _number(headers["WARC-Record-ID"]), kind, size, digest, _number(headers.get("WARC-Refers-To")), archive, at


def _rank(row: tuple) -> tuple:
    return row[0].encode(), row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def read_archives(spark, path: str) -> DataFrame:
    """The index of the archives: one sorted run for each, rows as in INDEX."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                archive = name.as_py().rsplit("/", 1)[-1]
                rows = sorted((index_row(archive, *r) for r in parse(content.as_buffer(), archive.endswith(".gz"))), key=_rank)
                for k in range(0, len(rows), 10_000):
                    yield _batch(rows[k : k + 10_000])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX)


def _batch(rows: list, more: list | None = None) -> pa.RecordBatch:
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    arrays = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)]
    if more is not None:
        return pa.RecordBatch.from_arrays([*arrays, pa.array(more, pa.int64())], names=[*names, "capture_order"])
    return pa.RecordBatch.from_arrays(arrays, names=names)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the root's winner comes out."""

    def __init__(self, runs: list[list], key):
        self.k = len(runs)
        self.heads = [iter(r) for r in runs]
        self.key = key
        self.now = [self._next(i) for i in range(self.k)]
        self.loser = [-1] * self.k
        for i in range(self.k):
            self._climb(i, building=True)

    def _next(self, i: int):
        row = next(self.heads[i], None)
        return None if row is None else (self.key(row), row)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.now[i], self.now[j]
        if a is None or b is None:
            return a is not None or (b is None and i < j)
        return (a[0], i) < (b[0], j)

    def _climb(self, i: int, building: bool = False) -> None:
        at = (i + self.k) // 2
        while at > 0:
            j = self.loser[at]
            if j < 0:
                if building:
                    self.loser[at] = i
                    return
            elif self._beats(j, i):
                self.loser[at], i = i, j
            at //= 2
        self.loser[0] = i

    def __iter__(self):
        while self.k and self.now[w := self.loser[0]] is not None:
            yield self.now[w][1]
            self.now[w] = self._next(w)
            self._climb(w)


def merge_runs(runs: DataFrame, *, range_rows: int = 100_000) -> DataFrame:
    """Rows as in INDEX with capture_order, which grows with (url_key, ts, page_id) over the whole table."""
    runs = settle(runs, "runs")
    n = max(1, -(-runs.count() // range_rows))
    keys = ["url_key", "ts", "page_id", "archive", "offset"]

    def merge(batches):
        found: dict[str, list] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                found.setdefault(row[7], []).append(row)
        first, part, more = TaskContext.get().partitionId() << 40, [], []
        for i, row in enumerate(LoserTree(list(found.values()), _rank)):
            part.append(row)
            more.append(first + i)
            if len(part) == 10_000:
                yield _batch(part, more)
                part, more = [], []
        yield _batch(part, more)

    dealt = runs.repartitionByRange(n, *keys).sortWithinPartitions("archive", *keys)
    return dealt.mapInArrow(merge, f"{INDEX}, capture_order long")


def capture_histories(pages: DataFrame, *, least: int = 100) -> DataFrame:
    """Write the archives of pages, read them back, merge their runs."""
    return merge_runs(read_archives(pages.sparkSession, write_archives(pages, least=least)))
