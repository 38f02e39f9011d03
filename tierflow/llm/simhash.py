"""Near-duplicate groups by SimHash: exact tiled comparison of all fingerprints.

Fingerprints are made in one pass over the whole texts. Documents of equal fingerprints are one node.
Nodes are dealt into cells by population counts, each cell into tiles of about `tile` fingerprints by
hash. Two fingerprints within a radius differ by at most that in the sum of their words' population
counts, so only tiles of such cells meet (numpy exclusive-or and bit counts) and all other tile pairs
are skipped: every pair within the radius is found.

A cell's tiles are dealt into gangs of GANG. A gang is the unit of work: it holds its own tiles and is
sent, one by one, the tiles that it must compare with, those of its own cell with a smaller or equal
number and those of the cells one allowed step on. So a cell of any size is spread over tasks, and a
task holds one gang and one tile. Of the links that it finds it keeps those that a union-find needs,
fewer than it has fingerprints. Components of the whole are found by joins (see graph).

group() is the contract of `op4`: one word of 64 bits over shingles with their repeats, radius 2.
similar_groups() takes candidates at a wide radius, for a Jaccard similarity of word shingles: the
fingerprint has WIDE words over the set of shingles, and cells go by set size and population count.
Two documents that are candidates are in one component of the candidates' graph, so only documents of
one component are compared once more with their whole sets at hand, where a link counts only if the
sets have the similarity. A component of at most MEMBERS documents and MEMBER_BYTES of sets is compared
in one place, to which each set travels once; a larger one has cells, tiles and gangs of its own. Nearest
candidates come first, and those already joined are passed over, so a group of copies costs about its
size in exact tests; no candidate is left out. Texts are fetched, and rows dropped, past a bitmap of the
keys in question where these are too many to be broadcast, so no other rows cross a shuffle.
At a similarity of 0.8 a bit differs with a probability of 0.15 (0.19 at worst, for sets of 4 and 5),
so 256 bits differ in 38.7 (48.6) bits with a deviation of 5.7 (6.3): RADIUS is 4 deviations more. A pair
of exactly 0.8 is missed with a probability under 1e-6 (4e-5 at worst), by the binomial tails.
Sets of fewer than 4 shingles are similar by 0.8 only if they are equal, which equal fingerprints show.

Defined results: null text and text without words have fingerprint zero and are one group in group(),
and one group of empty sets in similar_groups(); repeated rows share their component; a null doc_id
is the smallest id of no component that has others; an empty table gives no rows; extra columns are
ignored. without_near_duplicates() keeps one row of each group, whatever its ids: that of the smallest
id (nulls last), of these the smallest row key, of equal rows any one.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import few, forget, gathered, is_few, marked, marks, pieces, row_key, settle, size_of
from .graph import components

SLICES = 4  # of a 64-bit word, for population counts
GANG, TILE = 16, 1024
GANGS, MOST = 32, 512  # gangs of a cell, above which they take more tiles each, and the most tiles of a gang without sets
WIDE, RADIUS, FIRST = 4, 76, 26  # words of 64 bits; bits that may differ in all of them, and in the first
TASK_BYTES = 64 << 20
MEMBERS, MEMBER_BYTES = 512, 4 << 20  # of a component that is compared in one place
LEAST = 4  # smaller sets are similar only if equal


# fingerprints


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: only A-Z change, white space is \x20 and \x09-\x0D


def majority(h: np.ndarray, words: int = 1) -> np.ndarray:
    """Words whose bits are 1 where over half of the rows of h (n, words) have them."""
    counts = np.zeros(64 * words, dtype=np.int64)
    h = h.reshape(-1, words)
    for at in range(0, len(h), 16_384):
        part = np.ascontiguousarray(h[at : at + 16_384].astype(">u8")).view(np.uint8).reshape(-1, 8 * words)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(h)).view(">u8").astype(np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of a text's word shingles; signed 64 bits; 0 without words."""
    import xxhash

    words = split_words(text)
    if not words:
        return 0
    joined, size = b" ".join(words), [len(w) for w in words]
    ends = np.cumsum(np.array(size) + 1) - 1
    starts = (ends - size).tolist()
    ends = ends.tolist()[min(width, len(words)) - 1 :]
    one = xxhash.xxh64_intdigest
    return int(majority(np.array([one(joined[s:e], 42) for s, e in zip(starts, ends)], dtype=np.uint64)).view(np.int64)[0])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads near ones (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.int64)


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


class Shingler:
    """Sets of shingle hashes; word hashes are remembered, as far as memory allows."""

    def __init__(self, width: int):
        import xxhash

        self.one, self.width, self.factors = xxhash.xxh64_intdigest, width, _odd(width + 1, 3)
        self.known: dict[bytes, int] = {}
        self.turns = _odd(WIDE, 5)

    def _hash(self, word: bytes) -> int:
        if len(self.known) >= 500_000:
            self.known.clear()
        return self.known.setdefault(word, self.one(word, 42))

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted and distinct; a text of fewer words than the width has one shingle, of none has none."""
        words, known = split_words(text), self.known
        if not words:
            return np.zeros(0, dtype=np.uint64)
        h = np.array([known.get(w) or self._hash(w) for w in words], dtype=np.uint64)
        width = min(self.width, len(h))
        n = len(h) - width + 1
        out = np.full(n, np.uint64(width), dtype=np.uint64) * self.factors[-1]
        for k in range(width):
            out += h[k : k + n] * self.factors[k]
        return np.unique(mix(out).view(np.uint64))

    def wide(self, shingles: np.ndarray) -> np.ndarray:
        """The WIDE words of a set."""
        if not len(shingles):
            return np.zeros(WIDE, dtype=np.uint64)
        return majority(mix(shingles[:, None] * self.turns[None, :]).view(np.uint64), WIDE)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row of docs."""

    def run(batches):
        for b in pieces(batches):
            fps = [fingerprint(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


# cells, tiles and gangs


class Grid:
    """Cells as tuples of small numbers, each one number in base BASE, and the steps between cells that must meet.

    What a cell's number has above these digits stays: cells that differ in it don't meet.
    """

    BASE = 128

    def __init__(self, steps: list[tuple[int, ...]]):
        self.steps = [s for s in steps if s > (0,) * len(s)]
        self.factors = np.array([self.BASE ** k for k in reversed(range(len(steps[0])))], dtype=np.int64)

    def number(self, places: np.ndarray) -> np.ndarray:
        return places.astype(np.int64) @ self.factors

    def next(self, cell: int) -> list[int]:
        """The cells one allowed step on."""
        at = [cell // int(f) % self.BASE for f in self.factors]
        return [cell + int(np.dot(s, self.factors)) for s in self.steps if all(0 <= a + d < self.BASE for a, d in zip(at, s))]


def steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of the counts of SLICES words that may hold pairs within the radius."""
    return [s for s in product(range(-radius, radius + 1), repeat=SLICES) if sum(map(abs, s)) <= radius]


def slice_counts(fps: np.ndarray) -> np.ndarray:
    """(n, SLICES): population counts of the 16-bit words of 64-bit fingerprints."""
    shifts = np.arange(SLICES, dtype=np.uint64) * np.uint64(16)
    return np.bitwise_count((fps.view(np.uint64)[:, None] >> shifts) & np.uint64(0xFFFF))


def size_class(n: np.ndarray, similarity: float) -> np.ndarray:
    """Sets that can have the similarity are of the same class or of neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / -np.log(similarity) + 1e-9).astype(np.int64) % Grid.BASE


NODE = "cell long, node long, fp binary, shingles binary"


def gangs(nodes: DataFrame, grid: Grid, *, tile: int, gang: int = GANG, most: int = MOST, sets: bool = False) -> DataFrame:
    """(cell, gang, guest, near, part, tile) of nodes(NODE), by (cell, gang), a gang's own tiles before its guests.

    A hot cell's tiles go to every gang after them: the work is quadratic in a cell, not a task's share of it.
    A gang has `gang` tiles; in a cell of more than GANGS gangs it has more, up to `most`, so a tile is sent
    to at most GANGS of them until then. sets: nodes have shingles, files of which may be much smaller than what they hold.
    """
    spark = nodes.sparkSession
    nodes = settle(nodes, "nodes")
    # a row for each cell: of population counts at most 17^4, of sizes and counts at most 128 x 4, whatever the table;
    # of components, only of those that are too large for one place
    sizes = nodes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("parts"))
    of_gang = F.greatest(F.lit(gang), F.least(F.lit(most), F.ceil(F.col("parts") / GANGS).cast("int")))
    of_nodes = size_of(nodes)
    sizes = settle(gathered(sizes.withColumn("per", of_gang), of_nodes), "sizes")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    dealt = nodes.join(F.broadcast(sizes), "cell").select("cell", part, F.struct("node", "fp", "shingles").alias("e"), "per")
    # grouped by tile, so the nodes of a hot cell don't meet before they are in tiles
    tiles = dealt.groupBy("cell", "part").agg(F.collect_list("e").alias("tile"), F.first("per").alias("per"))
    tiles = settle(tiles if sets else gathered(tiles, of_nodes), "tiles")
    to = F.udf(grid.next, "array<long>", useArrow=False)
    reach = sizes.select("cell", F.explode(to("cell")).alias("to")).join(sizes.select(F.col("cell").alias("to"), F.col("parts").alias("there"), "per"), "to")
    reach = reach.select("cell", "to", "there", "per", F.lit(False).alias("near")).unionByName(sizes.select("cell", F.col("cell").alias("to"), F.col("parts").alias("there"), "per", F.lit(True).alias("near")))
    reach = settle(gathered(reach, size_of(sizes) * (len(grid.steps) + 1)), "reach")
    own_gang = F.floor(F.col("part") / F.col("per")).cast("int")
    hosts = tiles.select("cell", own_gang.alias("gang"), F.lit(False).alias("guest"), F.lit(True).alias("near"), "part", "tile")
    first = F.when(F.col("near"), own_gang).otherwise(F.lit(0))
    last = F.floor((F.col("there") - 1) / F.col("per")).cast("int")
    sent = tiles.drop("per").join(F.broadcast(reach), "cell").select(F.col("to").alias("cell"), F.explode(F.sequence(first, last)).alias("gang"), F.lit(True).alias("guest"), "near", "part", "tile")
    # a task for so many tile pairs, of about a million comparisons each, and for so many bytes of tiles that are sent
    there = F.ceil(F.col("there") / F.col("per"))
    pairs, copies, own = reach.join(sizes.drop("per"), "cell").agg(F.sum(F.col("parts").cast("double") * F.col("there")), F.sum(F.col("parts") * there), F.sum(F.when(F.col("near"), F.col("parts")))).first()
    of_tiles = size_of(tiles)
    sent_bytes = of_tiles * (copies or 0) / max(own or 0, 1)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(max((pairs or 0) / 4096, sent_bytes / TASK_BYTES)), 100_000))
    work = hosts.unionByName(sent).repartition(n, "cell", "gang").sortWithinPartitions("cell", "gang", "guest")
    work._tables = [nodes, sizes, tiles, reach]
    work._links_bytes = 2 * int(of_tiles + sent_bytes)  # a link is 16 bytes, of a node that has 8 at least; a gang finds fewer than it holds and is sent
    return work


class Forest:
    """Components of so many nodes, the first of which may be joined already (up)."""

    def __init__(self, n: int, up: np.ndarray | tuple = ()):
        self.up = np.concatenate([np.asarray(up, dtype=np.int64), np.arange(len(up), n)])

    def labels(self) -> np.ndarray:
        while ((further := self.up[self.up]) != self.up).any():
            self.up = further
        return self.up

    def join(self, i: int, j: int) -> bool:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        if i == j:
            return False
        up[max(i, j)] = min(i, j)
        return True


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, first: int):
    """(i, j, distance) of the rows of a and b (n, words) within the radius, in blocks of a bounded size."""
    rows = max(1, (1 << 20) // max(len(b), 1))
    for at in range(0, len(a), rows):
        d = np.bitwise_count(a[at : at + rows, None, 0] ^ b[None, :, 0])
        flat = np.flatnonzero(d <= first)
        i, j = flat // len(b), flat % len(b)
        dist = d.ravel()[flat].astype(np.int64)
        if a.shape[1] > 1 and len(flat):
            dist += np.bitwise_count(a[at + i, 1:] ^ b[j, 1:]).sum(axis=1, dtype=np.int64)
            ok = dist <= radius
            i, j, dist = i[ok], j[ok], dist[ok]
        if len(i):
            yield at + i, j, dist


def unions(forest: Forest, i: np.ndarray, j: np.ndarray, dist: np.ndarray, accept: Callable | None):
    """Those of the pairs (i, j), the nearest first, that are accepted and join two components of the forest."""
    label = forest.labels()
    open_ = label[i] != label[j]  # the others are joined already
    i, j, dist = i[open_], j[open_], dist[open_]
    order = np.argsort(dist, kind="stable")
    for at in range(0, len(order), 2048):
        x, y = i[order[at : at + 2048]], j[order[at : at + 2048]]
        label = forest.labels()
        open_ = label[x] != label[y]
        for p, q in zip(x[open_].tolist(), y[open_].tolist()):
            if accept is None or forest.up[p] != forest.up[q] and accept(p, q):
                if forest.join(p, q):
                    yield p, q


def link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def compare(work: DataFrame, words: int, radius: int, first: int, accept: Callable | None) -> DataFrame:
    """Links (a, b) of the gangs of work."""

    def of(tile, part: int) -> tuple:
        nodes, fps, sets = (tile.field(k) for k in range(3))
        fps = np.frombuffer(b"".join(fps.to_pylist()), dtype=np.uint64).reshape(-1, words)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in sets.to_pylist()] if accept else []
        return nodes.to_numpy(), fps, np.full(len(nodes), part), sets

    def meet(host, up: np.ndarray, guest, near: bool):
        """Pairs that keep the components of all accepted links of a host gang and a guest tile; up: of the host's nodes so far."""
        hn, hf, hp, hs = host
        gn, gf, gp, gs = guest
        if near:  # of a cell's own pairs each one once
            use = np.flatnonzero(hp >= gp[0])
            hf = hf[use]
        counts_h, counts_g = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (hf, gf))
        if not len(hf) or counts_h.min() - counts_g.max() > radius or counts_g.min() - counts_h.max() > radius:
            return
        forest, n = Forest(len(hn) + len(gn), up), len(hn)
        test = accept and (lambda p, q: accept(gs[p - n], hs[q]))
        for i, j, dist in near_pairs(gf, hf, radius, first):
            if near:
                j = use[j]
                ok = (hp[j] > gp[0]) | (hn[j] > gn[i])
                i, j, dist = i[ok], j[ok], dist[ok]
            for p, q in unions(forest, n + i, j, dist, test):
                yield int(gn[p - n]), int(hn[q])
        up[:] = forest.labels()[:n]  # a root is the smallest number, so one of the host's

    def run(batches):
        key, own, host, up = None, [], None, None
        for batch in batches:
            cells, gang, guest, near, part = (batch.column(k).to_pylist() for k in range(5))
            for k, tile in enumerate(batch.column(5)):
                if (cells[k], gang[k]) != key:
                    key, own, host = (cells[k], gang[k]), [], None
                if not guest[k]:
                    own.append(of(tile.values, part[k]))
                    continue
                if host is None:
                    host = tuple(np.concatenate(x) for x in list(zip(*own))[:3]) + ([s for o in own for s in o[3]],)
                    up = np.arange(len(host[0]))
                links = list(meet(host, up, of(tile.values, part[k]), near[k]))
                if links:
                    yield link_batch(links)

    out = work.mapInArrow(run, "a long, b long")
    out._tables = work._tables  # to be forgotten when the links have been read
    out._bytes = work._links_bytes
    return out


# groups by fingerprint


def links(nodes: DataFrame, *, radius: int = 2, tile: int = TILE) -> DataFrame:
    """(a, b): links of nodes(fp), distinct fingerprints, that keep the components of all links; ids are fingerprints."""
    grid = Grid(steps(radius))

    def split(batches):
        for b in pieces(batches):
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = [f.tobytes() for f in fps]
            yield pa.RecordBatch.from_arrays([pa.array(grid.number(slice_counts(fps))), pa.array(fps), pa.array(raw, pa.binary()), pa.array([b""] * len(raw), pa.binary())], names=["cell", "node", "fp", "shingles"])

    work = gangs(nodes.select("fp").mapInArrow(split, NODE), grid, tile=tile)
    return compare(work, 1, radius, radius, None)


def group(docs: DataFrame, *, radius: int = 2, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs: component_id is the smallest doc_id reachable."""
    own = settle(fingerprints(docs), "fingerprints")
    size = size_of(own)
    nodes = settle(gathered(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), size), "nodes")
    found = links(nodes, radius=radius, tile=tile)
    roots = components(found, size=found._bytes)
    forget(*found._tables)
    known = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    known = settle(gathered(known, size_of(nodes)), "roots")
    least = settle(gathered(known.groupBy("root").agg(F.min("first_id").alias("component_id")), size_of(known)), "least")
    named = settle(gathered(known.join(least, "root").select("fp", "component_id"), size_of(known)), "components")
    forget(nodes, roots, known, least)
    return gathered(own.join(named, "fp").select("doc_id", "fp", "component_id"), size)


def near_duplicates(docs: DataFrame, *, radius: int = 2) -> DataFrame:
    """As group(), with the fingerprint as 16 hexadecimal digits."""
    return group(docs, radius=radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# groups by similarity


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have the Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(k1, k2, doc_id, node, n, fp) for each row of docs(k1, k2, doc_id, text): node is a digest of its set."""
    from xxhash import xxh3_64_intdigest

    def run(batches):
        of = Shingler(width)
        for b in pieces(batches):
            node, n, fp = [], [], []
            for t in b.column(3):
                s = of(t.as_py())
                node.append(xxh3_64_intdigest(s.tobytes()))
                n.append(len(s))
                fp.append(of.wide(s).tobytes())
            nodes = pa.array(np.array(node, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], nodes, pa.array(n, pa.int64()), pa.array(fp, pa.binary())], names=["k1", "k2", "doc_id", "node", "n", "fp"])

    return docs.mapInArrow(run, "k1 long, k2 long, doc_id long, node long, n long, fp binary")


SETS = "root long, node long, n long, fp binary, shingles binary"


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """(SETS) of texts(root, node, n, fp, text), shingles as the bytes of the sorted hashes; a node about once, however often it is there."""

    def run(batches):
        of, done = Shingler(width), set()
        for b in pieces(batches):
            fresh, nodes = [], b.column(1).to_pylist()
            for k, node in enumerate(nodes):
                if node not in done:
                    if len(done) >= 100_000:
                        done.clear()
                    done.add(node)
                    fresh.append(k)
            b = b.take(pa.array(fresh, pa.int64()))
            sets = pa.array([of(t.as_py()).tobytes() for t in b.column(4)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], sets], names=["root", "node", "n", "fp", "shingles"])

    return texts.select("root", "node", "n", "fp", "text").mapInArrow(run, SETS)


def links_within(sets: DataFrame, *, similarity: float) -> DataFrame:
    """(a, b): verified links of the nodes of sets(SETS) that have one root; for roots whose sets fit one place."""
    spark = sets.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size_of(sets) // TASK_BYTES, 100_000))

    def close(nodes: list, fps: list, raw: list):
        f, forest = np.frombuffer(b"".join(fps), dtype=np.uint64).reshape(-1, WIDE), Forest(len(nodes))
        own = [np.frombuffer(x, dtype=np.uint64) for x in raw]
        for i, j, dist in near_pairs(f, f, RADIUS, FIRST):
            ok = i > j
            for p, q in unions(forest, i[ok], j[ok], dist[ok], lambda p, q: similar(own[p], own[q], similarity)):
                yield nodes[p], nodes[q]

    def run(batches):
        now, held = None, ([], [], [])
        for b in pieces(batches):
            links = []
            for root, node, fp, raw in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if root != now:
                    links += close(*held)
                    now, held = root, ([], [], [])
                if not held[0] or node != held[0][-1]:  # a node may come from several tasks
                    for x, v in zip(held, (node, fp, raw)):
                        x.append(v)
            yield link_batch(links)
        yield link_batch(list(close(*held)))

    return sets.repartition(n, "root").sortWithinPartitions("root", "node").mapInArrow(run, "a long, b long")


def similar_links(own: DataFrame, docs: DataFrame, *, width: int, similarity: float, tile: int = TILE) -> DataFrame:
    """(a, b): verified links of the nodes of own (see sketches) that keep the components of all of them."""
    grid = Grid(list(product((-1, 0, 1), repeat=2)))

    def cells(nodes: DataFrame) -> DataFrame:
        """NODE of nodes(root, node, n, fp, shingles): nodes of different roots have different cells, but for a few that share 40 bits."""

        def run(batches):
            for b in pieces(batches):
                raw = b.column(3).to_pylist()
                fps = np.frombuffer(b"".join(raw), dtype=np.uint64).reshape(-1, WIDE)
                places = np.stack([size_class(b.column(2).to_numpy(), similarity), np.bitwise_count(fps).sum(axis=1) // RADIUS], axis=1)
                high = (b.column(0).to_numpy().view(np.uint64) >> np.uint64(24)).astype(np.int64) * Grid.BASE**2
                yield pa.RecordBatch.from_arrays([pa.array(high + grid.number(places)), b.column(1), b.column(3), b.column(4)], names=["cell", "node", "fp", "shingles"])

        return nodes.select("root", "node", "n", "fp", "shingles").mapInArrow(run, NODE)

    nodes = own.where(F.col("n") >= LEAST).groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.min(F.struct("k1", "k2")).alias("k"))
    nodes = settle(nodes, "sets")
    slim = nodes.withColumns({"root": F.lit(0).cast("long"), "shingles": F.lit(b"")})
    near = compare(gangs(cells(slim), grid, tile=tile), WIDE, RADIUS, FIRST, None)
    roots = components(near, size=near._bytes)
    forget(*near._tables)
    wanted = settle(nodes.join(few(roots), "node").select("root", "node", "n", "fp", "k.k1", "k.k2"), "wanted")
    forget(nodes, roots)
    small = is_few(wanted)
    asked = docs if small else marked(docs, marks(wanted, "k1"), "k1")  # only texts that may be wanted cross a shuffle
    texts = asked.join(F.broadcast(wanted) if small else wanted, ["k1", "k2"])
    sets = settle(sets_of(texts, width), "shingles")
    of_root = wanted.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("n"))
    large = settle(of_root.where((F.col("members") > MEMBERS) | (F.col("n") * 8 > MEMBER_BYTES)).select("root"), "large")
    forget(wanted)
    if large.isEmpty():
        out = links_within(sets, similarity=similarity)
        out._tables = [sets, large]
        return out
    known = few(large)
    # exact tests take longer than bit counts: smaller gangs, so a large group of copies is spread
    more = sets.join(known, "root", "left_semi").dropDuplicates(["node"])
    work = gangs(cells(more), grid, tile=max(1, tile // 4), gang=2, most=2, sets=True)
    spread = compare(work, WIDE, RADIUS, FIRST, lambda a, b: similar(a, b, similarity))
    rest = settle(sets.join(known, "root", "left_anti"), "rest")
    forget(sets)
    out = links_within(rest, similarity=similarity).unionByName(spread)
    out._tables = [rest, large, *spread._tables]
    return out


def similar_groups(docs: DataFrame, *, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(k1, k2, doc_id, root) for each row of docs: rows of one root are a group; k1, k2 are the row's key."""
    k1, k2 = row_key(docs)
    slim = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = settle(sketches(slim, width), "sketches")
    found = similar_links(own, slim.select("k1", "k2", "text"), width=width, similarity=similarity)
    roots = components(found)
    forget(*found._tables)
    return own.join(roots, "node", "left").select("k1", "k2", "doc_id", F.coalesce("root", "node").alias("root"))


def without_near_duplicates(docs: DataFrame, *, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, that stay: one of each group of similar texts."""
    known = settle(similar_groups(docs, width=width, similarity=similarity), "similar")
    keys = known.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("root").alias("root"), F.count(F.lit(1)).alias("times"))
    keys = settle(keys, "keys")
    forget(known)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("k1"), F.col("k2"))
    best = settle(keys.groupBy("root").agg(F.min(order).alias("best")), "best")
    mine = keys.join(best, "root").withColumn("stays", (F.col("best.k1") == F.col("k1")) & (F.col("best.k2") == F.col("k2")))
    gone = settle(mine.where("not stays or times > 1").select("k1", "k2", "stays"), "gone")
    forget(keys, best)
    k1, k2 = row_key(docs)
    # the row travels as one column, so its other columns may have any names
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    asked, clear = rows, rows.limit(0)
    if not is_few(gone):  # only rows that may be among these cross a shuffle
        bitmap = marks(gone, "k1")
        asked, clear = marked(rows, bitmap, "k1"), marked(rows, bitmap, "k1", "left_anti")
    single = asked.join(few(gone, columns=("k1", "k2")), ["k1", "k2"], "left_anti").select("row")
    # rows that are there several times: one of each, found by partial aggregation where they lie
    more = settle(gone.where("stays").select("k1", "k2"), "again")
    again = asked.join(few(more), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(again).unionByName(clear.select("row")).select("row.*")

