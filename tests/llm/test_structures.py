import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tierflow.llm import graph, media, simhash, toxicity, warc

DATA = "/root/testdata/sf0.001"


def both(documents, odd):
    return documents.unionByName(odd.select(*documents.columns).selectExpr("doc_id + 5000 as doc_id", "text", "lang", "source", "n_chars"))


# op4


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(fps: dict, radius=2):
    parent = {k: k for k in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def test_fingerprints_and_groups_equal_brute_force(documents, odd):
    docs = both(documents, odd)
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.where("doc_id is not null").collect()}
    want = brute_groups(fps)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            assert (int(r["fingerprint"], 16), r["component_id"]) == (fps[r["doc_id"]], want[r["doc_id"]])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [1024, 7])
def test_links_keep_all_components(spark, tile):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    for f in list(fps)[:30]:  # chains of near ones
        for _ in range(6):
            f ^= 1 << rng.randrange(64)
            fps.add(f)
            fps.add(f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    signed = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"]: r["root"] for r in graph.components(simhash.links(nodes, tile=tile)).collect()}
    groups = {}
    for f in signed:
        groups.setdefault(roots.get(f, f), set()).add(f)
    want = {}
    for k, v in brute_groups({f: f % 2**64 for f in signed}).items():
        want.setdefault(v, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_scratch_is_the_applications_own_and_can_be_cleaned(spark):
    import os

    from tierflow.llm import base

    made = base.settle(spark.range(5), "some")
    folder = base.scratch_folder(spark).removeprefix("file://")
    assert made.count() == 5 and made._settled_path.startswith(base.scratch_folder(spark)) and os.path.isdir(folder)
    other = type("Cluster", (), {"master": "spark://x", "getConf": lambda self: {}, "_jsc": type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()})()
    session = type("Session", (), {"sparkContext": other, "conf": type("C", (), {"get": lambda self, k, d: d})()})()
    with pytest.raises(RuntimeError):  # no folder of one machine on a cluster
        base.scratch.root(session)


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.range(n).selectExpr("id as a", "id + 1 as b").unionByName(spark.createDataFrame([(1000, 1000), (2000, 2001)], "a long, b long"))
    found = {}
    for r in graph.components(edges).collect():
        found.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, found.values())) == [2, n + 1]
    assert graph.components(edges.limit(0)).count() == 0


def test_small_tables_are_written_in_few_files(spark, monkeypatch):
    import glob

    from tierflow.llm import base

    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", 23)
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = session.read.parquet(f"{DATA}/documents.parquet")
    files = {}

    def settle(df, what):
        out = base.settle(df, what)
        files[what] = max(files.get(what, 0), len(glob.glob(out._settled_path.removeprefix("file://") + "/part-*")))
        return out

    for module in (simhash, graph):
        monkeypatch.setattr(module, "settle", settle)
    path = graph.components(session.range(300).selectExpr("id as a", "id + 1 as b"), size=300 * 16)
    out = simhash.near_duplicates(docs)
    rows = sorted(out.collect())
    assert path.count() == 301 and {"nodes", "sizes", "tiles", "reach", "edges", "parents", "least", "components"} <= set(files)
    assert max(files.values()) == 1 and out.rdd.getNumPartitions() == 1, files
    monkeypatch.setattr(base, "BROADCAST_BYTES", 0)  # as a large table: dealt as the session says, with the same rows
    out = simhash.near_duplicates(docs)
    assert sorted(out.collect()) == rows and files["nodes"] > 1 and out.rdd.getNumPartitions() > 1


@pytest.fixture(scope="module")
def one_cell(spark):
    """Fingerprints of one cell: each word has one bit in each of its halves."""
    rng = random.Random(8)
    some = set()
    while len(some) < 3000:
        some.add(sum(1 << 16 * k + rng.randrange(8) + 8 * h for k in range(4) for h in range(2)))
    signed = sorted(f - 2**64 if f >= 2**63 else f for f in some)
    return signed, spark.createDataFrame([(f,) for f in signed], "fp long")


def test_a_hot_cell_is_spread_over_gangs(spark, one_cell):
    signed, nodes = one_cell
    found = simhash.links(nodes, tile=8)  # some 375 tiles of one cell: 24 gangs
    parts = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(p > 0 for p in parts) > 1
    roots = {r["node"]: r["root"] for r in graph.components(found).collect()}
    u = np.array(signed, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 2
    label = np.arange(len(u))
    while True:  # the smallest label of all neighbours, until nothing changes
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    got = [roots.get(f, f) for f in signed]
    assert len({*zip(got, label.tolist())}) == len(set(got)) == len(set(label.tolist()))


# near-duplicate groups by similarity


def brute_similar(texts: dict, width=5, similarity=0.8):
    """The smallest id of each group, on sets of word tuples."""
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            x, y = sets[a], sets[b]
            if x == y or 10 * len(x & y) >= round(10 * similarity) * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {k: root(k) for k in keys}


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"z{rng.randrange(10**6)}"
    return " ".join(out)


def test_similar_groups_equal_brute_force(spark, documents):
    rng, texts = random.Random(5), {}
    for r in documents.collect():
        texts[r["doc_id"] + 10_000] = r["text"]
    for _ in range(30):  # groups of near copies around the similarity, and chains
        base = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(12, 300))]
        for _ in range(8):
            texts[len(texts)] = edited(rng, base, rng.randrange(0, max(1, len(base) // 40) + 1))
    for t in (None, "", " \n", "one two", "ONE two", "two one", "a b c d e", "a b c d f", "a b c d e f g h", "a b c d e f g h i"):
        texts[len(texts)] = t
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = set(brute_similar(texts).values())
    kept = [r["doc_id"] for r in simhash.without_near_duplicates(docs).collect()]
    assert sorted(kept) == sorted(want)
    assert simhash.without_near_duplicates(docs.limit(0)).count() == 0


def test_sets_of_small_groups_travel_once_and_other_rows_stay(spark, monkeypatch):
    """Found at 6 GB: tiles with their sets went to every gang of their cells, and all texts and rows crossed shuffles."""
    rng, texts = random.Random(9), {}
    for g in range(400):  # 60 groups of two, one of 40, the rest alone; all sets in a few cells
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(40 if g == 7 else 2 if g < 60 else 1):
            texts[len(texts)] = edited(rng, base, 1)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = sorted(set(brute_similar(texts).values()))
    sent, moved, gangs, marked = [], [], simhash.gangs, simhash.marked

    def watched_gangs(nodes, *a, **b):
        work = gangs(nodes, *a, **b)
        sent.append(work.selectExpr("inline(tile)").where("length(shingles) > 0").select("node").distinct().count())
        return work

    def watched_marks(rows, bitmap, key, how="left_semi"):
        out = marked(rows, bitmap, key, how)
        moved.append((how, out.count()))
        return out

    monkeypatch.setattr(simhash, "gangs", watched_gangs)
    monkeypatch.setattr(simhash, "marked", watched_marks)
    for limit, members, tiles in ((32 << 20, 512, [0]), (0, 512, [0]), (0, 20, [0, 40])):
        monkeypatch.setattr("tierflow.llm.base.BROADCAST_BYTES", limit)
        monkeypatch.setattr(simhash, "MEMBERS", members)
        sent.clear(), moved.clear()
        assert sorted(r["doc_id"] for r in simhash.without_near_duplicates(docs).collect()) == want
        assert sent == tiles
        assert moved == ([] if limit else [("left_semi", 158), ("left_semi", 98), ("left_anti", len(texts) - 98)])


def test_one_row_of_each_group_stays(spark, odd):
    out = simhash.without_near_duplicates(odd)
    kept = sorted(str(r["doc_id"]) for r in out.collect())
    # 2 and 3 are empty as 1; the nameless row and the second 5 are copies of 5; 7 has one shingle more
    assert out.columns == odd.columns and kept == sorted(map(str, (1, 5, 8, 9, 10, 11, 12, 13)))
    same = spark.createDataFrame([(7, "x y z", {"a": 1})] * 3 + [(None, "x y z", {"a": 1})] * 2, "doc_id long, text string, k1 map<string,int>")
    rest = simhash.without_near_duplicates(same).collect()
    assert [tuple(r) for r in rest] == [(7, "x y z", {"a": 1})]
    nameless = spark.createDataFrame([(None, "x y z")] * 2 + [(None, "X y z")], "doc_id long, text string")
    assert simhash.without_near_duplicates(nameless).count() == 1


# op6


def test_media_round_trip(documents, odd):
    docs = both(documents, odd)
    want = []
    for r in docs.collect():
        payload, n = media.payload_of(r["text"])
        raw = (r["text"] or "").encode()
        assert payload.startswith(raw) and len(payload) % 192 == 0 and len(payload) - len(raw) < 193 and not payload[len(raw) :].strip(b" ")
        wav = media.to_wav(payload)
        assert media.from_wav(wav) == payload
        want.append((r["doc_id"], n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(wav), hashlib.sha256(wav).hexdigest(), media.features(payload)))
    got = [tuple(r) for r in media.media_columns(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert media.media_columns(docs.limit(0)).count() == 0


def test_copies_keep_their_own_length(spark):
    texts = [None, " ", "", "abc", "abc ", "abc  ", "abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["payload_sha256"]) for r in media.media_columns(docs).collect()}
    assert got == {k: (len(t or ""), hashlib.sha256((t or "").ljust(192).encode()).hexdigest()) for k, t in enumerate(texts)}


def test_wav_is_read_by_others():
    import io
    import wave

    w = wave.open(io.BytesIO(media.to_wav(b"a" * 192)))
    assert (w.getnchannels(), w.getsampwidth(), w.readframes(999)) == (1, 1, b"a" * 192)


def test_cuts_follow_content():
    data = np.random.default_rng(0).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    ends = media.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= media.MOST and sizes[:-1].min() >= media.LEAST
    moved = media.chunks_of(b"some bytes in front" + data)
    same = {d for d, _ in media.chunks_of(data)} & {d for d, _ in moved}
    assert len(same) > 0.9 * len(ends)
    # the vectorised hash is the rolling one
    h, small, want = 0, data[:3000], []
    for i, b in enumerate(small):
        h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    g = media.GEAR[np.frombuffer(small, dtype=np.uint8)].copy()
    for s in (1, 2, 4, 8, 16):
        g[s:] += g[:-s] << np.uint32(s)
    assert g.tolist()[32:] == want[32:]


# op7


def test_loser_tree():
    rng = random.Random(1)
    for k in range(10):
        runs = [sorted(rng.choices(range(40), k=rng.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(sum(runs, []))


def test_archives_round_trip(spark):
    odd = [(1, "http://a b/\n", None), (None, None, "x" * 200), (3, "http://WWW.a.com:8/P?Q#f", "x" * 200), (2, "u", "x" * 200), (2, "u", "x" * 200), (5, "", "WARC/1.1\r\n\r\nWARC-Type: é\r\n\r\n" * 9), (6, "http://[bad", "y" * 99), (7, "z", "y" * 99), (8, "z", "y" * 100), (9, "z", "y" * 100), (10, "z", "v" * 2_000_000)]
    pages = spark.createDataFrame(odd, "page_id long, url string, html string")
    pages = pages.unionByName(spark.read.parquet(f"{DATA}/pages.parquet").selectExpr("page_id + 1000 as page_id", "url", "html"))
    rows, first = pages.collect(), {}
    for r in rows:
        b = (r["html"] or "").encode()
        if len(b) >= 100 and r["page_id"] is not None:
            first[b] = min(first.get(b, r["page_id"]), r["page_id"])
    want = []
    for r in rows:
        b = (r["html"] or "").encode()
        rep = first.get(b)
        again = rep is not None and rep != r["page_id"]
        want.append((r["page_id"], len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", rep if again else None))
    got = warc.capture_histories(pages).collect()
    assert sorted(want, key=str) == sorted(((g["page_id"], g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) for g in got), key=str)
    got.sort(key=lambda g: g["capture_order"])
    keys = [(g["url_key"].encode(), g["ts"]) for g in got]
    assert keys == sorted(keys)
    assert warc.capture_histories(pages.limit(0)).count() == 0


def test_archives_are_bounded_and_seekable(spark, tmp_path):
    import glob

    pages = spark.createDataFrame([(k, f"http://h{k % 3}.org/{k}", "x" * (70_000 if k % 5 == 0 else 10) + str(k)) for k in range(40)], "page_id long, url string, html string")
    pages = pages.selectExpr("*", "7 as digest", "8 as bytes", "9 as payload")  # columns that the operator has inside
    path = warc.write_archives(pages, compression="none")
    index = warc.read_archives(spark, path).collect()
    assert len(index) == 40
    for r in index:
        with open(glob.glob(f"{path.removeprefix('file://')}/{r['archive']}")[0], "rb") as f:
            f.seek(r["offset"])
            at, headers, _ = next(warc.parse(f.read()))
        assert at == 0 and headers["WARC-Record-ID"] == f"<urn:page:{r['page_id']}>"


def test_a_stream_holds_little():
    import gzip

    block = b"WARC/1.1\r\nContent-Length: 1000\r\n\r\n" + b"y" * 1000 + b"\r\n\r\n"
    data = gzip.compress(block * 500) + gzip.compress(block * 500)
    got = list(warc.parse(data, packed=True))
    assert len(got) == 1000 and [g[0] for g in got[:2]] == [0, len(block)]
    s = warc.Stream(data, True, step=64)
    assert s.take(10) == b"WARC/1.1\r\n" and s.at == 10


# op9


def test_long_texts_pool_over_windows():
    rng = np.random.default_rng(0)
    m = toxicity.Model()
    m.embed = [rng.standard_normal(e.shape).astype(np.float32) for e in m.embed]
    d = rng.integers(0, 5000, (1003, 2)).astype(np.int32)
    for n in (0, 1, 99, 100, 101, 102, 103, 200, 203, 1003):
        assert np.allclose(m.logits([d[:n], d]), m.logits([d[:n], d], words=100), atol=1e-4)
    text = " ".join("w" + "abcdefghij"[k % 10] * (k % 7 + 1) for k in range(200_000))
    whole = toxicity.Words().rows(text)
    part, toxicity.PART = toxicity.PART, 1000
    try:
        assert (toxicity.Words().rows(text) == whole).all() and len(whole) == 200_000
    finally:
        toxicity.PART = part


def test_a_long_text_and_a_repeated_id_leave_the_fit_whole(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    order = [r["doc_id"] for r in labels.where("toxic is not null").where(~toxicity.held_out()).selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h").collect()]
    longer = docs.withColumn("text", F.when(F.col("doc_id") == order[0], F.repeat(F.lit("word "), 300_000)).otherwise(F.col("text")))
    model = toxicity.train(longer, labels, max_chars=1_000_000)
    assert model.constant is None
    many = docs.unionByName(docs.where(F.col("doc_id") == order[1]).crossJoin(spark.range(3000)).drop("id"))
    a, b = toxicity.train(docs, labels), toxicity.train(many, labels)
    assert all(np.array_equal(x, y) for x, y in zip(a.params(), b.params()))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs, labels)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1 or predicted <> if(score >= 0.7, 1, 0)").count() == 0
    for r in out.select("doc_id", "held_out").collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    rows = out.where("held_out").join(labels, "doc_id").collect()
    z, y = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    assert toxicity.rank_quality(z, y) > 0.75
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 2


def test_held_out_labels_and_other_columns_are_no_inputs(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scores = lambda d, lab: {r["doc_id"]: r["score"] for r in toxicity.score(d, lab).collect()}
    base = scores(docs, labels)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert scores(docs, flipped) == base
    other = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("z")})
    assert scores(other, labels) == base


def test_odd_rows_and_missing_labels(spark, odd):
    labels = spark.createDataFrame([(1, None), (5, 1), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score(odd, labels)
    assert out.count() == odd.count() and out.where("score is null").count() == 0
    assert toxicity.score(odd, labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.without_toxic(odd, labels.limit(0)).columns == odd.columns
    assert toxicity.score(odd.limit(0), labels).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    m = toxicity.Model()
    m.embed = [rng.standard_normal(e.shape).astype(np.float64) for e in m.embed]
    m.conv = {k: w.astype(np.float64) for k, w in m.conv.items()}
    m.bias = {k: rng.standard_normal(b.shape) for k, b in m.bias.items()}  # not at the kink
    m.out, m.out_bias = rng.standard_normal(len(m.out)), np.zeros(1)
    docs, y = [rng.integers(0, 50, (n, 2)) for n in (0, 1, 2, 9)], np.array([0, 1, 0, 1.0])

    def loss():
        z = m.forward(docs)[0] @ m.out + m.out_bias
        return float((np.logaddexp(0, z) - y * z).mean())

    def dense(p, g):
        out = np.zeros(p.shape)
        out[g[0]] = g[1]
        return out

    for p, g in zip(m.params(), m.gradients(docs, y)):
        g = dense(p, g) if isinstance(g, tuple) else g
        at = tuple(rng.integers(0, min(n, 50)) for n in p.shape)
        old, eps = p[at], 1e-5
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert (up - down) / (2 * eps) == pytest.approx(float(g[at]), abs=1e-4)


# pipeline

PII = (("[EMAIL]", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("[IP]", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("[CARD]", r"[0-9]([\x20-]?[0-9])+"), ("[PHONE]", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_clean(text):
    """The union of all valid spans by the label of the first."""
    found = []
    for rank, (label, pattern) in enumerate(PII):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if (True, all(int(x) <= 255 for x in m[0].split(".")) if rank == 1 else True, 14 <= len(d) <= 19 and luhn, 10 <= len(d) <= 15)[rank]:
                found.append((m.start(), rank, m.end(), label))
    out, at = "", 0
    for start, _, end, label in sorted(found):
        if start >= at:
            out += text[at:start] + label
        at = max(at, end)
    return out + text[at:]


def test_each_stage_equals_brute_force_on_its_input(spark, documents, odd, tmp_path):
    """Nulls, empty and long texts, repeats and ties go through all stages; each is held against a plain version."""
    from tierflow.llm import mixing
    from tierflow.llm.tokens import default_vocabulary, encoder

    sf_dir = str(tmp_path)
    both(documents, odd).withColumn("row", F.lit(1)).write.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    labels.write.parquet(f"{sf_dir}/labels.parquet")
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = docs
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{sf_dir}/{name}")
        docs = spark.read.parquet(f"{sf_dir}/{name}")
        assert name == "packing" or out.columns == columns
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())
    stages = {n: spark.read.parquet(f"{sf_dir}/{n}") for n in kept}
    scored = toxicity.score(kept["toxicity"], labels)
    assert ids(stages["toxicity"]) == ids(scored.where("not rejected"))
    texts, copies = {}, {}
    for r in kept["near_duplicates"].collect():
        texts.setdefault(len(texts), r["text"])
        copies[len(texts) - 1] = r["doc_id"]
    groups = {}
    for k, root in brute_similar(texts).items():
        groups.setdefault(root, []).append(copies[k])
    want = [min((x for x in g if x is not None), default=None) for g in groups.values()]
    assert ids(stages["near_duplicates"]) == sorted(map(str, want))
    clean = sorted((str(r["doc_id"]), str(r["text"] if r["text"] is None else brute_clean(r["text"]))) for r in kept["personal_data"].collect())
    assert clean == sorted((str(r["doc_id"]), str(r["text"])) for r in stages["personal_data"].collect())
    assert ids(stages["mixing"]) == ids(mixing.mix(kept["mixing"], max_passes=corpus_pipeline.MAX_PASSES))
    enc, whole = encoder(default_vocabulary()), {}
    for r in stages["packing"].collect():
        own = np.frombuffer(r["ids"], dtype="<u4")
        assert len(own) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        whole.setdefault(r["doc_id"], []).append((r["start"], own))
    times = {}
    for r in kept["packing"].collect():
        times.setdefault(r["doc_id"], []).append(r["text"] or "")
    assert whole.keys() == times.keys()
    for k, pieces in whole.items():
        ids_ = np.append(enc.encode(times[k][0]), np.uint32(1))
        assert sum(len(p) for _, p in pieces) == len(ids_) * len(times[k])
        assert all(np.array_equal(p, ids_[at : at + len(p)]) for at, p in pieces)
    # no sequence has two copies of a document that lie in it from their start
    firsts = [(r["sequence_id"], r["doc_id"]) for r in stages["packing"].where("start = 0").collect()]
    assert len(firsts) - len(set(firsts)) <= 0.01 * len(firsts)


def test_the_pipeline_runs_and_takes_an_empty_table(spark, documents, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    assert corpus_pipeline.run(spark, DATA).count() > 0
    documents.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_near_duplicate_stage_drops_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    near, far = edited(rng, base, 3), edited(rng, base, 40)  # similarity over 0.8 and far under
    docs = spark.createDataFrame([(1, " ".join(base)), (2, near), (3, far), (None, near)], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == ["1", "3"]
