"""WARC, search, digests, near-duplicates, sharding and the pipeline."""

import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import digest, sharding, simhash, topk, warc
from millrace.llm.common import join_unique
from millrace.session import staged, table
from tests.conftest import rows


def test_join_unique_splits_hot_keys(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(4000)] + [(None, None)], "i long, k string")
    right = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    got = {r[0]: r[2] for r in rows(join_unique(left, right, "k", "n", 4001))}
    assert len(got) == 4001 and got[None] is None and got[3] == 3 and got[4] == got[3998] == 1


PAGES = [
    (5, "http://a/1", "<p>" + "x" * 200), (2, "http://a/2", "<p>" + "x" * 200), (9, None, "<p>" + "x" * 200), (3, "u", "short"), (4, "v é\r\n", "short"),
    (7, "w", None), (8, "w", ""), (None, "n", "<p>" + "x" * 200), (10, "é", "é漢\r\n\r\nWARC/1.1\r\n" * 20), (2, "http://a/2", "<p>" + "x" * 200),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, digest string, bytes int")
    index = warc.write(pages)
    got = rows(warc.read(index), "page_id")
    assert len(got) == len(PAGES)
    for page_id, size, said, kind, refers in got:
        assert any(page_id == p and said == hashlib.sha256((h or "").encode()).hexdigest() and size == len((h or "").encode()) for p, _, h in PAGES)
        assert (kind, refers) == (("revisit", 2) if page_id in (5, 9, None) else ("response", None))
    some = warc.read(index.where("page_id in (3, 10)"))
    assert sorted(r[0] for r in rows(some)) == [3, 10]
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_warc_paths_as_spark_names_them(tmp_path):
    assert warc._uri("/a/b") == "file:///a/b" == warc._uri("file:/a/b") == warc._uri("file:///a/b")
    assert warc._uri("s3a://bucket/x") == "s3://bucket/x" and warc._uri("hdfs://name:9000/x") == "hdfs://name:9000/x" and warc._uri("hdfs:/x") == "hdfs:///x"
    files, folder = warc._filesystem(f"file:{tmp_path}")
    files.create_dir(f"{folder}/made")
    assert (tmp_path / "made").is_dir()


def test_warc_offsets_point_at_records(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    index = warc.write(pages, str(tmp_path)).collect()
    for r in index:
        data = (tmp_path / r["archive"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        head, http, _ = warc.parse(zlib.decompress(data, 31))
        assert head["warc-type"] == r["record_type"] and http["content-type"].startswith("text/html")
    for name in {r["archive"] for r in index}:  # members lie side by side
        own = sorted((r["offset"], r["length"]) for r in index if r["archive"] == name)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]


def test_warc_reads_are_coalesced_and_checked(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}" * 50) for i in range(50)], "page_id long, url string, html string")
    index = staged(warc.write(pages, str(tmp_path)), "index")
    for f in tmp_path.glob("*.gz"):
        data = bytearray(f.read_bytes())
        data[len(data) // 2] ^= 1
        f.write_bytes(data)
    with pytest.raises(Exception):
        warc.read(index).collect()


def vectors(spark, values):
    made = spark.createDataFrame([(i, v, 1) for i, v in values], "vec_id long, embedding array<float>, score int")
    return made.where(topk.usable() & F.col("vec_id").isNotNull()).select("vec_id", topk.quantised().alias("vec"))


def brute_top_k(values, k=5):
    out = []
    for i, q in values:
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in values if j != i and len(c) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    values = [(i, [float(x) for x in rng.integers(-6, 7, 24) / 16]) for i in range(700)]
    values += [(1000 + i, values[3][1]) for i in range(40)] + [(2000, [0.5, 0.25]), (2001, [1.0, -1.0])]
    whole = [(i, [int(np.floor(256 * np.float32(x).astype(float))) for x in v]) for i, v in values]
    made = vectors(spark, values + [(2050, None), (2051, [None, 1.0]), (2100, [float("nan"), 1.0]), (2150, [float("inf"), 1.0]), (None, [1.0, 2.0]), (2200, [])])
    got = topk.top_k(made.where("vec_id % 50 = 0"), made)
    assert [tuple(r) for r in rows(got, "query_id", "rank")] == brute_top_k(whole)


def test_search_cases(spark):
    few = vectors(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 9.0])])
    assert rows(topk.top_k(few.where("vec_id = 0"), few)) == [(0, 1, 1, 256 * 128), (0, 2, 2, 256 * 128)]
    assert topk.top_k(few.limit(0), few).count() == 0
    assert topk.top_k(few, few.limit(0)).count() == 0


def test_block_search_prunes_nothing_it_needs():
    rng = np.random.default_rng(3)
    for _ in range(20):
        c = rng.integers(-200, 200, (300, 48)).astype(float)
        c[50:80] = c[0]
        q = rng.integers(-200, 200, (7, 48)).astype(float)
        got = topk.search_block(np.arange(7) + 1000, q, np.arange(300), c, 5)
        s = q @ c.T
        want = [(1000 + i, int(j), int(s[i, j])) for i in range(7) for j in np.lexsort((np.arange(300), -s[i]))[:5]]
        assert got == want


def test_window_classes_by_brute_force():
    random.seed(1)
    for text in (b"a" * 70, bytes(random.choices(b"abcdefgh \n", k=300)), bytes(range(256)) * 2, b"short"):
        got = digest.window_classes(text)
        for i, c in enumerate(got):
            part = text[i : i + digest.WINDOW]
            counts = np.bincount(np.frombuffer(part, np.uint8))
            s = sum(n * np.log2(n) for n in counts if n)
            assert c == digest._classes(np.array([s]))[0]
        assert (digest.tile_classes(text) == got[:: digest.WINDOW][: len(text) // digest.WINDOW]).all()


def test_popular_by_brute_force():
    rng = np.random.default_rng(2)
    for n in (17, 40, 200):
        ranks = rng.integers(0, 20, n)
        points = np.zeros(n, int)
        for i in range(n - digest.RUN + 1):
            points[i + int(ranks[i : i + digest.RUN].argmin())] += 1
        want = points >= digest.POINTS
        assert digest.popular(ranks).tolist() == (want.tolist() if want.any() else digest.popular(ranks).tolist())


def test_digests_of_a_table(spark, data):
    documents = table(spark, data, "documents")
    texts = [r["text"] or "" for r in documents.orderBy("doc_id").collect()]
    ids = [r["doc_id"] for r in documents.orderBy("doc_id").collect()]
    got = {r["doc_id"]: r for r in digest.fingerprints(documents.repartition(7)).collect()}
    prints = {}
    for i, own, following in zip(ids, texts, texts[1:] + texts[:1], strict=True):
        n = len(own) // 4
        changed = own[: len(own) - n] + following[:n]
        assert got[i]["n_chars"] == len(own) and got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(own, got[i]["fingerprint"]) == got[i]["fingerprint"]
        a, b = digest.Digest.parse(got[i]["fingerprint"]), digest.Digest.parse(got[i]["edited_fingerprint"])
        assert got[i]["near_edited"] == pytest.approx(a.likeness(b)) and 0 <= got[i]["near_next"] <= 1
        assert a.likeness(a) == pytest.approx(1.0)
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.6 > 0.2 > np.mean([r["near_next"] for r in got.values()])


def test_digest_ranges_do_not_matter(spark, data, monkeypatch):
    documents = table(spark, data, "documents")
    one = rows(digest.fingerprints(documents), "doc_id")
    monkeypatch.setattr(digest, "RANGE_ROWS", 13)
    assert rows(digest.fingerprints(documents), "doc_id") == one


def test_digest_cases(odd, empty):
    got = rows(digest.fingerprints(odd), "doc_id")
    assert len(got) == 11
    by = {r[0]: r for r in got}
    assert by[2][1] == by[3][1] == 0 and by[2][3] == "0:" and by[2][5:7] == (1.0, 1.0) and by[9][1] == 40000
    assert len({r[3] for r in got if r[0] in (1, 6)}) == 1
    assert digest.fingerprints(empty).count() == 0


@pytest.mark.parametrize("kind", ["string", "decimal(20,3)", "double", "date", "long", "boolean"])
def test_digests_of_any_ids_in_many_ranges(spark, monkeypatch, kind):
    """Ids of any type, a third of the rows with one id and some without, in ranges of few rows: each text is followed by the next."""
    monkeypatch.setattr(digest, "RANGE_ROWS", 40)
    made = {
        "string": "concat('k', id)", "decimal(20,3)": "cast(id / 8 as decimal(20,3))", "double": "if(id = 7, double('nan'), id / 8)", "date": "date_add(date'2020-01-01', cast(id as int))",
        "long": "9007199254740993 + id", "boolean": "id % 2 = 0",
    }[kind]
    docs = spark.range(900).selectExpr(f"case when id % 3 = 0 then (select min({made}) from range(50, 51)) when id % 50 = 1 then null else {made} end AS doc_id", "concat(repeat('words and more words ', 3), id * 7919 % 1000) AS text")
    docs = docs.repartition(5)
    got = digest.fingerprints(docs)
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    order = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).collect()
    want = sorted((repr(a["doc_id"]), hashlib.sha256(digest.edited(a["text"], b["text"]).encode()).hexdigest()) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert sorted((repr(r["doc_id"]), r["edited_sha256"]) for r in got.collect()) == want


def test_an_id_with_many_rows_is_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(digest, "RANGE_ROWS", 50)
    docs = spark.range(1000).selectExpr("if(id % 3 = 0, id, 5L) AS doc_id", "concat('t', id) AS text")
    sizes = [r["n"] for r in digest._ranged(docs).groupBy("r").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 12 and max(sizes) < 150


def test_likeness_block_by_block(monkeypatch):
    rng = np.random.default_rng(0)
    a, b = (digest.Digest(rng.integers(0, 1 << 62, n, np.int64).astype(np.uint64)) for n in (2000, 3000))
    whole = a.likeness(b)
    monkeypatch.setattr(digest, "FILTERS_AT_ONCE", 3)
    assert a.likeness(b) == whole


def plain_simhash(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i, p in prints:
        least[find(p)].append(i)
    return {i: min(v) for v in least.values() for i in v}


def test_fingerprints_by_hand(odd, spark):
    for r in odd.collect():
        assert simhash.fingerprint(r["text"]) == plain_simhash(r["text"])
    assert simhash.fingerprint("A b C É") == plain_simhash("A b C É")
    small = spark.createDataFrame([(1, "AB c d e")], "doc_id long, text string")
    assert rows(simhash.grouped(small))[0][1] == f"{plain_simhash('ab c d e'):016x}"


def test_groups_equal_brute_force(spark, data):
    documents = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").collect()]
    random.seed(9)
    base = " ".join(random.choices([f"w{i}" for i in range(400)], k=400)).split()
    for k in range(120):  # a large group of near copies
        words = base.copy()
        words[random.randrange(400)] = f"n{k}"
        documents.append((10_000 + k, " ".join(words)))
    documents += [(20_000, None), (20_001, ""), (20_002, " \n")]
    made = spark.createDataFrame([(i, t, "x", 1) for i, t in documents], "doc_id long, text string, fp string, component_id int")
    got = {r[0]: (r[1], r[2]) for r in rows(simhash.grouped(made))}
    want = plain_components([(i, plain_simhash(t)) for i, t in documents])
    assert {i: c for i, (_, c) in got.items()} == want
    assert all(f == f"{plain_simhash(t):016x}" for i, t in documents for f in [got[i][0]])


def test_links_find_all_pairs_of_random_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(6):
            x = b
            for bit in rng.choice(63, rng.integers(1, 4), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    df = spark.createDataFrame([(f, f) for f in fps], "node long, fp long").repartition(5)
    found = simhash.components(simhash.links(df))
    roots = {r["node"]: r["root"] for r in found.collect()}
    want = plain_components([(f, f & (1 << 64) - 1) for f in fps])
    groups, mine = defaultdict(set), defaultdict(set)
    for f, c in want.items():
        groups[c].add(f)
    for f in fps:
        mine[roots.get(f, f)].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


@pytest.mark.parametrize("at_once", [100, 1_000_000])  # by rounds over the edges, and in one task
def test_components_of_a_long_chain_and_a_star(spark, monkeypatch, at_once):
    monkeypatch.setattr(simhash, "EDGES_A_TASK", at_once)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000)]
    random.shuffle(edges)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 400)}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_cases(spark, odd, empty):
    got = rows(simhash.grouped(odd), "doc_id")
    by = {r[0]: r for r in got}
    assert len(got) == 11 and by[6][2] == by[1][2] == 1 and by[2][2] == by[3][2] == by[4][2] == 2 and by[2][1] == "0" * 16
    assert simhash.grouped(empty).count() == 0
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 5, 7, 8, 9]


def near_copies(rng, n, edits):
    words = [f"w{i}" for i in rng.integers(0, 4000, n)]
    other = words.copy()
    for i in rng.choice(n, edits, replace=False):
        other[i] = f"x{rng.integers(0, 4000)}"
    five = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return " ".join(words), " ".join(other), len(five(words) & five(other)) / len(five(words) | five(other))


def test_near_copies_are_found_and_others_stay(spark):
    rng = np.random.default_rng(12)
    docs, near = [], []
    for k in range(600):
        n = int(rng.integers(80, 500))
        a, b, similarity = near_copies(rng, n, int(rng.integers(1, 12)))
        docs += [(2 * k, a), (2 * k + 1, b)]
        near.append((k, similarity))
    kept = {r[0] for r in rows(simhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert all(2 * k in kept for k, _ in near)
    found = lambda low, high: [2 * k + 1 not in kept for k, s in near if low <= s < high]
    assert np.mean(found(0.8, 1.1)) > 0.99 and np.mean(found(0, 0.8)) == 0


def test_equal_halves_link_in_tables_of_the_other_half(spark, monkeypatch):
    rng = np.random.default_rng(6)
    fps = set()
    for half in (0, 32):  # many fingerprints with one equal half, some of them linked
        other = rng.integers(0, 1 << 31, 1500)
        other = np.concatenate((other, other[:400] ^ 1 << rng.integers(0, 31, 400), other[:400] ^ 0b10010001))
        fps |= {(int(x) << half) | (0x1234567 << (32 - half)) for x in other}
    fps |= {f ^ (1 << int(rng.integers(0, 63))) for f in list(fps)[:500]}
    want = plain_components([(f, f) for f in sorted(fps)])
    for bucket, hot in ((256, 1 << 19), (16, 200)):  # the second one deals groups out
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        monkeypatch.setattr(simhash, "HOT_GROUP", hot)
        found = simhash.components(simhash.links(spark.createDataFrame([(f, f) for f in fps], "node long, fp long")))
        roots = {r["node"]: r["root"] for r in found.collect()}
        assert {f: roots.get(f, f) for f in fps} == want


def test_many_equal_halves_take_seconds():
    rng = np.random.default_rng(7)
    n = 100_000
    fps = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint64))
    began = time.perf_counter()
    edges = simhash.link_group(fps.astype(np.int64), fps, np.ones(len(fps), bool), np.zeros(len(fps), np.uint32), 24, 1)
    assert time.perf_counter() - began < 60
    close = np.sort(fps)[1:] ^ np.sort(fps)[:-1]
    assert len(edges) >= (np.bitwise_count(close) == 1).sum() // 2


def test_shards_equal_brute_force(spark, data, odd, empty):
    for documents in (table(spark, data, "documents"), odd):
        measured = sharding.measured(documents)
        got = rows(sharding.by_bytes(measured, 7), "shard", "slot")
        whole = sum(r[1] for r in got)
        assert len(got) == documents.count()
        before, ids = 0, []
        slots = defaultdict(int)
        for doc_id, size, crc, shard, slot in got:
            assert slot == slots[shard]
            slots[shard] += 1
            assert shard == min(6, (before + size - size // 2) * 7 // whole)
            before += size
            ids.append(doc_id)
        assert ids == sorted(ids, key=lambda i: (i is not None, i))
        texts = defaultdict(set)
        for r in documents.collect():
            data_ = (r["text"] or "").encode()
            texts[r["doc_id"]].add((len(data_) + 16, zlib.crc32(data_)))
        assert all((size, crc) in texts[i] for i, size, crc, _, _ in got)
    assert sharding.by_bytes(sharding.measured(empty)).count() == 0


def test_shards_are_balanced(spark):
    made = spark.range(20000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 7919 % 300).cast("int")).alias("text"))
    got = sharding.by_bytes(sharding.measured(made)).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in got]
    assert len(sizes) == 40 and max(sizes) - min(sizes) <= 2 * 316


def test_pipeline_stages(spark, data):
    docs = table(spark, data, "documents")
    original = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = staged(stage(spark, docs, data), name)
        assert after.columns == original.columns and after.count() <= docs.count()
        docs = after
    assert docs.count() > 0.6 * original.count()
    assert docs.groupBy("text").count().where("count > 1").count() == 0
    left = " ".join(r["text"] for r in docs.collect())
    assert "@mail" not in left
    got = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in docs.collect()}


def test_stretches_of_a_long_text_do_not_matter(monkeypatch):
    random.seed(8)
    data = bytes(random.choices(b"abcdefgh \n", k=5000))
    rarity = np.random.default_rng(0).permutation(digest.CLASSES)
    classes, tiles, (places, hashes) = digest.window_classes(data), digest.tile_classes(data), digest.features(data, rarity)
    monkeypatch.setattr(digest, "STRETCH", 64)
    assert (digest.window_classes(data) == classes).all() and (digest.tile_classes(data) == tiles).all()
    again = digest.features(data, rarity)
    assert (again[0] == places).all() and (again[1] == hashes).all()


def five_word_sets(texts):
    lists = [t.lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} for w in lists]


def test_keep_first_finds_every_pair_of_five_word_similarity(spark):
    rng = np.random.default_rng(31)
    texts = []
    for _ in range(250):
        texts += near_copies(rng, int(rng.integers(20, 400)), int(rng.integers(1, 16)))[:2]
    base = texts[0].split()
    for k in range(150):  # a large group of near copies, some of them only through others
        words = base.copy()
        for i in rng.choice(len(base), int(rng.integers(1, 6)), replace=False):
            words[i] = f"z{k}"
        texts.append(" ".join(words))
    order = rng.permutation(len(texts)).tolist()
    sets, root = five_word_sets(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, doc_id in enumerate(order):
        least[find(i)].append(doc_id)
    made = spark.createDataFrame(list(zip(order, texts, strict=True)), "doc_id long, text string").repartition(5)
    assert sorted(r["doc_id"] for r in simhash.keep_first(made, shingle=5).collect()) == sorted(map(min, least.values()))


def test_parities_rule_out_no_similar_pair():
    rng = np.random.default_rng(5)
    ruled_out = 0
    for _ in range(300):
        n = int(rng.integers(10, 900))
        a, b, _ = near_copies(rng, n, int(rng.integers(1, min(n, 60))))
        one, other = simhash.shingle_set(a, 5), simhash.shingle_set(b, 5)
        may = simhash.may_be_similar(simhash.parities(one)[None], simhash.parities(other)[None], np.array([len(one) + len(other)]))[0]
        assert may or not simhash.similar(one, other)
        ruled_out += not may
    assert ruled_out > 30
    least = simhash.parities(simhash.shingle_set("", 5))
    assert np.bitwise_count(least).sum() == 1 and len(least) == len(simhash.PARITIES)


def test_recall_of_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(77)
    docs, near = [], []
    while len(near) < 500:
        n = int(rng.integers(30, 400))
        a, b, similarity = near_copies(rng, n, max(1, round(n * float(rng.uniform(0.01, 0.03)))))
        if 0.8 <= similarity < 0.87:
            docs += [(2 * len(near), a), (2 * len(near) + 1, b)]
            near.append(similarity)
    kept = simhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).count()
    assert len(docs) - kept >= 0.99 * len(near)


def test_dealing_tables_out_loses_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for k in range(200):  # a large group of near copies, many of them only through others
        words = base.copy()
        for i in rng.choice(len(base), int(rng.integers(1, 8)), replace=False):
            words[i] = f"z{k}"
        docs.append((k, " ".join(words)))
    made = spark.createDataFrame(docs, "doc_id long, text string")
    want = rows(simhash.near_groups(made))
    for name, value in (("TABLE_ROWS", 50), ("NEAR_GROUP", 4), ("WINDOW", 2), ("BLOCK", 7), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(simhash, name, value)
    assert rows(simhash.near_groups(made)) == want


def test_keep_first_with_ids_of_text(spark):
    made = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), ("b", "other words")], "doc_id string, text string")
    assert sorted(map(tuple, simhash.keep_first(made).collect())) == [("a", "one two three four five six"), ("b", "other words")]


def test_pipeline_near_dedup_takes_five_words(spark, data):
    words = [f"w{i}" for i in range(100)]
    other = words.copy()
    for i in (20, 50, 80):
        other[i] = f"x{i}"
    # Three-word shingles are alike by 89 of 107, five-word ones by 81 of 111 only.
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    assert corpus_pipeline.near_dedup(spark, docs, data).count() == 2
    assert simhash.keep_first(docs, shingle=3).count() == 1


def test_keep_first_tells_rows_apart_by_row(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    docs = [(7, text("a")), (7, text("b")), (7, text("c")), (1, text("a")), (None, text("b")), (None, text("d")), (None, text("d")), (7, text("c"))]
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, simhash.keep_first(made).collect()), key=repr)
    assert got == sorted([(1, text("a")), (7, text("b")), (7, text("c")), (None, text("d"))], key=repr)


def test_rarity_counts_windows_at_every_byte(spark):
    # Tiles are of one letter each; only the windows between them are of other classes.
    text = "".join(c * digest.WINDOW for c in "abcdefgh")
    counts = np.bincount(digest.window_classes(text.encode()), minlength=digest.CLASSES)
    want = np.argsort(np.argsort(counts, kind="stable"), kind="stable")
    assert (digest.rarity_of(spark.createDataFrame([(1, text)], "doc_id long, text string")) == want).all()


def test_warc_decides_alike_with_and_without_a_shuffle(spark, monkeypatch):
    """The repeated payloads by broadcast, or met in a shuffle: the same records; pages are not shuffled in the first way."""
    made = [(i, f"u{i}", "<p>" + "x" * (100 + i % 7)) for i in range(300)] + [(None, "n", "<p>" + "x" * 100), (5000, None, None), (5001, "e", "")]
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    near = warc.decided(pages)
    assert "Exchange hashpartitioning" not in near._jdf.queryExecution().executedPlan().toString()
    one = rows(near)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 3)
    assert rows(warc.decided(pages)) == one
    assert sum(r[4] is not None for r in one) == 294
