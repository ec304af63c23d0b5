from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from heddle.llm import ann, common, embed_dedup, near_copies, queries, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def reference(text, shingle=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, near):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in near:
        a, b = sorted((root(i), root(j)))
        label[b] = a
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("text", ["", None, "one", "Two words", "A b\tC d\n e", "É É é e x y z", "word " * 70_000, "a b c " * 3, "x\x0by\x0cz w"])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == reference(text)


def test_fingerprint_hash_is_sparks(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("ab c dé"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("ab c dé", 42)


@pytest.mark.parametrize("limit", [16_384, 40])
def test_simhash_links_match_brute_force(spark, limit):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = [0]
    for b in base:
        fps += [int(b) ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)) for k in (0, 1, 2, 3, 4, 5)]
    ball = int(base[0])
    fps += [ball ^ (1 << i) for i in range(0, 16)]  # a dense ball in one shard
    fps = sorted(set(fps))
    want = classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    d = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    found = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(d, limit=limit).collect()]
    at = {f: i for i, f in enumerate(fps)}
    assert classes(len(fps), [(at[a], at[b]) for a, b in found]) == want
    roots = {r.v % 2**64: r.root for r in common.components(simhash.links(d, limit=limit)).collect()}
    for i, f in enumerate(fps):
        assert (f in roots) == (want.count(want[i]) > 1)


def test_simhash_documents(spark):
    long = " ".join(f"w{i * i % 997}" for i in range(401))
    rows = [(5, long), (3, long + " once"), (9, long.upper()), (7, "entirely different words here now"), (8, None), (2, ""), (4, " \n"), (None, "entirely different words here now"), (7, "entirely different words here now"), (11, "lone"), (None, "nobody else")]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumnsRenamed({"lang": "fp", "source": "rep"})
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(d).collect()]
    assert len(got) == len(rows)
    by = {}
    for i, f, c in got:
        by.setdefault((i, c), []).append(f)
    assert {(5, 3), (3, 3), (9, 3), (7, 7), (None, 7), (8, 2), (2, 2), (4, 2), (11, 11), (None, None)} == set(by)
    assert by[8, 2] == ["0" * 16] and len(by[7, 7]) == 2
    kept = sorted(r.doc_id for r in simhash.keep_first(d.where("doc_id is not null")).collect())
    assert kept == [2, 3, 7, 11]
    assert simhash.near_duplicates(d.where("false")).collect() == [] and simhash.keep_first(d.where("false")).count() == 0


def test_rows_that_share_an_id_are_kept_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i * i % 97}" for i in range(120)) for x in "abc")
    rows = [(5, a), (5, b), (5, a), (9, b), (7, a), (5, f"{a} once"), (4, c), (3, c), (None, c), (None, c)]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    for keep in (simhash.keep_first, near_copies.keep_first):
        got = sorted((r.doc_id or 0, r.text[:2]) for r in keep(d).collect())
        assert got == sorted([(0, c[:2])] * 2 + [(3, c[:2]), (5, a[:2]), (5, b[:2])])


def five_word_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_rows():
    """Bases with copies of 0 to 9 changed words each (similarity from 1 down to about 0.6), and a large group around one base."""
    rng = np.random.default_rng(3)
    texts = []
    for base in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 80 + 5 * base)]
        for changes in [0, 0, *range(10)] + [4] * 120 * (base == 0):
            copy = list(words)
            for at in rng.integers(0, len(copy), changes):
                copy[at] = f"new{rng.integers(10**6)}"
            texts.append(" ".join(copy))
    texts += [None, "", " ", "a b", "A  B", "a c"]
    return [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]


@pytest.mark.parametrize("limit", [1_000, 16])
def test_near_copies_match_brute_force(spark, limit):
    rows = sorted(near_rows())
    sets = [five_word_set(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert sum(len(sets[i] & sets[j]) < 0.9 * len(sets[i] | sets[j]) for i, j in near) > 300
    want = classes(len(rows), near)
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows] + [(None, rows[0][1], "en", "s", 0), (0, rows[0][1], "en", "s", 0)], DOCS)
    got = {r.doc_id: r.component_id for r in near_copies.near_duplicates(d, limit=limit).collect()}
    assert got == dict(enumerate(want))
    if limit == 1_000:
        kept = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, d.where("doc_id is not null"), "").collect())
        assert kept == sorted(set(want))
        assert near_copies.keep_first(d).where("doc_id is null").count() == 1 and near_copies.keep_first(d.where("false")).count() == 0


@pytest.mark.parametrize("chunk", [100_000, 64])
def test_near_copies_are_found_by_their_fingerprints(spark, chunk):
    rng = np.random.default_rng(4)
    words = rng.integers(0, 2**63, (300, near_copies.WORDS), dtype=np.uint64)
    for at in range(150):  # 38 bits apart on average, from one of ten
        words[at + 10] = words[at % 10] ^ np.packbits(rng.random((1, 256)) < 1 - near_copies.SAME, axis=1).view(np.uint64)[0]
    x = np.bitwise_count(words[:, None] ^ words[None])
    near = (x.sum(2) <= near_copies.WHOLE) & (x[:, :, 0] <= near_copies.RADIUS)
    df = spark.createDataFrame([(i, *map(int, w)) for i, w in enumerate(words.view(np.int64))], "fp long, w0 long, w1 long, w2 long, w3 long")
    got = [(r.a, r.b) for r in near_copies.candidates(df, chunk).collect()]
    assert got and all(near[a, b] for a, b in got)
    assert classes(300, got) == classes(300, [(i, j) for i in range(300) for j in range(i) if near[i, j]])


def test_pairs_at_the_threshold_share_a_bucket():
    n, pairs = 230_000, 20_000
    differ = np.random.default_rng(5).random((pairs, 64 * near_copies.WORDS)) < 1 - near_copies.SAME
    tables, lost = near_copies.shard_bits(n), np.ones(pairs, dtype=bool)
    for t, shard in enumerate(tables):
        for bucket in near_copies.bucket_bits(n >> tables.shape[1], t << tables.shape[1]):
            lost &= differ[:, shard].any(1) | differ[:, bucket].any(1)
    assert lost.sum() <= 4 and (differ.sum(1) > near_copies.WHOLE).sum() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(900, None, 1), (901, [0.0] * 8, 1), (902, [nan] + [1.0] * 7, 1), (903, [inf] + [1.0] * 7, 1), (904, [None] + [1.0] * 7, 1), (905, [], 1), (906, [1.0, 2.0], 1)]


@pytest.mark.parametrize(("dims", "limit"), [(8, 2048), (24, 20)])
def test_embedding_links_match_brute_force(spark, dims, limit):
    rng = np.random.default_rng(dims)
    x = rng.standard_normal((60, dims))
    x = np.concatenate([x] + [x[:30] + s * rng.standard_normal((30, dims)) for s in (0.05, 0.12, 0.2, 0.25)] + [x[:5], 3 * x[5:8], np.repeat(x[:1], 30, 0) + 0.05 * rng.standard_normal((30, dims))]).astype(np.float32)
    label = [int(i) if i < 2 else None for i in rng.integers(0, 3, len(x))]
    rows = [(i, x[i].tolist(), label[i]) for i in range(len(x))] + odd_rows() + [(None, x[0].tolist(), label[0])]
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(vectors(spark, rows), limit=limit).collect()}
    y = x.astype(float)
    norm = np.sqrt(ann.dots(y, y))
    near = [(i, j) for i in range(len(x)) for j in range(i) if label[i] is not None and label[i] == label[j] and ann.dots(y[i : i + 1], y[j : j + 1])[0] / (norm[i] * norm[j]) >= 0.98]
    n = np.bincount([k for p in near for k in p], minlength=len(x))
    twin = [label[0] is not None and label[i] == label[0] and (y[i] @ y[0]) / (norm[i] * norm[0]) >= 0.98 for i in range(len(x))]
    want = classes(len(x), near)
    assert len(near) > 60
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n[i] + twin[i], want[i], want[i] == i), i
    assert got[None].n_links == sum(twin) and got[None].kept is False
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _, _ in odd_rows())


def test_planted_links_match_the_registered_sql(spark, tmp_path):
    rng = np.random.default_rng(21)
    x = rng.standard_normal((120, 64))
    x = np.concatenate([x, x[:40] + 0.12 * rng.standard_normal((40, 64)), x[:20] + 0.16 * rng.standard_normal((20, 64)), 2 * x[:10], x[40:44]]).astype(np.float32)
    rows = [(i, v.tolist(), None if i % 31 == 0 else i % 40 % 3) for i, v in enumerate(x)] + odd_rows()[:-1]
    vectors(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for name in ("op10_embedding_dedup", "op3_nearest"):
        rel = con.sql(queries.ORACLE[name])
        plain = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
        want = sorted(map(plain, rel.fetchall()))
        got = sorted(map(plain, queries.QUERIES[name](spark, str(tmp_path)).select(*rel.columns).collect()))
        assert got == want
        assert name == "op3_nearest" or sum(r[rel.columns.index("n_links")] for r in want) > 60


def test_embedding_dedup_empty(spark):
    assert embed_dedup.near_duplicates(vectors(spark, [])).count() == 0


def brute(rows, k=20, every=20):
    ok = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    out = []
    for q, v in ok:
        if q % every == 0:
            s = sorted((-ann.dots(v[None], w[None])[0], i) for i, w in ok if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -d) for r, (d, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [50, 8192])
def test_nearest_matches_brute_force(spark, shard):
    rng = np.random.default_rng(shard)
    x = (rng.standard_normal((300, 8)) * rng.uniform(0.1, 3, (300, 1))).astype(np.float32)
    x[100:140] = x[0]  # ties
    rows = [(i, x[i].tolist(), 0) for i in range(300)] + odd_rows() + [(1000, [1.0, 1.0], 0), (None, [1.0] * 8, 0)]
    d = vectors(spark, rows).withColumnRenamed("label", "shard")
    assert sorted(map(tuple, ann.nearest(d, shard_rows=shard, block_rows=7, leaf=16).collect())) == brute(rows)
    assert ann.nearest(d.where("false")).count() == 0


def test_relaxed_search_keeps_recall():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 16))
    ids = np.arange(2000)
    tree = ann.VantageTree(ids, x, 64)
    exact, loose = tree.search(ids[:50], x[:50]), tree.search(ids[:50], x[:50], factor=0.8)
    a, b = (set(zip(r[0].tolist(), r[1].tolist(), strict=True)) for r in (exact, loose))
    assert len(a) == 1000 and len(a & b) / len(a) >= 0.9


def clustered(n, dims=16, groups=24):
    rng = np.random.default_rng(5)
    c = rng.standard_normal((groups, dims)) * 4
    return np.concatenate([c[i % groups][None] + 0.3 * rng.standard_normal((1, dims)) for i in range(n)])


def test_clustered_vectors_are_pruned(spark):
    x = clustered(3000)
    x /= np.sqrt((x * x).sum(1))[:, None]
    tree = ann.VantageTree(np.arange(3000), x, 32)
    tree.search(np.arange(0, 3000, 20), x[::20])
    assert tree.scanned < 0.25 * 150 * 3000
    rows = [(i, x[i].tolist(), 0) for i in range(3000)]
    v = vectors(spark, rows).selectExpr("vec_id", "cast(embedding as array<double>) as vector", "size(embedding) as dim")
    pivots = ann.pivots_of(v, 512, 100)
    d = ann.celled(v, pivots).cache()
    balls = {16: np.zeros((2, len(pivots[16])))}
    for r in d.groupBy("cell").agg({"far": "max", "norm": "max"}).collect():
        balls[16][:, r.cell] = r["max(far)"], r["max(norm)"]
    q = d.where("vec_id % 20 = 0").withColumn("least", F.lit(0.97))
    assert 30 == len(pivots[16]) and ann.onward(q, pivots, balls, 1.0).count() < 150 * 29 * 0.3
    assert sorted(map(tuple, ann.nearest(vectors(spark, rows), shard_rows=100, block_rows=16, leaf=16).collect())) == brute([(i, [float(np.float32(v)) for v in e], 0) for i, e, _ in rows])


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the test tables")
def test_relaxed_search_of_the_tables_own_vectors(spark):
    """Without clusters, in 64 dimensions, nothing can be skipped but at the price of recall."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in e], dtype=float)
    ids = np.array([r.vec_id for r in e])
    tree = ann.VantageTree(ids, x, 32)
    q = ids % 20 == 0
    exact, loose = (set(zip(*[a.tolist() for a in tree.search(ids[q], x[q], factor=f)[:2]], strict=True)) for f in (1.0, 0.15))
    assert len(exact & loose) >= 0.8 * len(exact)


def test_components(spark):
    rng = np.random.default_rng(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    wild = [tuple(map(int, rng.integers(1000, 1100, 2))) for _ in range(70)]
    e = chain + star + wild
    got = {r.v: r.root for r in common.components(spark.createDataFrame(e, "a long, b long")).collect()}
    v = sorted({x for p in e for x in p if p[0] != p[1]})
    at = {x: i for i, x in enumerate(v)}
    want = classes(len(v), [(at[a], at[b]) for a, b in e if a != b])
    assert got == {x: v[want[at[x]]] for x in v}


def test_paired_chunks_meet_once(spark):
    d = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 7)], "k int, id long")
    rows = common.paired_chunks(d, ["k"], "id", 30).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.k, r.gi, r.gj), []).append((r.id, r.side))
    met = {}
    for g in groups.values():
        assert len(g) <= 90
        for a, s in g:
            for b, t in g:
                if a < b and (s == t == 0 or {s, t} == {1, 2}):
                    met[a, b] = met.get((a, b), 0) + 1
    assert len(met) == 4950 and set(met.values()) == {1}


def test_ranks_are_a_permutation(spark):
    d = spark.createDataFrame([("a", i) for i in range(1000)] + [(None, i) for i in range(7)], "k string, id long")
    got = {}
    for r in common.ranked(d, "k", ["id"], "rank", per_bin=50).collect():
        got.setdefault(r.k, []).append(r["rank"])
    assert sorted(got["a"]) == list(range(1000)) and sorted(got[None]) == list(range(7))
