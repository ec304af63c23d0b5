import collections
import math
import zlib
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs as pafs
from tokenizers import Tokenizer

import corpus_pipeline
from heddle.llm import common, langid, mixing, packing, queries, simhash, tokenids, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODER = tokens.Encoder(limit=50)
TEXTS = [None, "", " ", "a", "Hello, world.\nIt's 3 o'clock.", "tab\tand  two spaces", "\n\nx \n", "a b c d", "end <|endoftext|> end", "naïve façade, 中文 字.", "x.. y,, .z ,", "word " * 30_000, "l'eau d'été.\nUn, deux.", "a\x0bb\x1cc", "don't We'll I'd 'tis 's"]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_librarys(text):
    assert np.frombuffer(ENCODER.encode(text), "<u2").tolist() == ids_of(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(categories=["L"]), min_size=1, max_size=12))
def test_words_of_letters_are_the_librarys(word):
    assert np.frombuffer(ENCODER.encode(f"{word} {word}, {word}."), "<u2").tolist() == ids_of(f"{word} {word}, {word}.")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sé. ,\n\t 12中-<|>!"), max_size=40))
def test_any_ids_are_the_librarys(text):
    assert np.frombuffer(ENCODER.encode(text), "<u2").tolist() == ids_of(text)


def frame(spark):
    rows = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", None, None, None), (3, "a", "en", "s0", 1), (3, "other text", "en", "s0", 1)]
    return spark.createDataFrame(rows, DOCS).withColumnsRenamed({"n_chars": "start", "lang": "offset"})


def test_shards_round_trip(spark):
    d = frame(spark)
    shards = tokenids.write(d, common.scratch(spark, "ids"), shard_rows=4)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start), r.n_tokens, r.ids_crc32) for r in tokenids.documents(shards).collect())
    rows = d.collect()
    want = collections.Counter((r.doc_id, tuple(ids_of(r.text)) + (0,)) for r in rows)
    assert len(got) == len(rows)
    at = 0
    for (_, _, start), n, _ in got:
        assert start == at
        at += n
    have = collections.Counter((None if not k[0] else k[1], n, crc) for k, n, crc in got)
    assert have == collections.Counter({(i, len(t), zlib.crc32(np.array(t, "<u4").tobytes())): n for (i, t), n in want.items()})
    opened = [tokenids.Shard(r.path) for r in shards.collect()]
    hits = [s.get(4) for s in opened if s.get(4) is not None]
    assert len(hits) == 1 and hits[0].tolist() == ids_of(TEXTS[4]) + [0]
    assert all(s.get(10**9) is None for s in opened)
    assert tokenids.round_trip(spark, d.where("false")).count() == 0


def test_perfect_hash():
    for n in (0, 1, 2, 7, 5000):
        keys = np.arange(n) * 3 - 5
        h = tokenids.hashes(keys, np.zeros(n, bool), np.zeros(n, int))
        index = tokenids.PerfectHash.build(h)
        assert sorted(index.slots(h).tolist()) == list(range(n))
        assert index.slots(tokenids.hashes(keys + 10**12, np.zeros(n, bool), np.zeros(n, int))).max(initial=-1) < max(n, 1)


def test_patterns_place_everything():
    rng = np.random.default_rng(0)
    for _ in range(20):
        h = {int(k): int(v) for k, v in zip(rng.integers(1, 65, 30), rng.integers(1, 50, 30), strict=True)}
        used = collections.Counter()
        for packs, runs in packing.patterns(h, 64):
            assert sum(n * t for n, t in runs) <= 64 and packs > 0
            for n, t in runs:
                used[n] += packs * t
        assert used == collections.Counter(h)
    assert packing.patterns({}, 64) == []


def check_packing(rows, texts, size):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    docs = collections.defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
    for i, t in texts.items():
        ids = np.array(ids_of(t) + [0], "<u4")
        at = 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_packing(spark):
    d = frame(spark)
    rows = packing.pack(d.where("doc_id <> 3 or doc_id is null"), 64).collect()
    check_packing(rows, {i: t for i, t in enumerate(TEXTS) if i != 3} | {None: "null id"}, 64)
    assert packing.pack(d, 64).count() == len(rows) + 3 and packing.pack(d.where("false")).count() == 0


@pytest.mark.parametrize("weights", [{"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}, {"a": Fraction(1, 3), "b": Fraction(2, 3)}, {"a": 1 / 3, "b": 2 / 3}, {"a": 0.00005, "b": 0.99995}, {"a": 3, None: 1}, {"a": 0.9, "b": 0.1}, {"big": 0.5} | {f"s{i}": 0.05 for i in range(10)}, {"a": 5}])
def test_every_prefix_stays_within_a_block_of_the_given_weights(weights):
    shares = mixing.exact(weights)
    plan = mixing.schedule(shares)
    total = sum(Fraction(str(w)) for w in weights.values())
    got = collections.Counter()
    for t in range(1, 100_001):  # the period repeats
        got[plan[(t - 1) % len(plan)]] += 1
        if t < 3000 or t % 97 == 0 or t > 99_000:
            assert all(abs(got[s] - t * Fraction(str(w)) / total) < 1 for s, w in weights.items())


def test_weights():
    assert mixing.exact({}) == {} and mixing.exact({"a": 0, "b": 2}) == {"b": 1}
    for bad in (float("nan"), -1, float("inf")):
        with pytest.raises(ValueError):
            mixing.exact({"a": bad})
    with pytest.raises(ValueError, match="fewer digits"):
        mixing.exact({"a": 0.123456789, "b": 1})


def brute_slots(weights, slots):
    """(source, block) of each slot, by fractions and without periods: of released blocks the earliest deadline."""
    total = sum(weights.values())
    names = sorted(weights, key=lambda x: (x is None, x or ""))
    share = {n: Fraction(weights[n]) / total for n in names}
    done = dict.fromkeys(names, 0)
    out = []
    for t in range(slots):
        ready = [(math.ceil((done[n] + 1) / share[n]), i, n) for i, n in enumerate(names) if math.floor(done[n] / share[n]) <= t]
        n = min(ready)[2]
        out.append((n, done[n]))
        done[n] += 1
    return out


def test_places_against_brute_force(spark):
    weights = {"a": Fraction(5, 11), "b": Fraction(1, 7), "c": Fraction(1, 13), None: Fraction(2, 3)}
    d = spark.createDataFrame([(i, "t", "en", ["a", "b", "c", None][min(3, i % 7)], 1) for i in range(900)] + [(None, "t", "en", "a", 1)], DOCS)
    p = mixing.places(d, weights, block=3).collect()
    assert len(p) == 901
    counts = collections.Counter(r.source for r in p)
    plan = brute_slots(weights, 1 + max(r.slot for r in p))
    assert {(r.source, r.block, r.slot) for r in p} == {(s, j, t) for t, (s, j) in enumerate(plan) if 3 * j < counts[s]}
    assert len({(r.slot, r.place) for r in p}) == 901 and {r.place for r in p} == {0, 1, 2}


def test_sources_of_no_weight_come_last(spark):
    d = spark.createDataFrame([(i, "t", "en", "abc"[i % 3], 1) for i in range(90)], DOCS)
    p = mixing.places(d, {"a": 1, "b": 0}, block=4).collect()
    assert len(p) == 90
    last = max(r.slot for r in p if r.source == "a")
    rest = {r.slot: (r.source, r.block) for r in p if r.source != "a"}
    assert min(rest) == last + 1 and [rest[k] for k in sorted(rest)] == [(s, j) for s in "bc" for j in range(8)]


def test_mixing(spark):
    rows = [(i, "t", "en", "big" if i % 3 else "small", 1) for i in range(600)] + [(600 + i, None, None, None, None) for i in range(20)] + [(5, "t", "en", "big", 1)]
    d = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "slot")
    p = mixing.places(d, {"big": 1, "small": 1}, block=4).collect()
    assert len(p) == 620 and len({(r.slot, r.place) for r in p}) == 620
    blocks = collections.defaultdict(set)
    for r in p:
        blocks[r.slot].add((r.source, r.block))
    assert all(len(b) == 1 for b in blocks.values())
    order = [next(iter(blocks[s]))[0] for s in sorted(blocks)]
    for t in range(1, 80):  # both sources last that long
        n = collections.Counter(order[:t])
        assert abs(n["big"] - n["small"]) <= 2
    m = mixing.mix(d, block=4)
    assert m.columns == d.columns and sorted(map(str, m.collect())) == sorted(map(str, d.collect()))
    assert mixing.places(d.where("false")).count() == 0 and mixing.mix(d.where("false")).count() == 0


def test_packing_follows_the_mixed_order(spark, monkeypatch):
    words = "alpha beta gamma delta omega sigma".split()
    rows = [(i, " ".join(words[(i + k) % 6] for k in range(60 + i * 7 % 40)), "en", "ab"[i % 2], 1) for i in range(1600)]
    d = spark.createDataFrame([*rows, (None, "no id", None, None, None)], DOCS)
    texts = {r[0]: r[1] for r in rows} | {None: "no id"}
    for weights, share in (({"a": 1, "b": 1}, 0.5), ({"a": 3, "b": 1}, 0.75), ({"a": 1, "b": 3}, 0.25)):
        monkeypatch.setattr(corpus_pipeline, "WEIGHTS", weights)
        got = corpus_pipeline.packed(spark, corpus_pipeline.mixed(spark, d, ""), "").collect()
        check_packing(got, texts, 1024)
        order = [r.doc_id % 2 == 0 for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) if r.doc_id is not None]
        assert len(order) == 1600 and {r.sequence_id for r in got} == set(range(1 + max(r.sequence_id for r in got)))
        for n in (200, 400, 800):  # both sources last that long
            assert np.mean(order[:n]) == pytest.approx(share, abs=0.08)


def pipeline_rows():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        words = rng.choice("alpha beta gamma delta omega sigma lambda kappa theta zeta iota rho".split(), 30 + i % 50).tolist()
        if i % 6 == 0:
            words[3] = words[9] = "vileword"
        rows.append((i, " ".join(words), "en" if i % 2 else "xx", f"src{i % 3}", 1))
    return rows + [(300, "12 34 ..", "en", "src0", 1), (301, rows[1][1], "en", "src1", 1), (302, rows[1][1].upper(), "en", "src1", 1), (303, None, None, None, None)]


def test_pipeline_against_brute_force(spark, tmp_path):
    d = spark.createDataFrame(pipeline_rows(), DOCS)
    y = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    y.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "toxicity", "SimHash near-dedup", "mixing", "packing"]
    sets = []
    docs = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, str(tmp_path)), "x")
        assert docs.columns == d.columns, name
        sets.append(docs.collect())
    start = {r.doc_id for r in d.collect()}
    one, two, three, four = ({r.doc_id for r in s} for s in sets)
    assert start - one == {300, 303}
    assert one - two == {i for i in range(0, 240, 6)}
    texts = {r.doc_id: r.text for r in sets[1]}
    first = {}
    for i in sorted(texts):
        f = simhash.fingerprint(texts[i])
        if not any((f ^ g).bit_count() <= 3 for g in first.values()):
            first[i] = f
    assert three == set(first) and {301, 302}.isdisjoint(three) and four == three
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), {r.doc_id: r.text for r in sets[3]}, 1024)
    empty = d.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_long_runs_are_not_kept():
    enc = tokens.Encoder(limit=100, most_bytes=20_000)
    long = [f"run{i}" * 60 for i in range(50)]
    for text in (f"a {x} b" for x in long):
        assert np.frombuffer(enc.encode(text), "<u2").tolist() == ids_of(text)
    assert max(map(len, enc.later)) <= tokens.LONGEST and enc.later.held <= 20_000 + 2 * tokens.LONGEST
    for i in range(300):
        enc.encode(f"a word{i} b")
    assert len(enc.later) <= 102 and len(enc.later.old) <= 102


def test_shards_on_another_file_system(monkeypatch):
    memory = pafs._MockFileSystem()
    seen = []

    def from_uri(uri):
        seen.append(uri)
        return memory, uri.split("://")[1]

    monkeypatch.setattr(tokenids, "pafs", SimpleNamespace(FileSystem=SimpleNamespace(from_uri=from_uri)))
    memory.create_dir("bucket")
    fs, path = tokenids.file_system("s3a://bucket/shard-0.ids")
    texts = ["a b", "", "Hello, world."]
    assert tokenids.write_shard(fs, path, iter([([1, 2, 5], pa.array(texts))]), tokens.NAME, 0) == (3, sum(len(ids_of(t)) + 1 for t in texts))
    shard = tokenids.Shard("s3a://bucket/shard-0.ids")
    assert [shard.get(k).tolist() for k in (1, 2, 5)] == [[*ids_of(t), 0] for t in texts] and shard.get(3) is None
    assert seen == ["s3://bucket/shard-0.ids"] * 2


def test_shards_are_cut_by_bytes(spark):
    d = spark.createDataFrame([(i, "some words " * 50, "en", "s", 1) for i in range(60)], DOCS)
    shards = tokenids.write(d, common.scratch(spark, "ids"), shard_bytes=5_000)
    assert shards.count() >= 6 and shards.agg({"docs": "sum"}).first()[0] == 60


def test_documents_of_no_known_language_go(spark):
    words = {"aa": "kal mira tonu sela nomi", "bb": "grussen straxa wuhli qanto bref"}
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words["ab"[i % 2] * 2].split(), 30)), "ab"[i % 2] * 2, "s", 1) for i in range(200)]
    strange = [(900, "пример текста на другом языке " * 5, None, "s", 1), (901, "完全に別の言語の文章です" * 5, None, "s", 1), (902, "12 34", None, "s", 1)]
    d = spark.createDataFrame(rows + strange, DOCS)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, d, "").collect()}
    assert kept == set(range(200))
    assert {r.doc_id for r in langid.keep_known(d, None).collect()} == {*range(200), 900, 901}


def test_every_operator_has_a_query():
    got = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert got == list(range(1, 11)) and set(queries.ORACLE) <= set(queries.QUERIES)
    assert langid.MAX_DOCS and toxicity.MAX_EACH and tokenids.SHARD_ROWS
