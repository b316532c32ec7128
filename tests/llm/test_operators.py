"""Each operator against brute force or an exact round trip, with awkward rows."""

import pathlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagefinder.llm import bpe, components, decontaminate, embed_dedup, jaccard_join, licenses, line_dedup, lm_score, packing, quality, sharding, token_store, verify
from pagefinder.llm.common import bucket5

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, h long"


def corpus(seed=3, n=60):
    """Random texts with copies, near copies, null, empty, blank-only and very long ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts = ["\n".join(line(rng.randint(1, 25)) for _ in range(rng.randint(1, 6))) for _ in range(n)]
    near = texts[0].split(" ")
    near[len(near) // 2] = "changed"
    texts += [texts[0], texts[0], " ".join(near), None, None, "", " \n\t\r\n ", "one", "one", "Ünïcode ß 中文字符 text", line(30000), texts[1].upper()]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(d, t, None if d % 7 == 0 else "en", f"s{d % 3}", None if t is None else len(t), 1.0, "x", 5) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_decontamination(spark, docs, rows, empty):
    texts = dict(rows)
    long = texts[1].replace("\n", " ").split(" ")
    items = [(1, " ".join(long[:14])), (2, "one"), (3, None), (4, ""), (5, "one"), (5, texts[2]), (None, "changed"), (7, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = decontaminate.brute_force([r for r in rows if r[1] is None or len(r[1]) < 9000], [("null" if i is None else i, t) for i, t in items])
    for block in (decontaminate.BLOCK_BYTES, 60):
        got = decontaminate.decontaminate(docs, bench, block_bytes=block)
        got = got.select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("s"))
        got = {r.doc_id: (r.n_words, r.n_hit, r.n, r.s, r.n_hit > 0) for r in got.collect()}
        assert len(got) == len(rows) and {d: got[d] for d in want} == want
    clean = decontaminate.without_hits(docs, bench)
    assert clean.columns == docs.columns and all(not want[r.doc_id][4] for r in clean.collect() if r.doc_id in want)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_jaccard(spark, docs, rows, empty):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(docs).collect()}
    assert got == jaccard_join.brute_force(rows)
    kept = jaccard_join.one_of_each_class(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, (c, _) in got.items() if c == d}
    assert jaccard_join.jaccard_classes(empty).count() == 0


def test_jaccard_tiles(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(40)] + [" ".join(base)] * 5
    some = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(some, tile=7).collect()}
    assert got == jaccard_join.brute_force(list(enumerate(texts)))


def test_token_store(spark, docs, rows, empty):
    got = token_store.read(token_store.write(docs, segment_ids=500)).collect()
    start, e = 0, bpe.encoder()
    for r in sorted(got, key=lambda r: r.doc_id):
        want = e.ids(dict(rows)[r.doc_id] or "").tobytes() + (1).to_bytes(4, "little")
        assert (bytes(r.ids), r.start, r.n_tokens, r.ids_crc32) == (want, start, len(want) // 4, zlib.crc32(want))
        start += r.n_tokens
    assert len(got) == len(rows) and token_store.read(token_store.write(empty)).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_addressable_codes(bits):
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = (rng.integers(0, 1 << 31, n) >> rng.integers(0, 31, n)).astype(np.uint32)
        s = token_store.Segment(token_store.encode(ids, bits))
        assert len(s) == n and (s.decode() == ids).all() and all(s[i] == ids[i] for i in range(0, n, 97))
        i, j = n // 3, n - n // 4
        assert (s.decode(i, j) == ids[i:j]).all()


def test_word_encoder():
    e, rng = bpe.encoder(), random.Random(4)
    letters = "abzAZ019'sտtßÀñŸſİı²½ªº!?.,-_<|>| ­\u0085\t\ŕéèЖ中ΣΑς한ก’“😀\x1f \n"
    for k in range(2000):
        x = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) + ("<|endoftext|>A" if k % 50 == 0 else "")
        assert e.encode([x])[0] == e.ids(x).tobytes(), repr(x)


def test_lm_score(spark, docs, rows, empty):
    want = lm_score.brute_force(rows)
    got = lm_score.score(docs, bucket5() != 1, chunk_tokens=900).collect()
    assert len(got) == len(rows)
    for r in got:
        held, n, known, total, base, s = want[r.doc_id]
        assert (r.learnt, r.n_tokens, r.n_known, r.train_tokens) == (not held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(s, rel=1e-9)
    assert lm_score.score(empty).count() == 0
    assert lm_score.score(docs, F.lit(False)).where("n_known > 0").count() == 0


def test_sharding(spark, docs, rows, empty, tmp_path):
    got = sharding.assign_shards(docs, shards=7).orderBy("rank").collect()
    n = len(rows)
    assert [r["rank"] for r in got] == list(range(n))
    assert [(r.curve, r.text_crc32, r.doc_id) for r in got] == sorted((r.curve, r.text_crc32, r.doc_id) for r in got)
    slots = {}
    for r in got:
        raw = (dict(rows)[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(s == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.assign_shards(empty).count() == 0
    sharding.write_shards(docs, str(tmp_path / "shards"), 7)
    assert spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().count() == 7


@pytest.mark.parametrize("n", [2, 3, 4])
def test_hilbert(n):
    digit, following = sharding.hilbert_table(n)
    bits, place = 3, {}
    for p in np.ndindex(*[1 << bits] * n):
        i = s = 0
        for b in range(bits - 1, -1, -1):
            at = (s << n) + sum((p[k] >> b & 1) << k for k in range(n))
            i, s = (i << n) + digit[at], following[at]
        place[i] = np.array(p)
    assert len(place) == 1 << n * bits and all(np.abs(place[i] - place[i + 1]).sum() == 1 for i in range(len(place) - 1))


def test_packing(spark, docs, rows, empty):
    got = packing.pack(docs, capacity=64).collect()
    texts, e, sequences = dict(rows), bpe.encoder(), {}
    for r in got:
        own = e.ids(texts[r.doc_id] or "").tobytes() + bytes(4)
        assert r.start == r.piece * 64 and r.ids_crc32 == zlib.crc32(own[4 * r.start : 4 * (r.start + r.length)])
        assert r.length == 64 or 4 * (r.start + r.length) == len(own)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {r.doc_id for r in got} == set(texts)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= -(-sum(r.length for r in got) // 64) * 1.1 + 1
    assert packing.pack(empty).count() == 0


def test_packing_plan():
    rng = random.Random(5)
    for _ in range(30):
        histogram = {rng.randint(1, 100): rng.choice([1, 2, 7, 5000]) for _ in range(rng.randint(1, 60))}
        used = {}
        for lengths, n in packing.plan(histogram, 100):
            assert sum(lengths) <= 100
            for x in lengths:
                used[x] = used.get(x, 0) + n
        assert used == histogram
    assert packing.plan({60: 3, 25: 3, 10: 3, 5: 3}, 100) == [((60, 25, 10, 5), 3)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}}


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((20, 16))
    x = np.concatenate([c + 0.12 * rng.standard_normal((k, 16)) for c, k in zip(centers, [1] * 10 + [5] * 9 + [80], strict=True)])
    rows = [(i, [float(v) for v in r], i) for i, r in enumerate(x)]
    rows += [(900, rows[0][1], 0), (901, None, 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, [None] * 16, 0), (905, [], 0), (906, [1.0, 2.0], 0)]
    got = {r.vec_id: r for r in embed_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long"), block=32).collect()}
    ids = [i for i, v, _ in rows if i < 901]
    m = np.array([v for i, v, _ in rows if i < 901])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    found = sum(got[i].n_links for i in ids)
    assert found >= 0.9 * (near.sum() - len(ids)) and all(got[i].n_links <= near[k].sum() - 1 for k, i in enumerate(ids))
    assert got[900].component_id == 0 and not got[900].kept and all(got[i].n_links == 0 and got[i].kept for i in range(901, 907))


def test_crowded_embeddings(spark):
    rng = np.random.default_rng(4)
    turned = lambda x, by: by * x + np.sqrt(1 - by**2) * rng.standard_normal(x.shape) / np.sqrt(x.shape[1])
    axis = np.zeros((1, 256))
    axis[0, 0] = 1
    hot = turned(np.repeat(axis, 1500, 0), 0.84**0.5)
    twins = turned(hot[:100], 0.925)
    x = np.concatenate([hot, twins, rng.standard_normal((1500, 256)) / 16])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    assert 150 <= (want > 0).sum() <= 250
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = {r.vec_id: r.n_links for r in embed_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=32).collect()}
    assert all(got[i] <= n for i, n in enumerate(want)) and sum(got.values()) >= 0.97 * want.sum()


def test_quality(spark, docs, empty):
    good = [(i, "plain words of a text " * 5, 1) for i in range(0, 40)]
    bad = [(i, "WORDS!! LOUD$$$ " * 5, 0) for i in range(40, 80)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = quality.train(d.select("doc_id", "text"), d.select("doc_id", "quality"), bucket5() != 0)
    held = d.join(quality.classify(d, model), "doc_id").where(bucket5() == 0).collect()
    assert held and all(r.predicted == r.quality and (r.score >= 0.3) == r.predicted for r in held)
    assert quality.classify(docs, model).count() == docs.count() and quality.classify(empty, model).count() == 0
    assert quality.keep_good(d, model).where("quality = 0").count() == 0 and quality.keep_good(docs, model).columns == docs.columns
    nothing = quality.train(d, d.where("false").select("doc_id", "quality"))
    assert quality.keep_good(d, nothing).count() == 80


def test_lines(spark, docs, rows, empty):
    want = line_dedup.brute_force(rows)
    got = {(r.doc_id, r.line_no) for r in line_dedup.line_classes(docs).where("kept").collect()}
    assert got == want
    after = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs).collect()}
    for d, t in rows:
        parts = None if t is None else t.split("\n")
        blank = lambda x: not x.replace("\r", " ").strip(" ")
        assert after[d] == (None if t is None else "\n".join(x for k, x in enumerate(parts) if blank(x) or (d, k) in want))
    assert line_dedup.line_classes(empty).count() == 0


def test_fuzzy_lines(spark):
    base = [f"word{i}x" for i in range(50)]
    texts = [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(30)] + [" ".join(base)] * 3 + [None, ""]
    rows = list(enumerate(texts)) + [(None, "all alone in here, nobody else")]
    got = {(r.doc_id, r.line_no) for r in line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").collect()}
    assert got == {(0, 0), (None, 0)}


def test_line_tails(spark):
    code = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=200))
    lines = ["December 2018", "December 2019", "Invoice no 10482", "Invoice no 17733", "Total: 1,234.56", "Total: 1,234.99"]
    lines += ["https://www.one.example/first", "https://www.other.example/second/page", code[:12] + code[20:100], code[:12] + code[100:]]
    lines += ["ភាសាខ្មែរជាភាសាផ្លូវការ", "ភាសាខ្មែរជាអក្សរបុរាណ", "x", "y"]
    docs = list(enumerate(lines))
    got = {(r.doc_id, r.line_no) for r in line_dedup.line_classes(spark.createDataFrame(docs, "doc_id long, text string")).where("kept").collect()}
    assert got == {(d, 0) for d, _ in docs}


def test_one_letter_edits(spark):
    rng = random.Random(5)
    docs = []
    for k, n in enumerate(range(30, 121, 2)):
        line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=n - 2))
        at = rng.randrange(n - 2)
        docs += [(2 * k, f"a{line}b"), (2 * k + 1, f"a{line[:at]}#{line[at + 1 :]}b")]
    gone = {d for d, _ in docs} - {d for d, _ in line_dedup.brute_force(docs)}
    assert gone >= {d for d, t in docs if d % 2 and len(t) > 50} and all(d % 2 for d in gone)
    found = {r.doc_id for r in line_dedup.line_classes(spark.createDataFrame(docs, "doc_id long, text string")).where("not kept").collect()}
    assert found <= gone and len(found) >= 0.95 * len(gone)


def test_licenses(spark, docs, empty):
    mit = dict(licenses.KNOWN)["MIT"]
    texts = [mit, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,"), mit.replace("sublicense", "sub-license") + "\n", mit + " Extra.", "", None, "Licensed under CC BY-NC 4.0"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.license_id for r in got] == ["MIT", "MIT", "MIT", None, None, None, "CC-BY-NC-4.0"]
    assert licenses.scan_licenses(docs).where("is_license").count() == 0 and licenses.scan_licenses(empty).count() == 0


def test_every_license(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "GFDL-1.3": "GFDL-1.3"}
    texts = [(i, "Copyright (c) 2021 A. Holder\n" + t.upper()) for i, t in licenses.KNOWN]
    texts += [(i, (folder / f).read_text()) for i, f in files.items() if (folder / f).exists()]
    rows = [(k, t) for k, (_, t) in enumerate(texts)] + [(100 + k, t + " more") for k, (_, t) in enumerate(texts)]
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == [i for i, _ in texts] and all(got[100 + k] is None for k in range(len(texts)))


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, _gone string, _d long, _id long, shard int, slot long, rid long, row string, h long, bands string, key string, cid long, label string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Repeated and null ids, equal rows, and columns named as operators might name their own."""
    line = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    texts = [(1, f"{line(1)}\n{line(2)}"), (5, f"{line(1)}\n{line(3)}"), (5, f"{line(4)}\n{line(5)}"), (6, f"{line(6)}\n{line(7)}"), (6, f"{line(6)}\n{line(7)}"), (None, line(8)), (None, line(8)), (None, line(9)), (3, f"{line(4)}\n{line(5)}"), (7, None), (7, "")]
    rows = [(d, t, "en", "s", None if t is None else len(t), "a", 1, 2, 3, 4, 5, "b", 6, "c", "d", 7, "e") for d, t in texts]
    return spark.createDataFrame(rows, AWKWARD).repartition(2).cache()


def test_rows_of_equal_id(spark, awkward, tmp_path):
    line = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    lines = line_dedup.line_classes(awkward).collect()
    assert len(lines) == 15 and sum(r.kept for r in lines) == 9  # of nine different lines one each
    after = line_dedup.without_repeated_lines(awkward)
    assert after.columns == awkward.columns and {r._gone for r in after.collect()} == {"a"}
    texts = [(r.doc_id, r.text) for r in after.collect()]
    left = [x for _, t in texts for x in (t or "").split("\n") if x]
    assert sorted(left) == sorted(map(line, range(1, 10))) and len(texts) == 11 and (7, None) in texts and (7, "") in texts
    kept = jaccard_join.one_of_each_class(awkward)
    want = [(1, f"{line(1)}\n{line(2)}"), (5, f"{line(1)}\n{line(3)}"), (3, f"{line(4)}\n{line(5)}"), (6, f"{line(6)}\n{line(7)}"), (None, line(8)), (None, line(9)), (7, None), (7, "")]
    assert kept.columns == awkward.columns and sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in kept.collect())
    classes = jaccard_join.jaccard_classes(awkward).collect()
    assert len(classes) == 11 and sum(r.kept for r in classes) == 8 and sorted(r.n_links for r in classes) == [0] * 5 + [1] * 6
    name = sharding.write_shards(awkward, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert name == "shard_" and set(back.columns) == {*awkward.columns, "shard_"}
    assert sorted(map(str, back.select(awkward.columns).collect())) == sorted(map(str, awkward.collect()))
    counts = [r["count"] for r in sharding.assign_shards(awkward, 4).groupBy("shard").count().collect()]
    assert sum(counts) == 11 and max(counts) - min(counts) <= 1


def test_awkward_rows_elsewhere(spark, awkward):
    n = awkward.count()
    bench = spark.createDataFrame([(1, "w4x0 w4x1"), (1, "w4x0 w4x1")], "item_id long, text string")
    hit = decontaminate.decontaminate(awkward, bench)
    assert hit.count() == n and hit.where("n_hit = 2").count() == 2 and decontaminate.without_hits(awkward, bench).columns == awkward.columns
    store = token_store.write(awkward, segment_ids=40)
    ids = [t for r in token_store.read(store).orderBy("start").collect() for t in np.frombuffer(bytes(r.ids), "<u4").tolist()]
    assert [token_store.token(store, k) for k in (0, 1, len(ids) // 2, len(ids) - 1)] == [ids[k] for k in (0, 1, len(ids) // 2, len(ids) - 1)]
    for k in (-1, len(ids)):
        with pytest.raises(IndexError):
            token_store.token(store, k)
    assert token_store.read(store).count() == n and packing.pack(awkward).count() == n
    scored = lm_score.score(awkward).collect()
    assert len(scored) == n and len({r.score for r in scored if r.doc_id == 6}) == 1 and {r.n_tokens for r in scored if r.doc_id == 7} == {1}
    model = quality.train(awkward, spark.createDataFrame([(5, 1), (5, 1), (6, 0), (None, 1)], "doc_id long, quality int"))
    assert quality.classify(awkward, model).count() == n and quality.keep_good(awkward, model).columns == awkward.columns
    assert licenses.scan_licenses(awkward).count() == n


def test_wide_benchmark_item(spark):
    """An item with more words than a block is meant to hold, and one block for each item."""
    item = " ".join(f"w{i}" for i in range(3000))
    docs = [(1, "x " + " ".join(f"w{i}" for i in range(2000, 2012)) + " y"), (2, "nothing here")]
    some = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "nothing at all")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(some, bench, block_bytes=9000).collect()}
    assert got == {1: (14, 12, ["1"]), 2: (2, 0, [])}


@pytest.mark.parametrize("order", [1, 2, 4])
def test_lm_orders(spark, order):
    rows = corpus(n=12)[:20]
    want = lm_score.brute_force(rows, order, 2.0)
    for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), bucket5() != 1, order, 2.0, 300).collect():
        assert r.score == pytest.approx(want[r.doc_id][5], rel=1e-9)


def test_chain_of_unlike_texts(spark):
    """Candidates that are no links don't chain: each text shares words with the next, at a similarity below the threshold."""
    words_ = [f"v{i}" for i in range(2000)]
    chain = [" ".join(words_[20 * k : 20 * k + 60]) for k in range(80)]
    rows = list(enumerate(chain + [chain[3] + " end"]))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_join.brute_force(rows) and got[80] == (3, 1) and got[4] == (4, 0)


def test_large_bands(spark, monkeypatch):
    """Bands settled in tiles give what pairs give."""
    rng = random.Random(8)
    base = "".join(rng.choices("abcdefghij ", k=150))
    rows = []
    for k in range(120):
        t = list(base)
        for at in rng.sample(range(150), rng.randint(1, 8)):
            t[at] = "z"
        rows.append((k, "".join(t)))
    some = spark.createDataFrame(rows, "doc_id long, text string")
    want = line_dedup.brute_force(rows)
    by_pairs = {(r.doc_id, r.line_no) for r in line_dedup.line_classes(some).where("kept").collect()}
    monkeypatch.setattr(line_dedup, "PAIRWISE", 2)
    monkeypatch.setattr(line_dedup, "LEFT_CHARS", 900)
    monkeypatch.setattr(line_dedup, "RIGHT_CHARS", 2000)
    in_tiles = {(r.doc_id, r.line_no) for r in line_dedup.line_classes(some).where("kept").collect()}
    assert in_tiles == by_pairs >= want and len(by_pairs) <= len(want) + 3  # a pair just at the threshold may share no band


def test_outlines_lose_no_pair(spark):
    """Pairs of torn bands are told apart by bitmaps: unlike ones go before texts are compared, none above the threshold does."""
    rng = random.Random(9)
    base = "".join(rng.choices("abcdefghij ", k=300))
    texts = []
    for k in range(40):
        t = list(base)
        for at in rng.sample(range(300), 3 * (k // 2)):
            t[at] = "z"
        texts.append((k, "".join(t)))
    edge = "\n" * (line_dedup.SHINGLE - 1)
    sets = {k: {(edge + t + edge)[i : i + line_dedup.SHINGLE] for i in range(len(t) + len(edge))} for k, t in texts}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    pairs = spark.createDataFrame(list(like), "a long, b long")
    outlines = line_dedup._outlines(spark.createDataFrame(texts, "cid long, line string"))
    left = {(r.a, r.b) for r in line_dedup._perhaps(pairs, outlines, 0.8).collect()}
    assert {p for p, j in like.items() if j >= 0.8} <= left and not {p for p, j in like.items() if j < 0.5} & left


def test_common_words_make_no_bands(spark):
    """Lines of few words, all common, share no band unless six words in a row meet: what is compared doesn't grow with the square."""
    rng = random.Random(4)
    some = ["the", "of", "and", "in", "to", "that", "was", "ing", "er", "on"] * 4 + [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(some, k=40))) for k in range(2000)]
    bands = line_dedup.with_bands(spark.createDataFrame(rows, "cid long, line string"), "line").select("cid", F.explode("bands").alias("key")).distinct()
    most = bands.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")).first()
    assert most.most <= 20 and most.pairs <= 2 * len(rows)


def test_large_bands_meet_more_hubs(spark, monkeypatch):
    """A band of many classes whose first hub is like none of them is united by further hubs, with the result of all pairs."""
    monkeypatch.setattr(line_dedup, "MANY", 3)
    rng = random.Random(12)
    words = [f"word{k}" for k in range(400)]
    shared = " ".join(rng.choices(words, k=7))
    rows = []
    for g in range(3):
        base = rng.choices(words, k=60)
        rows += [(100 * g + k, " ".join([shared, *base[:k], f"x{k}", *base[k + 1 :]])) for k in range(15)]
    rows += [(900 + k, " ".join([shared, *rng.choices(words, k=60)])) for k in range(6)]
    got = {(r.doc_id, r.line_no) for r in line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").collect()}
    assert got == line_dedup.brute_force(rows) and len(got) == 9


def test_extreme_vectors(spark):
    rows = [(1, [1e-200, 0.0]), (2, [2e-200, 0.0]), (3, [1e300, 1e300]), (4, [1e308, 1e308]), (5, [-0.0, 1.0]), (6, [0.0, 1.0]), (6, [0.0, 1.0]), (None, [0.0, -1.0])]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embed_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [("1", 1, "1"), ("2", 1, "1"), ("3", 1, "3"), ("4", 1, "3"), ("5", 2, "5"), ("6", 2, "5"), ("6", 2, "5"), ("None", 0, "None")]
    assert embed_dedup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_planted_vectors(spark):
    """Recall at the default block: pairs just above the threshold among many random vectors."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((6000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal((1000, 48))
    noise -= (noise * x[:1000]).sum(1, keepdims=True) * x[:1000]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    twins = 0.905 * x[:1000] + np.sqrt(1 - 0.905**2) * noise
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(np.concatenate([x, twins]))]
    got = {r.vec_id: r.component_id for r in embed_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[6000 + i] == got[i] for i in range(1000)) >= 980


def test_quality_gradient():
    """Weights solve the pairwise logistic loss: its gradient vanishes there."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, quality.N_FEATURES))
    good = (x[:, 0] + 0.5 * x[:, 1] + rng.standard_normal(300) > 0).astype(int)
    m = quality.PairwiseRanker().fit(x, good, pairs=4000)
    z = np.clip((x - m.mean) / m.scale, -8, 8)
    r = np.random.default_rng(m.seed)
    above, below = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    d = z[r.choice(above, 4000)] - z[r.choice(below, 4000)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + m.ridge / 2 * w @ w
    assert all(loss(m.weights) <= loss(m.weights + 0.01 * e) for e in (*np.eye(len(m.weights)), *-np.eye(len(m.weights))))
    assert m.threshold == pytest.approx(np.quantile(m.raw(x), (good == 0).mean(), method="midpoint"))


@pytest.mark.skipif(not pathlib.Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = quality.query(spark, sf).where("held_out").join(labels, "doc_id").where("quality is not null").toPandas()
    good, bad = rows.score[rows.quality == 1].to_numpy(), rows.score[rows.quality == 0].to_numpy()
    auc = (good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2
    assert len(good) and len(bad) and auc >= 0.95 and (rows.predicted == rows.quality).mean() >= 0.9


def kept_by_tiles(rows):
    """What ``line_dedup.brute_force`` gives, all pairs of lines compared by matrix products."""
    place = {}
    for d, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if x := x.replace("\r", " ").strip(" ").lower():
                place.setdefault(x, []).append((d, k))
    names, number = sorted(place, key=len), {}
    edge = "\n" * (line_dedup.SHINGLE - 1)
    grams = lambda p: {p[i : i + line_dedup.SHINGLE] for i in range(len(p) - line_dedup.SHINGLE + 1)}
    sets = [np.array([number.setdefault(g, len(number)) for g in grams(edge + x + edge)]) for x in names]
    size, root, step = np.array([len(s) for s in sets], float), list(range(len(sets))), 700

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(0, len(sets), step):
        for j in range(i, len(sets), step):
            a, b = np.arange(i, min(i + step, len(sets))), np.arange(j, min(j + step, len(sets)))
            if min(size[b]) * 0.8 > max(size[a]):
                continue
            shared = verify.overlaps([sets[k] for k in (*a, *b)], np.arange(len(a)), len(a) + np.arange(len(b))).astype(float)
            for x, y in zip(*np.nonzero(shared >= 0.8 * (size[a][:, None] + size[b][None] - shared)), strict=True):
                root[max(find(a[x]), find(b[y]))] = min(find(a[x]), find(b[y]))
    groups = {}
    for k, x in enumerate(names):
        groups.setdefault(find(k), []).extend(place[x])
    return {min(g) for g in groups.values()}


@pytest.mark.skipif(not pathlib.Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_recall_on_documents(spark):
    """Against all pairs of the table's own lines and texts: recall, and no false merge."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    lines = {(r.doc_id, r.line_no) for r in line_dedup.line_classes(docs).where("not kept").collect()}
    every = {(d, k) for d, t in rows for k, x in enumerate((t or "").split("\n")) if x.replace("\r", " ").strip(" ")}
    gone = every - kept_by_tiles(rows)
    assert not lines - gone and len(lines) >= 0.97 * len(gone)
    near = jaccard_join.brute_force(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(docs).collect()}
    found, real = sum(n for _, n in got.values()), sum(n for _, n in near.values())
    assert all(got[d][1] <= near[d][1] for d in near) and found >= 0.97 * real


def test_shared_folder_is_asked_for():
    from pagefinder.llm.common import shared_dir

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    full = [(d, t, "en", "s", None if t is None else len(t)) for d, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    leak = dict(rows)[1].split("\n")[0]
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = line_dedup.brute_force(rows)
    texts = [(d, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not x.replace("\r", " ").strip(" ") or (d, k) in kept)) for d, t in rows]
    texts = [(d, t) for d, t in texts if jaccard_join.brute_force(texts)[d][0] == d]
    leaks = decontaminate.brute_force([x for x in texts if not x[1] or len(x[1]) < 9000], [(0, leak)])
    assert got == {d for d, _ in texts if not leaks.get(d, (0,) * 5)[4]}
