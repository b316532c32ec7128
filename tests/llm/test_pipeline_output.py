"""The pipeline's decisions with two classes of labels, and what it packs."""

import random
import zlib

from pyspark.sql import functions as F

from pagefinder.llm import bpe, decontaminate, jaccard_join, line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect_and_output_is_packed(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    plain = lambda: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 25))) for _ in range(rng.randint(1, 5)))
    good = {k: plain() for k in range(30)}
    good[30], good[31] = good[0], good[1] + " changed"
    good[32] = " ".join(rng.choice(vocabulary) for _ in range(6000))
    junk = {k: f"BUY!!! $$$ NOW {k} >>> http://x{k} !!!\n" * rng.randint(2, 8) for k in range(100, 130)}
    rows = [(d, t, "en", "s", len(t)) for d, t in {**good, **junk}.items()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 100), 0) for d, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    leak = " ".join(good[5].split()[:12])
    spark.createDataFrame([(7, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.good_documents(spark, docs, str(tmp_path)).collect()}
    assert kept.isdisjoint(junk) and len(kept) >= 0.9 * len(good)  # the first stage decides
    rows = [(d, t) for d, t in good.items() if d in kept]
    lines = line_dedup.brute_force(rows)
    rows = [(d, "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip() or (d, k) in lines)) for d, t in rows]
    rows = [(d, t) for d, t in rows if jaccard_join.brute_force(rows)[d][0] == d]
    leaks = decontaminate.brute_force(rows, [(7, leak)])
    want = {d: t for d, t in rows if not leaks[d][4]}
    assert 5 not in want and 30 not in {d for d, t in want.items() if t}

    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy(F.col("sequence_id"), "offset").collect()
    assert {r.doc_id for r in got} == set(want)
    e, place, total = bpe.encoder(), {}, 0
    for r in got:
        own = e.ids(want[r.doc_id]).tobytes() + bytes(4)
        assert r.start == 2048 * r.piece and r.ids_crc32 == zlib.crc32(own[4 * r.start : 4 * (r.start + r.length)])
        assert r.length == 2048 or 4 * (r.start + r.length) == len(own)
        assert r.offset == place.get(r.sequence_id, 0)
        place[r.sequence_id] = r.offset + r.length
        total += r.length
    assert max(place.values()) <= 2048 and len(place) == -(-total // 2048) and sum(r.doc_id == 32 for r in got) > 1
