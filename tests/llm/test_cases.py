"""Odd inputs of every operator and every stage of the pipeline: nulls, empty texts, repeated rows and ids, clashing names, empty tables, long texts."""

import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import _words, bloom_lm, decontamination, embedding_dedup, minhash_dedup, mixing, quality, sharding, substring_dedup, token_counts, toxicity

#: Names that operators use for their own columns.
CLASHING = "score string, held_out string, size string, taken string, target string, kept string, rid string, key string, cls string, label string, shard string, n_words string, contaminated string, found string, id string, text_crc32 string, _times string"
LONG = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated ids with the same and other texts, null ids, null and empty texts, null sources."""
    texts = [(1, LONG, "a"), (1, LONG, "a"), (1, "other " + LONG, "a"), (None, LONG, "b"), (None, "null id " * 9, None), (2, None, "a"), (2, "", None), (3, " \t\n", "b"), (4, "x", "b"), (5, "é ÉÉ 日本 🙂", None), (6, "w " * 3000, "a")]
    n = len(CLASHING.split(","))
    df = spark.createDataFrame([(*t, *["?"] * n) for t in texts], f"doc_id long, text string, source string, {CLASHING}")
    return df.repartition(3).cache()


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_near_duplicates(odd):
    got = rows(minhash_dedup.near_duplicates(odd), "doc_id", "n_shingles", "component_id", "kept")
    # a null id isn't the least of its group
    assert got.count((1, 8, 1, True)) == 2 and (1, 9, 1, True) in got and (None, 8, 1, False) in got and (None, 2, None, True) in got and len(got) == 11
    assert got.count((2, 0, 2, True)) == 2 and (3, 0, 3, True) in got
    assert minhash_dedup.drop_near_duplicates(odd).columns == odd.columns and minhash_dedup.drop_near_duplicates(odd).count() == 8


def test_shards_and_mixes(odd):
    got = sharding.stratified_shards(odd, shards=4).collect()
    assert len(got) == 11 and sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(4) for k in range(11 * (s + 1) // 4 - 11 * s // 4)] or [len([r for r in got if r.shard == s]) for s in range(4)] == [3, 3, 3, 2]
    raw = {(r.doc_id, zlib.crc32((r.text or "").encode())) for r in odd.collect()}
    assert {(r.doc_id, r.text_crc32) for r in got} == raw
    mixed = mixing.mix_sources(odd, carry=("text",)).collect()
    assert len(mixed) == 11 and all(0 <= r.taken <= 2 * r.size for r in mixed) and all(r.taken == 0 for r in mixed if not (r.text or "").split())


def test_language_model(odd):
    got = bloom_lm.lm_scores(odd).collect()
    assert len(got) == 11 and all(r.n_tokens >= 1 and r.score < 0 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    one = [r for r in got if r.doc_id == 1 and r.n_tokens == 13]
    assert len(one) == 2 and one[0].score == one[1].score


def test_classifiers(odd, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None), (4, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for run in (quality.quality_scores, toxicity.toxicity_scores):
        got = run(odd, labels).collect()
        assert len(got) == 11 and all(0 <= r.score <= 1 for r in got) and all(r.predicted in (0, 1) for r in got)
        same = {}
        for r in got:
            same.setdefault((r.doc_id, r.score), []).append(r)
        again = run(odd, labels).collect()
        assert sorted((str(r.doc_id), r.score) for r in got) == sorted((str(r.doc_id), r.score) for r in again)
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns


def test_long_texts_are_scored_whole(spark):
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    base = [(i, ("good plain words here and there " * 5 if i % 2 else "bad!! GRUBNOT grubnot grubnot zilchface ") * 4) for i in range(40)]
    docs = spark.createDataFrame([*base, (1000, "plain words " * 900_000 + " grubnot zilchface grubnot"), (1001, "plain words " * 900_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(got) == 42 and got[1000].score != got[1001].score  # its last words count
    assert len(quality.quality_scores(docs, labels).collect()) == 42


def test_token_counts(odd):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    got = token_counts.token_counts(odd, public_tokenizers.path("byte_bpe_50k.json"))
    assert got.count() == 11 and rows(got.filter("doc_id = 2"), "n_bytes", "n_tokens", "over_limit") == [(0, 0, False), (0, 0, False)] and got.filter("over_limit").count() == 1


def test_substrings(odd):
    got = rows(substring_dedup.substring_dedup(odd, window=12), "doc_id", "n_words", "n_removed")
    assert (1, 12, 12) in got and (1, 13, 12) in got and (None, 12, 12) in got and (2, 0, 0) in got and (6, 3000, 3000) in got and len(got) == 11


def test_leaks(odd, spark):
    items = spark.createDataFrame([(None, LONG), (None, None), (7, "X"), (8, ""), (7, "日本")], "item_id long, text string")
    got = decontamination.decontaminate(odd, items)
    assert got.columns == ["doc_id", "n_words", "n_hit", "items", "spans", "n_items", "items_sha256", "contaminated"] and got.count() == 11
    hit = rows(got.filter("contaminated"), "doc_id", "n_hit", "n_items")
    assert hit == sorted([(1, 12, 1), (1, 12, 1), (1, 12, 1), (None, 12, 1), (4, 1, 1), (5, 1, 1)], key=str)
    assert got.filter("n_items = 1 AND n_hit = 12").first().items_sha256 == hashlib.sha256(b"").hexdigest()  # a null id is the empty one


def test_embeddings(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(1, v, 1, "?"), (1, v, 1, "?"), (1, [-1.0, 0.0, 5.0], 1, "?"), (9, [2.0, 4.0, 6.0], 1, "?"), (3, v, 2, "?"), (4, None, 1, "?")], "vec_id long, embedding array<float>, label int, cls string")
    got = rows(embedding_dedup.embedding_duplicates(df), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (1, 0, 1, True), (9, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)], key=str)


def test_rows_of_many_megabytes():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in rng.integers(0, 50_000, 1_600_000)]
    text = " ".join(words)
    assert len(text) > 8 * _words.CHUNK
    column = pa.array(["a b", text, None, "c"])
    data, offs = _words.buffers(column)
    got, counts = _words.hashes(data, offs)
    assert counts.tolist() == [2, len(words), 0, 1]
    short, _ = _words.hashes(*_words.buffers(pa.array([" ".join(words[:1000]), " ".join(words[-1000:])])))
    assert (got[2:1002] == short[:1000]).all() and (got[2 + len(words) - 1000 : 2 + len(words)] == short[1000:]).all()
    one = np.frombuffer(b"x" * (9 * _words.CHUNK), np.uint8)
    assert len(_words.hashes(one, np.array([0, len(one)]))[0]) == 1


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(spark, kind):
    from tessera.llm._components import components
    from tessera.llm._scratch import Scratch

    rng = np.random.default_rng(3)
    pairs = {"random": rng.integers(0, 120, (90, 2)).tolist(), "chain": [(i, i + 1) for i in range(40)], "star": [(0, i) for i in range(1, 9)] + [(20, 21)], "none": [(3, 3)]}[kind]
    label = list(range(200))
    for _ in range(200):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components(Scratch(spark), spark.createDataFrame(pairs, "a long, b long"), "x").collect()}
    assert got == {n: label[n] for p in pairs if p[0] != p[1] for n in p}


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("stage", range(5))
def test_stages_of_the_pipeline(odd, spark, stage):
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, odd, FOLDER)
    none = run(spark, odd.limit(0), FOLDER)
    assert none.count() == 0
    if name == "sharding":
        assert out.count() == 11 and none.columns == out.columns
        return
    assert out.columns == odd.columns and none.columns == odd.columns
    want = {"toxicity": 11, "near_dedup": 8, "decontamination": 11}
    if name in want:
        assert out.count() == want[name]
    else:
        kept = out.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()
        assert all((r.text or "").split() for r in kept) and out.filter("text is null").count() == 0
