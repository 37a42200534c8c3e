"""The stages of corpus_pipeline.py against brute force: null, repeated, negative and very large doc_ids."""

from __future__ import annotations

import corpus_pipeline
import pyarrow as pa
import pytest
from cases import words

from variorum.llm import byte_bpe, common, decontamination, jaccard_join

BIG = (1 << 62) + 5
TOP = (1 << 63) - 1
ITEM = words(40, 90)


def rows():
    a, b, c, d = (words(120, 20 + k) for k in range(4))
    near = lambda w: [*w[:60], "changed", *w[61:]]
    leak = lambda k: words(50, k) + ITEM + words(50, k + 1)
    texts = [
        (None, words(90, 40)), (None, words(90, 41)), (BIG, words(90, 42)), (TOP, words(90, 43)), (-BIG, words(90, 44)),
        (BIG + 1, a), (BIG + 2, near(a)), (None, near(a)), (None, b), (None, near(b)), (None, b),
        (TOP - 1, c), (None, c), (7, near(c)), (8, d), (8, d), (None, leak(50)), (BIG + 3, leak(60)), (9, leak(70)),
    ]
    return [(i, " ".join(w)) for i, w in texts] + [(None, ""), (None, ""), (None, None), (10, ""), (10, "")]


def shingles(text):
    w = tuple((text or "").split())
    return {w[i : i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else ({w} if w else set())


def groups(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))
    for x, s in enumerate(sets):
        for y, t in enumerate(sets[:x]):
            same_document = docs[x][0] is not None and docs[x][0] == docs[y][0]
            if same_document or s and t and 100 * len(s & t) >= 80 * len(s | t):
                root = [root[y] if r == root[x] else r for r in root]
    return [[docs[k] for k in range(len(docs)) if root[k] == r] for r in sorted(set(root))]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_components_of_any_doc_id(corpus):
    want = []
    for g in groups(rows()):
        ids = [i for i, _ in g if i is not None]
        want += [(i, min(ids, default=None)) for i, _ in g]
    got = [(r.doc_id, r.component_id) for r in jaccard_join.join(corpus).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_near_duplicates(spark, sf_dir, corpus):
    kept = pairs(corpus_pipeline.near_duplicates(spark, corpus, sf_dir))
    found = groups(rows())
    assert len(kept) == len(found)
    for g in found:
        ids = [i for i, _ in g if i is not None]
        assert any(row in kept for row in g if row[0] == min(ids, default=None)), g
    assert corpus_pipeline.near_duplicates(spark, corpus.limit(0), sf_dir).count() == 0


def test_leaks(spark, tmp_path, corpus):
    """What goes is what the search finds when each text has a plain number; how much it finds is the operator's own test."""
    items = [(k, " ".join(words(90, 40 + k)[20:60])) for k in range(3)]  # of two documents without a doc_id and one with a very large one
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    numbered = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows())], "doc_id long, text string")
    found = {r.doc_id for r in decontamination.find_leaks(numbered, common.table(spark, str(tmp_path), "benchmark")).collect()}
    assert {rows()[k][0] for k in found} == {None, BIG}
    kept = pairs(corpus_pipeline.leaks(spark, corpus, str(tmp_path)))
    assert kept == sorted((r for k, r in enumerate(rows()) if k not in found), key=str)


def test_leaks_of_items_without_id(spark, tmp_path, corpus):
    """An item without an item_id and one of two words are leaks as any other."""
    text = words(90, 41)
    spark.createDataFrame([(None, " ".join(text[20:60])), (2, "qqqq wwww")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, " ".join(text)), (2, "a qqqq wwww b"), (3, "another text of few words")], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.leaks(spark, docs, str(tmp_path)).collect()] == [3]


def test_all_stages(spark, tmp_path, corpus):
    """Without labels every document scores 0.5 and stays; windows of 35 words are the leaking item's only, so those texts lose it before the leaks are looked for."""
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = common.table(spark, str(tmp_path), "documents")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, str(tmp_path)), "stage")
        counts.append(docs.count())
    assert counts == [len(rows()), *[len(groups(rows()))] * 3]
    ids = sorted((r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    assert ids == sorted((min((i for i, _ in g if i is not None), default=None) for g in groups(rows())), key=str)


def test_small_batches(spark, tmp_path):
    """Every stage leaves a session whose tasks get texts in batches of a few MB: 10,000 long texts at once are 30 MB in each worker, and twice that in its executor."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, " ".join(words(50, 1)), "en", "web", 300)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    wide = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 3000) text")
    sizes = wide.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(name)
        stage(spark, docs, str(tmp_path))
        assert sizes.agg({"n": "max"}).first()[0] < common.BATCH + 10_000
    spark.conf.set(name, "1m")
    common.bounded(docs)
    assert spark.conf.get(name) == "1m"
    spark.conf.unset(name)


def test_tokens_by_any_blocks(spark, corpus):
    ids = [sorted(map(str, byte_bpe.encode(corpus, *byte_bpe.vocabulary(), block=n).select("doc_id", "text", "ids").collect())) for n in (byte_bpe.BLOCK, 1 << 20, 1000)]
    assert ids[0] == ids[1] == ids[2]
