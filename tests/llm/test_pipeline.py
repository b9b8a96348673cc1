import corpus_pipeline
from graphloom.llm.common import stash
from tests.llm.test_llm import classes, words


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stash(stage(spark, kept, tables), name)
        after = {r.doc_id: r.text for r in kept.collect()}
        assert kept.columns == columns and set(after) <= set(before)
        if name == "language_id":
            assert len(after) > 0.97 * len(before)
        if name == "near_copies":
            s = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} for i, w in ((i, words(t)) for i, t in before.items()) if w}
            ids = sorted(s)
            root = classes(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])])
            assert set(after) == {i for i, r in root.items() if i == r}
        if name == "secret_scan":
            assert set(after) == set(before) and all("[SECRET]" in t for i, t in after.items() if t != before[i])
    pieces = corpus_pipeline.run(spark, tables).collect()
    assert {p.doc_id for p in pieces} == set(after) and max(p.offset + p.length for p in pieces) <= 1024


def test_empty(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        assert out.count() == 0


def test_odd_rows(spark, tables):
    """Nulls in every column, empty and very long texts, repeats, ids that repeat, and columns of clashing names."""
    from pyspark.sql import functions as F

    from tests.llm.test_llm import DOCS, corpus

    rows = [(i, t, None if k % 5 == 0 else "en", "s", 0, *[None] * 10) for k, (i, t) in enumerate(corpus())]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"gone": F.lit(1), "key": F.lit("k"), "pid": F.lit(2), "m": F.create_map(F.lit("a"), F.lit(1)), "length": F.lit(None).cast("long")})
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stash(stage(spark, kept, tables), name)
        assert kept.columns == columns and 0 < kept.count() <= before
        if name == "language_id":
            assert kept.where("text IS NULL OR trim(text) = ''").count() == 0
        if name == "near_copies":
            assert kept.groupBy("doc_id", "text").count().where("count > 1").count() == 0 and kept.where("gone <> 1 OR key <> 'k' OR m['a'] <> 1").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, tables)
    assert pieces.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count() and pieces.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024
