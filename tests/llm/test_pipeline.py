import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_representatives import expected
from tidewell.llm import langid
from tidewell.llm.common import table

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    """Each stage against what its operator's own tests establish, on its own input."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen[name] = docs
        if name != "bpe":
            assert docs.columns == columns
    ids = {k: [r.doc_id for r in v.select("doc_id").collect()] for k, v in seen.items()}
    lettered = {r.doc_id for r in table(spark, SF, "documents").where(F.col("text").rlike(r"\p{L}")).collect()}
    assert set(ids["language id"]) == lettered
    texts = [" ".join(r.text.split()) for r in seen["exact dedup"].collect()]
    assert len(set(texts)) == len(texts) and len(set(ids["exact dedup"])) == len(texts)
    near = expected([(r.doc_id, r.text) for r in seen["exact dedup"].collect()])
    assert sorted(ids["near dedup"]) == [i for _, i in near]
    assert set(ids["mixing"]) <= set(ids["near dedup"]) and max(map(ids["mixing"].count, ids["mixing"])) == 2
    assert sorted(ids["bpe"]) == sorted(ids["mixing"])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(ids["bpe"])


def test_stages_keep_columns_and_edge_cases(spark, docs):
    """Nulls, repeats, empty and long texts, columns of any name, and empty tables, through every stage."""
    rows = docs = docs.cache()
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.collect() == []
        out = stage(spark, rows, SF)
        if name == "bpe":
            assert "ids" in out.columns and out.count() == rows.count()
            break
        assert out.columns == docs.columns == empty.columns
        out = out.cache()
        got = out.collect()
        assert got and all(r[c] == "clash" for r in got for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")), name
        whole = {(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()}
        assert {(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got} <= whole
        rows = out


def test_language_stage_sends_each_text_once(spark, docs, monkeypatch):
    """Python gets each column once, and gives rows back in parts."""
    sent, run, mapped = [], [], type(docs).mapInArrow
    monkeypatch.setattr(corpus_pipeline, "predict", lambda df, *a: sent.append(df) or langid.predict(df, *a))
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a: run.append(f) or mapped(self, f, *a))
    corpus_pipeline.language_stage(spark, docs, SF)
    assert [f.dataType for f in sent[0].schema] == [f.dataType for f in docs.schema]
    text = pa.RecordBatch.from_pydict({n: ["some words"] * 1000 for n in sent[0].columns})
    assert [b.num_rows for b in run[-1](iter([text]))] == [256, 256, 256, 232]


def test_batches_of_texts_are_bounded(spark, docs):
    """Python gets some megabytes at once, not 10,000 texts; a session's own bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    spark.conf.unset(name)
    try:
        corpus_pipeline.encoding_stage(spark, docs, SF)
        long = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("words "), 1000).alias("text"))
        got = [r.n for r in long.mapInArrow(sizes, "n long").collect()]
        assert sum(got) > 20e6 and max(got) < 5e6
        spark.conf.set(name, "1000")
        corpus_pipeline.encoding_stage(spark, docs, SF)
        assert spark.conf.get(name) in ("1000", "1000b")
    finally:
        spark.conf.unset(name)
