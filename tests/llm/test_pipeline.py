"""The pipeline against its stages done plainly, and its contract."""

import zlib

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from outfold.llm import decontaminate, langid
from outfold.llm.queries import QUERIES, tokenizer_path
from outfold.plans.registry import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents").selectExpr("*", "'x' as _id", "1 as lang_pred")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema["doc_id"] == docs.schema["doc_id"]


def test_pipeline_matches_plain_stages(spark):
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [(d, t) for d, t in rows if t and langid.LETTER.search(t)]
    rows = [(d, t) for (d, t), (e, _, c) in zip(rows, brute.near(rows), strict=True) if d == c]
    items = [decontaminate.normal(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    rows = [(d, t) for d, t in rows if not any(i in decontaminate.normal(t) for i in items)]
    out = corpus_pipeline.run(spark, SF).collect()
    got = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert set(got) <= {d for d, _ in rows}
    # leaks with edits are found too, exact ones are all there are here
    assert set(got) == {d for d, _ in rows}
    from outfold.llm.pii import pseudonymise
    from outfold.llm.queries import DEMO_KEY
    from outfold.llm.tokens import load
    tok = load(tokenizer_path())
    text = {r["doc_id"]: r["text"] for r in pseudonymise(docs, DEMO_KEY).collect()}
    for d, n in got.items():
        assert n == len(tok.encode(text[d], add_special_tokens=False).ids) + 1


def test_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert [k for k, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_duplicates", "decontamination", "pseudonyms", "packing"]


def test_language_stage_without_labels(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the thing and that", None, "s", 18), (2, None, None, "s", 0), (3, "12 _ 3", None, "s", 6),
            (None, "\u65e5\u672c", None, None, 2), (1, "the thing and that", None, "s", 18), (4, "", None, "s", 0)]
    out = corpus_pipeline.language(spark, spark.createDataFrame(rows, schema), SF)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted((rows[i] for i in (0, 3, 4)), key=repr)
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 3 == 1)
    few = spark.createDataFrame([(held, "the thing", "en", "s", 9)], schema)
    assert corpus_pipeline.language(spark, few, SF).count() == 1


def test_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the thing and that", "en", "s", 4),
            (3, "the thing and that", "en", "s", 4), (None, "der die das und", "de", None, None)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[1:]:
        stage(spark, docs, SF).collect()
    stay = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0) for r in stay) == [0, 1, 2, 3, 3]
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert corpus_pipeline.pseudonyms(spark, docs, SF).where(F.col("text").isNull()).count() == 1
