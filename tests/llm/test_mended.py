"""Repeated query rows, one-to-one pseudonyms and clashing ids in the pipeline."""

import datetime
import random

import corpus_pipeline
from pyspark.sql import functions as F

from outfold.llm import multi_index, pii


def test_repeated_query_rows_are_answered_each(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(100)]
    rows.append(rows[20])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = multi_index.search(df, F.col("vec_id") % 20 == 0, top=20, share=1.0).where("query_id = 20").collect()
    best = sorted(((-sum(a * b for a, b in zip(v, rows[20][1])), i) for i, v in rows if i != 20))[:20]
    assert sorted((r["rank"], r["vec_id"]) for r in out) == sorted(
        [(k, i) for k, (_, i) in enumerate(best, 1)] * 2)


def moved(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "text string").repartition(8)
    out = df.select("text", F.col("text").alias("was"))
    return {r["was"]: r["text"] for r in pii.pseudonymise(out, "k").collect()}


def test_slash_dates_stay_distinct(spark):
    days = [datetime.date(1800, 1, 1) + datetime.timedelta(d) for d in range(0, 146097, 7)]
    values = {d.strftime("%m/%d/") + f"{d.year:04d}" for d in days}
    values |= {d.strftime("%d/%m/") + f"{d.year:04d}" for d in days if d.day > 12}
    new = moved(spark, sorted(values))
    assert len(set(new.values())) == len(values)
    assert all((int(a[:2]) > 12) == (int(b[:2]) > 12) for a, b in new.items())
    assert sum(a == b for a, b in new.items()) < 10


def test_padded_addresses_stay_distinct(spark):
    rng = random.Random(2)
    octets = [[rng.randrange(256) for _ in range(4)] for _ in range(3000)]
    values = {".".join(map(str, o)) for o in octets}
    padded = {".".join(f"{x:03d}" for x in o) for o in octets}
    new = moved(spark, sorted(values | padded | {"01.1.1.1"}))
    assert len(set(new.values())) == len(values | padded) + 1
    assert new["01.1.1.1"] == "01.1.1.1"  # other paddings stay
    for a, b in new.items():
        if a in padded - values:
            assert len(b) == 15 and ".0" in "." + b and max(map(int, b.split("."))) < 256


def test_long_hexadecimal_tokens_move(spark):
    rng = random.Random(3)
    values = ["".join(rng.choices("0123456789abcdef", k=n)) for n in (32, 64, 65, 128, 600)]
    new = moved(spark, [f"key {v} end" for v in values])
    for v in values:
        out = new[f"key {v} end"]
        assert v not in out and len(out) == len(v) + 8


def test_near_duplicates_with_clashing_ids(spark):
    a, b, c = (" ".join(f"{t}{i}" for i in range(40)) for t in "abc")
    rows = [(1, a), (3, b), (3, a), (None, a), (5, c), (5, b.upper()), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_gone", F.lit(1))
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(
        [(1, a), (3, b), (None, a), (5, c), (7, None), (7, "")], key=repr)


def test_other_tokenizers_count_whole_texts(spark):
    """The shortcut is for one form of tokenizer; others must give their own counts."""
    import os

    from outfold.llm import token_counts
    from outfold.llm.queries import tokenizer_path
    from outfold.llm.tokens import Words, load, splits, whole_tokens
    rows = ["Hello  World, it's 2024!", "a\n\nb  c", "\u00dcber <|endoftext|> x", "", "12345 \u65e5\u672c"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    folder = os.path.dirname(tokenizer_path())
    assert splits(load(tokenizer_path()))
    assert not splits(load(f"{folder}/byte_bpe_50k.json"))
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = f"{folder}/{name}"
        tok = load(path)
        want = [tok.encode(t, add_special_tokens=False).ids for t in rows]
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, path).collect()}
        assert got == {i: len(w) for i, w in enumerate(want)}
        words = Words(path, whole_tokens(path))
        assert [list(memoryview(words.encode(t)).cast("I")) for t in rows] == want


def test_items_without_an_id_remove_documents(spark):
    from outfold.llm import decontaminate
    docs = spark.createDataFrame([(1, "here the secret question of the exam stands"), (2, "nothing"), (3, None)],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(None, "The secret question of the exam"), (7, None), (None, None)],
                                  "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == [2, 3]
    assert decontaminate.leaks(docs, items).count() == 0


def test_texts_in_no_learned_language(spark):
    """Noise and other scripts go, learned and neighbouring languages stay."""
    import random

    from pyspark.sql import functions as F

    from outfold.llm import langid
    from outfold.plans.registry import table
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    rng = random.Random(1)
    odd = [("gone", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(4000))),
           ("gone", "\u3053\u308c\u306f\u5225\u306e\u8a00\u8a9e\u3067\u3059 " * 20), ("gone", None),
           ("gone", "12 34"), ("gone", ""), ("stay", "zq"), ("stay", "xylophone"), ("stay", "PLEASE READ THIS"),
           ("stay", "for (int i=0;i<n;++i){ a[i]=b[i]*2; }")]
    odd = spark.createDataFrame(odd, "k string, text string")
    got = langid.predict(odd, model, F.struct("k", "text")).select(
        "kept.k", langid.rejected(F.col("kept.text")).alias("r")).collect()
    assert all((r["k"] == "gone") == r["r"] for r in got), got
    own = langid.predict(docs, model, F.struct("text"))
    assert own.where(langid.rejected(F.col("kept.text")) & (F.col("lang_pred") != "und")).count() == 0
