"""What the pipeline's stages take of the driver's memory."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from outfold.llm import langid, pii


def test_language_model_is_fitted_in_blocks():
    rng = np.random.default_rng(7)
    langs = [f"l{i}" for i in range(8)]
    contexts = rng.choice(langid.SYMBOLS ** 3, 4000, replace=False)
    code = np.repeat(contexts, 20) * langid.SYMBOLS + rng.integers(0, langid.SYMBOLS, 80_000)
    lang = rng.integers(0, len(langs), len(code))
    counts = [(langs[x], int(c), 2) for x, c in zip(lang, code, strict=True)]
    tracemalloc.start()
    try:
        model = langid.Model.fit(counts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.cost.nbytes > 16e6
    assert peak < 5 * model.cost.nbytes + 50e6, peak


def test_blocks_do_not_change_the_model(monkeypatch):
    texts = ["the thing and that of the other", "der die das und ein anderes", "THE 12 été 日本"] * 5
    counts = []
    for name, t in zip("abc" * 5, texts, strict=True):
        context, symbol, _ = langid.grams([langid.symbols(t)])
        counts += [(name, int(c), 1) for c in context * langid.SYMBOLS + symbol]
    one = langid.Model.fit(counts)
    monkeypatch.setattr(langid, "FIT_ROWS", 3)
    other = langid.Model.fit(counts)
    assert one.langs == other.langs == ["a", "b", "c"]
    assert np.array_equal(one.row_of, other.row_of) and np.array_equal(one.cost, other.cost)
    empty = langid.Model.fit([])
    assert empty.langs == [] and empty.code_lengths([langid.symbols("a")]).tolist() == [[0.0]]


def test_pseudonyms_give_the_parser_no_long_sql(spark, monkeypatch):
    sizes = []
    plain = F.expr
    monkeypatch.setattr(F, "expr", lambda s: sizes.append(len(s)) or plain(s))
    df = spark.createDataFrame([("call a@b.org, 2020-01-02",), ("nothing",), (None,)], "text string")
    got = [r["text"] for r in pii.pseudonymise(df, "k").collect()]
    assert got[0] != "call a@b.org, 2020-01-02" and got[1:] == ["nothing", None]
    assert sum(sizes) < 2000, sizes
