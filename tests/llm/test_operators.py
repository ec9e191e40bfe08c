"""Each corpus operator against brute force, and on awkward tables: nulls,
empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import math
import os
import random
import struct
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from outfold.llm import (decontaminate, langid, minhash, multi_index, packing, phrase_dedup, pii,
                         sharding, suffix_dedup, token_counts)
from outfold.llm.queries import QUERIES, tokenizer_path
from outfold.plans.registry import table

SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    """doc_id, text and columns whose names the operators use too."""
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr(
        "*", "cast(1 as int) size", "'x' shard", "'y' _id", "'z' _t", "'k' kept", "'c' component_id",
        "1 length", "'q' _h", "array(1) _refs")


@pytest.fixture(scope="module")
def some(spark):
    """Rows with copies, overlaps, shared passages, periodic and odd texts."""
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choices(vocab, k=n))

    passage, base = prose(60), prose(150)
    rows = [(i, prose(rng.randint(1, 120))) for i in range(25)]
    rows += [(100 + i, f"{prose(10)} {passage} {prose(i)}") for i in range(12)]
    for i in range(14):  # near copies
        w = base.split()
        for _ in range(i // 3):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((200 + i, " ".join(w)))
    rows += [(300, base), (301, base), (302, base.upper()), (303, None), (304, ""), (305, " \n\t "),
             (306, "a" * 700), (307, "ab" * 300), (308, (prose(7) + "\n") * 30), (309, prose(4000)),
             (310, "x"), (311, "    é"), (312, base + " " + base)]
    return rows


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("batches", [1, 3])
def test_substrings(spark, some, batches):
    df = suffix_dedup.repeated_substrings(docs_of(spark, some), batches=batches)
    assert got(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == \
        sorted(brute.substrings(some), key=repr)


def test_substrings_repeated_and_null_ids(spark):
    long = "".join(random.Random(1).choices("abcdef ", k=500))
    rows = [(1, long), (1, long), (None, long + "x"), (2, "short"), (2, "other text of one id")]
    df = suffix_dedup.repeated_substrings(docs_of(spark, rows))
    assert got(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == \
        sorted(brute.substrings(rows), key=repr)


def test_substrings_in_pieces():
    from outfold.llm import anchors, passages
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 101, 6000).astype(np.uint8))
    whole = set()
    for lo, hi in anchors.pieces(len(text), 200, 1000):
        for s in range(lo, hi - 199):
            assert s not in whole
            whole.add(s)
    assert whole == set(range(len(text) - 199))
    kind = passages.Bytes(200, 32)
    found = [r for _, r in passages._batch_runs([kind.read(text)], kind)]
    assert sum(int(r.windows.sum()) for r in found) == len(text) - 199


def test_phrases(spark, some):
    df = phrase_dedup.repeated_phrases(docs_of(spark, some))
    assert got(df, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.phrases(some), key=repr)


def test_phrases_small_windows_and_null_id(spark, some):
    rows = [*some, (None, some[30][1])]
    df = phrase_dedup.repeated_phrases(docs_of(spark, rows), width=5, gram=2)
    assert got(df, "doc_id", "n_words", "n_removed", "kept_sha256") == \
        sorted(brute.phrases(rows, 5), key=repr)


@pytest.mark.parametrize("block", [4, 512])
@pytest.mark.parametrize("words,percent", [(5, 80), (3, 85), (1, 50)])
def test_near_duplicates(spark, some, monkeypatch, block, words, percent):
    monkeypatch.setattr(minhash, "BLOCK", block)
    bands = {"bands": 60, "rows": 2} if percent == 50 else {}
    df = minhash.near_duplicates(docs_of(spark, some), words=words, percent=percent, **bands)
    want = sorted(brute.near(some, words, percent), key=repr)
    assert got(df, "doc_id", "n_shingles", "component_id") == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in df.collect())


def test_near_duplicates_repeated_and_null_ids(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (5, "A B c d e f"), (None, "a b c d e f"), (7, None)]
    out = minhash.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out if r["doc_id"]) == [
        (3, 3, True), (3, 3, True), (5, 3, False), (7, 7, True)]
    assert len(out) == 5


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2 ** 63, 900).astype(np.uint64)
    a, b = x[:700], x[200:]
    same = (minhash.signature(a, 512) == minhash.signature(b, 512)).mean()
    assert abs(same - 500 / 900) < 0.1


def test_leaks(spark, some):
    rng = random.Random(8)
    items = [(1, some[3][1][:150] or "nothing"), (2, some[30][1][40:230]), (3, None), (4, "  "),
             (5, "never seen anywhere in here, this one"), (6, "é"), (2, some[31][1][50:220])]
    w = list(items[1][1])
    for _ in range(6):
        w[rng.randrange(len(w))] = "#"
    rows = [*some, (900, "start " + "".join(w) + " end"), (901, "start " + items[1][1].upper() + " end"),
            (902, items[1][1].replace(" ", "\n  "))]
    df = decontaminate.leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    want = set()
    for d, t in rows:
        for i, it in items:
            it, text = decontaminate.normal(it or ""), decontaminate.normal(t or "")
            if it and brute.edit_search(it, text) <= len(it) // decontaminate.CHARS_PER_EDIT:
                want.add((d, i))
    assert {(r["doc_id"], r["item_id"]) for r in df.collect()} == want
    assert {(900, 2), (901, 2), (902, 2)} <= want


def test_leaks_blocks_and_no_items(spark, some, monkeypatch):
    items = spark.createDataFrame([(i, t[:80]) for i, t in some[25:35]], "item_id long, text string")
    docs = docs_of(spark, some)
    want = got(decontaminate.leaks(docs, items), "doc_id", "item_id", "distance")
    blocks = list(decontaminate.item_blocks(items, "item_id", "text", 200))
    assert len(blocks) >= 4 and sum(map(len, blocks)) == 10
    plain = decontaminate.item_blocks
    monkeypatch.setattr(decontaminate, "item_blocks", lambda *a: plain(*a, block_chars=200))
    assert got(decontaminate.leaks(docs, items), "doc_id", "item_id", "distance") == want
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_short_items_are_whole_words(spark):
    docs = docs_of(spark, [(1, "the eyes of a start"), (2, "Yes, of course"), (3, "eyes say yes"), (4, "c++ or é.art"),
                           (5, "yesé 2art"), (6, "\u65e5\u672c\u8a9e"), (7, "a\u0301rt")])
    items = spark.createDataFrame([(7, "yes"), (8, "art"), (10, "\u672c")], "item_id long, text string")
    assert got(decontaminate.clean(docs, items), "doc_id") == [(1,), (5,), (7,)]
    leaks = decontaminate.leaks(docs, items, whole_words=True)
    assert got(leaks, "doc_id", "item_id", "distance", "match_end") == [
        (2, 7, 0, 3), (3, 7, 0, 12), (4, 8, 0, 12), (6, 10, 0, 2)]
    assert (1, 7) in got(decontaminate.leaks(docs, items), "doc_id", "item_id")


def test_myers_matches_table():
    rng = random.Random(4)
    for _ in range(200):
        p = "".join(rng.choices("abc", k=rng.randint(1, 80)))
        t = "".join(rng.choices("abc", k=rng.randint(0, 90)))
        assert decontaminate.Myers(p).best(t)[0] == brute.edit_search(p, t)


def test_packing(spark, some):
    from outfold.llm.tokens import load
    tok = load(tokenizer_path())
    rows = [*some, (None, "a null id"), (310, "x")]
    out = packing.pack(docs_of(spark, rows), tokenizer_path(), capacity=256).collect()
    ids = {}
    for d, x in rows:
        ids.setdefault(d, tok.encode(x or "", add_special_tokens=False).ids + [2])
    assert sum(r["length"] for r in out) == sum(
        len(tok.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows)
    by_seq = {}
    for r in out:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert len(by_seq) <= 1.1 * sum(r["length"] for r in out) / 256 + 2


@pytest.mark.parametrize("n", [0, 1, 5, 128, 129, 4095, 4096, 4097, 9000, 123_457])
def test_cut_covers_and_fits(n):
    parts = packing.cut(n, 4096, 128)
    assert sum(s for s, _ in parts) == n
    assert all(s <= 4096 // j and (s > 4096 // (j + 1) or s == 4096 // j) for s, j in parts)


def test_shards(spark, some):
    rows = [*some, (310, "x"), (None, "null id")]
    out = sharding.byte_shards(docs_of(spark, rows)).orderBy("shard", "slot").collect()
    assert len(out) == len(rows) and out[0]["law"] == "bytes"
    text = {}
    for d, t in rows:
        text.setdefault(d, []).append(t or "")
    for r in out:
        assert (r["size"], r["text_crc32"]) in {(len(t.encode()) + 1, zlib.crc32(t.encode()))
                                                for t in text[r["doc_id"]]}
    for s in range(8):
        assert [r["slot"] for r in out if r["shard"] == s] == list(range(sum(r["shard"] == s for r in out)))
    ids = [r["doc_id"] for r in out if r["doc_id"] is not None]
    assert ids == sorted(ids)  # contiguous
    total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
    for s in range(8):
        assert abs(sum(r["size"] for r in out if r["shard"] == s) - total / 8) <= largest


def test_token_counts(spark, some):
    from outfold.llm.tokens import load
    tok = load(tokenizer_path())
    rows = [*some, (400, "I'm DON'T it's 12 345 <|endoftext|>x <|startoftext|> İΣ é \x1c a\x1cb"),
            (401, "naïve ＡＢ ① 漢字 \U0001f600 á  x y\x85z"), (None, "null id")]
    out = token_counts.count_tokens(docs_of(spark, rows), tokenizer_path(), limit=50).collect()
    want = sorted(((d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids),
                    n > 50) for d, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out), key=repr) == want


def test_whole_tokens_are_one_token():
    from outfold.llm.tokens import Words, load
    tok, proved = load(tokenizer_path()), token_counts.whole_tokens(tokenizer_path())
    assert len(proved) > 20_000
    assert all(len(tok.model.tokenize(s)) == 1 for s in list(proved)[:2000])
    words = Words(tokenizer_path(), proved)
    assert words.count("the theeaing") == len(tok.encode("the theeaing", add_special_tokens=False).ids)


@pytest.mark.parametrize("limit", [4, 10_000])
def test_words_give_the_tokenizers_ids(monkeypatch, limit):
    from outfold.llm import tokens
    monkeypatch.setattr(tokens, "CACHE_PIECES", limit)
    words = tokens.Words(tokenizer_path(), tokens.whole_tokens(tokenizer_path()))
    rng = random.Random(11)
    chars = [chr(c) for c in range(1, 600)] + list("  \n\t'sdlmtre09\u0301\u03a3\u0130\u2003\ufb01\u6f22\U0001f600") * 6
    for i in range(1500):
        text = "".join(rng.choices(chars if i % 2 else chars[:255], k=rng.randint(0, 40)))
        if i % 50 == 0:
            text = f"{text}<|endoftext|>{text[::-1]} <|startoftext|>x"
        ids = words.t.encode(text, add_special_tokens=False).ids
        assert words.encode(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)
        assert words.count(text) == len(ids)


def test_language(spark):
    docs = table(spark, SF, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    out = langid.predict(docs, model, F.struct("*")).select("kept.*", "lang_pred", "score").where(
        langid.held_out()).collect()
    assert len(out) > 30
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.95
    odd = docs_of(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "the thing"), (None, "der die das und")])
    got_ = {r["kept"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd, model, F.col("doc_id")).collect()}
    assert got_[1] == got_[2] == got_[3] == ("und", 0.0)
    assert got_[4][0] == "en" and 0 <= got_[4][1] <= 1 and got_[None][0] == "de"


def test_language_without_training(spark):
    none = spark.createDataFrame([(1, None, "en"), (2, "text", None)], "doc_id long, text string, lang string")
    out = langid.predict(none, langid.fit(none), F.col("doc_id")).collect()
    assert [r["lang_pred"] for r in out] == ["und", "und"]


def ppm(counts, lang, text):
    """Code length in nats, symbol by symbol, from nested dictionaries."""
    seen = {}
    for la, code, n in counts:
        for order in range(4):
            ctx = (code // 128) % 128 ** order
            seen.setdefault((order, ctx), {}).setdefault(la, {}).setdefault(code % 128, 0)
            seen[order, ctx][la][code % 128] += n
    kept = {key: t for key, t in seen.items()
            if key[0] == 0 or sum(n for d in t.values() for n in d.values()) >= langid.MIN_CONTEXT}

    def p(order, ctx, s):
        if order < 0:
            return 1 / 128
        t = kept.get((order, ctx))
        if t is None:
            return p(order - 1, ctx % 128 ** max(0, order - 1), s)
        d = t.get(lang, {})
        total, kinds = sum(d.values()), len(d)
        if s in d:
            return d[s] / (total + kinds)
        return (kinds / (total + kinds) if total else 1.0) * p(order - 1, ctx % 128 ** max(0, order - 1), s)

    syms = [0, 0, 0, *langid.symbols(text).tolist()]
    return sum(-math.log(p(3, syms[i - 3] * 128 ** 2 + syms[i - 2] * 128 + syms[i - 1], syms[i]))
               for i in range(3, len(syms)))


def test_code_lengths_are_ppm():
    texts = {"en": ["the thing is here", "there and then"], "de": ["der die das", "und die anderen der"]}
    counts = []
    for lang, ts in texts.items():
        context, symbol, _ = langid.grams([langid.symbols(t) for t in ts * 3])
        code, n = np.unique(context * 128 + symbol, return_counts=True)
        counts += [(lang, int(c), int(k)) for c, k in zip(code, n)]
    model = langid.Model.fit(counts)
    tests = ["the end", "die andere", "x", "zzz thé"]
    out = model.code_lengths([langid.symbols(t) for t in tests])
    for i, t in enumerate(tests):
        for j, lang in enumerate(model.langs):
            assert out[i, j] == pytest.approx(ppm(counts, lang, t), rel=1e-5)


def brute_search(rows, is_query, top):
    good = [(i, np.array(v, dtype=float)) for i, v in rows
            if i is not None and v is not None and len(v) and None not in v
            and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    out = {}
    for i, q in good:
        if is_query(i):
            cand = sorted(((-float(sum(q * v)), j) for j, v in good if j != i))
            out[i] = [j for _, j in cand[:top]]
    return out


def test_search_finds_all_when_all_cells_are_visited(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(60)]  # one common vector: ties
    rows += [(400, None), (401, []), (402, [0.0] * 6), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0]),
             (404, [float("nan")] * 6), (405, [float("inf")] * 6), (406, [1.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "1 score", "2 rank", "'a' _id", "'b' _cell")
    want = brute_search([r for r in rows if r[0] != 406], lambda i: i % 20 == 0, 20)
    out = multi_index.search(df, F.col("vec_id") % 20 == 0, share=1.0).orderBy("query_id", "rank").collect()
    got_ = {}
    for r in out:
        got_.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(got_[r["query_id"]])
    assert got_ == want


def test_search_recall_and_empty(spark):
    sf = "/root/testdata/check_s" if os.path.isdir("/root/testdata/check_s") else "/root/testdata/sf0.1"
    df = table(spark, sf, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    out = {}
    for r in QUERIES["op10_multi_index"](spark, sf).collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    hit = n = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        hit, n = hit + len(set(best) & set(out[ids[q]])), n + 20
        assert len(out[ids[q]]) == 20
    assert hit / n >= 0.92
    assert multi_index.search(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("side", [1, 3, 8])
def test_visit_takes_the_nearest_cells(side):
    rng = np.random.default_rng(9)
    for _ in range(50):
        a, b = rng.normal(size=13), rng.normal(size=17)
        sizes = rng.integers(0, 4, 13 * 17)
        want = int(rng.integers(1, sizes.sum() + 5))
        cells, least = multi_index.visit(a, b, sizes, want, side)
        sums = np.add.outer(a, b).ravel()
        order = [c for c in np.argsort(-sums) if sizes[c]]
        n = int(np.searchsorted(np.cumsum(sizes[order]), want)) + 1
        assert sorted(cells) == sorted(order[:n]) and least == pytest.approx(sums[order[:n]].min())


def test_large_cells_and_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BUCKET_ROWS", 16)
    monkeypatch.setattr(multi_index, "QUERY_ROWS", 3)
    test_search_finds_all_when_all_cells_are_visited(spark)


def test_visited_cells_do_not_hang_on_rounding(spark):
    """Sums of one row and of a block of rows are rounded differently; with a
    single visited cell, each vector must still meet its copies."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(30, 64))
    rows = [(i, [float(c) for c in x[i % 30]]) for i in range(300)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    spark.conf.set(size, "1")
    try:
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        out = multi_index.search(df, F.lit(True), top=9, share=0.0, least=1).collect()
        same = spark.createDataFrame([(i, rows[0][1]) for i in range(100)], df.schema).repartition(100)
        alike = multi_index.search(same, F.lit(True)).collect()
    finally:
        spark.conf.set(size, old)
    found = {}
    for r in out:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert found == {i: {j for j in range(300) if j % 30 == i % 30} - {i} for i in range(300)}
    assert len(alike) == 100 * 20


def test_groups_hold_a_block_of_queries(spark, monkeypatch):
    """No group gets all queries, and the neighbours are the same."""
    monkeypatch.setattr(multi_index, "BUCKET_ROWS", 64)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 20, raising=False)
    slots, frame = [], type(spark.range(0))
    real = frame.groupBy
    monkeypatch.setattr(frame, "groupBy", lambda self, *c: slots.append((self, c)) or real(self, *c))
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = multi_index.search(df, F.col("vec_id") % 2 == 0, share=1.0)
    monkeypatch.undo()
    found = {}
    for r in out.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == brute_search(rows, lambda i: i % 2 == 0, 20)
    queries, key = next(s for s in slots if {"_v", "_bucket"} <= set(s[0].columns))
    sizes = [r["count"] for r in queries.groupBy(*key).count().collect()]
    assert max(sizes) <= 40 and sum(sizes) >= 200


EMPTY = "doc_id long, text string"


@pytest.mark.parametrize("run", [
    lambda d: suffix_dedup.repeated_substrings(d), lambda d: phrase_dedup.repeated_phrases(d),
    lambda d: minhash.near_duplicates(d), lambda d: sharding.byte_shards(d),
    lambda d: token_counts.count_tokens(d, tokenizer_path()), lambda d: packing.pack(d, tokenizer_path()),
    lambda d: pii.pseudonymise(d, "k"),
    lambda d: decontaminate.leaks(d, d.sparkSession.createDataFrame([(1, "item")], "item_id long, text string")),
    lambda d: langid.predict(d, langid.fit(d.selectExpr("*", "'en' lang")), F.col("doc_id"))])
def test_empty_and_all_null_tables(spark, run):
    assert run(spark.createDataFrame([], EMPTY)).count() == 0
    run(spark.createDataFrame([(None, None), (None, None)], EMPTY)).collect()


def test_components_of_paths_and_stars(spark):
    from outfold.llm.common import Workspace
    from outfold.llm.components import components
    rng = random.Random(12)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 300)]
    edges += [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(120)] + [(5, 5), (7, 6)]
    rng.shuffle(edges)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got_ = components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "cc")).collect()
    assert sorted((r["id"], r["component"]) for r in got_) == sorted((x, root(x)) for x in list(parent))
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "cc")).count() == 0


def test_refs_can_be_taken_away():
    import pyarrow as pa

    from outfold.llm import passages
    col = pa.array([[{"start": 1}, {"start": 2}], None, [], [{"start": 3}]])
    rows, ref = passages._refs_of(col)
    assert rows.tolist() == [0, 0, 3] and ref["start"].tolist() == [1, 2, 3]
    left = passages._only(col.slice(0), np.array([False, True, False]))
    assert left.to_pylist() == [[{"start": 2}], None, [], []]
    assert passages._only(col.slice(1), np.array([False])).to_pylist() == [None, [], []]
