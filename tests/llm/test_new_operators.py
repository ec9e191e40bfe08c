"""Phrase collocations, the Merkle manifest and the n-gram join, against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from outfold.llm import collocations, merkle, ngram_join


def prose(rng, vocab, n):
    return " ".join(rng.choices(vocab, k=n))


@pytest.fixture(scope="module")
def vocab():
    rng = random.Random(5)
    return ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(300)]


# --- n-gram join ------------------------------------------------------------------

@pytest.fixture(scope="module")
def copies(vocab):
    rng = random.Random(3)
    base, passage = prose(rng, vocab, 150), prose(rng, vocab, 60)
    rows = [(i, prose(rng, vocab, rng.randint(1, 120))) for i in range(25)]
    rows += [(100 + i, f"{prose(rng, vocab, 10)} {passage} {prose(rng, vocab, i)}") for i in range(40)]
    for i in range(60):
        w = base.split()
        for _ in range(i // 6):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((200 + i, " ".join(w)))
    return rows + [(300, base), (301, base), (302, base.upper()), (303, None), (304, ""), (305, " \n\t "),
                   (309, prose(rng, vocab, 4000)), (310, "x"), (312, base + " " + base)]


@pytest.mark.parametrize("block,local,words,percent", [(4, 1, 4, 85), (512, 4, 5, 80), (8, 1, 1, 50),
                                                       (512, 1, 4, 100)])
def test_ngram_join(spark, copies, monkeypatch, block, local, words, percent):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LOCAL", local)
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(3).selectExpr(
        "*", "'a' _v", "'b' _w", "1 _n", "array(1) _set")
    out = ngram_join.jaccard_join(docs, words, percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == \
        sorted(brute.near(copies, words, percent))


def test_ngram_join_repeated_and_null_ids(spark):
    docs = spark.createDataFrame(
        [(3, "a b c d e f"), (3, "a b c d e f"), (3, "other words are in this one"), (5, "A B c d e f"),
         (None, "a b c d e f"), (None, "solo words of nobody"), (7, None)], "doc_id long, text string")
    out = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_join(docs).collect()), key=repr)
    assert out == sorted([(3, 3), (3, 3), (3, 3), (5, 3), (None, 3), (None, None), (7, 7)], key=repr)
    assert ngram_join.jaccard_join(docs.limit(0)).count() == 0


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(1)
    for bits in (256, 1024):
        for _ in range(50):
            pool = rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)
            a, b = (np.unique(rng.choice(pool, rng.integers(1, 250))) for _ in range(2))
            differ = int(np.bitwise_count(ngram_join.bitmap(a, bits) ^ ngram_join.bitmap(b, bits)).sum())
            assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - differ) // 2


@pytest.mark.parametrize("percent", [50, 85, 99])
def test_bands_and_prefixes_lose_no_pair(percent):
    edges = ngram_join.band_edges(percent)
    for a in [*range(1, 400), 5000]:
        b = a * 100 // percent  # the largest linked set
        band = np.searchsorted(edges, [a, b], side="right")
        assert band[1] - band[0] <= 1
        need = -(-percent * a // 100)  # shared with any linked set, at least
        assert ngram_join.prefix_size(a, percent) == a - need + 1


# --- Merkle manifest -----------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def leaf(row, low=False):
    out = b""
    for name, v in zip(merkle.FIELDS, row):
        if v is None:
            out += b"-"
            continue
        v = str(v).encode()
        v = v.lower() if low and name == "text" else v
        out += str(len(v)).encode() + b":" + v
    return sha(out)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for t, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now, proof = leaf(r, tampered), ""
            for tree, at in ((trees[g], i), (top, t)):
                for level in tree[:-1]:
                    run, place = level[at // 8 * 8:at // 8 * 8 + 8], at % 8
                    before, after = "".join(run[:place]), "".join(run[place + 1:])
                    now, proof, at = sha(before + now + after), proof + before + after, at // 8
            out.append((r[0], trees[g][0][i], trees[g][-1][0], top[-1][0], sha(proof), now, now == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


@pytest.mark.parametrize("rows", [
    [(i, f"s{i % 3}", ["en", None, "é"][i % 3] if i % 7 else "z", i, f"Text {i} Of É") for i in range(150)],
    [(i, None, f"l{i}", None, "A") for i in range(70)],             # more groups than one run
    [(1, "s", "en", 3, "Abc")],                                     # a lone leaf
    [(5, "s", "en", 1, "A")] * 20 + [(None, "s", "en", 1, "B"), (6, "", None, None, None), (6, None, None, None, "")],
])
def test_merkle_manifest(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "'x' _id", "'y' _digest", "1 _t")
    out = merkle.tamper_check(docs)
    assert sorted(map(tuple, out.collect()), key=repr) == manifest(rows)


def test_merkle_proofs_of_some_leaves(spark):
    docs = spark.createDataFrame([(i, "s", "ab"[i % 2], i, "t") for i in range(90)], SCHEMA)
    m = merkle.build(docs)
    some = merkle.prove(m, m.leaves.where("_id in (3, 88)"))
    rows = some.select("_id", merkle.fold(F.col("leaf"), F.col("path")).alias("root")).collect()
    assert sorted(r["_id"] for r in rows) == [3, 88] and {r["root"] for r in rows} == {m.root}
    assert merkle.prove(m, m.leaves.limit(0)).count() == 0
    empty = merkle.build(docs.limit(0))
    assert empty.root is None and merkle.tamper_check(docs.limit(0)).count() == 0


def test_merkle_store_holds_equal_parts_once(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1, "same")] * 64, SCHEMA)
    m = merkle.build(docs)
    assert m.store.count() == 2  # eight equal runs are one record, and their parent


# --- collocations ----------------------------------------------------------------------

def phrases(rows, least, top, cover):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode()):
            w = re.findall(rb"[^\x20\x09]+", piece.lower())
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    frequent = {k: c for k, c in f.items() if c >= least and len(k[1]) > 1}
    inside = collections.defaultdict(int)
    for (lang, p), c in frequent.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    inside[lang, p[i:j]] = max(inside[lang, p[i:j]], c)
    found = collections.defaultdict(list)
    for (lang, p), a in frequent.items():
        if 100 * inside[lang, p] >= cover * a:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k,
                                     f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found[lang].append((-score, -a, b" ".join(p), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, v in found.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(v)[:top], 1))


@pytest.mark.parametrize("shares,task,cover,top", [(1000, 1 << 18, 100, 2000), (2, 50, 100, 2000),
                                                   (1000, 50, 60, 7)])
def test_collocations(spark, vocab, monkeypatch, shares, task, cover, top):
    monkeypatch.setattr(collocations, "SHARES", shares)
    monkeypatch.setattr(collocations, "TASK_ROWS", task)
    rng = random.Random(9)
    few = vocab[:12]
    rows = [(["en", "fr", None, "und"][i % 4], ". ".join(prose(rng, few, 6) for _ in range(8))) for i in range(60)]
    rows += [("en", "In The Same, in the same line again!\rin the same")] * 15
    rows += [("de", None), ("de", ""), (None, " \t\n"), ("fr", "A a A A a A\x0ba a a" * 9), ("x", "one")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3).selectExpr(
        "*", "'q' phrase", "1 rank", "2 _g", "'w' _word")
    out = collocations.collocations(docs, least=10, top=top, cover=cover)
    assert sorted(map(tuple, out.collect())) == phrases(rows, 10, top, cover)


def test_collocations_take_few_texts_at_once(spark, monkeypatch):
    """Batches of 10,000 whole texts filled the memory of an executor."""
    count = collocations._count_words

    def watched(batches):
        def few():
            for b in batches:
                assert b.num_rows <= 1000
                yield b
        yield from count(few())
    monkeypatch.setattr(collocations, "_count_words", watched)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(3000, numPartitions=1).selectExpr("'en' lang", "concat('red sea ', id) text")
    got = collocations.collocations(docs, least=3000).collect()
    assert [(r["phrase"], r["a"], r["n"]) for r in got] == [("red sea", 3000, 9000)]
    assert spark.conf.get(key) == before


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([("en", "too few words")], "lang string, text string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_multikey_counts_prefixes():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 4, (500, 4)).astype(np.uint64)
    weight = rng.integers(1, 5, 500)
    want = collections.Counter()
    for k, w in zip(keys.tolist(), weight.tolist()):
        for d in range(1, 5):
            if 0 in k[:d]:
                break
            want[tuple(k[:d])] += w
    got = {tuple(keys[row, :d].tolist()): n for d, row, n in collocations.multikey(keys, weight, 20)}
    assert got == {k: n for k, n in want.items() if n >= 20}
