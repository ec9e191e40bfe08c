"""DuckDB SQL for the corpus queries that SQL can express, in the direct form:
every window and every pair of documents with a common shingle."""

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

#: Windows of 20 words, the first occurrence stays.
OP7 = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
win AS (SELECT doc_id, i, word, CASE WHEN i + 19 <= n THEN md5(string_agg(word, ' ') OVER (
          PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) END AS h FROM w),
first AS (SELECT h, min(row(doc_id, i)) AS f FROM win WHERE h IS NOT NULL GROUP BY h),
hit AS (SELECT win.doc_id, win.i, win.word,
               coalesce(first.f <> row(win.doc_id, win.i), false) AS again
        FROM win LEFT JOIN first ON win.h = first.h),
cov AS (SELECT doc_id, i, word, max(CAST(again AS INTEGER)) OVER (
          PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM hit),
run AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS head
        FROM cov),
agg AS (SELECT doc_id, count(*) AS n, sum(gone) AS g, count(*) FILTER (WHERE head) AS s,
               string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept
        FROM run GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, CAST(coalesce(g, 0) AS BIGINT) AS n_removed,
       coalesce(s, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN agg ON d.doc_id = agg.doc_id"""

#: Strings of 200 bytes; all occurrences go.
OP1 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
b AS (SELECT doc_id, unnest(range(1, octet_length(x) + 1)) AS i, x FROM d),
win AS (SELECT doc_id, i, hex(x[i:i]) AS c,
               CASE WHEN i + 199 <= octet_length(x) THEN md5(x[i:i + 199]) END AS h FROM b),
twice AS (SELECT h FROM win WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
hit AS (SELECT win.doc_id, win.i, win.c, twice.h IS NOT NULL AS again
        FROM win LEFT JOIN twice ON win.h = twice.h),
cov AS (SELECT doc_id, i, c, max(CAST(again AS INTEGER)) OVER (
          PARTITION BY doc_id ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM hit),
run AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS head
        FROM cov),
agg AS (SELECT doc_id, count(*) AS n, sum(gone) AS g, count(*) FILTER (WHERE head) AS s,
               string_agg(c, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept
        FROM run GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_bytes, CAST(coalesce(g, 0) AS BIGINT) AS n_removed,
       coalesce(s, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN agg ON d.doc_id = agg.doc_id"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _linked(k: int, percent: int, out: str) -> str:
    """Links of documents by their k-word shingles, and what they connect."""
    gram = " || ' ' || ".join(f"ws[i + {j}]" if j else "ws[i]" for j in range(k))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
             ELSE [{gram} FOR i IN range(1, len(ws) - {k - 2})] END) AS g
      FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
      FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
      WHERE 100 * p.c >= {percent} * (na.n + nb.n - p.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id{out}
FROM m LEFT JOIN n ON m.doc_id = n.doc_id"""


OP8 = _linked(3, 85, ", m.component_id = m.doc_id AS kept")
OP13 = _linked(4, 85, "")

#: Contiguous shards in the order of the ids, each row where its middle byte falls.
#: The checksum is CRC-32 byte by byte, its table made by the usual rule.
OP5 = """
WITH t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)),
             lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
c AS (SELECT doc_id, octet_length(x) + 1 AS size, xor(4294967295, list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(x) + 1),
                                                               lambda i: CAST('0x' || hex(x[i:i]) AS BIGINT))),
               lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))) AS text_crc32
      FROM d, t),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto,
             sum(size) OVER () AS total FROM c),
s AS (SELECT *, CAST(least(7, ((2 * upto - size) * 8) // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s"""

def _h(text: str) -> str:
    """A leaf's input: each field with its length, ``-`` for null."""
    cols = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return " || ".join(f"coalesce(CAST(octet_length(encode({c})) AS VARCHAR) || ':' || {c}, '-')" for c in cols)


#: A manifest per language, then over the languages; level by level.
OP12 = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)),
             lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, lang, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1),
                              lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
               lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))) % 3 = 0 AS tampered,
             sha256({_h("text")}) AS leaf,
             sha256({_h("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS low
      FROM documents, t),
g AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r,
             count(*) OVER (PARTITION BY lang) AS n FROM d),
lv AS (SELECT lang, 0 AS l, r AS i, leaf AS h, n AS m FROM g
       UNION ALL SELECT lang, l + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (m + 7) // 8
       FROM lv WHERE m > 1 GROUP BY lang, l, i // 8, m),
sub AS (SELECT lang, l AS depth, h AS subroot,
               row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS r, count(*) OVER () AS n
        FROM lv WHERE m = 1),
up AS (SELECT 0 AS l, r AS i, subroot AS h, n AS m FROM sub
       UNION ALL SELECT l + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (m + 7) // 8
       FROM up WHERE m > 1 GROUP BY l, i // 8, m),
pos AS (SELECT g.*, sub.depth, sub.subroot, sub.r AS s FROM g JOIN sub ON g.lang IS NOT DISTINCT FROM sub.lang),
seg AS (SELECT doc_id, lv.l AS q, string_agg(h, '' ORDER BY i) FILTER (WHERE i < r // CAST(8 ** lv.l AS BIGINT)) AS a,
               string_agg(h, '' ORDER BY i) FILTER (WHERE i > r // CAST(8 ** lv.l AS BIGINT)) AS b
        FROM pos JOIN lv ON lv.lang IS NOT DISTINCT FROM pos.lang AND m > 1
             AND i // 8 = r // CAST(8 ** (lv.l + 1) AS BIGINT) GROUP BY doc_id, lv.l
        UNION ALL
        SELECT doc_id, depth + up.l, string_agg(h, '' ORDER BY i) FILTER (WHERE i < s // CAST(8 ** up.l AS BIGINT)),
               string_agg(h, '' ORDER BY i) FILTER (WHERE i > s // CAST(8 ** up.l AS BIGINT))
        FROM pos JOIN up ON m > 1 AND i // 8 = s // CAST(8 ** (up.l + 1) AS BIGINT) GROUP BY doc_id, depth, up.l),
walk AS (SELECT doc_id, 0 AS q, CASE WHEN tampered AND low IS NOT NULL THEN low ELSE leaf END AS h, '' AS p FROM pos
         UNION ALL SELECT walk.doc_id, walk.q + 1, sha256(coalesce(a, '') || h || coalesce(b, '')),
                          p || coalesce(a, '') || coalesce(b, '')
         FROM walk JOIN seg ON walk.doc_id = seg.doc_id AND walk.q = seg.q),
fin AS (SELECT doc_id, arg_max(h, q) AS folded_root, sha256(arg_max(p, q)) AS proof_sha256 FROM walk GROUP BY doc_id)
SELECT pos.doc_id, pos.leaf, pos.subroot, up.h AS root, proof_sha256, folded_root, folded_root = up.h AS verified
FROM pos JOIN fin ON pos.doc_id = fin.doc_id JOIN up ON up.m = 1"""

#: Phrases of up to five words, spelled out; every cut of every candidate.
OP11 = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
s AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, unnest(flatten([[ws[i:i + k - 1] FOR i IN range(1, len(ws) - k + 2)] FOR k IN range(1, 6)])) AS p
      FROM s),
f AS (SELECT lang, p, count(*) AS c FROM g GROUP BY lang, p),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE len(p) = 1 GROUP BY lang),
c AS (SELECT lang, p, c AS a, unnest(range(1, len(p))) AS k FROM f WHERE c >= 100 AND len(p) > 1),
x AS (SELECT c.*, fl.c AS l, fr.c AS r, n.n,
             (1000::HUGEINT * c.a * n.n) // (fl.c::HUGEINT * fr.c) AS score
      FROM c JOIN n ON n.lang = c.lang JOIN f fl ON fl.lang = c.lang AND fl.p = c.p[1:k]
      JOIN f fr ON fr.lang = c.lang AND fr.p = c.p[k + 1:len(c.p)]),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_ AS (SELECT lang, p[i:j] AS p, max(a) AS m
           FROM (SELECT *, unnest(range(i + 1, len(p) + 1)) AS j
                 FROM (SELECT lang, p, a, unnest(range(1, len(p))) AS i FROM b))
           WHERE j - i + 1 < len(p) GROUP BY ALL),
t AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, n, score
      FROM b LEFT JOIN inner_ o ON o.lang = b.lang AND o.p = b.p WHERE o.m IS NULL OR 100 * o.m < 100 * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM t)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o WHERE rank <= 2000"""

ORACLES = {"op1_suffix_dedup": OP1, "op5_byte_shards": OP5, "op7_phrase_dedup": OP7, "op8_minhash": OP8,
           "op11_collocations": OP11, "op12_merkle_manifest": OP12,
           "op13_ngram_join": OP13}
