"""Registered queries of the corpus operators: name -> function of (spark, folder), and their check SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dealsight.llm import chat, jaccard, licenses, minhash, mixing, neighbours, packing, pii, ranked, repair, rules, suffix, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Source targets as the level at which sorted limits stop being met; documents in the order of the seeded hash.
MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
      FROM d GROUP BY source),
f AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS goal, row_number() OVER (ORDER BY cap / w, source) AS k FROM f),
l AS (SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
m AS (SELECT min(k) AS k FROM l WHERE cap > level * w),
t AS (SELECT o.source, o.source_size, CASE WHEN o.k < m.k OR m.k IS NULL THEN o.cap ELSE (SELECT level FROM l WHERE l.k = m.k) * o.w END AS target FROM o, m),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
p AS (SELECT *, CAST(floor(target - whole * source_size) AS BIGINT) AS part FROM r),
c AS (SELECT d.*, p.source_size, p.target, p.whole, p.part,
             sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + greatest(0, least(size, part - before)) AS BIGINT) AS taken FROM c
"""


def packing_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_source_mixing", MIXING_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("row.doc_id", "size", "source_size", "target", "taken")


@query("op6_skip_chain_pii")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.find(docs, pii.fit(docs))


@query("op10_quality_rules")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return rules.judge(docs, rules.fit(docs, table(spark, folder, "labels")))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), packing_vocabulary())


#: Conversations as lists of turns, compared as prefixes.
CHAT_SQL = r"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS pos FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
u AS (SELECT turns, n, min(conv_id) AS rep FROM c GROUP BY turns, n),
x AS (SELECT a.turns, min_by(b.rep, (-b.n, b.rep)) AS kept_in FROM u a JOIN u b ON b.n > a.n AND b.turns[1] = a.turns[1] AND b.turns[1:a.n] = a.turns GROUP BY a.turns),
k AS (SELECT c.conv_id, coalesce(x.kept_in, u.rep) AS kept_in FROM c JOIN u ON c.turns = u.turns LEFT JOIN x ON c.turns = x.turns),
h AS (SELECT kept_in AS conv_id, count(*) - 1 AS collapsed FROM k GROUP BY kept_in),
r AS (SELECT t.conv_id, pos, role, '<|im_start|>' || coalesce(role, 'unknown') || chr(10) ||
             regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') || '<|im_end|>' || chr(10) AS rendered FROM t)
SELECT r.conv_id, CAST(pos AS BIGINT) AS turn_no, CAST(c.n AS BIGINT) AS n_turns, role, rendered,
       CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY r.conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       CAST(collapsed AS BIGINT) AS collapsed
FROM r JOIN h ON r.conv_id IS NOT DISTINCT FROM h.conv_id JOIN c ON c.conv_id IS NOT DISTINCT FROM r.conv_id
"""


@query("op7_snapshot_collapse", CHAT_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return chat.render(table(spark, folder, "conversations"))


@query("op5_warc_derivatives")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, folder, "pages")))


@query("op1_license_scan")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query("op8_adaptive_scan")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"))


@query("op4_minhash_components")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query("op3_suffix_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.measure(table(spark, folder, "documents"))


#: Damage with the checksum bit by bit; then each conversation backward from its last turn, with the cheapest and
#: ASCII-least edits from each of the four states of the role pattern.
REPAIR_SQL = r"""
WITH RECURSIVE
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
d AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(key) + 1), lambda i:
             list_transform(range(8), lambda b: CASE WHEN b = 0 THEN CAST(ascii(key[i]) AS BIGINT) ELSE 0::BIGINT END)))),
             lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384))) % 20 AS kind FROM k),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM d WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM m),
f AS (SELECT *, left(role, 1) AS ini, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t,
             row_number() OVER (PARTITION BY conv_id, role, md5(text) ORDER BY pos) AS seen,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prev FROM o),
g AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM f),
n AS (SELECT conv_id, count(*) AS n FROM g GROUP BY conv_id),
w AS (SELECT n.conv_id, n AS i, {'c': 0, 'a': '', 'o': ''} AS s0, {'c': 6, 'a': 'II', 'o': 'user:' || chr(10) || 'assistant:' || chr(10)} AS s1,
             {'c': 3, 'a': 'I', 'o': 'assistant:' || chr(10)} AS s2, {'c': 0, 'a': '', 'o': ''} AS s3 FROM n
      UNION ALL
      SELECT conv_id, i,
             list_min([b0, {'c': 3 + e2.c, 'a': 'I' || e2.a, 'o': 'user:' || chr(10) || e2.o}]), list_min([b1, {'c': 3 + e2.c, 'a': 'I' || e2.a, 'o': 'user:' || chr(10) || e2.o}]), e2, e3
      FROM (SELECT *, list_min([b2, {'c': 3 + b3.c, 'a': 'I' || b3.a, 'o': 'assistant:' || chr(10) || b3.o}]) AS e2,
                      list_min([b3, {'c': 3 + b2.c, 'a': 'I' || b2.a, 'o': 'user:' || chr(10) || b2.o}]) AS e3
            FROM (SELECT w.conv_id, w.i - 1 AS i,
                         list_min([{'c': 4 + s0.c, 'a': 'D' || s0.a, 'o': s0.o}, {'c': keep + CASE ini WHEN 's' THEN s1.c WHEN 'u' THEN s2.c ELSE 1000000 END, 'a': 'K' || CASE ini WHEN 's' THEN s1.a ELSE s2.a END, 'o': line || CASE ini WHEN 's' THEN s1.o ELSE s2.o END}, {'c': keep + 3 + s2.c, 'a': 'R' || s2.a, 'o': 'user:' || body || s2.o}]) AS b0,
                         list_min([{'c': 4 + s1.c, 'a': 'D' || s1.a, 'o': s1.o}, {'c': keep + CASE ini WHEN 'u' THEN s2.c ELSE 1000000 END, 'a': 'K' || s2.a, 'o': line || s2.o}, {'c': keep + 3 + s2.c, 'a': 'R' || s2.a, 'o': 'user:' || body || s2.o}]) AS b1,
                         list_min([{'c': 4 + s2.c, 'a': 'D' || s2.a, 'o': s2.o}, {'c': keep + CASE ini WHEN 'a' THEN s3.c ELSE 1000000 END, 'a': 'K' || s3.a, 'o': line || s3.o}, {'c': keep + 3 + s3.c, 'a': 'R' || s3.a, 'o': 'assistant:' || body || s3.o}]) AS b2,
                         list_min([{'c': 4 + s3.c, 'a': 'D' || s3.a, 'o': s3.o}, {'c': keep + CASE ini WHEN 'u' THEN s2.c ELSE 1000000 END, 'a': 'K' || s2.a, 'o': line || s2.o}, {'c': keep + 3 + s2.c, 'a': 'R' || s2.a, 'o': 'user:' || body || s2.o}]) AS b3
                  FROM w JOIN (SELECT *, CASE fault WHEN 'truncated' THEN 3 WHEN 'none' THEN 0 ELSE 1000000 END AS keep,
                                      role || ':' || text || chr(10) AS line, text || chr(10) AS body FROM g) g
                  ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.pos = w.i) x) y),
c AS (SELECT conv_id, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
      FROM g GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.s0.c, 0) AS BIGINT) AS cost,
       coalesce(w.s0.a, '') AS audit, sha256(coalesce(left(w.s0.o, length(w.s0.o) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM a.conv_id AND w.i = 0
"""


@query("op13_checkpointed_repair", REPAIR_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return repair.report(turns, repair.damage(turns))


#: Counts of every term of an item in every document, scored as they are.
RANKED_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*)::BIGINT AS n, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
t AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(terms) AS term FROM d) GROUP BY k, term),
i AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT term, count(*)::BIGINT AS df FROM t GROUP BY term),
w AS (SELECT i.item_id, i.text, i.term, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / CAST(2 * f.df + 1 AS DOUBLE))) AS BIGINT) AS w FROM i JOIN f ON i.term = f.term, s),
m AS (SELECT d.k, d.doc_id, 10 + (90 * len(d.terms) * s.n) // s.total AS m FROM d, s WHERE len(d.terms) > 0),
x AS (SELECT w.item_id, w.text, m.k, m.doc_id, CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * m.m))) AS BIGINT) AS score
      FROM w JOIN t ON w.term = t.term JOIN m ON t.k = m.k GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 10
"""


@query("op11_bit_sliced_search", RANKED_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: All pairs that share a shingle, and the closure of their links.
JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT k, doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM d),
n AS (SELECT k, doc_id, count(*) AS n FROM s GROUP BY k, doc_id),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.k <> b.k WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL GROUP BY a.k, b.k),
l AS (SELECT a, b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT x.k, y.k FROM n x JOIN n y ON x.doc_id = y.doc_id AND x.k <> y.k),
r AS (SELECT k AS a, k AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, CAST(coalesce(m.m, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n ON d.k = n.k JOIN (SELECT r.a, min(d.doc_id) AS component_id FROM r JOIN d ON r.b = d.k GROUP BY r.a) c ON c.a = d.k
LEFT JOIN (SELECT a, count(*) AS m FROM l GROUP BY a) m ON m.a = d.k
"""


@query("op12_set_relation_join", JACCARD_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar(table(spark, folder, "documents"))
