"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeweave.llm.bpe import round_trip
from tapeweave.llm.collocations import collocations
from tapeweave.llm.common import table
from tapeweave.llm.exact_dedup import exact_dedup
from tapeweave.llm.fingerprints import fingerprints
from tapeweave.llm.html_text import extract
from tapeweave.llm.mixing import mix
from tapeweave.llm.near_dedup import near_dedup
from tapeweave.llm.pii import pseudonymised
from tapeweave.llm.prefix_trie import conversation_trie
from tapeweave.llm.quality import quality_scores
from tapeweave.llm.simhash import simhash_dedup
from tapeweave.llm.substring_dedup import repeated_passages
from tapeweave.llm.warc import through_archives


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_archives(spark, table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_pii, op2_mixing, op3_bpe, op4_substring_dedup, op5_fingerprints, op6_html_text, op7_exact_dedup, op8_warc, op9_quality, op10_near_dedup, op11_collocations, op12_simhash, op13_prefix_trie)
    return {f.__name__: f for f in own}


OP7_SQL = """
WITH m AS (SELECT (min(doc_id) + max(doc_id)) // 2 AS mid FROM documents),
t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size,
             coalesce(bool_or(doc_id < (SELECT mid FROM m)), false) AS seen_before
      FROM t GROUP BY body),
r AS (SELECT doc_id, body, row_number() OVER (PARTITION BY doc_id, body) AS copy FROM t)
SELECT r.doc_id, g.keep_id, g.group_size,
       (r.doc_id IS NOT DISTINCT FROM g.keep_id AND r.copy = 1) AS kept,
       sha256(r.body) AS text_sha256, g.seen_before
FROM r JOIN g USING (body)
"""


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\v\f\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS words FROM p),
t AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (SELECT lang, words[i : i + k - 1] AS ws FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(words)),
f AS (SELECT lang, ws, array_to_string(ws, ' ') AS phrase, count(*) AS f FROM g GROUP BY lang, ws HAVING count(*) >= 30),
c AS (SELECT lang, ws, phrase, f AS a, unnest(range(1, len(ws))) AS k FROM f WHERE len(ws) > 1),
d AS (SELECT c.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1 : k] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[k + 1 : len(c.ws)]),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) AS cut FROM d) WHERE cut = 1),
o AS (SELECT lang, ws[i : i + z - 1] AS ws, max(f) AS longer FROM (SELECT *, unnest(range(1, len(ws) - z + 2)) AS i FROM (SELECT *, unnest(range(2, len(ws))) AS z FROM f WHERE len(ws) > 2)) GROUP BY ALL),
q AS (SELECT e.* FROM e LEFT JOIN o USING (lang, ws) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM k JOIN t USING (lang) WHERE rank <= 2000
"""

OP13_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, md5(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS turns FROM t GROUP BY conv_id),
h AS (SELECT *, CAST(xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
        lambda crc, b: list_reduce([xor(crc, b)] || list_transform(range(8), lambda i: CAST(i AS BIGINT)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS BIGINT) % 9 AS h FROM l),
r AS (SELECT c.conv_id, list_slice(coalesce(b.turns, []), 1, c.h) || list_slice(c.turns, c.h + 1, len(c.turns)) AS turns
      FROM h c LEFT JOIN l b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, len(turns) AS size, d AS depth, list_slice(turns, 1, d) AS prefix FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
n AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256,
             CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * strlen(prefix[-1].text) END AS own
      FROM p GROUP BY prefix, depth),
c AS (SELECT list_slice(prefix, 1, depth - 1) AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c USING (prefix)),
u AS (SELECT list_slice(prefix, 1, d) AS prefix, n_children = 0 AS leaf, own FROM (SELECT *, unnest(range(depth + 1)) AS d FROM m)),
s AS (SELECT prefix, count(*) FILTER (leaf) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM u GROUP BY prefix)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM m JOIN s USING (prefix) LEFT JOIN n up ON up.depth = m.depth - 1 AND up.prefix = list_slice(m.prefix, 1, m.depth - 1)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op11_collocations": OP11_SQL, "op13_prefix_trie": OP13_SQL}
