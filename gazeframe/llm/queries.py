"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeframe.llm.quality import (
    CLASS_LEAST_CHARS,
    CLASS_LIMIT,
    COMMON,
    LEAST_WORDS,
    MOST_REPEATED_PERCENT,
    WORD_LEAST_WORDS,
    WORD_LIMIT,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.near_dedup import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


@_query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.quality import judge

    judged = judge(_documents(spark, sf_dir))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


@_query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.pii import find_pii

    return find_pii(_documents(spark, sf_dir))


@_query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.mixing import mix_copies

    return mix_copies(_documents(spark, sf_dir)).drop("key")


@_query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.packing import pack

    return pack(_documents(spark, sf_dir))


@_query
def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.substrings import remove_repeats

    return remove_repeats(_documents(spark, sf_dir)).drop("kept_text")


@_query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.sharding import shard

    return shard(_documents(spark, sf_dir)).select("row.doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@_query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.secret_scan import find_secrets

    return find_secrets(_documents(spark, sf_dir))


@_query
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(_documents(spark, sf_dir))


@_query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.warc import archive_round_trip

    return archive_round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query
def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.line_dedup import drop_shared_lines

    rest = drop_shared_lines(_documents(spark, sf_dir))
    return rest.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@_query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.alignment import align

    return align(_documents(spark, sf_dir), digest=True).documents.withColumnRenamed("groups", "groups_sha256")


@_query
def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.conversations import family_trie

    return family_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).nodes


# --- SQL, where SQL can say it ----------------------------------------------------------

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op1_substrings"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM d) s),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS n FROM wins) s WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS cut_at FROM later, range(20) AS r(k) GROUP BY doc_id),
cut AS (SELECT d.doc_id, w, coalesce(cut_at, []) AS cut_at FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, len(cut_at)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda v, i: NOT list_contains(cut_at, i)), ' ')) AS kept_sha256 FROM cut"""

ORACLES["op4_near_dedup"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0) q),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
walk AS (SELECT DISTINCT a AS doc_id, a AS seen FROM edges UNION SELECT w.doc_id, e.b FROM walk w JOIN edges e ON e.a = w.seen),
least_ AS (SELECT doc_id, min(seen) AS c FROM walk GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_ USING (doc_id)""".replace("both AS (", "both_ AS (")

ORACLES["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
f AS (SELECT *, CASE WHEN size >= 100 THEN min(page_id) OVER (PARTITION BY body) ELSE page_id END AS first FROM p)
SELECT page_id, size::BIGINT AS payload_bytes, sha256(body) AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""


_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES["op11_lines"] = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, {_BLANK}), '{_UPPER}', '{_LOWER}') AS x FROM l),
hot AS (SELECT x, max(doc_id) AS last FROM k WHERE length(x) >= 20 GROUP BY x HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, last IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN hot USING (x))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id"""


# A checksum bit by bit: a byte, then eight shifts for it.
_CRC32 = """xor(4294967295::UBIGINT, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda c: [ascii(c)::BIGINT] || list_resize([]::BIGINT[], 8, -1))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)::UBIGINT)"""

ORACLES["op13_trie"] = f"""
WITH own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS l FROM conversations
  WHERE conv_id IS NOT NULL GROUP BY conv_id),
headed AS (SELECT conv_id, l, conv_id - conv_id % 5 AS base, ({_CRC32} % 9)::BIGINT AS h FROM own),
rebuilt AS MATERIALIZED (SELECT a.conv_id, coalesce(b.l, [])[:a.h] || a.l[a.h + 1:] AS l FROM headed a LEFT JOIN own b ON b.conv_id = a.base),
numbered AS (SELECT conv_id, l, d, CASE WHEN d > 0 THEN octet_length(encode(l[d].t)) ELSE 0 END AS bytes
  FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM rebuilt) s),
member AS MATERIALIZED (SELECT conv_id, d, len(l) = d AS ends, bytes, sha256(l[:d]::VARCHAR || '/' || list_transform(l[:d], lambda x: len(x.r))::VARCHAR
  || list_transform(l[:d], lambda x: len(x.t))::VARCHAR) AS key FROM numbered),
node AS MATERIALIZED (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM member GROUP BY d, key),
edge AS (SELECT DISTINCT c.d, c.key, p.key AS up FROM member c JOIN member p ON p.conv_id = c.conv_id AND p.d = c.d - 1),
kids AS (SELECT d - 1 AS d, up AS key, count(*) AS k FROM edge GROUP BY ALL),
full_ AS MATERIALIZED (SELECT node.*, coalesce(k, 0) AS k, up FROM node LEFT JOIN kids USING (d, key) LEFT JOIN edge USING (d, key)),
above AS (SELECT DISTINCT a.d AS ad, a.key AS akey, m.d, m.key FROM member m JOIN member a ON a.conv_id = m.conv_id AND a.d <= m.d),
sums AS (SELECT ad AS d, akey AS key, sum((k = 0)::INT) AS leaves, sum((n - 1) * f.bytes) AS saved FROM above JOIN full_ f USING (d, key) GROUP BY ALL)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n::BIGINT AS n_convs, f.k::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, f.ends_sha256 FROM full_ f JOIN sums USING (d, key) LEFT JOIN full_ p ON p.d = f.d - 1 AND p.key = f.up"""


def _distance_sql(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of shares; 0 if either is all zero."""
    half = lambda x: f"list_sum(list_transform(list_zip({p}, {q}), lambda z: CASE WHEN z[{x}] > 0 THEN z[{x}] * log2(z[{x}] / ((z[1] + z[2]) / 2)) ELSE 0 END))"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, ({half(1)} + {half(2)}) / 2)) ELSE 0 END"


_COMMON_VALUES = ", ".join(f"('{k}', {i}, '{w}')" for k, v in COMMON.items() for i, w in enumerate(v.split()))
_UNION = sorted({w for v in COMMON.values() for w in v.split()}, key=lambda w: w.encode())
_COMMON_VALUES += "".join(f", ('', {i}, '{w}')" for i, w in enumerate(_UNION))
_LEFT = lambda kept: f"length(regexp_replace(t, '[^{kept}]', '', 'g'))"
_ASCII_SIX = "a-zA-Z0-9 \\t\\n\\x0B\\f\\r.,;:?''\"()!-"
_SHARE = lambda h: f"CASE WHEN list_sum({h}) > 0 THEN list_transform({h}, lambda v: v / list_sum({h})) ELSE {h} END"

ORACLES["op8_quality"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang,
    CASE WHEN lower(lang)[:2] IN ({", ".join(f"'{k}'" for k in COMMON)}) THEN lower(lang)[:2] ELSE '' END AS kind FROM documents),
words AS MATERIALIZED (SELECT *, regexp_extract_all(t, '{_WORD}') AS w FROM d),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, w FROM words) s),
fives AS (SELECT doc_id, i, {" || ' ' || ".join(f"lead(word, {k}) OVER o" for k in range(5))} AS x FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
grams AS MATERIALIZED (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM fives WHERE x IS NOT NULL),
twice AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM grams, range(5) AS r(k) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) s
  WHERE regexp_matches(x, '{_WORD}') GROUP BY doc_id),
base AS MATERIALIZED (SELECT words.*, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN twice USING (doc_id) LEFT JOIN lines USING (doc_id)),
classes AS MATERIALIZED (SELECT doc_id, list_transform([{_LEFT("a-z")}, {_LEFT("A-Z")}, {_LEFT("0-9")}, {_LEFT(" \\t\\n\\x0B\\f\\r")},
    {_LEFT(".,;:?''\"()-")}, {_LEFT("!")}, length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')),
    length(regexp_replace(t, '[{_ASCII_SIX}]|[^\\x00-\\x7F]', '', 'g'))], lambda v: v::DOUBLE) AS h FROM d),
listed(kind, k, word) AS (VALUES {_COMMON_VALUES}),
hits AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, kind, unnest(regexp_extract_all(translate(t, '{_UPPER}', '{_LOWER}'), '{_WORD}')) AS word FROM d) s
  JOIN listed USING (kind, word) GROUP BY ALL),
slots AS (SELECT doc_id, k, coalesce(n, 0)::DOUBLE AS n FROM (SELECT doc_id, k FROM d JOIN listed USING (kind)) s LEFT JOIN hits USING (doc_id, k)),
found AS (SELECT doc_id, list(n ORDER BY k) AS h, sum(n) AS total FROM slots GROUP BY doc_id),
both_ AS MATERIALIZED (SELECT b.*, {_SHARE("c.h")} AS p, {_SHARE("list_append(f.h, n_words - f.total)")} AS q, list_sum(c.h) AS chars
  FROM base b JOIN classes c USING (doc_id) JOIN found f USING (doc_id)),
refs AS (SELECT lang, list(m ORDER BY i) AS m FROM (SELECT lang, i, round(avg(p[i]), 12) AS m FROM both_, range(1, 9) AS r(i) GROUP BY ALL) s GROUP BY lang),
word_refs AS (SELECT lang, list(m ORDER BY i) AS m FROM (SELECT lang, i, round(avg(q[i]), 12) AS m FROM (SELECT lang, q, unnest(range(1, len(q) + 1)) AS i FROM both_) s
  GROUP BY ALL) s GROUP BY lang),
shares AS MATERIALIZED (SELECT b.*, {_SHARE("r.m")} AS rp, {_SHARE("x.m")} AS rq FROM both_ b JOIN refs r USING (lang) JOIN word_refs x USING (lang)),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed,
    CASE WHEN chars >= {CLASS_LEAST_CHARS} THEN {_distance_sql("p", "rp")} ELSE 0 END AS far_p,
    CASE WHEN n_words >= {WORD_LEAST_WORDS} THEN {_distance_sql("q", "rq")} ELSE 0 END AS far_q FROM shares)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND far_p <= {CLASS_LIMIT} AND far_q <= {WORD_LIMIT} AS kept,
  round(far_p, 6) AS class_distance, round(far_q, 6) AS word_distance FROM judged"""
