"""Queries of the training-data operators over the tables of a directory, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bestfit_packing import pack
from .decontaminate import contamination
from .exact_dedup import exact_duplicates
from .jaccard_join import near_duplicates
from .kneser_ney import lm_scores
from .license_scan import license_scan
from .line_chunks import deduplicate_lines, deduplicate_passages
from .merkle_manifest import manifest, without_line_ends
from .quality_fm import quality_scores
from .source_mix import taken
from .token_alignment import aligned
from .token_count import token_counts, zipf_vocabulary
from .tool_chat import TURN_TOOLS, link_calls, turn_calls

#: The public vocabulary whose pieces token counts use; no public file here holds a unigram model.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The public byte-level tokenizer for packing and alignment.
BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL has: places and labels of the base phrases."""
    return license_scan(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL has: sizes and targets."""
    return taken(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def op2_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as its digest and length."""
    linked = link_calls(*turn_calls(read(spark, sf_dir, "conversations")), TURN_TOOLS)
    return linked.select("conv_id", "call_id", "turn", "name", "depth", "status", "valid", F.sha2("line", 256).alias("line_sha256"), F.length("line").cast("long").alias("line_chars"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), zipf_vocabulary(VOCABULARY))


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each remaining text as its digest."""
    out = deduplicate_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "removed_chunks", "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each remaining text as its digest."""
    out = deduplicate_passages(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(read(spark, sf_dir, "documents")).drop("row", "source")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents")).drop("chunks")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=3, num=9, den=10).select("doc_id", "n_shingles", "component_id")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("row_key")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))


def op11_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), BYTE_TOKENIZER)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(read(spark, sf_dir, "documents"), BYTE_TOKENIZER, VOCABULARY)[0]


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified against texts that lost their line ends."""
    return manifest(read(spark, sf_dir, "documents"), without_line_ends())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_tool_chat": op2_tool_chat,
    "op4_token_counts": op4_token_counts,
    "op5_line_chunks": op5_line_chunks,
    "line_passages": line_passages,
    "op3_source_mix": op3_source_mix,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_decontamination": op9_decontamination,
    "op10_lm_scores": op10_lm_scores,
    "op11_bestfit_packing": op11_bestfit_packing,
    "op12_token_alignment": op12_token_alignment,
    "op13_merkle_manifest": op13_merkle_manifest,
    "license_phrases": license_phrases,
    "mix_targets": mix_targets,
}

SQL: dict[str, str] = {
    "license_phrases": r"""
WITH p AS (SELECT * FROM (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) t(g, label)),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, label, unnest(list_filter(range(1, len(w) - len(g) + 2), lambda i: list_slice(w, i, i + len(g) - 1) = g)) - 1 AS i FROM d, p WHERE len(w) >= len(g)),
a AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN a ON d.doc_id = a.doc_id
""",
    "mix_targets": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\t-\r]+'), lambda x: x <> '')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w FROM d GROUP BY source),
u AS (SELECT 0 AS k, (SELECT 1.5 * sum(n) / sum(w) FROM s) AS unit
  UNION ALL SELECT k + 1, (SELECT (1.5 * sum(n) - coalesce(sum(2 * n) FILTER (2 * n < unit * w), 0)) / sum(w) FILTER (2 * n >= unit * w) FROM s) FROM u WHERE k < 50 AND unit IS NOT NULL),
l AS (SELECT max_by(unit, k) AS unit FROM u WHERE unit IS NOT NULL)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, round(least(2 * n, unit * w), 6) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, l
""",
    "op6_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\t-\r]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, n.h AS text_sha256 FROM n JOIN g ON n.h = g.h
""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text,
  list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)) % 2 = 1 AS even FROM documents),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(t) || ':' || t, '-')) AS other FROM (SELECT *, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS t FROM d)),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l),
t AS (SELECT 0 AS k, source, i, leaf AS h, n FROM p
  UNION ALL SELECT k + 1, source, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY k, source, i // 3, n),
r AS (SELECT source, h AS subroot, k AS height, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS k, i, subroot AS h, n FROM r
  UNION ALL SELECT k + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY k, i // 3, n),
s AS (SELECT p.doc_id, p.source, p.i, t.k, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < p.i // CAST(pow(3, t.k) AS BIGINT)), '') AS a, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > p.i // CAST(pow(3, t.k) AS BIGINT)), '') AS b
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source AND t.n > 1 AND t.i // 3 = p.i // CAST(pow(3, t.k + 1) AS BIGINT) GROUP BY p.doc_id, p.source, p.i, t.k
  UNION ALL SELECT p.doc_id, p.source, p.i, r.height + u.k, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < r.i // CAST(pow(3, u.k) AS BIGINT)), ''), coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > r.i // CAST(pow(3, u.k) AS BIGINT)), '')
  FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source JOIN u ON u.n > 1 AND u.i // 3 = r.i // CAST(pow(3, u.k + 1) AS BIGINT) GROUP BY p.doc_id, p.source, p.i, r.height, u.k),
f AS (SELECT source, i, 0 AS k, other AS h FROM p
  UNION ALL SELECT f.source, f.i, f.k + 1, sha256(s.a || f.h || s.b) FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source AND f.i = s.i AND f.k = s.k),
g AS (SELECT source, i, max_by(h, k) AS folded_root FROM f GROUP BY source, i),
x AS (SELECT source, i, sha256(string_agg(a || b, '' ORDER BY k)) AS proof_sha256 FROM s GROUP BY source, i)
SELECT p.doc_id, p.leaf, r.subroot, u.h AS root, coalesce(x.proof_sha256, sha256('')) AS proof_sha256, g.folded_root, g.folded_root = u.h AS verified
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source JOIN u ON u.n = 1 JOIN g ON p.source IS NOT DISTINCT FROM g.source AND p.i = g.i LEFT JOIN x ON p.source IS NOT DISTINCT FROM x.source AND p.i = x.i
""",
    "op9_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, list_slice(w, i, i + m - 1) AS g FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bs)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, list_slice(w, i, i + m - 1) AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
h AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
""",
    "op2_tool_chat": r"""
WITH RECURSIVE u AS (SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS call_id, length(coalesce(text, '')) AS chars, turn // 2 - (turn // 2) % 2 AS half, turn // 2 < turn AS has FROM conversations WHERE role = 'user'),
f AS (SELECT conv_id, call_id, min({'turn': turn, 'name': CASE WHEN chars % 3 = 0 THEN 'outline' ELSE 'lookup' END, 'chars': chars, 'half': half, 'has': has}) AS c, count(*) AS n FROM u GROUP BY conv_id, call_id),
q AS (SELECT conv_id, call_id, c.turn AS turn, c.name AS name, c.chars AS chars, c.has AS has, CASE WHEN c.has THEN 'c' || conv_id || '-' || c.half END AS before, n FROM f),
d AS (SELECT q.conv_id, q.call_id, 0 AS depth FROM q LEFT JOIN q b ON q.conv_id = b.conv_id AND q.before = b.call_id WHERE b.call_id IS NULL
  UNION ALL SELECT q.conv_id, q.call_id, d.depth + 1 FROM q JOIN d ON q.conv_id = d.conv_id AND q.before = d.call_id WHERE q.before <> q.call_id),
r AS (SELECT conv_id, 'c' || conv_id || '-' || (turn - 1) AS call_id, min({'turn': turn, 'content': md5(coalesce(text, ''))}).content AS content, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
l AS (SELECT q.conv_id, q.call_id, q.turn, q.name, CAST(d.depth AS BIGINT) AS depth, CASE WHEN q.n > 1 OR r.n > 1 THEN 'repeated' WHEN r.n IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  q.has OR q.name = 'lookup' AS valid,
  '{"arguments":{' || CASE WHEN q.has THEN '"after":["' || q.before || '"],' ELSE '' END || '"chars":' || q.chars || ',"turn":' || q.turn || '},"call_id":"' || q.call_id || '","content":' || coalesce('"' || r.content || '"', 'null') || ',"name":"' || q.name || '"}' AS line
  FROM q LEFT JOIN d ON q.conv_id = d.conv_id AND q.call_id = d.call_id LEFT JOIN r ON q.conv_id = r.conv_id AND q.call_id = r.call_id)
SELECT conv_id, call_id, turn, name, depth, status, valid, sha256(line) AS line_sha256, length(line) AS line_chars FROM l
""",
    "op5_line_chunks": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
h AS (SELECT doc_id, w, list_transform(w, lambda x: CAST('0x' || substr(md5(x), 1, 6) AS BIGINT)) AS h FROM d),
r AS (SELECT doc_id, w, list_transform(range(1, len(w)), lambda i: (h[i] * 257 + h[i + 1]) % 3) AS r FROM h),
e AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: i = len(w) OR r[i] <> v) AS e FROM r, (VALUES (0), (1), (2)) AS classes(v)),
c AS (SELECT doc_id, w, least(unnest(e) + 1, len(w)) AS z, greatest(unnest(list_prepend(0, e[:-2])) - 1, 0) AS a FROM e),
k AS (SELECT DISTINCT doc_id, a, z - a AS n, array_to_string(list_slice(w, a + 1, z), chr(10)) AS t FROM c WHERE z - a > 1 AND strlen(array_to_string(list_slice(w, a + 1, z), chr(10))) >= 16),
m AS (SELECT doc_id, a, n FROM (SELECT doc_id, a, n, row_number() OVER (PARTITION BY t ORDER BY doc_id, a) AS r FROM k) WHERE r > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(a + 1, a + n + 1)) AS i FROM m),
x AS (SELECT doc_id, count(*) AS chunks FROM m GROUP BY doc_id),
l AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d)
SELECT l.doc_id, count(*) AS n_lines, coalesce(any_value(chunks), 0) AS removed_chunks, count(g.i) AS removed_lines, sha256(coalesce(string_agg(l.x, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '')) AS text_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i LEFT JOIN x ON l.doc_id = x.doc_id GROUP BY l.doc_id
""",
    "line_passages": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
p AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
g AS (SELECT doc_id, i FROM r UNION SELECT doc_id, i + 1 FROM r),
l AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d)
SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS removed_lines, sha256(coalesce(string_agg(x, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '')) AS text_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
""",
}
