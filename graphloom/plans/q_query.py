"""Queries of vectors, contexts, fusion and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph, vectors
from ..operators.vector_index import VectorIndex, recall
from ..sources import datasets
from ..sources.store import Store, shared_dir
from . import evaluation as E
from . import fixtures as X
from . import retrieval as R

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with SQL for the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _vectors(s, d):
    return X.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _question(s, d):
    return X.read(s, d, "embeddings").where("vec_id = 7").first()["embedding"]


_Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7), v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_SIM = "list_inner_product(e, q) / sqrt(list_inner_product(e, e) * list_inner_product(q, q))"


@query(f"WITH {_Q} SELECT id, round({_SIM}, 6) AS similarity, round(1 - {_SIM}, 6) AS distance FROM v, q ORDER BY {_SIM} DESC, id LIMIT 20")
def vector_top_k(s, d):
    return vectors.top_k(_vectors(s, d), _question(s, d), 20).select("id", F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance"))


@query(f"WITH {_Q} SELECT id, round({_SIM}, 6) AS similarity FROM v, q WHERE {_SIM} >= 0.2 ORDER BY {_SIM} DESC, id LIMIT 50")
def vector_threshold(s, d):
    return vectors.top_k(_vectors(s, d), _question(s, d), 50, 0.2).select("id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_Q} SELECT id, round(list_inner_product(e, q), 6) AS similarity FROM v, q ORDER BY list_inner_product(e, q) DESC, id LIMIT 20")
def dot_top_k(s, d):
    return vectors.top_k(_vectors(s, d), _question(s, d), 20, measure="dot").select("id", F.round("similarity", 6).alias("similarity"))


@query("WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.id AS query_id, b.id, list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) AS s FROM v a, v b WHERE a.id % 100 = 0) SELECT query_id, id, round(s, 6) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 10")
def vector_top_k_batch(s, d):
    v = _vectors(s, d)
    queries = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    return vectors.top_k_each(v, queries, 10).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query("SELECT count(*) AS queries, 10 * count(*) AS wanted, TRUE AS reached FROM embeddings WHERE vec_id % 100 = 0 AND (SELECT count(*) FROM embeddings) >= 10")
def vector_index_recall(s, d):
    """Whether an index of all vectors finds at least nine in ten of the exact ten nearest of each query."""
    v = _vectors(s, d)
    queries = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = VectorIndex(Store(s, f"{shared_dir(s)}/index-{uuid.uuid4().hex}"))
    index.build(v)
    found = recall(index.search(queries, 10), vectors.top_k_each(v, queries, 10))
    return found.select("queries", "wanted", (F.col("recall") >= 0.9).alias("reached"))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 9 <> 0")
def vector_delete(s, d):
    v = _vectors(s, d)
    return v.join(v.where("id % 9 = 0").select("id"), "id", "left_anti").select("id")


def _retrievers(s, d):
    return X.read(s, d, "benchmark").select(F.col("item_id").alias("retriever_pos"), (1.0 / (F.col("item_id") % 5 + 1)).alias("weight"), F.concat("text", F.lit("\n\n"), F.lit("shared "), (F.col("item_id") % 3).cast("string"), F.lit("\n\n \n\nlast")).alias("result"))


_WHOLE = r"""w AS (SELECT item_id AS retriever_pos, 1.0 / (item_id % 5 + 1) AS weight, list_transform(string_split(text || chr(10) || chr(10) || 'shared ' || item_id % 3 || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || 'last', chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM benchmark),
p AS (SELECT * FROM (SELECT retriever_pos, weight, unnest(l) AS passage, unnest(range(len(l))) AS pos FROM w) WHERE passage <> '')"""


@query(f"WITH {_WHOLE} SELECT retriever_pos, pos, sha256(passage) AS passage FROM p ORDER BY weight DESC, retriever_pos, pos LIMIT 30")
def weighted_fusion(s, d):
    """Whole texts; each passage as its digest."""
    return vectors.weighted_fusion(_retrievers(s, d), 30).withColumn("passage", F.sha2("passage", 256))


@query(f"WITH {_WHOLE}, r AS (SELECT *, row_number() OVER (PARTITION BY retriever_pos ORDER BY pos) - 1 AS k FROM p) SELECT sha256(passage) AS passage, round(CAST(sum(weight / (k + 61)) AS DOUBLE), 9) AS score FROM r GROUP BY r.passage ORDER BY round(CAST(sum(weight / (k + 61)) AS DOUBLE), 12) DESC, min((retriever_pos, k)) LIMIT 12")
def rrf_fusion(s, d):
    """Whole texts; each passage as its digest."""
    return vectors.reciprocal_rank_fusion(_retrievers(s, d), 12).select(F.sha2("passage", 256).alias("passage"), F.round("score", 9).alias("score"))


@query()
def rerank(s, d):
    p = X.read(s, d, "benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("passage"))
    return vectors.rerank(p, "the of and in", vectors.overlap_scorer, 20).select("pos", "score")


@query()
def raptor_tree(s, d):
    leaves = X.read(s, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("node_id"), F.concat(F.lit("content "), F.col("vec_id").cast("string")).alias("content"), "embedding")
    return vectors.build_tree(leaves, levels=2).select("node_id", "parent_id", "level", F.length("content").alias("chars"))


def _graph(s, d):
    e = X.customer_edges(s, d).withColumn("description", F.concat(F.lit("knows through "), "chunk_id"))
    nodes = X.read(s, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("entity_name"), F.col("c_mktsegment").alias("entity_type"), F.concat(F.lit("of nation "), F.col("c_nationkey").cast("string")).alias("description"))
    hits = X.read(s, d, "customer").where("c_custkey between 1 and 20").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").alias("ord"))
    return nodes, e, hits


def _reports(s, d):
    """A report of each cluster of the customers' membership."""
    m = X.membership(s, d).groupBy("level", "cluster").agg(F.count("*").alias("n"))
    return m.select("cluster", "level", F.concat(F.lit("report on "), "cluster", F.lit(" with many words in it")).alias("report"), (F.col("n") % 11).cast("double").alias("rating"), (F.col("n") / 1000).alias("occurrence"))


_REPORTS = "reports AS (SELECT cluster, level, 'report on ' || cluster || ' with many words in it' AS report, CAST(count(*) % 11 AS DOUBLE) AS rating, count(*) / 1000 AS occurrence FROM membership GROUP BY level, cluster)"
_HITS = "hits AS (SELECT 'C' || c_custkey AS id, c_custkey AS ord FROM customer WHERE c_custkey BETWEEN 1 AND 20)"
_NTOK = "len(list_filter(string_split_regex({}, '[ \\t\\r\\n]+'), lambda x: x <> ''))"


@query(f"WITH {X.MEMBERSHIP}, {_REPORTS}, {_HITS}, c AS (SELECT cluster, count(*) AS hits FROM hits JOIN membership USING (id) WHERE level <= 1 GROUP BY cluster), r AS (SELECT cluster, hits, rating, {_NTOK.format('report')} + 1 AS t FROM c JOIN reports USING (cluster)) SELECT cluster, hits, rating FROM (SELECT *, sum(t) OVER (ORDER BY hits DESC, rating DESC, cluster ROWS UNBOUNDED PRECEDING) AS u FROM r) WHERE u <= 100")
def local_communities(s, d):
    _, _, hits = _graph(s, d)
    return R.related_communities(hits, X.membership(s, d), _reports(s, d).drop("level"), 1, 100).select("cluster", "hits", "rating")


_CHUNKS = "nc AS (SELECT src AS id, chunk_id FROM cedges UNION SELECT dst, chunk_id FROM cedges), b AS (SELECT src AS id, dst AS o, weight FROM cedges UNION ALL SELECT dst, src, weight FROM cedges)"


@query(f"""WITH {X.CUSTOMER_EDGES}, {_HITS}, {_CHUNKS}, own AS (SELECT chunk_id, min(ord) AS ord, arg_min(id, ord) AS id FROM hits JOIN nc USING (id) GROUP BY chunk_id),
sh AS (SELECT x.chunk_id, count(*) AS relations FROM (SELECT DISTINCT own.chunk_id, b.o FROM own JOIN b ON own.id = b.id) x JOIN nc ON nc.id = x.o AND nc.chunk_id = x.chunk_id GROUP BY 1),
t AS (SELECT own.chunk_id, ord, coalesce(relations, 0) AS relations, 4 + 1 AS c FROM own LEFT JOIN sh USING (chunk_id)) SELECT chunk_id, ord, relations FROM (SELECT *, sum(c) OVER (ORDER BY ord, relations DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS u FROM t) WHERE u <= 60""")
def local_text_units(s, d):
    _, e, hits = _graph(s, d)
    node_chunks = graph.both_ways(e, "chunk_id").select("id", "chunk_id").distinct()
    chunks = node_chunks.select("chunk_id").distinct().withColumn("content", F.concat(F.lit("three words "), "chunk_id", F.lit(" here")))
    return R.related_chunks(hits, node_chunks, e, chunks, 60).select("chunk_id", "ord", "relations")


@query(f"""WITH {X.CUSTOMER_EDGES}, {_HITS}, g AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM cedges UNION ALL SELECT dst FROM cedges) GROUP BY id),
e AS (SELECT src, dst, weight, a.n + b.n AS rank, 3 + 1 AS c FROM cedges JOIN g a ON src = a.id JOIN g b ON dst = b.id WHERE src IN (SELECT id FROM hits) OR dst IN (SELECT id FROM hits)) SELECT src, dst, weight, rank FROM (SELECT *, sum(c) OVER (ORDER BY rank DESC, weight DESC, src, dst ROWS UNBOUNDED PRECEDING) AS u FROM e) WHERE u <= 80""")
def local_relations(s, d):
    _, e, hits = _graph(s, d)
    return R.related_edges(hits, e, 80).select("src", "dst", "weight", "rank")


_CELL = "CASE WHEN regexp_matches({0}, '^[-+]?[0-9]*\\.?[0-9]+$') THEN {0} ELSE '\"' || {0} || '\"' END"


def _csv(*cells):
    return " || ',' || chr(9) || ".join(_CELL.format(f"CAST({c} AS VARCHAR)") for c in cells)


def _fenced(title, header, line, rows, order):
    head = " || ',' || chr(9) || ".join(f"'\"{h}\"'" for h in ["id", *header])
    return f"SELECT '-----{title}-----' || chr(10) || '```csv' || chr(10) || {head} || coalesce(chr(10) || string_agg({line}, chr(10) ORDER BY k), '') || chr(10) || '```' AS s FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS k FROM {rows})"


@query(f"""WITH {X.CUSTOMER_EDGES}, {X.MEMBERSHIP}, {_REPORTS}, {_HITS}, {_CHUNKS}, g AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM cedges UNION ALL SELECT dst FROM cedges) GROUP BY id),
rc AS (SELECT cluster, count(*) AS hits FROM hits JOIN membership USING (id) WHERE level <= 1 GROUP BY cluster),
r0 AS (SELECT *, sum({_NTOK.format('report')} + 1) OVER (ORDER BY hits DESC, rating DESC, cluster ROWS UNBOUNDED PRECEDING) AS u FROM rc JOIN reports USING (cluster)), r AS (SELECT * FROM r0 WHERE u <= 3200),
n AS (SELECT h.ord, c.c_name AS entity_name, c.c_mktsegment AS entity_type, 'of nation ' || c.c_nationkey AS description, coalesce(g.n, 0) AS degree FROM hits h JOIN customer c ON h.ord = c.c_custkey LEFT JOIN g ON g.id = h.id),
e0 AS (SELECT src, dst, weight, 'knows through ' || chunk_id AS description, a.n + b.n AS rank FROM cedges JOIN g a ON src = a.id JOIN g b ON dst = b.id WHERE src IN (SELECT id FROM hits) OR dst IN (SELECT id FROM hits)),
e AS (SELECT * FROM (SELECT *, sum({_NTOK.format('description')} + 1) OVER (ORDER BY rank DESC, weight DESC, src, dst ROWS UNBOUNDED PRECEDING) AS u FROM e0) WHERE u <= 4800),
own AS (SELECT chunk_id, min(ord) AS ord, arg_min(id, ord) AS id FROM hits JOIN nc USING (id) GROUP BY chunk_id),
sh AS (SELECT x.chunk_id, count(*) AS relations FROM (SELECT DISTINCT own.chunk_id, b.o FROM own JOIN b ON own.id = b.id) x JOIN nc ON nc.id = x.o AND nc.chunk_id = x.chunk_id GROUP BY 1),
c0 AS (SELECT own.chunk_id, ord, coalesce(relations, 0) AS relations, 'text of ' || own.chunk_id AS content FROM own LEFT JOIN sh USING (chunk_id)),
c AS (SELECT * FROM (SELECT *, sum({_NTOK.format('content')} + 1) OVER (ORDER BY ord, relations DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS u FROM c0) WHERE u <= 4000)
SELECT sha256(w.s || chr(10) || x.s || chr(10) || y.s || chr(10) || z.s) AS context FROM ({_fenced('Reports', ['content'], _csv('k', 'report'), 'r', 'hits DESC, rating DESC, cluster')}) w, ({_fenced('Entities', ['entity', 'type', 'description', 'rank'], _csv('k', 'entity_name', 'entity_type', 'description', 'degree'), 'n', 'ord')}) x,
({_fenced('Relationships', ['source', 'target', 'description', 'weight', 'rank'], _csv('k', 'src', 'dst', 'description', 'weight', 'rank'), 'e', 'rank DESC, weight DESC, src, dst')}) y, ({_fenced('Sources', ['content'], _csv('k', 'content'), 'c', 'ord, relations DESC, chunk_id')}) z""")
def local_context(s, d):
    nodes, e, hits = _graph(s, d)
    node_chunks = graph.both_ways(e, "chunk_id").select("id", "chunk_id").distinct()
    chunks = node_chunks.select("chunk_id").distinct().withColumn("content", F.concat(F.lit("text of "), "chunk_id"))
    told = graph.degrees(nodes.join(hits.select("id"), "id", "left_semi"), e)
    out = R.local_context(hits, nodes.join(told, "id"), R.related_communities(hits, X.membership(s, d), _reports(s, d).drop("level"), 1), R.related_edges(hits, e), R.related_chunks(hits, node_chunks, e, chunks))
    return out.select(F.sha2("context", 256).alias("context"))


@query(f"WITH {X.MEMBERSHIP}, {_REPORTS}, t AS (SELECT * FROM reports WHERE level <= 1 ORDER BY occurrence DESC, cluster LIMIT 60) SELECT cluster, round(occurrence, 6) AS occurrence, rating FROM t WHERE rating >= 3")
def global_select(s, d):
    r = _reports(s, d)
    out = R.global_selection(r.select("cluster", "level", "occurrence"), r.select("cluster", "rating", "report"), 1, 60, 3)
    return out.select("cluster", F.round("occurrence", 6).alias("occurrence"), "rating")


@query("""WITH p AS (SELECT item_id AS analyst, pos, 'point ' || item_id AS description, CASE WHEN pos = 1 THEN 1.0 ELSE CAST(item_id % 7 AS DOUBLE) END AS score FROM benchmark, (SELECT unnest([0, 1]) AS pos)) SELECT analyst, pos, description, score FROM (SELECT *, sum(3) OVER (ORDER BY score DESC, analyst, pos ROWS UNBOUNDED PRECEDING) AS u FROM p WHERE score > 0) WHERE u <= 90""")
def global_points_reduce(s, d):
    b = X.read(s, d, "benchmark")
    text = F.concat(F.lit("point "), F.col("item_id").cast("string"))
    answer = F.to_json(F.struct(F.array(F.struct(text.alias("description"), (F.col("item_id") % 7).cast("double").alias("score")), F.struct(text.alias("description"), F.lit(None).cast("double").alias("score")), F.struct(F.lit(None).cast("string").alias("description"), F.lit(9.0).alias("score"))).alias("points")))
    return R.reduce_points(b.select(F.col("item_id").alias("analyst"), answer.alias("answer")), 90)


@query("""WITH t AS (SELECT doc_id, text, len(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '')) + 1 AS c FROM documents WHERE doc_id % 100 = 3) SELECT sha256(string_agg(text, '--New Chunk--' || chr(10) ORDER BY doc_id)) AS context FROM (SELECT *, sum(c) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS u FROM t) WHERE u <= 1500""")
def naive_context(s, d):
    docs = X.documents(s, d)
    hits = docs.where("doc_id % 100 = 3").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("ord"))
    return R.naive_context(hits, docs.withColumnRenamed("doc_id", "chunk_id"), 1500).select(F.sha2("context", 256).alias("context"))


@query(f"""WITH {X.CUSTOMER_EDGES}, {_HITS}, b AS (SELECT src AS id FROM cedges UNION ALL SELECT dst FROM cedges) SELECT h.id, h.ord, c.c_name AS canonical_name, c.c_mktsegment AS entity_type, 'of nation ' || c_nationkey AS description, (SELECT count(*) FROM b WHERE b.id = h.id) AS neighbours FROM hits h JOIN customer c ON h.ord = c.c_custkey WHERE c_custkey % 4 <> 0""")
def grounded_context(s, d):
    nodes, e, hits = _graph(s, d)
    reg = nodes.where("cast(substr(id, 2) as int) % 4 <> 0").select(F.col("id").alias("entity_id"), F.col("entity_name").alias("canonical_name"), "entity_type", F.array().cast("array<string>").alias("aliases"))
    return R.grounded_context(hits, reg, nodes, e).select("id", "ord", "canonical_name", "entity_type", "description", "neighbours")


def _answers(s, d):
    n = X.read(s, d, "nation")
    answers = n.groupBy(F.col("n_regionkey").alias("answer_id")).agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 3 == 0, F.upper("n_name")))), "; ").alias("answer")).withColumn("answer", F.when(F.col("answer_id") % 2 == 0, F.regexp_replace("answer", "; ", " and ")).otherwise(F.col("answer")))
    got = n.select(F.col("n_regionkey").alias("answer_id"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("canonical_name"), F.array(F.lit("")).alias("aliases"))
    return R.validate_answer(answers, got)


_VALID = """a AS (SELECT n_regionkey AS answer_id, replace(string_agg(upper(n_name), '; ') FILTER (n_nationkey % 3 = 0), '; ', CASE WHEN n_regionkey % 2 = 0 THEN ' and ' ELSE '; ' END) AS answer FROM nation GROUP BY n_regionkey), r AS (SELECT answer_id, n_nationkey AS ord, n_name AS name, contains(lower(coalesce(answer, '')), lower(n_name)) AS hit, answer FROM nation JOIN a ON n_regionkey = answer_id)"""


@query(f"WITH {_VALID} SELECT answer_id, CAST(count(*) FILTER (hit) AS BIGINT) AS used, coalesce(CASE WHEN contains(any_value(answer), ' and ') THEN string_agg(name, ' and ' ORDER BY ord) FILTER (hit) ELSE string_agg(name, ', ' ORDER BY ord) FILTER (hit) END, '') AS answer FROM r GROUP BY answer_id")
def answer_validation(s, d):
    return _answers(s, d).drop("confidence")


@query(f"WITH {_VALID} SELECT answer_id, round(least(1.0, 0.4 * count(*) FILTER (hit) / count(*) + 0.6 * CASE WHEN count(*) FILTER (hit) > 0 THEN count(*) FILTER (hit AND ord < 10) / count(*) FILTER (hit) ELSE 0 END), 9) AS confidence FROM r GROUP BY answer_id")
def grounding_confidence(s, d):
    return _answers(s, d).select("answer_id", F.round("confidence", 9).alias("confidence"))


_ASKED = """q AS (SELECT conv_id, turn, CASE turn % 9 WHEN 0 THEN 'What do they have IN COMMON? ' WHEN 1 THEN 'Give a high-level broad view: ' WHEN 2 THEN 'Which authors are related to it? ' WHEN 3 THEN 'Main ideas across all? ' WHEN 4 THEN 'Who else also wrote ' ELSE '' END || text AS q FROM conversations)"""


def _score(patterns):
    return " + ".join(f"CAST(regexp_matches(q, '{p}', 'i') AS INT)" for p in patterns)


@query(f"WITH {_ASKED} SELECT conv_id, turn, CASE WHEN {_score(R.MULTIHOP)} >= 1 THEN 'multihop' WHEN {_score(R.OVERVIEW)} >= 1 THEN 'global' ELSE 'local' END AS mode FROM q")
def route_mode(s, d):
    """All turns as questions, some with a wording in front."""
    front = F.col("turn") % 9
    fronts = ("What do they have IN COMMON? ", "Give a high-level broad view: ", "Which authors are related to it? ", "Main ideas across all? ", "Who else also wrote ")
    asked = F.concat(F.coalesce(*[F.when(front == i, t) for i, t in enumerate(fronts)], F.lit("")), "text")
    return X.read(s, d, "conversations").select("conv_id", "turn", R.route(asked).alias("mode"))


@query("SELECT conv_id, hop, pos, sha256(content) AS content FROM (SELECT *, sum(length(content) // 4) OVER (PARTITION BY conv_id ORDER BY hop DESC, pos ROWS UNBOUNDED PRECEDING) AS u FROM (SELECT conv_id, turn AS hop, turn AS pos, text AS content FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, left(text, 80) ORDER BY turn DESC) = 1)) WHERE u <= 50")
def multihop_merge(s, d):
    """Whole turns; each as its digest."""
    c = X.read(s, d, "conversations").select("conv_id", F.col("turn").alias("hop"), F.col("turn").alias("pos"), F.col("text").alias("content"))
    return R.merge_hops(c, 50, ["conv_id"]).withColumn("content", F.sha2("content", 256))


#: Letters beyond ASCII become word characters that no name has, as this engine's word ends know ASCII only.
_PLAIN = r"regexp_replace(p, '[^\x00-\x7F\P{L}]', '_', 'g')"
_NAMES = rf"""list_distinct(flatten(list_transform(string_split(t, chr(10) || chr(10)), lambda p: list_concat(regexp_extract_all(p, '"([^"]+)"', 1), list_filter(regexp_extract_all({_PLAIN}, '\b([A-Z][a-z]+)\b', 1), lambda w: w NOT IN ('The', 'This', 'That', 'These', 'Those', 'A', 'An')), regexp_extract_all({_PLAIN}, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b', 1)))))"""


@query(f"WITH d AS (SELECT doc_id, coalesce(text, '') || ' by \"' || lang || '\" in New York City' AS t FROM documents) SELECT doc_id, CAST(len({_NAMES}) AS BIGINT) AS n, sha256(array_to_string(list_sort({_NAMES}), '|')) AS names FROM d")
def entity_harvest(s, d):
    """Names of whole documents; the list as its digest."""
    found = R.harvest(F.concat(F.coalesce("text", F.lit("")), F.lit(' by "'), "lang", F.lit('" in New York City')))
    return X.read(s, d, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.sha2(F.array_join(F.array_sort(found), "|"), 256).alias("names"))


@query(r"""WITH q AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN [text, 'second'] ELSE list_filter(list_transform(string_split('1. ' || text || chr(10) || '- two' || chr(10) || chr(10), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s*([-*]|\d+[.)])\s*', ''), '\s+$', '')), lambda x: x <> '') END AS l FROM conversations)
SELECT conv_id, turn, CAST(len(l) AS BIGINT) AS n, sha256(array_to_string(l, '|')) AS questions FROM q""")
def question_decomposition(s, d):
    """Turns as questions in a JSON array, or as a list of lines; the list as its digest."""
    answer = F.when(F.col("turn") % 2 == 0, F.to_json(F.array("text", F.lit("second")))).otherwise(F.concat(F.lit("1. "), "text", F.lit("\n- two\n\n")))
    got = R.sub_questions(answer)
    return X.read(s, d, "conversations").select("conv_id", "turn", F.size(got).cast("long").alias("n"), F.sha2(F.array_join(got, "|"), 256).alias("questions"))


@query(f"WITH {X.CUSTOMER_EDGES}, {X.MEMBERSHIP} SELECT level, cluster, count(*) AS nodes FROM membership WHERE level = 1 GROUP BY 1, 2")
def community_pack_rows(s, d):
    nodes, e, _ = _graph(s, d)
    m = X.membership(s, d).where("level = 1")
    kept, _ = R.pack_communities(m, graph.degrees(nodes, e).join(nodes, "id"), e, 1_000_000)
    return kept.groupBy("level", "cluster").agg(F.count("*").alias("nodes"))


@query(f"WITH {X.MEMBERSHIP}, {_REPORTS}, s AS (SELECT 0 AS level, split_part(cluster, '-', 1) AS cluster, cluster AS sub, occurrence, {_NTOK.format('report')} + 1 AS c FROM reports WHERE level = 1) SELECT level, cluster, sub FROM (SELECT *, sum(c) OVER (PARTITION BY cluster ORDER BY occurrence DESC, sub ROWS UNBOUNDED PRECEDING) AS u FROM s) WHERE u <= 100")
def sub_report_pack(s, d):
    m = X.membership(s, d)
    return R.pack_sub_reports(graph.sub_communities(m), _reports(s, d).drop("level"), m, 100)[0].select("level", "cluster", "sub")


@query("SELECT item_id, '# T' || item_id || chr(10) || chr(10) || 'sum' || chr(10) || chr(10) || '## a' || chr(10) || chr(10) || 'b' AS report FROM benchmark")
def report_markdown(s, d):
    r = F.struct(F.concat(F.lit("T"), F.col("item_id").cast("string")).alias("title"), F.lit("sum").alias("summary"), F.array(F.struct(F.lit("a").alias("summary"), F.lit("b").alias("explanation"))).alias("findings"))
    return X.read(s, d, "benchmark").select("item_id", R.report_text(r).alias("report"))


def _qa(s, d):
    a = X.read(s, d, "conversations")
    p = a.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prediction"))
    return a.join(p, ["conv_id", "turn"]).select("conv_id", "turn", "role", F.when(F.col("turn") % 3 == 0, F.col("prediction")).otherwise(F.concat(F.lit("The "), "text")).alias("gold"), F.when(F.col("turn") % 2 == 0, F.col("prediction")).otherwise(F.col("text")).alias("prediction"))


_QA = r"""qa AS (SELECT a.conv_id, a.turn, a.role, CASE WHEN a.turn % 3 = 0 THEN p.text ELSE 'The ' || a.text END AS gold, CASE WHEN a.turn % 2 = 0 THEN p.text ELSE a.text END AS prediction FROM conversations a JOIN conversations p ON a.conv_id = p.conv_id AND a.turn = p.turn + 1),
w AS (SELECT *, list_transform(list_filter(string_split_regex(prediction, '[^\p{L}\p{N}_]+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), lambda x: lower(x)) AS p, list_transform(list_filter(string_split_regex(gold, '[^\p{L}\p{N}_]+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), lambda x: lower(x)) AS g,
list_filter(string_split_regex(lower(prediction), '[^\p{L}\p{N}_]+'), lambda x: x NOT IN ('', 'a', 'an', 'the')) AS lp, list_filter(string_split_regex(lower(gold), '[^\p{L}\p{N}_]+'), lambda x: x NOT IN ('', 'a', 'an', 'the')) AS lg FROM qa),
m AS (SELECT conv_id, turn, role, CAST(array_to_string(lp, ' ') = array_to_string(lg, ' ') AS DOUBLE) AS em, CASE WHEN len(list_distinct(g)) = 0 THEN CAST(len(p) = 0 AS DOUBLE) WHEN len(list_intersect(p, g)) = 0 THEN 0.0 ELSE 2.0 * len(list_distinct(list_intersect(p, g))) / (len(list_distinct(p)) + len(list_distinct(g))) END AS f1 FROM w)"""


@query(f"WITH {_QA} SELECT conv_id, turn, em FROM m")
def exact_match(s, d):
    return _qa(s, d).select("conv_id", "turn", E.exact_match(F.col("prediction"), F.col("gold")).alias("em"))


@query(f"WITH {_QA} SELECT conv_id, turn, round(f1, 9) AS f1 FROM m")
def token_f1(s, d):
    return _qa(s, d).select("conv_id", "turn", F.round(E.token_f1(F.col("prediction"), F.col("gold")), 9).alias("f1"))


@query(f"WITH {_QA} SELECT role, metric, round(score, 9) AS score FROM (SELECT role, 'em' AS metric, avg(em) AS score FROM m GROUP BY role UNION ALL SELECT role, 'f1', avg(f1) FROM m GROUP BY role)")
def metric_means(s, d):
    rows = _qa(s, d).select("role", E.exact_match(F.col("prediction"), F.col("gold")).alias("em"), E.token_f1(F.col("prediction"), F.col("gold")).alias("f1"))
    return E.metric_means(rows, ["role"], ["em", "f1"]).withColumn("score", F.round("score", 9))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1.0 ELSE (CAST(contains(lower(text), 'the ') AS INT) + CAST(contains(lower(text), 'queau') AS INT) + CAST(contains(lower(text), 'zzzz') AS INT)) / 3 END AS recall FROM documents")
def context_recall(s, d):
    facts = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("THE "), F.lit("Queau"), F.lit("zzzz")))
    return X.read(s, d, "documents").select("doc_id", E.context_recall(F.col("text"), facts).alias("recall"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 1.0 ELSE 0.5 END AS overlap FROM nation")
def entity_overlap(s, d):
    got = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lower("n_name"), F.lit("X"))).otherwise(F.array(F.lit("x")))
    return X.read(s, d, "nation").select("n_nationkey", E.entity_overlap(got, F.array(F.upper("n_name"), F.lit("x"))).alias("overlap"))


@query("WITH a AS (SELECT event_type AS mode, 'v' AS metric, avg(value) AS s FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS mode, avg(value) AS s FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT mode, metric, round(a.s, 6) AS a, round(b.s, 6) AS b, round(b.s - a.s, 6) AS delta FROM a JOIN b USING (mode)")
def experiment_delta(s, d):
    run = lambda k: X.read(s, d, "events").where(f"event_id % 2 = {k}").groupBy(F.col("event_type").alias("mode"), F.lit("v").alias("metric")).agg(F.avg("value").alias("score"))
    return E.experiment_delta(run(0), run(1)).select("mode", "metric", *[F.round(c, 6).alias(c) for c in ("a", "b", "delta")])


@query("WITH d AS (SELECT event_type, value * (1 + user_id % 3 * 0.01) - value AS d FROM events) SELECT event_type, count(*) AS n, round(avg(d), 6) AS delta, abs(avg(d)) / sqrt(var_samp(d) / count(*)) > 1.96 AS significant FROM d GROUP BY 1")
def paired_significance(s, d):
    pairs = X.read(s, d, "events").select("event_type", F.col("value").alias("a"), (F.col("value") * (1 + F.col("user_id") % 3 * 0.01)).alias("b"))
    return E.paired_significance(pairs, ["event_type"]).withColumn("delta", F.round("delta", 6))


@query("SELECT count(DISTINCT md5(CAST(user_id AS VARCHAR))) AS entries, count(DISTINCT event_type) AS models, round(avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 9) AS hit_rate FROM events")
def cache_stats(s, d):
    e = X.read(s, d, "events").select(F.md5(F.col("user_id").cast("string")).alias("args_hash"), F.col("event_type").alias("model"), (F.col("event_id") % 3 == 0).alias("hit"))
    return E.cache_stats(e).withColumn("hit_rate", F.round("hit_rate", 9))


@query("SELECT event_id FROM events WHERE user_id % 4 <> 0")
def cache_misses(s, d):
    e = X.read(s, d, "events").withColumn("args_hash", F.md5(F.col("user_id").cast("string")))
    return E.cache_lookup(e, e.where("user_id % 4 = 0").select("args_hash").distinct().withColumn("answer", F.lit("x")))[1].select("event_id")


@query("WITH r AS (SELECT event_type AS dataset, user_id AS run_id, ts AS mtime, CASE WHEN event_id % 2 = 0 THEN 'naive' ELSE 'local' END AS mode, value AS score FROM events), l AS (SELECT dataset, arg_max(run_id, (mtime, run_id)) AS run_id FROM r GROUP BY 1), g AS (SELECT dataset, run_id, max(score) FILTER (mode = 'naive') AS n, max(score) FILTER (mode <> 'naive') AS score FROM r JOIN l USING (dataset, run_id) GROUP BY 1, 2) SELECT dataset, run_id, score, round(score - n, 6) AS delta, score > n AS won FROM g")
def runs_latest(s, d):
    e = X.read(s, d, "events").select(F.col("event_type").alias("dataset"), F.col("user_id").alias("run_id"), F.col("ts").alias("mtime"), F.when(F.col("event_id") % 2 == 0, "naive").otherwise("local").alias("mode"), F.col("value").alias("score"))
    return E.latest_runs(e).withColumn("delta", F.round("delta", 6))


@query("SELECT md5(lang) AS id, lang AS title, length(lang) + 1 + length(arg_min(text, doc_id)) AS chars FROM documents GROUP BY lang")
def corpus_flatten_distinct(s, d):
    rows = X.read(s, d, "documents").select(F.col("doc_id").alias("pos"), F.array(F.struct(F.col("lang").alias("title"), F.array("text").alias("sentences"))).alias("context"))
    return datasets.distinct_contexts(rows).select("id", "title", F.length("content").alias("chars"))


@query("SELECT 'doc_' || (2 * item_id + k) AS id, 't' || k AS title FROM benchmark, (SELECT unnest([0, 1]) AS k)")
def corpus_positions(s, d):
    row = lambda k: F.struct(F.lit(f"t{k}").alias("title"), F.col("text").alias("body"))
    rows = X.read(s, d, "benchmark").select(F.col("item_id").alias("pos"), F.array(row(0), row(1)).alias("context"))
    return datasets.running_contexts(rows).select("id", "title")


# second names of queries that took prefixes of the texts before
for _f in (weighted_fusion, rrf_fusion, multihop_merge):
    QUERIES[f"{_f.__name__}_all"], SQL[f"{_f.__name__}_all"] = _f, SQL[_f.__name__]
