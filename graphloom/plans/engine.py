"""The engine: a corpus indexed into versioned tables, incremental updates, and the query modes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.model import AnswerCache
from ..functions.tokens import Tokenizer, size_by
from ..operators import chunking, clustering, extraction, graph, merge, registry, tables, vectors
from ..operators.vector_index import VectorIndex
from ..sources.store import Change, Conflict, Store, materialize, scratch
from . import answers, reports, retrieval

DOCUMENTS = "doc_id string, content string, content_hash string, extraction_hash string"
IDENTITIES = "entity_id string, entity_name string, canonical_id string"
FAILED = "doc_id string, chunk_id string, attempts int, error string"

#: What is said without an answer.
FAIL = "Sorry, I'm not able to provide an answer to that question."
UNGROUNDED = "I don't have enough information to answer this question."


def _no_names() -> Column:
    return F.array().cast("array<string>")


def fingerprint(value) -> str:
    """A text that differs between functions of different code, defaults or enclosed values; other callables go by their type and attributes, a `version` among them if they have one."""
    code = getattr(value, "__code__", None)
    if code is not None:
        inner = [fingerprint(c) if hasattr(c, "co_code") else repr(c) for c in code.co_consts]
        enclosed = []
        for cell in value.__closure__ or ():
            try:
                enclosed.append(fingerprint(cell.cell_contents))
            except ValueError:  # not bound yet
                enclosed.append("")
        return repr(("function", code.co_code.hex(), code.co_names, inner, enclosed, [fingerprint(d) for d in value.__defaults__ or ()]))
    if hasattr(value, "co_code"):
        return repr((value.co_code.hex(), value.co_names, [fingerprint(c) if hasattr(c, "co_code") else repr(c) for c in value.co_consts]))
    if hasattr(value, "func") and hasattr(value, "args"):  # a partial
        return repr((fingerprint(value.func), value.args, sorted((value.keywords or {}).items())))
    if isinstance(value, type) or not callable(value):
        return repr(value)
    kept = {k: v for k, v in vars(value).items() if isinstance(v, str | int | float | bool | tuple)} if hasattr(value, "__dict__") else {}
    return repr((type(value).__module__, type(value).__qualname__, sorted(kept.items())))


@dataclass
class QueryParam:
    """Limits of a query. Names and defaults of the public interface."""

    mode: str = "global"
    only_need_context: bool = False
    response_type: str = "Concise Answer"
    level: int = 2
    top_k: int = 20
    naive_max_token_for_text_unit: int = 12000
    local_max_token_for_text_unit: int = 4000
    local_max_token_for_local_context: int = 4800
    local_max_token_for_community_report: int = 3200
    local_community_single_one: bool = False
    global_min_community_rating: float = 0
    global_max_consider_community: int = 512
    global_max_token_for_community_report: int = 16384

    @classmethod
    def of(cls, values: dict) -> QueryParam:
        """Only the fields that this class has; others belong to other modes."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})


@dataclass
class Grounding:
    """Limits of grounded answers."""

    max_answer_length: int = 50
    require_entity_match: bool = True
    fuzzy_match_threshold: float = 0.85
    fallback_message: str = UNGROUNDED


@dataclass
class Hops:
    """Limits of multi-hop retrieval."""

    max_hops: int = 4
    entities_per_hop: int = 10
    context_token_budget: int = 8000


@dataclass
class GroundedAnswer:
    answer: str
    entity_ids: list[str] = field(default_factory=list)
    canonical_entities: list[str] = field(default_factory=list)
    confidence: float = 0.0
    raw_response: str | None = None
    validation_errors: list[str] = field(default_factory=list)


@dataclass
class Config:
    chunk_tokens: int = 1200
    chunk_overlap: int = 100
    tokenizer: Tokenizer | None = None
    extraction_batch: int = 5
    quality: str = "balanced"
    resolutions: tuple[float, ...] = (2.0, 1.0, 0.5)
    cluster_seed: int = 0xDEADBEEF
    max_incremental_updates: int = 10
    modularity_drop: float = 0.1
    enable_local: bool = True
    enable_communities: bool = True
    enable_naive_rag: bool = True
    embed: Callable = field(default_factory=vectors.hashing_embedder)
    extractor: Callable = extraction.offline_extractor
    gleaning: int = 0
    glean_more: Callable[[str], bool] | None = None
    grouped_extraction: bool = False
    aliases: Callable | None = None
    link_entities: bool = False
    link_decider: Callable | None = None
    summarise: Callable | None = None
    summary_tokens: int = 500
    reporter: Callable = reports.offline_reporter
    report_tokens: int = 12000
    global_mapper: Callable = answers.offline_mapper
    answer: Callable[[str], str] = lambda prompt: prompt[:500]
    answer_stream: Callable[[str], Iterator[str]] | None = None
    cache_answers: bool = False
    frontier_limit: float = 0.5
    grounding: Grounding = field(default_factory=Grounding)
    hops: Hops = field(default_factory=Hops)
    api_key: str | None = None
    most_attempts: int = 10
    buckets: int = 32
    keep_states: int = 5
    vector_index: bool = False
    index_probes: int | None = None

    def __post_init__(self):
        if self.quality not in ("fast", "balanced", "thorough"):
            raise ValueError(f"quality: {self.quality}")
        if not 0 <= self.chunk_overlap < self.chunk_tokens:
            raise ValueError("chunk_overlap must be smaller than chunk_tokens")

    def facts_hash(self) -> str:
        """A digest of all that shapes a document's facts: functions by their code, defaults and enclosed values, and the settings of chunking and extraction."""
        shapes = ("chunk_tokens", "chunk_overlap", "quality", "extractor", "gleaning", "glean_more", "grouped_extraction", "aliases", "link_entities", "link_decider", *(["tokenizer"] if self.tokenizer else []))
        return hashlib.sha256(repr([(n, fingerprint(getattr(self, n))) for n in shapes]).encode()).hexdigest()

    def for_logs(self) -> dict:
        """Values with keys hidden and functions by name."""
        show = lambda k, v: "***" if v and "key" in k else getattr(v, "__name__", type(v).__name__) if callable(v) else v
        return {f.name: show(f.name, getattr(self, f.name)) for f in fields(self)}


class Engine:
    """Tables of a corpus in a store, and queries over them. An insert publishes all its tables at once or none."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        self.store = Store(spark, path, self.config.buckets)

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.store.read(name) if self.store.has(name) else self._empty(schema)

    def insert(self, texts: list[str] | str) -> int:
        """Insert strings; equal ones and those already there change nothing. Returns how many documents were processed."""
        rows = [(t,) for t in ([texts] if isinstance(texts, str) else texts)]
        known = self._read("documents", DOCUMENTS).select("doc_id")
        return self.insert_documents(tables.insert_strings(self.spark.createDataFrame(rows, "content string"), known))

    def _retrying(self, work: Callable[[Change], int | None], tries: int = 5) -> int:
        """work(change) and its publication, begun anew on the newest state if another writer was there first. None: nothing to publish."""
        for turn in range(tries):
            with scratch(self.spark):
                change = self.store.change()
                n = work(change)
                if n is None:
                    return 0
                try:
                    change.publish()
                except Conflict:
                    if turn == tries - 1:
                        raise
                    continue
            self.store.vacuum(self.config.keep_states)
            return n
        raise AssertionError

    def insert_documents(self, docs: DataFrame, force: bool = False, also: Callable[[Change], None] | None = None) -> int:
        """Insert or replace docs(doc_id, content): only new, changed and reconfigured ones are chunked and extracted again, and only what their old and new facts touch is merged, embedded, clustered and reported again.

        Chunks whose model call fails are kept in failed_chunks with the error, and each later insert asks
        for them first, up to most_attempts times. Returns how many documents got facts or lost them.
        also: what else to write in the same change.
        """
        return self._retrying(lambda change: self._insert(change, docs, force, also))

    def _insert(self, change: Change, docs: DataFrame, force: bool, also: Callable[[Change], None] | None) -> int | None:
        c = self.config
        stored = change.read("documents") if change.has("documents") else self._empty(DOCUMENTS)
        mark = c.facts_hash()
        todo = materialize(tables.changes(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content"), stored, mark, force).where("status <> 'unchanged'"))
        ids = todo.select("doc_id")
        failed = change.read("failed_chunks") if change.has("failed_chunks") else self._empty(FAILED)
        again = materialize(failed.where(F.col("attempts") < c.most_attempts).join(ids, "doc_id", "left_anti"))
        n, n_again = todo.count(), again.select("doc_id").distinct().count()
        if not n and not n_again:
            if also is None:
                return None
            also(change)
            return 0
        chunks = chunking.with_chunk_ids(chunking.token_windows(todo, c.chunk_tokens, c.chunk_overlap, c.tokenizer)).withColumn("attempts", F.lit(0))
        if n_again:
            kept = change.read("chunks").join(again.select("doc_id", "chunk_id", "attempts"), ["doc_id", "chunk_id"])
            chunks = kept.select(*chunks.columns).unionByName(chunks)
        told, entities, rels = extraction.extract(materialize(chunks), c.extractor, c.extraction_batch, c.gleaning, c.glean_more, c.grouped_extraction)
        entities, rels = extraction.fact_ids(entities, rels)
        if c.link_entities and change.has("entities"):
            entities, rels = registry.apply_links(entities, rels, registry.link_manifest(entities, self.registry(), decide=c.link_decider))
        fact_e = materialize(entities.select("doc_id", "chunk_id", "ord", "entity_id", "entity_name", "entity_type", "description"))
        fact_r = materialize(rels.select("doc_id", "chunk_id", "ord", "relationship_id", F.col("src_id").alias("src"), F.col("tgt_id").alias("tgt"), "relation_type", "description", "weight"))
        change.merge("documents", todo.select("doc_id", "content", "content_hash", F.lit(mark).alias("extraction_hash")), "doc_id", ids)
        fresh = told.join(ids, "doc_id", "left_semi").select("doc_id", "chunk_id", "chunk_order_index", "tokens", "content")
        change.merge("chunks", fresh, "doc_id", ids)
        still = told.where("output is null").select("doc_id", "chunk_id", (F.col("attempts") + 1).alias("attempts"), "error")
        change.merge("failed_chunks", still, "doc_id", ids.union(again.select("doc_id")))
        if c.aliases:  # a document's aliases are part of its facts, so they go with it
            by = ["doc_id", "entity_id"]
            found = extraction.extract_aliases(fact_e, told.select("chunk_id", "content"), c.aliases, by=by).groupBy(*by).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
            fact_e = materialize(fact_e.join(found, by, "left").withColumn("aliases", F.coalesce("aliases", _no_names())))
        vec = materialize(vectors.embed(fresh.select(F.col("chunk_id").alias("id"), "doc_id", "content"), "content", c.embed).drop("content"))
        change.merge("chunk_vectors", vec, "doc_id", ids)
        self._index(change, "chunk_vectors", vec, ids)
        self._facts(change, ids, fact_e, fact_r)
        if also:
            also(change)
        return n + n_again

    def _index(self, change: Change, name: str, fresh: DataFrame, gone: DataFrame) -> None:
        """Bring the index of a vector table up to date, before or after the table itself: gone(doc_id or entity id) leave it, fresh(id, embedding) come in."""
        if not self.config.vector_index:
            return
        index = VectorIndex(self.store, f"{name}_index")
        if not change.has(f"{name}_index_centres"):
            index.build(fresh, change=change)
            return
        if "doc_id" in gone.columns:
            gone = self.store.read(name).join(gone, "doc_id", "left_semi").select("id")
        index.delete(gone, change)
        index.add(fresh, change)

    def delete_documents(self, ids: DataFrame) -> int:
        """Take documents of ids(doc_id) out, and all that only they contributed. Returns how many there were."""

        def work(change: Change) -> int | None:
            if not change.has("documents"):
                return None
            gone = materialize(change.read("documents").join(ids.select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", "left_semi").select("doc_id"))
            n = gone.count()
            if not n:
                return None
            self._index(change, "chunk_vectors", change.read("chunk_vectors").limit(0), gone)
            for name in ("documents", "chunks", "chunk_vectors", "failed_chunks"):
                change.merge(name, change.read(name).limit(0), "doc_id", gone)
            self._facts(change, gone, change.read("doc_entity").limit(0), change.read("doc_relationship").limit(0))
            return n

        return self._retrying(work)

    def _facts(self, change: Change, ids: DataFrame, fact_e: DataFrame, fact_r: DataFrame) -> None:
        """Put facts in place of those of the documents ids(doc_id), bring the contribution index up to date by the difference, and derive what the old and new facts touch."""
        if "aliases" not in fact_e.columns:
            fact_e = fact_e.withColumn("aliases", _no_names())
        had = change.has("doc_entity")
        old_e = materialize(change.read("doc_entity").join(ids, "doc_id", "left_semi")) if had else fact_e.limit(0)
        old_r = materialize(change.read("doc_relationship").join(ids, "doc_id", "left_semi")) if had else fact_r.limit(0)
        change.merge("doc_entity", fact_e, "doc_id", ids)
        change.merge("doc_relationship", fact_r, "doc_id", ids)
        was, now = materialize(merge.contributions(old_e, old_r)), materialize(merge.contributions(fact_e, fact_r))
        if change.has("contributions"):  # chunks that were asked again add to what their documents have
            index = change.read("contributions")
            same = now.join(was, was.columns, "left_anti").join(index, was.columns, "left_semi")
            now = materialize(now.join(same, was.columns, "left_anti"))
        change.merge("contributions", now, "key", was)
        touched = materialize(old_e.select("entity_id", "entity_name").union(fact_e.select("entity_id", "entity_name")).distinct())
        ends = materialize(old_r.select("src", "tgt").union(fact_r.select("src", "tgt")).distinct())
        self._derive(change, touched, ends)

    def _combined(self, e: DataFrame) -> DataFrame:
        nodes = merge.combine_entities(merge.accumulate_entities(e))
        c = self.config
        if c.summarise:
            short, long_ = merge.needs_summary(nodes, size_by(c.tokenizer)(F.col("description")), c.summary_tokens)
            told = extraction.call_model(long_, F.col("description"), c.summarise).withColumn("description", F.coalesce("output", "description"))
            nodes = short.drop("tokens").unionByName(told.drop("tokens", "output", "error"))
        return nodes

    def _links(self, r: DataFrame) -> DataFrame:
        """(src, dst, weight, description, chunk_ids): relationships between two entities as one undirected edge."""
        ends = r.where("src <> tgt").withColumnRenamed("tgt", "dst")
        return graph.canonical(ends).groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.array_join(F.array_sort(F.collect_set("description")), "<SEP>").alias("description"))

    def _regrouped(self, change: Change, touched: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(facts, old, new) of all entities that the ids and names of touched(entity_id, entity_name) belong to: their facts as documents told them, and their identities before and after.

        An identity group holds all names of its ids, so the groups that a touched id or name is in are closed
        together with touched itself: no other document's id can join or leave them.
        """
        known = change.read("identities")
        met = known.join(touched.select("entity_id").distinct(), "entity_id", "left_semi").select("canonical_id").union(known.join(touched.select("entity_name").distinct(), "entity_name", "left_semi").select("canonical_id")).distinct()
        old = materialize(known.join(met, "canonical_id", "left_semi").select(known.columns))
        ids = materialize(old.select("entity_id").union(touched.select("entity_id")).distinct())
        facts = materialize(change.read("doc_entity").join(self._documents_of(change, ids), "doc_id", "left_semi").join(ids, "entity_id", "left_semi"))
        return facts, old, materialize(merge.identities(facts, old))

    def _documents_of(self, change: Change, ids: DataFrame) -> DataFrame:
        """(doc_id): documents with facts of ids(entity_id), as the contribution index says."""
        keys = ids.select(F.concat(F.lit("entity::"), "entity_id").alias("key"))
        return change.read("contributions").join(keys, "key", "left_semi").select("doc_id").distinct()

    def _derive(self, change: Change, touched: DataFrame | None = None, ends: DataFrame | None = None) -> None:
        """Write the tables that follow from the facts. touched(entity_id, entity_name), ends(src, tgt): what a change may have altered; without them all is made anew.

        Facts keep the ids that documents told; identities says which of them are one entity. Ids that a
        change gives another canonical id take along the relationships that other documents have with them.
        """
        c = self.config
        e, r = change.read("doc_entity"), change.read("doc_relationship")
        partly = touched is not None and change.has("entities") and change.has("identities")
        if not partly:
            same = materialize(merge.identities(e, change.read("identities") if change.has("identities") else self._empty(IDENTITIES)))
            for name in ("identities", "entities", "relationships", "entity_vectors"):
                change.state.pop(name, None)
            change.merge("identities", same, "entity_id")
            remap = materialize(merge.remap_of(same))
            nodes, links = materialize(self._combined(merge.remap_entities(e, remap))), self._links(merge.remap_relationships(r, remap))
            changed, gone_nodes, gone_links = nodes.select("entity_id"), None, None
        else:
            before = materialize(merge.remap_of(change.read("identities")))
            facts, old, same = self._regrouped(change, touched)
            change.merge("identities", same, "entity_id", old)
            remap = materialize(merge.remap_of(change.read("identities")))
            nodes = materialize(self._combined(merge.remap_entities(facts, remap)))
            now = same.select("entity_id", F.col("canonical_id").alias("now")).distinct()
            moved = materialize(old.select("entity_id", "canonical_id").distinct().join(now, "entity_id").where("canonical_id <> now").select("entity_id"))
            if not moved.isEmpty():
                theirs = r.join(self._documents_of(change, moved), "doc_id", "left_semi").select("src", "tgt")
                at = lambda end: theirs.join(moved.withColumnRenamed("entity_id", end), end, "left_semi").select("src", "tgt")
                ends = materialize(ends.union(at("src")).union(at("tgt")).distinct())
            pair = lambda m: graph.canonical(merge.remap_relationships(ends, m).withColumnRenamed("tgt", "dst"))
            pairs = materialize(pair(before).union(pair(remap)).distinct())
            near = graph.canonical(merge.remap_relationships(r, remap).withColumnRenamed("tgt", "dst")).join(pairs, ["src", "dst"], "left_semi").withColumnRenamed("dst", "tgt")
            links = self._links(near)
            changed = materialize(old.select("canonical_id").union(same.select("canonical_id")).distinct().withColumnRenamed("canonical_id", "entity_id"))
            gone_nodes, gone_links = changed, pairs
        rows = nodes.select(F.col("entity_id").alias("id"), F.concat_ws(" - ", "entity_name", "description").alias("content"))
        vec = materialize(vectors.embed(rows, "content", c.embed).drop("content"))
        if not partly:
            change.state.pop("entity_vectors_index_centres", None)
        self._index(change, "entity_vectors", vec, changed.select(F.col("entity_id").alias("id")))
        change.merge("entities", nodes, "entity_id", gone_nodes)
        change.merge("relationships", links, "src", gone_links)
        change.merge("entity_vectors", vec, "id", gone_nodes.withColumnRenamed("entity_id", "id") if partly else None)
        if not c.enable_communities:  # neither clusters nor reports; naive, grounded and rank-based retrieval need none
            if change.has("community_sums"):  # of an earlier graph from now on: the next clustering is a full one
                change.state.pop("community_sums")
            return
        nodes, links = change.read("entities"), change.read("relationships")
        ids = nodes.select(F.col("entity_id").alias("id"))
        membership, only = self._clustered(change, ids, links, changed.withColumnRenamed("entity_id", "id") if partly else None)
        node_chunks = merge.remap_entities(e, remap).select(F.col("entity_id").alias("id"), "chunk_id").distinct()
        schema = materialize(graph.community_counts(membership, links, node_chunks))
        told = graph.degrees(ids, links).join(nodes.withColumnRenamed("entity_id", "id"), "id")
        subs = graph.sub_communities(membership)
        report = reports.community_reports(membership, told, links, schema, subs, c.reporter, c.report_tokens, change.read("reports") if only is not None else None, only, size_by(c.tokenizer))
        change.put("membership", membership)
        change.put("communities", schema)
        change.put("reports", report)

    def _clustered(self, change: Change, ids: DataFrame, links: DataFrame, changed: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """(membership, clusters to report again or None for all): the changed nodes' surroundings alone if they are few, else all.

        The first level's modularity is kept by sums a cluster, which a change brings up to date from its own
        edges and nodes. If it is more than modularity_drop below that of the last full run, all is clustered
        anew. Writes community_sums and clustering(updates, modularity, baseline).
        """
        c = self.config
        first = lambda m: m.where("level = 0").select("id", "cluster")
        if changed is not None and all([change.has(n) for n in ("membership", "clustering", "community_sums")]):
            stored, last = change.read("membership"), change.read("clustering").first()
            old = stored.join(ids, "id", "left_semi").select("id", "level", "cluster")
            updates = last.updates
            reached = materialize(graph.frontier(ids, links, changed))
            choice = graph.incremental_choice(ids, reached, old.where("level = 0").select("id"), updates, c.frontier_limit, c.max_incremental_updates).first()
            if choice.incremental:
                now = materialize(clustering.incremental_leiden(ids, links, old, changed, updates + 1, seed=c.cluster_seed))
                before = self.store._table("relationships", change.base_state["relationships"])
                sums = materialize(graph.updated_sums(change.read("community_sums"), before, links, first(stored), first(now), changed))
                worth = graph.modularity_of(sums).first().modularity
                if last.baseline is None or worth is None or worth >= last.baseline - c.modularity_drop:
                    self._clustering_state(change, sums, updates + 1, worth, last.baseline)
                    moved = clustering.affected_clusters(stored, now)
                    near = now.join(changed, "id", "left_semi").select("cluster")
                    return now, materialize(moved.union(near).distinct())
        whole = materialize(clustering.leiden(ids, links, c.resolutions, c.cluster_seed))
        sums = materialize(graph.modularity_sums(links, first(whole)))
        worth = graph.modularity_of(sums).first().modularity
        self._clustering_state(change, sums, 0, worth, worth)
        return whole, None

    def _clustering_state(self, change: Change, sums: DataFrame, updates: int, worth: float | None, baseline: float | None) -> None:
        change.put("community_sums", sums)
        change.put("clustering", self.spark.createDataFrame([(updates, worth, baseline)], "updates long, modularity double, baseline double"))

    def append(self, docs: DataFrame, extractor: Callable | None = None) -> int:
        """Documents and chunks that the store doesn't have yet, extracted by a function of one's own; clusters and reports are made anew. Changed documents are not looked for."""
        known = self._read("documents", "doc_id string").select("doc_id")
        fresh = materialize(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content").join(known, "doc_id", "left_anti"))
        kept, self.config.extractor = self.config.extractor, extractor or self.config.extractor
        try:
            n = self.insert_documents(fresh)
        finally:
            self.config.extractor = kept
        if n:
            self.rebuild()
        return n

    def rebuild(self) -> int:
        """Derive everything from the stored facts again, without extraction."""
        self._retrying(lambda change: self._derive(change) or 0)
        return self.store.snapshot()

    def contributions(self) -> DataFrame:
        """(key, doc_id): which documents contribute to each entity, entity name and relationship, as kept by the changes."""
        return self.store.read("contributions")

    def _remap(self) -> DataFrame:
        """(old_id, new_id): ids that facts have and entities don't."""
        return merge.remap_of(self._read("identities", IDENTITIES))

    def _entity_facts(self) -> DataFrame:
        """Entity facts under canonical ids."""
        return merge.remap_entities(self.store.read("doc_entity"), self._remap())

    def integrity(self) -> tuple[int, int]:
        """(expected, found): distinct entities of the facts, and how many of them the graph has."""
        row = merge.integrity(self._entity_facts(), self.store.read("entities").withColumnRenamed("entity_id", "id")).first()
        return row.expected, row.found

    def _hits(self, name: str, question: str, k: int) -> DataFrame:
        vector = [float(x) for x in self.config.embed([question])[0]]
        if self.config.vector_index and self.store.has(f"{name}_index_centres"):
            asked = self.spark.createDataFrame([(0, vector)], "query_id int, embedding array<double>")
            top = VectorIndex(self.store, f"{name}_index").search(asked, k, self.config.index_probes)
        else:
            top = vectors.top_k(self.store.read(name), vector, k)
        return top.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")) - 1).select("id", "ord")

    def context(self, question: str, param: QueryParam) -> str | None:
        s, p = self.store, param
        if p.mode == "naive":
            if not self.config.enable_naive_rag:
                raise ValueError("naive mode is off")
            hits = self._hits("chunk_vectors", question, p.top_k).withColumnRenamed("id", "chunk_id")
            return retrieval.naive_context(hits, s.read("chunks"), p.naive_max_token_for_text_unit, size_by(self.config.tokenizer)).first()["context"] or None
        if p.mode == "global":
            if not self.config.enable_communities:
                raise ValueError("global mode is off")
            return self._global_points(question, p)
        if p.mode == "multihop":
            return self._hop_context(question, p)
        if p.mode == "entity_grounded":
            found = self.grounded_rows(question, p.top_k)
            return answers.entity_list(found) if found else None
        if p.mode != "local":
            raise ValueError(f"mode: {p.mode}")
        if not self.config.enable_local or not self.config.enable_communities:
            raise ValueError("local mode is off")
        hits = materialize(self._hits("entity_vectors", question, p.top_k))
        if not hits.limit(1).count():
            return None
        edges = s.read("relationships")
        nodes = s.read("entities").withColumnRenamed("entity_id", "id")
        nodes = graph.degrees(nodes, edges).join(nodes, "id")
        node_chunks = self._entity_facts().select(F.col("entity_id").alias("id"), "chunk_id").distinct()
        found = retrieval.related_communities(hits, s.read("membership"), s.read("reports").select("cluster", "report", "rating"), p.level, p.local_max_token_for_community_report, p.local_community_single_one, size_by(self.config.tokenizer))
        chunks = retrieval.related_chunks(hits, node_chunks, edges, s.read("chunks"), p.local_max_token_for_text_unit, size_by(self.config.tokenizer))
        return retrieval.local_context(hits, nodes, found, retrieval.related_edges(hits, edges, p.local_max_token_for_local_context, size_by(self.config.tokenizer)), chunks).first()["context"]

    def _global_points(self, question: str, p: QueryParam) -> str | None:
        """Points that the map model makes of groups of reports within the budget, best first."""
        s = self.store
        chosen = retrieval.global_selection(s.read("communities").select("level", "cluster", "occurrence"), s.read("reports").select("cluster", "rating", "report"), p.level, p.global_max_consider_community, p.global_min_community_rating)
        return answers.global_points(materialize(chosen), question, self.config.global_mapper, p.global_max_token_for_community_report, size_by(self.config.tokenizer))

    def _hop_context(self, question: str, p: QueryParam) -> str | None:
        """Contexts of the question's parts, asked one after the other; names found by one go with the next."""
        h, states, carry = self.config.hops, [], []
        for part in answers.decompose(question, self.config.answer, h.max_hops):
            local = QueryParam(mode="local", only_need_context=True, top_k=h.entities_per_hop, level=p.level)
            asked = f"{part} ({', '.join(carry)})" if carry else part
            pieces, names = answers.hop_pieces(self.context(asked, local) or "")
            carry = names[: h.entities_per_hop]
            states.append(pieces)
        return answers.merge_hop_texts(self.spark, states, h.context_token_budget) or None

    def grounded_rows(self, question: str, top_k: int = 30, mode: str = "local") -> list:
        """Entities for a question, at most top_k, in order: nearest by vector, with neighbours for mode multihop, or those named in it for naive."""
        s = self.store
        if mode == "naive":
            found = registry.mentions(self.spark.createDataFrame([(0, question)], "text_id int, text string"), self.registry())
            hits = found.join(self.registry(), "entity_id").select(F.col("entity_id").alias("id"), F.col("canonical_name").alias("name"))
            order = Window.orderBy("name")
            hits = hits.withColumn("ord", F.row_number().over(order) - 1).select("id", "ord")
        else:
            hits = materialize(self._hits("entity_vectors", question, top_k))
            if mode == "multihop":
                near = graph.both_ways(s.read("relationships")).join(hits, "id").select(F.col("other").alias("id"), (F.col("ord") + top_k).alias("ord"))
                hits = hits.select("id", "ord").union(near).groupBy("id").agg(F.min("ord").alias("ord")).orderBy("ord", "id").limit(top_k)
        nodes = s.read("entities").withColumnRenamed("entity_id", "id")
        return retrieval.grounded_context(hits, self.registry(), nodes, s.read("relationships")).orderBy("ord", "id").collect()

    def grounded(self, question: str, top_k: int = 30, mode: str = "local") -> GroundedAnswer:
        """An answer that names entities found for the question only, by their canonical names."""
        g = self.config.grounding
        rows = self.grounded_rows(question, top_k, mode)
        if not rows:
            return GroundedAnswer(g.fallback_message, validation_errors=["No entities retrieved"])
        raw = self._answer(answers.grounded_prompt(question, rows, g.fallback_message)).strip()
        used = answers.named_in(raw, rows)
        errors = []
        if not used and g.require_entity_match:
            errors.append("Answer does not reference any retrieved entities")
            known = {r.entity_id: r.canonical_name for r in self.registry().join(registry.mentions(self.spark.createDataFrame([(0, raw)], "text_id int, text string"), self.registry()), "entity_id").collect()}
            used = sorted(known.items(), key=lambda x: x[1])
            if not used:
                return GroundedAnswer(g.fallback_message, raw_response=raw, validation_errors=errors)
        text = answers.joined(raw, [name for _, name in used])
        score = answers.confidence([i for i, _ in used], [r.id for r in rows])
        return GroundedAnswer(text, [i for i, _ in used], [n for _, n in used], score, raw if raw != text else None, errors)

    def _answer(self, prompt: str) -> str:
        """The model's answer, kept in the store if the config says so."""
        if not self.config.cache_answers:
            return self.config.answer(prompt)
        rows = self.spark.createDataFrame([(prompt,)], "p string")
        ask = lambda todo, text: self.spark.createDataFrame([(r.args_hash, self.config.answer(r.prompt)) for r in todo.collect()], "args_hash string, output string")
        return AnswerCache(self.store).call(rows, F.col("p"), ask).first().output

    def _prompt(self, question: str, context: str, param: QueryParam) -> str:
        return f"{context}\n\nQuestion: {question}\nForm: {param.response_type}"

    def query(self, question: str, param: QueryParam | None = None) -> str:
        """The answer of the configured model to a question and its context, or the context itself."""
        param = param or QueryParam()
        if param.mode == "entity_grounded" and not param.only_need_context:
            return self.grounded(question, param.top_k).answer
        context = self.context(question, param)
        if context is None:
            return FAIL
        return context if param.only_need_context else self._answer(self._prompt(question, context, param))

    def stream(self, question: str, param: QueryParam | None = None) -> Iterator[str]:
        """The same answer piece by piece as a streaming model gives it; a model that doesn't stream, or a grounded answer, which is checked whole, comes in one piece."""
        param = param or QueryParam()
        if self.config.answer_stream is None or param.mode == "entity_grounded" or param.only_need_context:
            yield self.query(question, param)
            return
        context = self.context(question, param)
        yield from [FAIL] if context is None else self.config.answer_stream(self._prompt(question, context, param))

    def registry(self) -> DataFrame:
        """Entities by name with their aliases."""
        return self.store.read("entities").select("entity_id", F.col("entity_name").alias("canonical_name"), "entity_type", F.create_map().cast("map<string,string>").alias("metadata"), F.xxhash64("entity_id").alias("reg_order"), "aliases")

    def mentioned(self, text: str) -> list[str]:
        """Names of known entities in a text."""
        found = registry.mentions(self.spark.createDataFrame([(0, text)], "text_id int, text string"), self.registry())
        return sorted(r.canonical_name for r in found.join(self.registry(), "entity_id").select("canonical_name").collect())
