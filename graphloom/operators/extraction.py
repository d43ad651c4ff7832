"""Chunks to facts: parsers of extraction output, and model calls in batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import COMPLETE_MARK, RECORD_MARK, TUPLE_MARK, UNKNOWN_TYPE, clean, entity_id, entity_name, entity_type, is_number, relationship_id, split_markers, strip
from ..sources.store import materialize


def parse_records(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of texts(doc_id, chunk_id, output), the tuple format of extraction prompts.

    entities: doc_id, chunk_id, ord, entity_name, entity_type, description, implicit; endpoints of
    relationships that no earlier record of the chunk names become implicit entities of unknown type,
    described by the relationship. relationships: doc_id, chunk_id, ord, src, tgt, relation_type,
    description, weight.
    """
    # cut once: what an explode gives is no expression that later filters and columns evaluate again
    records = F.transform(split_markers(F.col("output"), [RECORD_MARK, COMPLETE_MARK]), lambda r: split_markers(F.regexp_extract(r, r"\((.*)\)", 1), [TUPLE_MARK]))
    is_entity = lambda a: (F.size(a) >= 4) & (F.try_element_at(a, F.lit(1)) == '"entity"')
    is_rel = lambda a: (F.size(a) >= 5) & (F.try_element_at(a, F.lit(1)) == '"relationship"')
    row = lambda i, place, implicit, name, kind, text: F.struct(i.cast("long").alias("ord"), F.lit(place).alias("place"), F.lit(implicit).alias("implicit"), name.alias("entity_name"), kind.alias("entity_type"), text.alias("description"))
    end = lambda a, i, place: row(i, place, True, entity_name(a[place + 1]), F.lit(UNKNOWN_TYPE), clean(a[3]))
    named = lambda a, i: F.when(is_entity(a), F.array(row(i, 0, False, entity_name(a[1]), entity_type(a[2]), clean(a[3])))).when(is_rel(a), F.array(end(a, i, 0), end(a, i, 1)))
    rows = texts.select("doc_id", "chunk_id", F.explode(F.transform(records, named)).alias("rows")).select("doc_id", "chunk_id", F.inline("rows"))

    def link(a: Column, i: Column) -> Column:
        last = F.element_at(a, -1)
        weight = F.when(is_number(last), last.try_cast("double")).otherwise(F.lit(1.0))
        return F.when(is_rel(a), F.struct(i.cast("long").alias("ord"), entity_name(a[1]).alias("src"), entity_name(a[2]).alias("tgt"), F.lit("RELATED").alias("relation_type"), clean(a[3]).alias("description"), weight.alias("weight")))

    links = texts.select("doc_id", "chunk_id", F.explode(F.transform(records, link)).alias("r")).where("r is not null")
    return _first_named(rows.where("implicit or entity_name <> ''")), links.select("doc_id", "chunk_id", "r.*")


def with_endpoints(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """entities with an implicit one for each endpoint of rels that nothing before it in its chunk names."""
    ends = rels.select("doc_id", "chunk_id", "ord", F.posexplode(F.array("src", "tgt")).alias("place", "entity_name"), F.lit(UNKNOWN_TYPE).alias("entity_type"), "description")
    return _first_named(entities.withColumns({"place": F.lit(0), "implicit": F.lit(False)}).unionByName(ends.withColumn("implicit", F.lit(True))))


def _first_named(rows: DataFrame) -> DataFrame:
    """rows without implicit entities that something before them in their chunk names, and without their place."""
    window = Window.partitionBy("doc_id", "chunk_id", "entity_name").orderBy("ord", "place").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("seen", F.count("*").over(window)).where("not implicit or seen = 0")
    return found.select("doc_id", "chunk_id", "ord", "entity_name", "entity_type", "description", "implicit")


OUTPUT_SCHEMA = "entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,target:string,description:string,weight:double>>"


def parse_structured(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Like parse_records for texts whose output is JSON of OUTPUT_SCHEMA."""
    parsed = texts.select("doc_id", "chunk_id", F.from_json("output", OUTPUT_SCHEMA).alias("o"))
    e = parsed.select("doc_id", "chunk_id", F.posexplode("o.entities").alias("ord", "e"))
    entities = e.select("doc_id", "chunk_id", F.col("ord").cast("long").alias("ord"), entity_name(F.col("e.name")).alias("entity_name"), entity_type(F.col("e.type")).alias("entity_type"), clean(F.col("e.description")).alias("description")).where("entity_name <> ''")
    r = parsed.select("doc_id", "chunk_id", F.posexplode("o.relationships").alias("ord", "r"))
    rels = r.select("doc_id", "chunk_id", (F.col("ord") + 1_000_000).cast("long").alias("ord"), entity_name(F.col("r.source")).alias("src"), entity_name(F.col("r.target")).alias("tgt"), F.lit("RELATED").alias("relation_type"), clean(F.col("r.description")).alias("description"), F.coalesce("r.weight", F.lit(1.0)).alias("weight"))
    return with_endpoints(entities, rels), rels


def call_model(chunks: DataFrame, prompt: Column, model: Callable[[list[str]], list[str]], batch: int = 5, rounds: int = 0, more: Callable[[str], bool] | None = None) -> DataFrame:
    """chunks with output and error: the model's answers to prompts, called in batches of rows of a partition.

    A batch that raises is tried prompt by prompt; what still raises has a null output and the error.
    rounds: further calls with the answers so far while more() says so.
    """
    columns = chunks.columns

    def ask(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            return [(a, None) for a in model(prompts)]
        except Exception:
            out = []
            for p in prompts:
                try:
                    out.append((model([p])[0], None))
                except Exception as error:  # kept in the row for a later retry
                    out.append((None, str(error)))
            return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers: list[tuple[str | None, str | None]] = []
            prompts = frame["__prompt"].tolist()
            for i in range(0, len(prompts), batch):
                got = ask(prompts[i : i + batch])
                for _ in range(rounds):
                    open_ = [j for j, (a, _) in enumerate(got) if a is not None and (more is None or more(a))]
                    if not open_:
                        break
                    for j, (a, _) in zip(open_, ask([prompts[i + j] + "\n" + got[j][0] for j in open_]), strict=True):
                        got[j] = (got[j][0] + RECORD_MARK + a, None) if a else got[j]
                answers += got
            yield frame[columns].assign(output=[a for a, _ in answers], error=[e for _, e in answers])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in chunks.dtypes)
    return chunks.withColumn("__prompt", prompt).mapInPandas(run, f"{schema}, output string, error string")


def parse_output(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Like parse_structured, with texts that aren't such JSON read in the tuple format."""
    structured = F.coalesce(F.from_json("output", OUTPUT_SCHEMA)["entities"].isNotNull(), F.lit(False))
    a, b = parse_structured(texts.where(structured)), parse_records(texts.where(~structured & F.col("output").isNotNull()))
    return a[0].unionByName(b[0]), a[1].unionByName(b[1])


def retried(chunks: DataFrame, told: DataFrame, prompt: Column, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """told(chunk_id, ..., output, error) with rows that have no output asked once more, one prompt at a time."""
    failed = materialize(told.where("output is null").select("chunk_id"))
    if not failed.limit(1).count():
        return told
    again = call_model(chunks.join(failed, "chunk_id", "left_semi"), prompt, model, 1)
    return told.where("output is not null").unionByName(again)


def call_in_groups(chunks: DataFrame, model: Callable[[list[str]], list[str]], batch: int = 5, text: str = "content") -> DataFrame:
    """chunks(chunk_id, ...) with output and error: `batch` chunks of a partition to a prompt, each under its id; the answer is a JSON object of an output for each id.

    A chunk that the answer lacks, or all of a prompt that failed, is asked for alone.
    """
    columns = chunks.columns

    def one(content: str) -> tuple[str | None, str | None]:
        try:
            return model([content])[0], None
        except Exception as error:  # kept in the row for a later retry
            return None, str(error)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple[str | None, str | None]] = []
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                found: dict = {}
                if len(part) > 1:
                    try:
                        asked = "\n".join(f"[{c}]\n{t}" for c, t in zip(part.chunk_id, part[text], strict=True))
                        found = json.loads(model([GROUP_MARK + asked])[0])
                    except Exception:
                        found = {}
                out += [(json.dumps(found[c]), None) if isinstance(found, dict) and c in found else one(t) for c, t in zip(part.chunk_id, part[text], strict=True)]
            yield frame[columns].assign(output=[a for a, _ in out], error=[e for _, e in out])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in chunks.dtypes)
    return chunks.mapInPandas(run, f"{schema}, output string, error string")


#: Begins a prompt of several chunks, each under its id in square brackets.
GROUP_MARK = "Extract from each text below; answer with a JSON object that has an entry for each id.\n"


def extract(chunks: DataFrame, model: Callable[[list[str]], list[str]], batch: int = 5, rounds: int = 0, more: Callable[[str], bool] | None = None, grouped: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(told, entities, relationships) of chunks(doc_id, chunk_id, content): model calls in batches or as grouped prompts, gleaning rounds, a retry of what failed, answers read as JSON or tuples."""
    prompt = F.col("content")
    told = call_in_groups(chunks, model, batch) if grouped else call_model(chunks, prompt, model, batch, rounds, more)
    told = materialize(retried(chunks, materialize(told), prompt, model))
    return told, *parse_output(told.select("doc_id", "chunk_id", "output"))


#: Entity and relation types that a local recogniser is asked for.
ENTITY_TYPES = ("person", "organization", "location", "event", "product", "technology", "date", "money", "film", "actor", "director", "award")
RELATION_TYPES = (
    "directed", "acted_in", "spouse_of", "parent_of", "child_of", "sibling_of", "born_in", "died_in", "located_in", "works_for", "founded_by", "member_of", "happened_in", "happened_on", "is_a", "also_known_as", "created_by", "released", "married_to", "mother_of", "father_of", "son_of",
    "daughter_of", "brother_of", "sister_of",
)


def recogniser(load: Callable[[], Callable]) -> Callable[[list[str]], list[str]]:
    """An extractor from a local recogniser, loaded once a worker: load() gives a function (texts, entity types, relation types) -> for each text (entities [(name, type)], relations [(source, type, target)]). A relation stays if both its ends are entities of the text; its weight is 1."""

    def model(prompts: list[str]) -> list[str]:
        import sys

        kept = sys.__dict__.setdefault("_graphloom_recognisers", {})
        if load not in kept:
            kept[load] = load()
        out = []
        for entities, relations in kept[load](prompts, ENTITY_TYPES, RELATION_TYPES):
            names = {n.strip().upper() for n, _ in entities}
            fits = [(a, kind, b) for a, kind, b in relations if a.strip().upper() in names and b.strip().upper() in names]
            out.append(json.dumps({"entities": [{"name": n, "type": t, "description": f"{n} ({t})"} for n, t in entities], "relationships": [{"source": a, "target": b, "description": f"{a} {kind} {b}", "weight": 1.0} for a, kind, b in fits]}))
        return out

    return model


def extract_aliases(entities: DataFrame, chunks: DataFrame, model: Callable[[list[str]], list[str]], batch: int = 10, most_chunks: int = 5, most_failed: float = 0.5, by: Sequence[str] = ("entity_id",)) -> DataFrame:
    """(by..., alias): a model's aliases of each group of entities(by..., entity_name, chunk_id), from up to `most_chunks` of the chunks(chunk_id, content) that name them.

    A prompt has one entity and its chunks; the answer is a JSON array of names. Names that differ from
    the entity's in case only go. Raises if more than `most_failed` of the prompts fail.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("chunk_id"))
    near = entities.select(*by, "entity_name", "chunk_id").distinct().withColumn("n", rank).where(F.col("n") <= most_chunks).join(chunks.select("chunk_id", "content"), "chunk_id")
    asked = near.groupBy(*by).agg(F.min("entity_name").alias("entity_name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda x: x["content"]), "\n").alias("text"))
    prompt = F.concat(F.lit("Other names of "), "entity_name", F.lit(" in these texts, as a JSON array:\n"), "text")
    told = materialize(call_model(asked, prompt, model, batch).select(*by, "entity_name", "output", "error"))
    n, failed = told.agg(F.count("*"), F.count("error")).first()
    if failed > n * most_failed:
        raise RuntimeError(f"{failed} of {n} prompts for aliases failed")
    each = told.select(*by, "entity_name", F.explode(F.from_json("output", "array<string>")).alias("alias"))
    return each.select(*by, "entity_name", strip(F.col("alias")).alias("alias")).where((F.col("alias") != "") & (F.lower("alias") != F.lower("entity_name"))).select(*by, "alias").distinct()


def offline_extractor(prompts: list[str]) -> list[str]:
    """A deterministic stand-in for a model: capitalised words of a prompt are entities, neighbours are related."""
    out = []
    for p in prompts:
        names = list(dict.fromkeys(w.strip(".,;:!?()\"'") for w in p.split() if w[:1].isupper()))
        names = [n for n in names if n]
        found = {"entities": [{"name": n, "type": "concept", "description": f"{n} as the text has it"} for n in names], "relationships": [{"source": a, "target": b, "description": f"{a} by {b}", "weight": 1.0} for a, b in zip(names, names[1:], strict=False)]}
        out.append(json.dumps(found))
    return out


def fact_ids(entities: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with entity_id; relationships with relationship_id and the ids of both ends."""
    e = entities.withColumn("entity_id", entity_id(F.col("entity_name")))
    r = rels.withColumns({"src_id": entity_id(F.col("src")), "tgt_id": entity_id(F.col("tgt"))})
    return e, r.withColumn("relationship_id", relationship_id(F.col("src_id"), F.col("tgt_id"), F.col("relation_type")))


def low_yield(entities: DataFrame, chunks: DataFrame, per_chunk: float = 2.0) -> DataFrame:
    """(doc_id, chunks, entities, low): documents with fewer entities than the chunks promise."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    e = entities.groupBy("doc_id").agg(F.countDistinct("entity_name").alias("entities"))
    out = n.join(e, "doc_id", "left").withColumn("entities", F.coalesce("entities", F.lit(0).cast("long")))
    return out.withColumn("low", F.col("entities") < F.greatest(F.lit(3), F.floor(F.col("chunks") * per_chunk)))


def attach_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """entities(entity_id, entity_name, ...) with the sorted distinct aliases of aliases(entity_id, alias) that aren't the name in another case."""
    found = aliases.groupBy("entity_id").agg(F.collect_set("alias").alias("found"))
    fits = F.filter("found", lambda a: F.lower(a) != F.lower("entity_name"))
    return entities.join(found, "entity_id", "left").withColumn("aliases", F.coalesce(F.array_sort(fits), F.array().cast("array<string>"))).drop("found")
