"""GraphML files: node and edge tables from and to them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMESPACE = "{http://graphml.graphdrawing.org/xmlns}"


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, attributes), edges(src, dst, attributes)) of the files at a path, attributes map<string,string> by their names; a file is parsed whole by one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["value"]:
                root = ElementTree.fromstring(text)
                names = {k.get("id"): k.get("attr.name", k.get("id")) for k in root.iter(f"{NAMESPACE}key")}
                values = lambda x: {names.get(d.get("key"), d.get("key")): d.text or "" for d in x.findall(f"{NAMESPACE}data")}
                rows = [("node", n.get("id"), None, values(n)) for n in root.iter(f"{NAMESPACE}node")]
                rows += [("edge", e.get("source"), e.get("target"), values(e)) for e in root.iter(f"{NAMESPACE}edge")]
                yield pd.DataFrame(rows, columns=["kind", "a", "b", "attributes"])

    rows = spark.read.text(path, wholetext=True).mapInPandas(run, "kind string, a string, b string, attributes map<string,string>")
    edges = rows.where("kind = 'edge'").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "attributes")
    return rows.where("kind = 'node'").select(F.col("a").alias("id"), "attributes"), edges


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One file of nodes(id, ...) and edges(src, dst, ...), other columns as attributes; written under another name and renamed. A file for viewers: rows come to the driver one after the other."""
    spark = nodes.sparkSession
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    temporary = Path(f"{path}.{uuid.uuid4().hex}")
    kept = {"node": [c for c in nodes.columns if c != "id"], "edge": [c for c in edges.columns if c not in ("src", "dst")]}
    data = lambda kind, r: "".join(f'<data key="{kind}-{i}">{escape(str(r[c]))}</data>' for i, c in enumerate(kept[kind]) if r[c] is not None)

    def lines() -> Iterator[str]:
        yield '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
        for kind, columns in kept.items():
            for i, c in enumerate(columns):
                yield f'<key id="{kind}-{i}" for="{kind}" attr.name={quoteattr(c)} attr.type="string"/>\n'
        yield '<graph edgedefault="undirected">\n'
        for r in nodes.orderBy("id").toLocalIterator():
            yield f"<node id={quoteattr(str(r['id']))}>{data('node', r)}</node>\n"
        for r in edges.orderBy("src", "dst").toLocalIterator():
            yield f"<edge source={quoteattr(str(r['src']))} target={quoteattr(str(r['dst']))}>{data('edge', r)}</edge>\n"
        yield "</graph>\n</graphml>\n"

    stream = fs.create(temporary)
    try:
        for line in lines():
            stream.write(bytearray(line.encode()))
    finally:
        stream.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(temporary, target):
        raise RuntimeError(f"can't write {path}")
