"""Documents to chunks: token windows natively, separator merging per document in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import prefixed_hash, strip, words
from ..functions.tokens import Tokenizer

#: Where separator chunking may cut.
SEPARATORS = ("\n\n", "\r\n\r\n", "\n", "\r\n", "。", "．", ".", "！", "!", "？", "?", " ", "\t", "　", "​")


def token_windows(docs: DataFrame, size: int = 1200, overlap: int = 100, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(doc_id, chunk_order_index, tokens, content) of docs(doc_id, content): windows of `size` tokens that begin every size - overlap ones, over the whole length; texts without tokens have none.

    Tokens are words, or those of a tokenizer, whose decoder then gives the contents.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than the window")
    if tokenizer:
        return _encoded(docs, tokenizer, lambda ids: [ids[i : i + size] for i in range(0, len(ids), step)])
    split = docs.select("doc_id", words(F.col("content")).alias("w")).where(F.size("w") > 0)
    each = split.select("doc_id", "w", F.posexplode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))).alias("order", "at"))
    content = strip(F.array_join(F.slice("w", F.col("at") + 1, F.lit(size)), " "))
    return each.select("doc_id", F.col("order").cast("long").alias("chunk_order_index"), F.least(F.lit(size), F.size("w") - F.col("at")).cast("long").alias("tokens"), content.alias("content"))


def _encoded(docs: DataFrame, tokenizer: Tokenizer, pieces: Callable[[list[int]], list[list[int]]]) -> DataFrame:
    """(doc_id, chunk_order_index, tokens, content) of pieces(ids) of each document's ids, decoded; one document at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, decode = tokenizer.make()
        for frame in frames:
            for d, text in zip(frame.doc_id, frame.content, strict=True):
                parts = pieces(encode([text or ""])[0])
                rows = [(d, i, len(p), t.strip()) for i, (p, t) in enumerate(zip(parts, decode(parts), strict=True))]
                yield pd.DataFrame(rows, columns=["doc_id", "chunk_order_index", "tokens", "content"])

    return docs.select("doc_id", "content").mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, chunk_order_index long, tokens long, content string")


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """chunks with chunk_id, the hash of document, order and content; equal ones collapse."""
    order = F.col("chunk_order_index").cast("string")
    return chunks.withColumn("chunk_id", prefixed_hash("chunk-", F.concat_ws(":", F.col("doc_id").cast("string"), order, "content"))).dropDuplicates(["chunk_id"])


def spans(text: str, separators: Sequence[str] = SEPARATORS, keep: str = "end") -> list[tuple[int, int]]:
    """(begin, end) of the parts of a text between separators, of which the first in the list that fits counts; empty parts go.

    keep: "end" or "start" leaves a separator with the part before or after it; "" drops it.
    """
    found = list(re.finditer("|".join(map(re.escape, separators)), text)) if separators else []
    ends = [m.end() if keep == "end" else m.start() for m in found] + [len(text)]
    begins = [0] + [m.start() if keep == "start" else m.end() for m in found]
    return [(a, b) for a, b in zip(begins, ends, strict=True) if a < b]


def pack(sizes: Sequence[int], most: int) -> list[tuple[int, int]]:
    """(first, behind the last) of consecutive groups whose sizes are at most `most` together; a larger one is alone."""
    out, begin, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            out.append((begin, i))
            begin, held = i, 0
        held += n
    return [*out, (begin, len(sizes))] if sizes else []


def separator_pieces(text: str, separators: Sequence[str] = SEPARATORS, size: int = 4000, overlap: int = 200, keep: str = "end") -> list[str]:
    """Chunks of a text that end at separators: parts in groups of up to `size` characters.

    With an overlap each chunk but the first begins with the end of the one before it and is cut to the
    size. A text that is one group over the size is cut in windows, of which one that only repeats the
    overlap goes; other groups over the size stay whole.
    """
    parts = spans(text, separators, keep)
    chunks = ["".join(text[x:y] for x, y in parts[a:b]) for a, b in pack([y - x for x, y in parts], size)]
    if len(chunks) == 1 and len(chunks[0]) > size:
        whole, step = chunks[0], size - overlap
        return [whole[i : i + size] for i in range(0, len(whole), step) if len(whole) - i > overlap]
    return [c if not overlap or not i else (chunks[i - 1][-overlap:] + c)[:size] for i, c in enumerate(chunks)]


def separator_chunks(docs: DataFrame, size: int = 1200, overlap: int = 100, separators: Sequence[str] = SEPARATORS, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Like token_windows, with chunks that end at separators. Tokens are characters, or those of a tokenizer, in whose ids those of a separator are looked for."""
    if tokenizer:
        # one character an id, so that ids are cut as texts are
        spelt = lambda ids: "".join(map(chr, ids))
        marks = [spelt(i) for i in tokenizer.make()[0](list(separators)) if i]
        return _encoded(docs, tokenizer, lambda ids: [[ord(c) for c in p] for p in separator_pieces(spelt(ids), marks, size, overlap)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, len(c), c.strip()) for d, text in zip(frame.doc_id, frame.content, strict=True) for i, c in enumerate(separator_pieces(text or "", separators, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_order_index", "tokens", "content"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "content").mapInPandas(run, f"doc_id {kind}, chunk_order_index long, tokens long, content string")
