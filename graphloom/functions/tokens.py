"""Tokenizers as encode and decode over lists, applied to Arrow batches on executors; without one, words are tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import n_tokens

Encode = Callable[[list[str]], list[list[int]]]
Decode = Callable[[list[list[int]]], list[str]]


@dataclass(frozen=True)
class Tokenizer:
    """name tells it from others in configurations; make() gives (encode, decode) and is called once a task, where it may load files that all executors see."""

    name: str
    make: Callable[[], tuple[Encode, Decode]] = field(repr=False)


def json_vocabulary(path: str) -> Tokenizer:
    """The tokenizer of a JSON file of the tokenizers library, without special tokens of its own."""

    def make() -> tuple[Encode, Decode]:
        import tokenizers

        loaded = tokenizers.Tokenizer.from_file(path)
        return (lambda texts: [loaded.encode(t, add_special_tokens=False).ids for t in texts]), (lambda ids: [loaded.decode(i, skip_special_tokens=False) for i in ids])

    return Tokenizer(path, make)


def piece_vocabulary(path: str) -> Tokenizer:
    """The tokenizer of a sentencepiece model file."""

    def make() -> tuple[Encode, Decode]:
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: [loaded.encode(t) for t in texts]), (lambda ids: [loaded.decode(i) for i in ids])

    return Tokenizer(path, make)


def token_ids(text: Column, tokenizer: Tokenizer) -> Column:
    """Ids of a text; null texts have none."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, _ = tokenizer.make()
        for texts in batches:
            yield pd.Series(encode(texts.fillna("").tolist()), index=texts.index, dtype=object)

    return run(text)


def size_by(tokenizer: Tokenizer | None) -> Callable[[Column], Column]:
    """text -> how many tokens it has, 0 if null."""
    if tokenizer is None:
        return n_tokens

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, _ = tokenizer.make()
        for texts in batches:
            yield pd.Series([len(i) for i in encode(texts.fillna("").tolist())], index=texts.index, dtype="int64")

    return run
