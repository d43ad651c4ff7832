"""Token ids of public tokenizers, their bytes, and where texts may be cut without changing them.

A byte-level tokenizer that splits texts by the usual pattern always begins a new pretoken at white space
after another character, so a text may be cut there. A byte-pair model of pieces may be cut between two
characters that no piece has side by side, since only pieces are merged.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable

import numpy as np

#: White space in front and what follows up to the next white space, or white space at the end.
SPACED = re.compile(r"\s*\S+|\s+").findall


class TokenBytes:
    """Bytes of each id, side by side."""

    def __init__(self, values: dict[int, bytes]):
        known = [values.get(i, b"") for i in range(max(values) + 1)]
        self.lengths = np.array([len(v) for v in known], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(known), np.uint8)

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The bytes of a row of ids that end at `ends`."""
        sizes = self.lengths[ids]
        return self.flat[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class ByteLevel:
    """A byte-level tokenizer of a JSON file; plain: special tokens' strings in texts are ordinary text.

    Where its merges have the order of their ids, stretches of characters below U+0200, whose classes
    all versions of Unicode agree on, go through tiktoken with the same ranks, which gives the same ids
    in a fraction of the time.
    """

    #: Fixed value: the pattern by which byte-level tokenizers of this kind split texts.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, plain: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = plain
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        self.bytes = byte_level_bytes(found)
        vocab = found["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in found["model"]["merges"]]
        in_order = [vocab["".join(m)] for m in merges] == list(range(256, 256 + len(merges))) and found["normalizer"] is None
        usual = found["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.odd = re.compile("|".join(["[^\\x00-\\u01ff]", *(re.escape(t["content"]) for t in found["added_tokens"])])).search
        self.fast = None
        if in_order and usual:
            import tiktoken

            ranks = {self.bytes[i]: i for i in vocab.values() if i < 256 + len(merges)}
            self.fast = tiktoken.Encoding(path, pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
            # white space characters that stand alone need no look ahead, which is slow
            self.faster = tiktoken.Encoding(path, pat_str=self.PATTERN.removesuffix(r"\s+(?!\S)|\s+") + r"\s", mergeable_ranks=ranks, special_tokens={})
            self.runs = re.compile(r"\s\s").search

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if self.fast and not self.odd(text):
            return (self.fast if self.runs(text) else self.faster).encode_to_numpy(text)
        slow = lambda t: np.array(self.slow.encode(t, add_special_tokens=False).ids, np.uint32)
        if not self.fast:
            return slow(text)
        parts, odd = [[]], False
        for word in SPACED(text):
            if bool(self.odd(word)) != odd:
                odd = not odd
                parts.append([])
            parts[-1].append(word)
        return np.concatenate([slow("".join(p)) if i % 2 else self.fast.encode_to_numpy("".join(p)) for i, p in enumerate(parts)])


def byte_level_bytes(found: dict) -> dict[int, bytes]:
    """Bytes of each id of a byte-level vocabulary. Printable bytes stand for themselves, the others, in order, for the characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    value = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["id"]: t["content"].encode() for t in found["added_tokens"]}
    return {i: bytes(value[c] for c in token) for token, i in found["model"]["vocab"].items() if i not in special} | special


class Pieces:
    """A SentencePiece model without its space in front, and where texts may be cut for it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = m.get_piece_size()
        plain = [m.id_to_piece(i) for i in range(self.size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        if any("\n" in p for p in plain) or any(re.search("[^▁]▁", p) for p in plain):
            raise ValueError("pieces go over line ends or over spaces after words: texts can't be cut for this model")
        self.bytes = {i: bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(self.size)}
        self.skip = len(m.encode("\n"))
        self.joining = "".join(sorted({c for p in plain for c in p[1:] if c.isspace()}))

    def ids(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Ids of texts that begin with their own space, if any: a line end in front, which no piece has, keeps the model's own space apart."""
        return [np.array(ids[self.skip :], np.int64) for ids in self.model.encode(["\n" + t for t in texts], num_threads=1)]

    def splitter(self) -> Callable[[str], list[str]]:
        """Words as by SPACED, but for white space that pieces may have after another character."""
        if not self.joining:
            return SPACED
        return re.compile(rf"\s*\S+(?:(?=[{re.escape(self.joining)}])\s+\S*)*|\s+").findall
