"""Scalar text, identifier and JSON functions as Column expressions."""

from __future__ import annotations

import html
import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of stored lists, record marks of extraction output, the unknown type (its quotes included).
GRAPH_SEP = "<SEP>"
TUPLE_MARK, RECORD_MARK, COMPLETE_MARK = "<|>", "##", "<|COMPLETE|>"
UNKNOWN_TYPE = '"UNKNOWN"'
#: Titles dropped from names, one after the other.
TITLES = ("mr", "mrs", "ms", "dr", "prof", "president", "ceo")
#: White space as Unicode defines it.
BLANKS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Without white space at both ends. Looks at the ends only, where a pattern tries every place of a text."""
    return F.btrim(text, F.lit(BLANKS))


def upper(text: Column) -> Column:
    """Upper case; ß becomes SS in every engine."""
    return F.upper(F.regexp_replace(text, "ß", "ss"))


def unescape_html(text: Column) -> Column:
    return F.pandas_udf(_unescape, "string")(text)


def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def clean(text: Column, entities: bool = False) -> Column:
    """Stripped, without control characters; entities: HTML entities resolved first, for rows that have any."""
    if entities:
        text = F.when(text.contains("&"), unescape_html(text)).otherwise(text)
    return F.regexp_replace(strip(text), r"[\x00-\x1f\x7f-\x9f]", "")


def entity_name(text: Column) -> Column:
    return upper(clean(text))


def entity_type(text: Column) -> Column:
    """Upper-cased type; blank or null ones are unknown."""
    return F.coalesce(F.nullif(upper(clean(text)), F.lit("")), F.lit(UNKNOWN_TYPE))


def registry_name(text: Column) -> Column:
    """Lower-cased, white space squeezed, titles dropped in their fixed order."""
    name = F.regexp_replace(F.lower(strip(text)), r"\s+", " ")
    return strip(reduce(lambda acc, t: F.regexp_replace(acc, rf"^{t}\.? ", ""), TITLES, name))


def prefixed_hash(prefix: str, text: Column, kind: str = "sha256") -> Column:
    return F.concat(F.lit(prefix), F.sha2(text, 256) if kind == "sha256" else F.md5(text))


def entity_id(name: Column, namespace: str = "default") -> Column:
    """Depends on the name only, not on the type."""
    return prefixed_hash("entity_", F.concat(F.lit(f"{namespace}:"), F.lower(strip(name))))


def relationship_id(a: Column, b: Column, kind: Column) -> Column:
    """The same for both directions."""
    return prefixed_hash("rel_", F.concat_ws("|", F.least(a, b), F.greatest(a, b), F.lower(strip(kind))))


def split_markers(text: Column, markers: list[str]) -> Column:
    """Trimmed parts between any of the markers, empty ones dropped."""
    if not markers:
        return F.array(text)
    parts = F.split(text, "|".join(re.escape(m) for m in markers), -1)
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def is_number(text: Column) -> Column:
    """Digits with an optional sign and fraction; no exponent, no trailing point."""
    return text.rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


def quote_cell(text: Column) -> Column:
    """Numbers bare, other text in double quotes of its own."""
    return F.when(is_number(text), text).otherwise(F.concat(F.lit('"'), F.regexp_replace(strip(text), '^"+|"+$', ""), F.lit('"')))


def csv_row(*cells: Column) -> Column:
    return F.concat_ws(",\t", *[quote_cell(c.cast("string")) for c in cells])


def join_unique(values: Column) -> Column:
    """Distinct non-empty values, sorted, joined by the list separator; values is an array."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))), GRAPH_SEP)


def source_ids(text: Column) -> Column:
    """A stored list of ids: a JSON array, or else joined by the list separator."""
    return F.filter(F.coalesce(F.when(text.startswith("["), F.from_json(text, "array<string>")), F.split(text, re.escape(GRAPH_SEP), -1)), lambda v: v != "")


def scalar_kind(text: Column) -> Column:
    """null, boolean, integer, float or string: what a lenient reader takes a bare value for. Only null, true and false in lower case are no strings; a number with a point is a float."""
    t = strip(text)
    return F.when(t == "null", "null").when(t.isin("true", "false"), "boolean").when(t.rlike(r"^[-+]?[0-9]+$"), "integer").when(t.rlike(r"^[-+]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"), "float").otherwise("string")


def answer_words(text: Column) -> Column:
    """Words of an answer: runs of letters, digits and underscores but for the lower-case articles, lower-cased after."""
    words = F.split(text, r"[^\p{L}\p{N}_]+", -1)
    return F.transform(F.filter(words, lambda w: ~w.isin("", "a", "an", "the")), F.lower)


def words(text: Column) -> Column:
    """The engine's default tokens: what stands between spaces, tabs and line ends."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\r\n]+", -1), lambda w: w != "")


def n_tokens(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def balanced_object(text: str) -> str | None:
    """The first {...} with balanced braces, whatever strings hold."""
    depth, start = 0, None
    for i, c in enumerate(text):
        if c == "{":
            if depth == 0:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


#: Words that lenient reading takes for constants, and its pattern of a key and value.
CONSTANTS = {"null": None, "true": True, "false": False}
FIELD = r'"?(\w+)"?\s*:\s*(\{[^}]*\}|".*?"|[^,}]+)'


def _bare(text: str):
    """A constant, a number (with a point a float) or else the text without quotes."""
    if text in CONSTANTS:
        return CONSTANTS[text]
    try:
        return float(text) if "." in text else int(text)
    except ValueError:
        return text.strip('"')


def lenient_fields(text: str) -> dict:
    """key: value pairs of broken JSON, one level of nesting included."""
    found = re.findall(FIELD, text.strip().removeprefix("{"), re.S)
    return {key: lenient_fields(value) if value.strip().startswith("{") else _bare(value.strip()) for key, value in found}


def response_json(text: str) -> dict:
    """A model's answer as a dict: its first whole object, or else what lenient reading finds."""
    found = balanced_object(text)
    if found is not None:
        try:
            got = json.loads(found.replace("\n", ""))
            if isinstance(got, dict):
                return got
        except ValueError:
            pass
    return lenient_fields(text)


def _response(text: pd.Series) -> pd.Series:
    return text.map(lambda t: json.dumps(response_json(t), sort_keys=True), na_action="ignore")


def response_to_json(text: Column) -> Column:
    """JSON text of response_json()."""
    return F.pandas_udf(_response, "string")(text)


def similarity(a: str, b: str) -> float:
    """Matching-blocks ratio of two strings."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


def fuzzy_ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(_ratios, "double")(a, b)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")
