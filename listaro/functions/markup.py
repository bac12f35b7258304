"""Reading landed markup: one pass cuts the few blocks that fields are read from out of a page, and column expressions read the fields.

A page is a row of tags: their names in lower case, with "/" before those of end
tags, their attributes as they stand, and the texts up to the next tag.
Attributes may come in any order, in double quotes, single quotes or none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Named characters.
NAMED = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "aring": "å", "Aring": "Å", "oslash": "ø", "Oslash": "Ø", "aelig": "æ", "AElig": "Æ", "sup2": "²", "ndash": "–", "amp": "&"}
_UNREAD = re.compile(r"<(?:!--.*?-->|(?i:style\b.*?</style\s*>|script\b.*?</script\s*>))", re.A | re.S)
_NAME, _ATTRS = r"/?[A-Za-z][^\s/>]*+", r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""
_TAG = re.compile(f"<({_NAME}){_ATTRS}>", re.A)
_TEXT = re.compile(f"(?:[^<]++|<(?!{_NAME}{_ATTRS}>))*+", re.A)
#: On to the next tag with attributes: texts and plain tags are passed, a sign that begins no tag is a match of its own.
_RICH = re.compile(rf"(?:[^<]++|<(?:{_NAME}>|(?![/A-Za-z])))*+(?:(<)(?:({_NAME})({_ATTRS})>)?+|\Z)", re.A)
_SHUT, _OPEN = "\x02", "\x01"
_SPACE = re.compile(r"[\s ]+", re.A)


def bare(text: str) -> str:
    """``stripped`` of a text."""
    return _SPACE.sub(" ", text).strip(" ")


def unescaped(text: str) -> str:
    """Named and the usual numbered characters as such; others stay as they are."""
    if "&" in text:
        text = re.sub(r"&#(?:160|[xX][aA]0);", " ", text)
        for name, sign in NAMED.items():
            text = text.replace(f"&{name};", sign)
    return text


@lru_cache(256)
def _value(name: str) -> re.Pattern:
    return re.compile(rf"""(?:^|[\s"'/]){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.A | re.I)


@lru_cache(256)
def _script(script_id: str) -> re.Pattern:
    return re.compile(rf"""<(?i:script)\b(?=[^>]*\b(?i:id)\s*=\s*["']?(?i:{script_id})["'\s>])[^>]*>(.*?)</(?i:script)\s*>""", re.A | re.S)


@lru_cache(256)
def _next(name: str) -> re.Pattern:
    """On to the next tag of this name, start or end."""
    tag = rf"(?i:{re.escape(name)})(?=[\s/>]){_ATTRS}>"
    return re.compile(rf"(?:[^<]++|<(?!/?{tag})(?:{_NAME}{_ATTRS}>)?+)*+<(/?){tag}", re.A)


def attribute(attrs: str, name: str) -> str | None:
    """The attribute's value, None where it is missing."""
    found = _value(name).search(attrs)
    if found is None:
        return None
    value = found[1]
    return unescaped(value[1:-1] if value[0] in "\"'" else value)


def script_body(html: str | None, script_id: str) -> str | None:
    """The body of the script with this id."""
    found = _script(script_id).search(html or "")
    return found[1] if found else None


class Block(NamedTuple):
    """The place of an element in a page: from its start tag on, the text inside (None: without an end tag), and up to the next tag behind it."""

    start: int
    inside: tuple[int, int] | None
    stop: int


class Page:
    """A page's text, without comments, styles and scripts, and its tags with attributes: (name, attributes, start, end)."""

    def __init__(self, html: str | None):
        self.text = _UNREAD.sub(" ", html or "").replace(_OPEN, " ").replace(_SHUT, " ")
        self.tags = [(m[2].lower(), m[3], m.start(1), m.end()) for m in _RICH.finditer(self.text) if m[2]]

    def marks(self, name: str) -> dict:
        """The first start tag with each value of an attribute, and with each value and tag."""
        out: dict = {}
        for tag in self.tags:
            if name in tag[1] and tag[0][0] != "/":
                value = attribute(tag[1], name)
                out.setdefault(value, tag)
                out.setdefault((value, tag[0]), tag)
        return out

    def first(self, name: str, within: Block | None = None) -> Block | None:
        """The first element of this name, of all or of a block."""
        at, stop = (within.start, within.stop) if within else (0, len(self.text))
        while found := _next(name).match(self.text, at, stop):
            if not found[1]:
                return self.element((name, "", found.start(1) - 1, found.end()), stop)
            at = found.end()
        return None

    def element(self, tag: tuple | None, stop: int | None = None) -> Block | None:
        """The element that begins with a tag: up to its end tag, or all that follows if it has none."""
        if tag is None:
            return None
        name, _, start, begun = tag
        at, stop, deep, pattern = begun, len(self.text) if stop is None else stop, 1, _next(name)
        while found := pattern.match(self.text, at, stop):
            at, deep = found.end(), deep + (-1 if found[1] else 1)
            if not deep:
                return Block(start, (begun, found.start(1) - 1), _TEXT.match(self.text, at, stop).end())
        return Block(start, None, stop)

    def inner(self, block: Block | None) -> str | None:
        """The text inside an element, without what follows its end tag or else the last one."""
        if block is None:
            return None
        if block.inside:
            return unescaped(_TAG.sub("", self.text[slice(*block.inside)]))
        names, texts = self._parts(block)
        return unescaped("".join(texts[:-1] if names[-1][0] == "/" else texts))

    def whole(self) -> Block | None:
        """All from the first tag on."""
        found = _TAG.search(self.text)
        return Block(found.start(), None, len(self.text)) if found else None

    def leaves(self, block: Block | None, tag: str = "div") -> list[str]:
        """The bare texts of the elements ``tag`` that hold no other of their kind, but for empty ones."""
        flat = self._marked(block, {tag: _OPEN, f"/{tag}": _SHUT})
        texts = [x.split(_SHUT, 1)[0] for x in flat.split(_OPEN)[1:] if _SHUT in x]
        return [x for x in map(bare, texts) if x]

    def terms(self, block: Block | None) -> dict[str, str]:
        """The terms (dt) of a list and the text of the definition (dd) behind each; the last of equal terms counts."""
        chunks = [x.split(_SHUT) for x in self._marked(block, {"dt": _OPEN, "dd": _SHUT}).split(_OPEN)[1:]]
        return {bare(x[0]): x[1] for x in chunks if len(x) > 1}

    def _marked(self, block: Block | None, marks: dict[str, str]) -> str:
        """All texts of a block, with ``marks`` for some of its tags."""
        return unescaped(_TAG.sub(lambda m: marks.get(m[1].lower(), ""), self.text[block.start : block.stop])) if block else ""

    def spaced(self, block: Block | None) -> str:
        """All texts of a block with spaces between."""
        return unescaped(" ".join(self._parts(block)[1])) if block else ""

    def _parts(self, block: Block) -> tuple[list[str], list[str]]:
        parts = _TAG.split(self.text[block.start : block.stop])
        return parts[1::2], parts[2::2]


def cut(pages: DataFrame, keep: list[str], names: list[str], blocks: Callable[[str | None], Iterable[str | None]]) -> DataFrame:
    """Columns ``keep`` and, as ``names``, the texts that ``blocks`` gives for each page's html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(*[blocks(html) for html in batch.column(len(keep)).to_pylist()]) if len(batch) else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(x, pa.string()) for x in found]], [*keep, *names])

    rows = pages.select(*keep, "html")
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], *[StructField(x, StringType()) for x in names]]))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out a single time, however often it is used, also inside of lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(text: Column) -> Column:
    """White space, also the unbreakable kind, as single spaces; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def last_of_each(pairs: Column) -> Column:
    """map from an array of struct(k, v); of equal keys the last counts."""
    def mapped(turned: Column, names: Column) -> Column:
        keys = F.reverse(F.array_distinct(names))
        return once(keys, lambda ks: F.map_from_arrays(ks, F.transform(ks, lambda k: F.element_at(turned, F.array_position(names, k).cast("int"))["v"])))
    return once(F.reverse(pairs), lambda turned: once(F.transform(turned, lambda p: p["k"]), lambda names: mapped(turned, names)))
