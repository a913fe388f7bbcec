"""Aliases of a table in texts, with their places, in one pass over the texts for the whole table.

All aliases and exclusions of a table are one automaton, which a task walks each text through once, so a
hundred times as many aliases are no more passes. The table is measured before it is sent: what is
larger than ``TABLE_BYTES`` goes in several automata, by target, each with a pass of its own.

Occurrences of one alias are taken from the left and do not overlap; an ASCII alias counts only where no
letter or digit of ASCII stands right before or behind it. A target's exclusion covers the
occurrences that it overlaps. An alias stands for its target if one of its occurrences is not covered.

Defined cases: null, empty and blank aliases and null targets are left out; aliases are compared in lower
case; of repeated alias rows one counts; a null text has no occurrences; rows are independent, so ties
and repeated ids come back as they are; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_BYTES = 64 << 20
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_BUILT: dict[str, object] = {}


def alias_rows(aliases: DataFrame) -> DataFrame:
    """target, alias, excludes: the table as it is compared."""
    excludes = F.col("excludes") if "excludes" in aliases.columns else F.lit(False)
    own = aliases.select(F.col("target").cast("string").alias("target"), F.lower(F.trim("alias")).alias("alias"), F.coalesce(excludes, F.lit(False)).alias("excludes"))
    return own.where("target IS NOT NULL AND alias <> ''").distinct()


def _automaton(name: str, rows: list[tuple[str, str, bool]]):
    """One automaton a worker: each string with its size, whether it is bounded by words, and what it stands for."""
    if name not in _BUILT:
        _BUILT.clear()
        named: dict[str, list[tuple[str, bool]]] = {}
        for target, alias, excludes in rows:
            named.setdefault(alias, []).append((target, excludes))
        built = ahocorasick.Automaton()
        for alias, uses in named.items():
            built.add_word(alias, (alias, len(alias), alias.isascii(), uses))
        built.make_automaton()
        _BUILT[name] = built
    return _BUILT[name]


def occurrences(automaton, text: str) -> dict[str, dict[tuple[str, bool], list[tuple[int, int]]]]:
    """By target: the places of each of its aliases and exclusions."""
    places: dict[str, list[tuple[int, int]]] = {}
    uses: dict[str, list[tuple[str, bool]]] = {}
    last: dict[str, int] = {}
    for end, (alias, size, ascii_only, stands_for) in automaton.iter(text):
        start, end = end + 1 - size, end + 1
        if start < last.get(alias, 0):
            continue
        last[alias] = end
        if ascii_only and ((start and text[start - 1] in _WORD) or (end < len(text) and text[end] in _WORD)):
            continue
        places.setdefault(alias, []).append((start, end))
        uses[alias] = stands_for
    found: dict[str, dict[tuple[str, bool], list[tuple[int, int]]]] = {}
    for alias, spans in places.items():
        for target, excludes in uses[alias]:
            found.setdefault(target, {})[alias, excludes] = spans
    return found


def _free(spans: list[tuple[int, int]], covers: list[tuple[int, int]]) -> int:
    """How many of the spans none of the covers (sorted by start) overlaps."""
    n, at, reach = 0, 0, -1
    for start, end in spans:
        while at < len(covers) and covers[at][0] < end:
            reach = max(reach, covers[at][1])
            at += 1
        n += reach <= start
    return n


def found(texts: DataFrame, text_id: str, text: Column | str, aliases: DataFrame, bytes_at_once: int = TABLE_BYTES) -> DataFrame:
    """id, target, alias, places ("from-to,..."), n, free: each alias in each text, how often, and how often not covered.

    ``aliases``: target, alias, and optionally excludes (true for an exclusion of the target).
    """
    rows = alias_rows(aliases)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("alias") + F.octet_length("target") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // bytes_at_once))
    column = F.col(text) if isinstance(text, str) else text
    given = texts.select(F.col(text_id).cast("long").alias("id"), F.lower(F.coalesce(column, F.lit(""))).alias("text"))

    def of(block: int) -> DataFrame:
        own = [tuple(r) for r in rows.where(F.pmod(F.xxhash64("target"), F.lit(blocks)) == block).collect()]
        sent, name = texts.sparkSession.sparkContext.broadcast(own), uuid.uuid4().hex

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(name, sent.value)
            for batch in batches:
                out: list[list] = [[] for _ in range(6)]
                for key, content in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    for target, uses in (occurrences(automaton, content) if len(automaton) else {}).items():
                        covers = sorted(s for (_, excludes), spans in uses.items() if excludes for s in spans)
                        for (alias, excludes), spans in uses.items():
                            if not excludes:
                                for to, value in zip(out, (key, target, alias, ",".join(f"{a}-{b}" for a, b in spans), len(spans), _free(spans, covers)), strict=True):
                                    to.append(value)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["id", "target", "alias", "places", "n", "free"])

        return given.mapInArrow(find, "id long, target string, alias string, places string, n long, free long")

    return reduce(DataFrame.unionByName, map(of, range(blocks)))


def surface_forms(name: Column) -> Column:
    """Spellings of a name: as it is, and with its signs as blanks, as hyphens or left out."""
    signs = r"[#\s\-_.·]+"
    return F.array_distinct(F.transform(F.array(name, F.regexp_replace(name, signs, " "), F.regexp_replace(name, signs, "-"), F.regexp_replace(name, signs, "")), lambda x: F.lower(F.trim(x))))
