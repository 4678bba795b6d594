"""Which texts contain which patterns.

Patterns up to BROADCAST_PATTERNS, of a known total length, go to every task as one automaton that finds
all of them in one pass over each text. More patterns are found by an equi-join on an anchor, their first
ANCHOR characters: the texts' substrings of the anchors' lengths join them, and the few that meet are
compared in full.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANCHOR = 8
#: Patterns, and their characters, that are sent to every task: below some 20 MB as an automaton.
BROADCAST_PATTERNS, BROADCAST_CHARS = 50_000, 1_000_000

_WORD = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-")


def automaton(patterns: Iterable[str]):
    """An automaton that gives the patterns themselves."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for p in patterns:
        out.add_word(p, p)
    out.make_automaton()
    return out


def find_all(text: str, patterns, words: bool) -> list[str]:
    """The patterns of an automaton that the text contains; with words set, ASCII ones only where they stand alone."""
    found = set()
    for end, p in patterns.iter(text):
        if p not in found:
            start = end + 1 - len(p)
            if not words or not p.isascii() or not (start and text[start - 1] in _WORD or text[end + 1 : end + 2] in _WORD and end + 1 < len(text)):
                found.add(p)
    return sorted(found)


def _finder(patterns: tuple[str, ...], words: bool, name: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(patterns)
        for batch in batches:
            at, met = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = find_all(text, known, words) if text else ()
                at += [k] * len(found)
                met += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(met, pa.string())], names=[name, pattern])

    return run


def contains(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, words: bool = False, broadcast_patterns: int = BROADCAST_PATTERNS) -> DataFrame:
    """The key of each text (unique) with the rows of patterns whose pattern the text contains.

    The column names of both must differ. With words set, ASCII patterns must stand alone, not within a
    word or beside a hyphen. Null texts contain nothing; null and empty patterns are found nowhere.
    """
    rows = patterns.where(F.length(pattern) > 0).distinct()
    size = rows.select(pattern).distinct().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(pattern)), F.lit(0)).alias("chars")).first()
    if not size["n"]:
        return texts.select(key).join(patterns, F.lit(False))
    if size["n"] <= broadcast_patterns and size["chars"] <= BROADCAST_CHARS:
        known = tuple(sorted(r[0] for r in rows.select(pattern).distinct().collect()))
        met = texts.select(key, text).mapInArrow(_finder(known, words, key, pattern), f"{key} {dict(texts.dtypes)[key]}, {pattern} string")
        return met if patterns.columns == [pattern] else met.join(rows, pattern).select(key, *patterns.columns)
    return _by_anchor(texts, key, text, rows, pattern, words).select(key, *patterns.columns)


def _by_anchor(texts: DataFrame, key: str, text: str, rows: DataFrame, pattern: str, words: bool) -> DataFrame:
    size = F.least(F.length(pattern), F.lit(ANCHOR))
    rows = rows.withColumn("__anchor", F.substring(F.col(pattern), F.lit(1), size))
    sizes = sorted(r[0] for r in rows.select(size).distinct().collect())  # at most ANCHOR numbers
    # A look-ahead finds the substrings in one pass; taking each by its position would be quadratic.
    parts = [F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]
    keyed = texts.select(F.col(key), F.explode(F.array_distinct(F.flatten(F.array(*parts)))).alias("__anchor"))
    met = keyed.join(rows, "__anchor").drop("__anchor")
    found = texts.join(met, key).where(F.contains(F.col(text), F.col(pattern)))
    if words:
        edge = F.concat(F.lit(r"(?<![0-9A-Za-z_-])\Q"), F.col(pattern), F.lit(r"\E(?![0-9A-Za-z_-])"))
        found = found.where(F.col(pattern).rlike(r"[^\x00-\x7F]") | F.regexp(F.col(text), edge))
    return found
