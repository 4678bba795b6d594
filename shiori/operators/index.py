"""Lexical index of search units: postings, terms, documents and corpus statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import compatible_fold, compatible_lower, script_run_tokens, tokens_a, tokens_b, word_pair_counts, word_pair_tokens
from ..session import cut


def tokenize(texts: DataFrame, text: str = "search_text", kind: str = "a") -> DataFrame:
    """texts with a column tokens; null texts have none."""
    fold, tokens = (compatible_fold, tokens_a) if kind == "a" else (compatible_lower, tokens_b)
    return texts.withColumn("__folded", fold(text)).withColumn("tokens", F.coalesce(tokens(F.col("__folded")), F.array().cast("array<string>"))).drop("__folded")


def term_frequencies(units: DataFrame, kind: str = "a", text: str = "search_text", key: str = "unit_seq") -> DataFrame:
    """(key, term, term_frequency) of units that have any token; the key is unique.

    A unit's text is in one row, so its terms are folded, cut and counted in the same pass, without a
    shuffle. Null texts have no terms.
    """
    tokens = script_run_tokens if kind == "a" else word_pair_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, terms, counts = [], [], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                counted = Counter(tokens(value)) if value else {}
                at += [k] * len(counted)
                terms += counted.keys()
                counts += counted.values()
                if len(terms) >= 200_000:
                    yield rows(batch, at, terms, counts)
                    at, terms, counts = [], [], []
            yield rows(batch, at, terms, counts)

    def rows(batch: pa.RecordBatch, at: list, terms: list, counts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], names=[key, "term", "term_frequency"])

    return units.select(key, text).mapInArrow(run, f"{key} {dict(units.dtypes)[key]}, term string, term_frequency long")


def inverse_document_frequency(n: float, df):
    return F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))


@dataclass
class LexicalIndex:
    """forward: unit_seq, terms, tfs, one row per unit that has any token; terms: term, document_frequency;
    documents: the units as given. Units without tokens belong to no statistic."""

    forward: DataFrame
    terms: DataFrame
    documents: DataFrame
    n_documents: int
    average_length: float
    kind: str = "a"

    @property
    def postings(self) -> DataFrame:
        """(term, unit_seq, term_frequency)"""
        both = self.forward.select("unit_seq", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
        return both.select(F.col("p.terms").alias("term"), "unit_seq", F.col("p.tfs").alias("term_frequency"))


def term_lists(units: DataFrame, kind: str = "a", text: str = "search_text", key: str = "unit_seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, terms, tfs, columns to keep) of units that have any token: the distinct tokens and how often each occurs."""
    def lists(texts: list[str | None]) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Which texts have any token, the tokens of these, and their counts."""
        if kind == "a":
            counted = [Counter(script_run_tokens(t)) if t else {} for t in texts]
            some = pa.array([k for k, c in enumerate(counted) if c], pa.int64())
            return some, pa.array([list(c) for c in counted if c], pa.list_(pa.string())), pa.array([list(c.values()) for c in counted if c], pa.list_(pa.int64()))
        text, tokens, counts = word_pair_counts(texts)
        first = np.flatnonzero(np.diff(text, prepend=-1))
        ends = pa.array(np.append(first, len(text)).astype(np.int32))
        return pa.array(text[first], pa.int64()), pa.ListArray.from_arrays(ends, tokens), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                some, terms, tfs = lists(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0).take(some), terms, tfs, *[part.column(2 + k).take(some) for k in range(len(keep))]], names=[key, "terms", "tfs", *keep])

    kinds = dict(units.dtypes)
    more = "".join(f", {c} {kinds[c]}" for c in keep)
    return units.select(key, text, *keep).mapInArrow(run, f"{key} {kinds[key]}, terms array<string>, tfs array<long>{more}")


def build(units: DataFrame, kind: str = "a") -> LexicalIndex:
    """Index of units (unit_seq unique, search_text; other columns are kept in documents).

    One pass cuts the terms, a row per unit, which is written where it arises; everything else derives from
    it. Terms are counted with a partial count on the map side, so common terms don't gather anywhere. A
    lasting index is written by sources.indexes.write_lexical.
    """
    documents = cut(units)
    return of_parts(cut(term_lists(documents, kind)), documents, kind)


def of_parts(forward: DataFrame, documents: DataFrame, kind: str, terms: DataFrame | None = None) -> LexicalIndex:
    if terms is None:
        terms = cut(forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("document_frequency")))
    length = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    size = forward.agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("a")).first()
    return LexicalIndex(forward, terms, documents, size["n"], size["a"] or 0.0, kind)
