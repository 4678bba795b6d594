"""Lexical search: BM25, reranked by field values and parent context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip, compatible_fold, field_values, folded_text, script_run_tokens, tokens_a
from ..session import cut, files_of
from .index import LexicalIndex, inverse_document_frequency
from .scoring import Finish, read_blocks, rounded, top_scores

K1, B = 1.2, 0.75
MAX_TERMS = 500
#: Hits whose sources a task holds at a time, about.
COVERED = 50_000


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, n_terms): the distinct terms of each query (query_id, query).

    A query without terms has no rows; one of more than MAX_TERMS fails.
    """
    folded = queries.select("query_id", compatible_fold("query").alias("folded"))
    terms = folded.select("query_id", F.array_distinct(tokens_a(F.col("folded"))).alias("terms"))
    checked = F.when(F.size("terms") > MAX_TERMS, F.raise_error(F.lit(f"a query has more than {MAX_TERMS} terms"))).otherwise(F.col("terms"))
    return terms.select("query_id", F.explode(checked).alias("term"), F.size("terms").alias("n_terms"))


def with_idf(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """Query terms that the index knows, with their inverse document frequency."""
    return terms.join(index.terms, "term").withColumn("idf", inverse_document_frequency(index.n_documents, F.col("document_frequency")))


def query_lists(idf: DataFrame) -> DataFrame:
    """(query_id, terms, factors, n_terms): each query's terms that the index knows, with their weights."""
    lists = idf.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("l"), F.first("n_terms").alias("n_terms"))
    return lists.select("query_id", F.transform("l", lambda x: x["term"]).alias("terms"), F.transform("l", lambda x: x["idf"]).alias("factors"), "n_terms")


def _units(index: LexicalIndex, unit_types: list[str] | None) -> DataFrame:
    """The units to search. A filter on unit types leaves the corpus statistics those of all units."""
    if not unit_types:
        return index.forward
    return index.forward.join(index.documents.where(F.col("unit_type").isin(unit_types)).select("unit_seq"), "unit_seq", "left_semi")


def search_bm25(index: LexicalIndex, queries: DataFrame, top_k: int = 10, unit_types: list[str] | None = None) -> DataFrame:
    """The top_k units of each query by BM25 alone."""
    lists = cut(query_lists(with_idf(index, query_terms(queries))))
    best = top_scores(_units(index, unit_types), lists.drop("n_terms"), top_k, K1, B, index.average_length)
    return best.join(lists.select("query_id", "n_terms"), "query_id").withColumnRenamed("score", "lexical_score").drop("base_score")


def _covered(files: list[str], query: np.ndarray, unit: np.ndarray, document: np.ndarray, named: np.ndarray, n_sources: np.ndarray) -> np.ndarray:
    """Hits (sorted by query) whose sources a hit of the same query and document that names a value has all, and
    more. Only sources of hits that by their number could be so are read, those of some queries at a time."""
    out = np.zeros(len(query), bool)
    known = np.flatnonzero(document >= 0)
    _, group, size = np.unique(np.stack([query[known], document[known]]), axis=1, return_inverse=True, return_counts=True)
    group = group.ravel()
    most, least = np.full(len(size), -1), np.full(len(size), np.iinfo(np.int64).max)
    np.maximum.at(most, group[named[known]], n_sources[known][named[known]])
    some = n_sources[known] >= 0
    np.minimum.at(least, group[some], n_sources[known][some])
    n = n_sources[known]
    asked = np.sort(known[some & ((n < most[group]) | named[known] & (n > least[group]))])
    group_of = np.full(len(query), -1)
    group_of[known] = group
    at = 0
    while at < len(asked):
        to = min(at + COVERED, len(asked))
        while to < len(asked) and query[asked[to]] == query[asked[to - 1]]:
            to += 1
        part = asked[at:to]
        wanted = np.unique(unit[part])
        sources: dict[int, frozenset] = {}
        for block in read_blocks(files, ["unit_seq", "sources"], 4_096):
            met = np.flatnonzero(np.isin(block.column("unit_seq").to_numpy(), wanted))
            rows = block.take(pa.array(met))
            sources |= {u: frozenset(x) for u, x in zip(rows.column("unit_seq").to_pylist(), rows.column("sources").to_pylist()) if x is not None}
        lowers: dict[tuple, list[frozenset]] = {}
        for h in part[named[part]].tolist():
            many = sources.get(int(unit[h]))
            for key in (*many, ()) if many else ():  # () stands for any source
                lowers.setdefault((group_of[h], key), []).append(many)
        for h in part.tolist():
            few = sources.get(int(unit[h]))
            if few is not None:
                out[h] = any(few < many for many in lowers.get((group_of[h], next(iter(few), ())), ()))
        at = to
    return out


def _reranker(files: list[str], top_k: int, field_value_weight: float, parent_context_penalty: float, names: list[str]) -> Finish:
    """Hits ranked anew by the values that the query names and by parents; files: unit_seq, document_id, sources, n_sources and values of all units."""

    def run(table: pa.Table, hits: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        query, unit = hits["query"], hits["unit_seq"]
        query_of = query.tolist()
        asked = ["".join(folded_text(t).split()) for t in table.column("query").to_pylist()]
        idf = [dict(zip(*x)) for x in zip(table.column("terms").to_pylist(), table.column("factors").to_pylist())]
        turn = np.argsort(unit, kind="stable")
        order = unit[turn]
        documents: dict[str, int] = {}
        document = np.full(len(unit), -1)
        n_sources = np.full(len(unit), -1)
        named: dict[int, tuple[str, ...]] = {}
        # Values recur over units and hits: each is folded once, and each sum made once.
        folds: dict[str, str] = {}
        terms: dict[str, set[str]] = {}
        sums: dict[tuple, float] = {}
        bonus = np.zeros(len(unit))
        for block in read_blocks(files, ["unit_seq", "document_id", "n_sources", "values"], 4_096):
            ids = block.column("unit_seq").to_numpy()
            first, last = np.searchsorted(order, ids), np.searchsorted(order, ids, "right")
            met = np.flatnonzero(last > first)
            for row, low, high in zip(block.take(pa.array(met)).to_pylist(), first[met].tolist(), last[met].tolist()):
                if row["document_id"] is not None:
                    document[turn[low:high]] = documents.setdefault(row["document_id"], len(documents))
                n_sources[turn[low:high]] = row["n_sources"]
                bare = []
                for v in row["values"] or ():
                    x = folds.get(v)
                    if x is None:
                        x = folds[v] = "".join(folded_text(v).split())
                    if 2 <= len(x) <= 64:
                        bare.append((v, x))
                for h in turn[low:high].tolist() if bare else ():
                    q = query_of[h]
                    text = asked[q]
                    found = tuple([v for v, x in bare if x in text])
                    if found:
                        total = sums.get((q, found))
                        if total is None:
                            for v in found:
                                if v not in terms:
                                    terms[v] = set(script_run_tokens(v))
                            known = idf[q]
                            total = sums[q, found] = field_value_weight * sum(known[t] for t in set().union(*(terms[v] for v in found)) if t in known)
                        named[h], bonus[h] = found, total
            if len(folds) > 200_000:
                folds.clear()
            if len(terms) > 50_000:
                terms.clear()
            if len(sums) > 200_000:
                sums.clear()
        names_any = np.zeros(len(unit), bool)
        names_any[list(named)] = True
        penalty = np.where(_covered(files, query, unit, document, names_any, n_sources), parent_context_penalty, 0.0)
        score = hits["score"] + bonus - penalty
        turn = np.lexsort((unit, -rounded(score), query))
        nth = np.arange(len(turn)) - np.searchsorted(query[turn], query[turn])
        turn, nth = turn[nth < top_k], nth[nth < top_k]
        for at in range(0, len(turn), 20_000):
            h = turn[at : at + 20_000]
            values = pa.array([named.get(x, ()) for x in h.tolist()], pa.list_(pa.string()))
            given = [table.column(c).take(pa.array(query[h])).combine_chunks() for c in ("query_id", "n_terms")]
            yield pa.RecordBatch.from_arrays([given[0], pa.array(nth[at : at + 20_000] + 1, pa.int32()), *map(pa.array, (score[h], hits["score"][h], bonus[h], penalty[h])), values, pa.array(hits["matched_terms"][h]), given[1], pa.array(unit[h])], names=names)

    return run


def search(
    index: LexicalIndex,
    queries: DataFrame,
    top_k: int = 10,
    unit_types: list[str] | None = None,
    snippet_chars: int = 500,
    k1: float = K1,
    b: float = B,
    field_value_weight: float = 0.5,
    parent_context_penalty: float = 2.0,
) -> DataFrame:
    """The top_k units of each query (query_id, query) after reranking the first max(50, 5 * top_k) by BM25.

    A unit gains for each short field value that the query names, and loses if a unit of the same document
    that names one has all its sources and more. Null and empty queries have no hits; ties go to the
    smaller unit_seq.
    """
    if top_k < 1 or snippet_chars < 1 or field_value_weight < 0 or parent_context_penalty < 0:
        raise ValueError("top_k and snippet_chars must be at least 1, weights at least 0")
    lists = cut(query_lists(with_idf(index, query_terms(queries))).join(queries.select("query_id", "query"), "query_id"))
    sources = F.array_distinct("source_evidence_ids")
    about = index.documents.select("unit_seq", "document_id", sources.alias("sources"), F.when(F.col("source_evidence_ids").isNull(), -1).otherwise(F.size(sources)).alias("n_sources"), field_values(F.col("search_text")).alias("values"))
    names = ["query_id", "rank", "score", "lexical_score", "field_value_bonus", "parent_context_penalty", "exact_field_value_matches", "matched_terms", "n_terms", "unit_seq"]
    kinds = [dict(queries.dtypes)["query_id"], "int", *["double"] * 4, "array<string>", "long", "int", "long"]
    rerank = _reranker(files_of(about), top_k, field_value_weight, float(parent_context_penalty), names)
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, kinds))
    best = cut(top_scores(_units(index, unit_types), lists, max(50, 5 * top_k), k1, b, index.average_length, finish=(rerank, schema)))
    texts = index.documents.select("unit_seq", "search_unit_id", "document_id", "unit_type", "source_evidence_ids", clip(F.col("search_text"), snippet_chars).alias("text"))
    return best.join(texts, "unit_seq").select(*names, "search_unit_id", "document_id", "unit_type", "source_evidence_ids", "text")
