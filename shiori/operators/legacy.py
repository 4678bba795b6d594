"""The older search path: chunk BM25 with file name, stub and project boosts, and the context budget."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compatible, compatible_lower, strip, tokens_b
from ..session import cut
from .containment import automaton, contains
from .index import LexicalIndex, inverse_document_frequency, of_parts, term_lists
from .scoring import top_scores

K1, B, TOP_K = 1.5, 0.75, 12
#: Bytes of a row group of the index, about: one or two thousand chunks.
GROUP_BYTES = 2_000_000
# Company forms left out of project names, and the marks of texts that stand for unread assets.
COMPANY = "(株式会社|医療法人社団|有限会社)"
# Fixed value: what may name a file in a query.
FILE_WORD = r"[0-9A-Za-z_][0-9A-Za-z_.\-]{2,}"
# Factors of a mentioned file, and, for a question that aims at projects, of units of these, of
# others and of none; all units are alike to other questions.
NAMED, AIMED, ASTRAY, COMMON, OTHER = 2.5, 3.0, 0.25, 1.2, 1.0
STUB, STUB_STARTS = "※OCR/VLM未実施", ("[テキスト層なし", "[画像ファイル")


def is_stub(text):
    """Whether a chunk only stands for an asset that was not read."""
    marked = F.contains(text, F.lit(STUB))
    for start in STUB_STARTS:
        marked = marked | text.startswith(start)
    return marked & (F.length(text) < 400)


def index_text(chunks: DataFrame):
    """File name, folder and location before the text; the full path stays out."""
    parts = F.split("path", "/")
    parent = F.when(F.size(parts) > 1, F.element_at(parts, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise("")
    return F.concat(F.coalesce("filename", F.lit("")), F.lit(" "), F.coalesce(parent, F.lit("")), F.lit(" "), F.coalesce("location", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))


def project_tokens(projects: DataFrame) -> DataFrame:
    """(project, token, words): what names a project in a question, and what is then left out of the terms:
    its name, and the words of its name without the company's form, of at least 3 characters each."""
    named = projects.select("project", compatible("project").alias("name"))

    def parts(between: str):
        core = F.split(strip(F.regexp_replace("name", COMPANY, between)), r"\s+")
        return F.filter(F.array_distinct(F.concat(F.array("name"), core)), lambda t: F.length(t) >= 3)

    return named.select("project", F.explode(parts("")).alias("token"), parts(" ").alias("words"))


def chunk_index(chunks: DataFrame) -> LexicalIndex:
    """Index of chunks (cid unique, path, project, filename, location, text), with what the boosts read."""
    # Chunks of a project lie together in their file, so that a search can leave out those of the others.
    documents = cut(chunks.withColumn("unit_seq", F.col("cid")).sortWithinPartitions("project"))
    about = [index_text(documents).alias("search_text"), F.coalesce(compatible_lower("filename"), F.lit("")).alias("file"), F.coalesce(is_stub(F.col("text")), F.lit(False)).alias("stub")]
    forward = term_lists(documents.select("unit_seq", "project", *about), "b", keep=("project", "file", "stub"))
    return of_parts(cut(forward, **{"parquet.block.size": GROUP_BYTES}), documents, "b")


class _Aims:
    """The projects that a group's queries aim at and the file names that they mention."""

    def __init__(self, queries: pa.Table):
        self.by_token: dict[str, list[int]] = {}
        for q, tokens in enumerate(queries.column("names_in").to_pylist()):
            for t in tokens or ():
                self.by_token.setdefault(t, []).append(q)
        self._finder = automaton(self.by_token)
        aims = [None if t is None else tuple(sorted(t)) for t in queries.column("targets").to_pylist()]
        self._kinds = {t: k for k, t in enumerate(dict.fromkeys(aims))}
        self.kind_of = np.array([self._kinds[t] for t in aims])
        self.hope = np.array([OTHER if t is None else AIMED for t in self._kinds])[self.kind_of]

    def named(self, names: list[str]) -> dict[int, set[int]]:
        """Which of the file names each query mentions."""
        out: dict[int, set[int]] = {}
        if self.by_token:
            # One pass over all names: no token holds the line break between them.
            ends = np.cumsum([len(name) + 1 for name in names])
            met = list(self._finder.iter("\n".join(names)))
            files = np.searchsorted(ends, [at for at, _ in met], "right").tolist()
            for f, t in set(zip(files, (t for _, t in met))):
                for q in self.by_token[t]:
                    out.setdefault(q, set()).add(f)
        return out

    def factors(self, projects: list[str]) -> np.ndarray:
        """The factor of each kind of query and project, and last of units without one."""
        out = np.full((len(self._kinds), len(projects) + 1), OTHER)
        for t, k in self._kinds.items():
            if t is not None:
                out[k] = [*[AIMED if p in t else ASTRAY if p else COMMON for p in projects], COMMON]
        return out


def _encoded(column: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
    """Codes and values of a column of strings; nulls have the code after the last."""
    encoded = column.combine_chunks().dictionary_encode()
    values = encoded.dictionary.to_pylist()
    return encoded.indices.fill_null(len(values)).to_numpy(zero_copy_only=False), values


def _boosts(queries: pa.Table):
    """Factors by file name, stub and project of the pairs of a group's queries and a block's units."""
    aims = _Aims(queries)
    kind_of = aims.kind_of

    def of_units(units: pa.Table):
        n = units.num_rows
        files, names = _encoded(units.column("file"))
        in_file = np.argsort(files, kind="stable")
        bounds = np.searchsorted(files[in_file], np.arange(len(names) + 1))
        units_of = {q: np.concatenate([in_file[bounds[f] : bounds[f + 1]] for f in fs]) for q, fs in aims.named(names).items()}
        named_pairs = np.sort(np.concatenate([np.zeros(0, np.int64), *[q * n + u for q, u in units_of.items()]]))
        project_of, projects = _encoded(units.column("project"))
        factor = aims.factors(projects)
        plain = np.where(units.column("stub").to_numpy(zero_copy_only=False), 0.3, 1.0)
        short, short_plain = factor.astype(np.float32), plain.astype(np.float32)

        def rows(which: np.ndarray) -> np.ndarray:
            out = np.take(short[kind_of[which]], project_of, axis=1)
            own = {(at, q): out[at, units_of[q]] for at, q in enumerate(which.tolist()) if q in units_of}
            out *= short_plain
            for (at, q), x in own.items():
                out[at, units_of[q]] = x * np.float32(NAMED)
            return out

        def pairs(q: np.ndarray, u: np.ndarray) -> np.ndarray:
            key = q * n + u
            at = np.searchsorted(named_pairs, key)
            met = np.append(named_pairs, -1)[at] == key
            return np.where(met, NAMED, plain[u]) * factor[kind_of[q], project_of[u]]

        return rows, pairs

    return of_units


def _reach(queries: pa.Table):
    """The largest factors of a group's queries, and those that a block's projects can give: a stub only lowers them."""
    aims = _Aims(queries)

    def of_units(units: pa.Table):
        project_of, projects = _encoded(units.column("project"))
        factor = aims.factors(projects)[aims.kind_of]
        upper = factor.copy()
        files, names = _encoded(units.column("file"))
        mentioned = aims.named(names)
        if mentioned:
            turn = np.argsort(files, kind="stable")
            bounds = np.searchsorted(files[turn], np.arange(len(names) + 1))
            for q, fs in mentioned.items():
                held = np.unique(np.concatenate([project_of[turn[bounds[f] : bounds[f + 1]]] for f in fs]))
                upper[q, held] = factor[q, held] * NAMED
        return project_of, factor, upper

    return aims.hope, of_units


def search(chunks: DataFrame, queries: DataFrame, top_k: int = TOP_K, index: LexicalIndex | None = None) -> DataFrame:
    """(query_id, rank, cid, score, base_score): the top_k chunks of each query (query_id, query, names).

    chunks: cid (unique), path, project, filename, location, text; names: canonical names to search as
    well. Ties go to the larger cid. Names of projects that the query aims at are used for the boost and
    left out of the terms. The index of the chunks is built unless it is given.
    """
    index = index or chunk_index(chunks)
    projects = cut(project_tokens(index.documents.where(F.length("project") > 0).select("project").distinct()))
    joined = F.concat_ws(" ", "query", F.array_join("names", " "))
    hay = queries.withColumn("hay", joined).select("query_id", compatible("hay").alias("hay"))
    hits = contains(hay, "query_id", "hay", projects, "token")
    targets = cut(hits.groupBy("query_id").agg(F.collect_set("project").alias("targets"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("tokens")))
    asked = queries.join(targets, "query_id", "left")
    none = F.array().cast("array<string>")
    tokens = F.array_sort(F.coalesce("tokens", none), lambda a, b: F.length(b) - F.length(a))
    kept_names = F.array_except(F.coalesce("names", none), F.coalesce("targets", none))
    words = asked.withColumn("words", F.concat(F.col("query"), F.lit("\n"), F.array_join(kept_names, "\n"))).withColumn("words", compatible("words"))
    asked = words.withColumn("expanded", F.aggregate(tokens, F.col("words"), lambda text, t: F.replace(text, t, F.lit(" "))))
    names = F.filter(F.regexp_extract_all("low", F.lit(FILE_WORD), F.lit(0)), lambda t: F.length(t) >= 4)
    asked = cut(asked.withColumn("low", compatible_lower("query")).select("query_id", "targets", F.array_distinct(names).alias("names_in"), compatible_lower("expanded").alias("expanded")))
    terms = asked.select("query_id", F.explode(tokens_b(F.col("expanded"))).alias("term"))
    terms = terms.groupBy("query_id", "term").agg(F.least(F.count(F.lit(1)), F.lit(3)).alias("times"))
    factor = inverse_document_frequency(index.n_documents, F.col("document_frequency")) * F.col("times")
    lists = terms.join(index.terms, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", factor.alias("f"))).alias("l"))
    lists = lists.select("query_id", F.transform("l", lambda x: x["term"]).alias("terms"), F.transform("l", lambda x: x["f"]).alias("factors"))
    aim = F.when(F.size("targets") > 0, F.array_join(F.array_sort("targets"), "\n"))
    ready = cut(lists.join(asked.drop("expanded"), "query_id").withColumn("aim", aim))
    best = top_scores(index.forward, ready, top_k, K1, B, index.average_length, larger_first=True, boost=_boosts, keep=("file", "project", "stub"), reach=(_reach, "aim"))
    return best.select("query_id", "rank", F.col("unit_seq").alias("cid"), "score", "base_score")


def chunk_header(path, location):
    """[path / location]"""
    return F.concat(F.lit("["), path, F.when(F.length(location) > 0, F.concat(F.lit(" / "), location)).otherwise(""), F.lit("]"))


def context(hits: DataFrame, chunks: DataFrame, budget: int = 60_000, show: Callable[[Column], Column] = lambda block: block) -> DataFrame:
    """(query_id, rank, cid, block, used): the blocks of the ranked chunks, up to the first that overflows the budget.

    show: what is shown of a block; it is taken before the chunks meet the hits, so that texts stay where they are."""
    block = F.concat(F.lit("--- "), chunk_header(F.col("path"), F.coalesce("location", F.lit(""))), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = hits.join(chunks.select("cid", show(block).alias("block"), F.length(block).alias("size")), "cid")
    used = F.sum("size").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("used", used).where(F.col("used") <= budget).select("query_id", "rank", "cid", "block", "used")
