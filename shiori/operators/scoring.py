"""Exact top-k of weighted term matches: groups of queries against all units, block by block.

Joining postings to query terms and grouping by query and unit writes a row for every pair that shares a
term, nearly all of which rank nowhere. Here a task holds one group of queries and reads the units' table
file by file, so neither side is copied for the other and only each query's k best leave the task. Scores of
a block come from a matrix product over the terms that many queries and units share, and from postings for
the rest, in single precision; every pair that could be among the k best within its error is then scored in
double precision. Memory is bounded by a group's terms, a block's units and the pairs scored at a time.

Where a boost tells how much it can give at most, units are met in two rounds: first those of each query's
largest factor, then, of the others, those whose bound reaches the query's k-th best score so far. What no
query of the group needs isn't decoded, and the few queries that alone need a class are put off: they meet
all units together with the queries that favour none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, files_of

#: Terms, queries and hits of a group, about, apart from one long query.
QUERY_TERMS, QUERY_ROWS, HITS = 1_000_000, 2_048, 250_000
#: Units of a block, at most, and pairs whose scores are held at a time.
UNIT_ROWS, CELLS = 8_192, 2_000_000
#: Terms that take the matrix product, at most, and the share of pairs that a term must score for it.
DENSE_TERMS, DENSE_SHARE = 1_024, 1 / 400
#: Matches by postings, and terms of pairs scored again, at a time.
MATCHES = 1_000_000
#: A class that a smaller share of a group's queries needs isn't read for them.
FEW = 1 / 20

#: From a group's queries, what gives for a block of units two functions: the factors of some of the queries
#: as rows, and those of single pairs.
Boost = Callable[[pa.Table], Callable[[pa.Table], tuple[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]]]]
#: From a group's queries, the factor that each hopes for, and what gives for a block of units the class of
#: each, the factor of each query and class, which is the same in every block, and the most that it gets in this block.
Reach = Callable[[pa.Table], tuple[np.ndarray, Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]]]
#: From a group's queries and its ranked hits (number of the query, rank and the columns of a hit), what leaves the task.
Finish = Callable[[pa.Table, dict[str, np.ndarray]], Iterator[pa.RecordBatch]]


def rounded(score: np.ndarray) -> np.ndarray:
    return np.floor(score * 1e8 + 0.5) / 1e8


def read_blocks(files: list[str], columns: list[str], rows: int, dictionaries: tuple[str, ...] = ()) -> Iterator[pa.Table]:
    """Parquet files as tables of at most so many rows; string columns named as dictionaries stay encoded."""
    for file in files:
        system, path = fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as handle:
            reader = pq.ParquetFile(handle, read_dictionary=list(dictionaries))
            # Row groups have dictionaries of their own, which no batch can join.
            for group in range(reader.num_row_groups):
                for batch in reader.iter_batches(rows, row_groups=[group], columns=columns, use_threads=False):
                    yield pa.Table.from_batches([batch])


def read_needed(files: list[str], columns: list[str], small: list[str], rows: int, dictionaries: tuple[str, ...], needed: Callable[[pa.Table], np.ndarray]) -> Iterator[pa.Table]:
    """Like read_blocks, but only the rows that needed() marks by their small columns; groups without any aren't read."""
    for file in files:
        system, path = fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as handle:
            reader = pq.ParquetFile(handle, read_dictionary=list(dictionaries))
            for group in range(reader.num_row_groups):
                mask = needed(reader.read_row_group(group, columns=small, use_threads=False))
                at = 0
                for batch in reader.iter_batches(rows, row_groups=[group], columns=columns, use_threads=False) if mask.any() else ():
                    part = mask[at : at + batch.num_rows]
                    at += batch.num_rows
                    if part.any():
                        yield pa.Table.from_batches([batch if part.all() else batch.filter(pa.array(part))])


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column, and the row of each."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes)


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each span of n places, one after the other."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


class _Queries:
    """A group of queries: weights of the frequent terms as a matrix, those of the others as sorted keys."""

    def __init__(self, table: pa.Table):
        terms, self._row = _lists(table.column("terms"))
        self.n, self.terms = table.num_rows, pc.unique(terms)
        self._code = pc.index_in(terms, self.terms).to_numpy(zero_copy_only=False).astype(np.int64)
        self._factor = _lists(table.column("factors"))[0].to_numpy(zero_copy_only=False)
        self.total = np.bincount(self._row, self._factor, self.n)
        self.column: np.ndarray | None = None

    def choose(self, count: np.ndarray, n_units: int, dense_terms: int, dense_share: float) -> None:
        """Which terms are frequent, by the number of units of a block that hold each."""
        share = np.bincount(self._code, minlength=len(self.terms)) / self.n * (count / n_units)
        top = np.argsort(-share, kind="stable")[:dense_terms]
        top = top[share[top] > dense_share]
        self.column = np.full(len(self.terms), -1)
        self.column[top] = np.arange(len(top))
        at = self.column[self._code]
        held = at >= 0
        self.exact = np.zeros((self.n, len(top)))
        self.exact[self._row[held], at[held]] = self._factor[held]
        self.rough = self.exact.astype(np.float32)
        #: Relative error of a score in single precision, with room: all its parts are positive.
        self.slack = (len(top) + 16) * 2.0**-23
        self.row, self.code, self.factor = self._row[~held], self._code[~held], self._factor[~held]
        self.bounds = np.searchsorted(self.row, np.arange(self.n + 1))
        keys = self.row * len(self.terms) + self.code
        turn = np.argsort(keys)
        self._keys, self._values = np.append(keys[turn], -1), np.append(self.factor[turn], 0.0)

    def weights(self, row: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The weight of a term in a query, 0 where the query lacks it."""
        at = self.column[code]
        held = at >= 0
        out = np.zeros(len(row))
        out[held] = self.exact[row[held], at[held]]
        key = row[~held] * len(self.terms) + code[~held]
        place = np.searchsorted(self._keys[:-1], key)
        out[~held] = np.where(self._keys[place] == key, self._values[place], 0.0)
        return out


class _Units:
    """A block of units in the codes of a group's terms."""

    def __init__(self, table: pa.Table, queries: _Queries, k1: float, b: float, average: float, dense: tuple[int, float]):
        terms, unit = _lists(table.column("terms"))
        tf = _lists(table.column("tfs"))[0].to_numpy(zero_copy_only=False).astype(np.float64)
        if not pa.types.is_dictionary(terms.type):
            terms = terms.dictionary_encode()
        self.n, self.ids = table.num_rows, table.column("unit_seq").to_numpy()
        length = np.bincount(unit, tf, self.n)
        known_as = pc.index_in(terms.dictionary, queries.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = known_as[terms.indices.to_numpy(zero_copy_only=False)]
        known = np.flatnonzero(code >= 0)
        self.code, unit, tf = code[known], unit[known], tf[known]
        self.weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[unit] / (average or 1.0)))
        self.bounds = np.searchsorted(unit, np.arange(self.n + 1))
        if queries.column is None:
            queries.choose(np.bincount(self.code, minlength=len(queries.terms)), self.n, *dense)
        at = queries.column[self.code]
        held = at >= 0
        self.dense = np.zeros((queries.rough.shape[1], self.n), np.float32)
        self.dense[at[held], unit[held]] = self.weight[held]
        code, unit, weight = self.code[~held], unit[~held], self.weight[~held]
        turn = np.argsort(code, kind="stable")
        self._unit, self._weight = unit[turn], weight[turn]
        self._count = np.bincount(code, minlength=len(queries.terms))
        self._first = np.cumsum(self._count) - self._count

    def rough(self, queries: _Queries, which: np.ndarray) -> np.ndarray:
        """Scores of some of the queries with all units of the block, in single precision."""
        out = queries.rough[which] @ self.dense
        flat, cells = out.reshape(-1), out.size
        size = queries.bounds[which + 1] - queries.bounds[which]
        span = _spans(queries.bounds[which], size)
        row, code, factor = np.repeat(np.arange(len(which)), size), queries.code[span], queries.factor[span]
        met = self._count[code] > 0
        row, code, factor = row[met], code[met], factor[met]
        done, at = np.cumsum(self._count[code]), 0
        while at < len(code):
            # So many query terms as have some millions of matches.
            to = at + max(1, int(np.searchsorted(done[at:], (done[at - 1] if at else 0) + MATCHES, "right")))
            n = self._count[code[at:to]]
            here = _spans(self._first[code[at:to]], n)
            cell = np.repeat(row[at:to] * self.n, n) + self._unit[here]
            np.add(flat, np.bincount(cell, np.repeat(factor[at:to], n) * self._weight[here], cells), out=flat, casting="unsafe")
            at = to
        return out

    def exact(self, queries: _Queries, q: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of pairs and how many terms each shares."""
        score, shared = np.zeros(len(q)), np.zeros(len(q), np.int64)
        size = self.bounds[u + 1] - self.bounds[u]
        done, at = np.cumsum(size), 0
        while at < len(q):
            to = at + max(1, int(np.searchsorted(done[at:], (done[at - 1] if at else 0) + MATCHES, "right")))
            here = _spans(self.bounds[u[at:to]], size[at:to])
            pair = np.repeat(np.arange(to - at), size[at:to])
            factor = queries.weights(q[at:to][pair], self.code[here])
            score[at:to] = np.bincount(pair, factor * self.weight[here], to - at)
            shared[at:to] = np.bincount(pair[factor > 0], minlength=to - at)
            at = to
        return score, shared


class _Best:
    """The k best hits of each query so far; hits wait in a list until they are worth sorting in."""

    def __init__(self, n: int, k: int, larger_first: bool):
        self.n, self.k, self._sign = n, k, -1 if larger_first else 1
        self.floor = np.full(n, -np.inf)
        self._held = [np.zeros(0, np.int64), *[np.zeros(0)] * 3, *[np.zeros(0, np.int64)] * 2]
        self._waiting: list[tuple[np.ndarray, ...]] = []
        self._size = 0

    def add(self, q: np.ndarray, final: np.ndarray, base: np.ndarray, unit: np.ndarray, shared: np.ndarray) -> None:
        order = rounded(final)
        good = order >= self.floor[q]
        self._waiting.append(tuple(x[good] for x in (q, order, final, base, unit, shared)))
        self._size += int(good.sum())
        if self._size > max(self.n, len(self._held[0]), 100_000):
            self.sort()

    def sort(self) -> None:
        if self._size:
            rows = [np.concatenate(x) for x in zip(self._held, *self._waiting)]
            turn = np.lexsort((self._sign * rows[4], -rows[1], rows[0]))
            q = rows[0][turn]
            turn = turn[np.arange(len(q)) - np.searchsorted(q, q) < self.k]
            self._held = [x[turn] for x in rows]
            full = np.flatnonzero(np.bincount(self._held[0], minlength=self.n) == self.k)
            self.floor[full] = self._held[1][np.searchsorted(self._held[0], full, "right") - 1]
        self._waiting, self._size = [], 0

    def hits(self) -> dict[str, np.ndarray]:
        self.sort()
        q, _, score, base, unit, shared = self._held
        return {"query": q, "rank": (np.arange(len(q)) - np.searchsorted(q, q) + 1).astype(np.int32), "unit_seq": unit, "score": score, "base_score": base, "matched_terms": shared}


def _plain(table: pa.Table, hits: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    ids = table.column("query_id").combine_chunks()
    for at in range(0, len(hits["query"]), 50_000):
        part = {name: x[at : at + 50_000] for name, x in hits.items()}
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(part.pop("query"))), *map(pa.array, part.values())], names=["query_id", *part])


def _scorer(files: list[str], k: int, k1: float, b: float, average: float, larger_first: bool, boost: Boost | None, reach: Reach | None, keep: tuple[str, ...], finish: Finish, limits: tuple[int, int, int, float], put_off: bool = False, shares: int = 1):
    """put_off: hits of queries that are put off are left out. shares: above 1, the column share says which of the files a group reads."""
    unit_rows, cells, *dense = limits
    columns, terms = ["unit_seq", "terms", "tfs", *keep], ("terms.list.element",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [batch for batch in batches if batch.num_rows]
        if not given:
            return
        table = pa.Table.from_batches(given)
        queries, best = _Queries(table), _Best(table.num_rows, k, larger_first)
        boosts = boost(table) if boost else None
        mine = files[table.column("share")[0].as_py() :: shares] if shares > 1 else files

        def meet(block: pa.Table, need: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> None:
            """Scores a block; need: which queries need any of it, the class of each unit, and the queries' classes of this round."""
            units = _Units(block, queries, k1, b, average, tuple(dense))
            factors, factor_of = boosts(block) if boosts else (None, None)
            step = max(1, cells // units.n)
            asking = np.arange(queries.n) if need is None else np.flatnonzero(need[0])
            for at in range(0, len(asking), step):
                which = asking[at : at + step]
                rough = units.rough(queries, which)
                if factors:
                    rough *= factors(which)
                floor = best.floor[which] - 1e-8
                new = np.flatnonzero(np.isneginf(floor))
                if len(new) and units.n > k:
                    floor[new] = np.partition(rough[new], units.n - k, axis=1)[:, units.n - k]
                least = np.maximum(floor * (1 - 2 * queries.slack), np.finfo(np.float32).tiny).astype(np.float32)
                q, u = np.divmod(np.flatnonzero(rough >= least[:, None]), units.n)
                q = which[q]
                if need is not None:
                    now = need[2][q, need[1][u]]
                    q, u = q[now], u[now]
                base, shared = units.exact(queries, q, u)
                best.add(q, base * factor_of(q, u) if factors else base, base, units.ids[u], shared)
            if np.isneginf(best.floor).all():
                best.sort()

        if reach is None:
            for block in read_blocks(mine, columns, unit_rows, terms):
                meet(block, None)
        else:
            hope, classes = reach(table)
            # A term's weight stays below k1 + 1.
            most = queries.total * (k1 + 1) * (1 + 1e-9)
            late = np.zeros(queries.n, bool)

            def needs(part: pa.Table, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                kind, factor, upper = classes(part)
                turn = (factor >= hope[:, None]) == first
                need = turn & (upper * most[:, None] >= best.floor[:, None] - 1e-8) & ~late[:, None]
                if put_off and not first:
                    late[need[:, need.sum(axis=0) < FEW * queries.n].any(axis=1)] = True
                    need[late] = False
                return need, kind, turn

            def marked(first: bool) -> Callable[[pa.Table], np.ndarray]:
                def needed(part: pa.Table) -> np.ndarray:
                    need, kind, turn = needs(part, first)
                    rounds[0] |= not turn.all()
                    return need.any(axis=0)[kind]

                return needed

            rounds = [False]
            for first in (True, False):
                for block in read_needed(mine, columns, list(keep), unit_rows, terms, marked(first)):
                    need, kind, turn = needs(block, first)
                    if need.any():
                        meet(block, (need[:, np.unique(kind)].any(axis=1), kind, turn))
                best.sort()
                if not rounds[0]:
                    break
        hits = best.hits()
        if put_off and reach:
            hits = {name: x[~late[hits["query"]]] for name, x in hits.items()}
        del queries, best, boosts
        pa.default_memory_pool().release_unused()
        yield from finish(table, hits)

    return run


def _tasks(n: int, terms: int, k: int, parallel: int) -> int:
    """How many groups so many queries make; a number that follows the queries, as the bytes say nothing of the work."""
    least = max(ceil(terms / QUERY_TERMS), ceil(n / QUERY_ROWS), ceil(n * k / HITS), ceil(n / 64) if n < 64 * parallel else parallel)
    return max(1, ceil(least / parallel) * parallel if least > parallel else least)


def top_scores(units: DataFrame, queries: DataFrame, k: int, k1: float, b: float, average_length: float, larger_first: bool = False, boost: Boost | None = None, keep: tuple[str, ...] = (), finish: tuple[Finish, str] | None = None, reach: tuple[Reach, str] | None = None) -> DataFrame:
    """(query_id, rank, unit_seq, score, base_score, matched_terms): the k best units of each query.

    units: unit_seq, terms, tfs and the columns to keep for boost; all terms of a unit, as they make up its
    length. queries: query_id, terms (distinct), factors (positive) and what boost needs. A score is the sum
    over shared terms of factor * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average_length)), times
    the boost; it ranks rounded to 8 places, ties by unit_seq. Units that share no term with a query are no
    hits. finish: what makes other rows of a group's queries and hits, and their schema; not with reach. reach:
    bounds of the boost, and the column of the queries that says which units they favour, null for all alike;
    groups are made of neighbours in it.
    Units that cut() or a stored index didn't write are written first: every task reads all their files.
    """
    parallel = units.sparkSession.sparkContext.defaultParallelism
    plain = f"query_id {dict(queries.dtypes)['query_id']}, rank int, unit_seq long, score double, base_score double, matched_terms long"
    make, schema = finish or (_plain, plain)
    limits = (UNIT_ROWS, CELLS, DENSE_TERMS, DENSE_SHARE)
    files = files_of(units)

    def scored(groups: DataFrame, put_off: bool = False, shares: int = 1) -> DataFrame:
        return groups.mapInArrow(_scorer(files, k, k1, b, average_length, larger_first, boost, reach and reach[0], keep, make, limits, put_off, shares), schema)

    def size(df: DataFrame) -> tuple[int, int]:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("t")).first()
        return row["n"], row["t"] or 0

    if not reach:
        return scored(queries.repartition(_tasks(*size(queries), k, parallel)))
    n, terms = size(queries.where(F.col(reach[1]).isNotNull()))
    settled = None
    if n:
        groups = queries.where(F.col(reach[1]).isNotNull()).repartitionByRange(_tasks(n, terms, k, parallel), reach[1], "query_id").sortWithinPartitions(reach[1])
        settled = cut(scored(groups, put_off=True))
        queries = queries.join(settled.select("query_id").distinct(), "query_id", "left_anti")
    # Few queries that meet all units: as few groups as memory allows, each over a share of the files in parallel.
    n, terms = size(queries)
    groups = max(1, ceil(terms / QUERY_TERMS), ceil(n / QUERY_ROWS), ceil(n * k / HITS))
    shares = max(1, min(len(files), parallel // groups))
    place = F.col("share") * groups + F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")
    shared = queries.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    hits = scored(shared.repartitionById(shares * groups, place), shares=shares)
    if shares > 1:
        unit = F.desc("unit_seq") if larger_first else F.asc("unit_seq")
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.floor(F.col("score") * 1e8 + 0.5).desc(), unit))
        hits = hits.withColumn("rank", best).where(F.col("rank") <= k)
    return hits if settled is None else settled.unionAll(hits)
