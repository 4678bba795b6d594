"""The most similar vectors of every vector (problem 5): multi-index hashing.

Rotations learned on a bounded sample (iterative quantisation) turn each vector into a code of CODE_BITS
bits, whose first bits are split into substrings of KEY_BITS. Each substring is the key of one table, so
a code lies in one bucket per table. By the pigeonhole principle every pair of codes that differ in fewer
of those bits than there are tables shares a bucket; pairs farther apart share one with a probability that
falls with the angle, and the tables are as many as pairs of the wanted cosine need for RECALL.

Only codes are sent to the buckets, packed by the batch, never vectors. A bucket compares its codes in
full and names those that have a partner within the Hamming radius; a pair counts in the first bucket it
shares. Only the named vectors then travel, each once per bucket that named it, and the buckets rerank
them by their floats and give each one's k best. So no list of pairs is ever written, and a dense topic
costs as much as its vectors, not as the square of them.

Large inputs ask for more than one shared substring within a bucket (depth), which divides the
comparisons by 2 ** KEY_BITS each time without sending anything more; the tables grow a little to hold
the recall. Buckets far above the average are cut into blocks, and all pairs of blocks are compared, in a
task each: nothing is dropped. Equal vectors form one class that takes part once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import HOT_ROWS, hot_join
from ..session import cut, release
from ..sources.tables import table

DIMENSIONS = 96
K = 5
MIN_COSINE = 0.8
#: Share of the pairs of MIN_COSINE that are to share a bucket; the Hamming radius takes one in 160 of them.
RECALL = 0.975
#: Vectors the rotations are learned on, at most.
SAMPLE = 10_000
CODE_BITS, WORDS = 256, 4
KEY_BITS = 7
#: Codes of a bucket that are compared in full, on average, before another substring divides them.
SPLIT_ROWS = 8_192
#: A bucket is cut into blocks of this many codes, or four times the average bucket if that is more.
BLOCK_ROWS = 16_384


def usable(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Rows (unit, vector, class_id) with a vector of the given number of finite numbers, not all zero."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.where(F.col("unit").isNotNull() & (F.size("vector") == dimensions)).where(finite & F.exists("vector", lambda x: x != 0))
    return good.select("unit", "vector", F.xxhash64("vector").alias("class_id"))


def learn_rotations(sample: np.ndarray, count: int, iterations: int = 10, seed: int = 7) -> np.ndarray:
    """count orthogonal matrices that bring the sample's signs close to its values."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(count):
        rotation = np.linalg.qr(rng.normal(size=(sample.shape[1], sample.shape[1])))[0]
        for _ in range(iterations if len(sample) else 0):
            u, _, v = np.linalg.svd(np.sign(sample @ rotation).T @ sample)
            rotation = (u @ v).T
        out.append(rotation)
    return np.concatenate(out, axis=1).astype(np.float32)


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Rows of unit length."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return (rows / np.sqrt((rows**2).sum(axis=1))[:, None]).astype(kind, copy=False)


def _encode(rotations: np.ndarray):
    """(class_id, proof, code words) of rows (class_id, proof, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                signs = _matrix(batch.column(2), np.float32) @ rotations[:, :CODE_BITS] > 0
                words = np.packbits(signs, axis=1, bitorder="little").view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(words[:, k]) for k in range(WORDS)]], names=["class_id", "proof", *WORD_COLUMNS])

    return run


WORD_COLUMNS = [f"w{k}" for k in range(WORDS)]


def _substring(words: np.ndarray, t: int) -> np.ndarray:
    """Substring t of codes (rows of WORDS words)."""
    word, shift = divmod(t * KEY_BITS, 64)
    out = words[:, word] >> np.uint64(shift)
    if shift + KEY_BITS > 64:
        out = out | words[:, word + 1] << np.uint64(64 - shift)
    return (out & np.uint64(2**KEY_BITS - 1)).astype(np.int64)


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    """Rows (class_id, code words) of a batch with these columns."""
    return np.stack([c.to_numpy().view(np.uint64) for c in batch.columns], axis=1)


def _bucket_sizes(tables: int):
    """(bucket, n) per batch of codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(tables << KEY_BITS, np.int64)
        for batch in batches:
            words = _codes(batch)[:, 1:]
            for t in range(tables):
                total[t << KEY_BITS : t + 1 << KEY_BITS] += np.bincount(_substring(words, t), minlength=1 << KEY_BITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return run


class Plan:
    """Tasks of the buckets: one each, or one for every pair of blocks of a bucket of more than block rows."""

    def __init__(self, sizes: dict[int, int], tables: int, depth: int, radius: int, block: int):
        self.tables, self.depth, self.radius = tables, depth, radius
        buckets = tables << KEY_BITS
        self.blocks = np.ones(buckets, np.int64)
        for bucket, n in sizes.items():
            self.blocks[bucket] = max(1, -(-n // block))
        self.first = np.r_[0, np.cumsum(self.blocks * (self.blocks + 1) // 2)]

    def table_of(self, task: int) -> int:
        return int(np.searchsorted(self.first, task, "right") - 1) >> KEY_BITS

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, task, side) of each place that codes (rows class_id, code words) go to. The two blocks of
        a task are its sides; a task of one block has side 0 only."""
        rows, tasks, sides = [], [], []
        for t in range(self.tables):
            bucket = (t << KEY_BITS) + _substring(codes[:, 1:], t)
            count, first = self.blocks[bucket], self.first[bucket]
            own = ((codes[:, 0] >> np.uint64(17)) % count.astype(np.uint64)).astype(np.int64)
            for other in range(int(count.max(initial=0))):
                at = np.flatnonzero(count > other)
                low, high = np.minimum(own[at], other), np.maximum(own[at], other)
                rows.append(at)
                tasks.append(first[at] + low * count[at] - low * (low - 1) // 2 + high - low)
                sides.append((own[at] > other).astype(np.int64))
        return np.concatenate(rows), np.concatenate(tasks), np.concatenate(sides)


def _pack(plan: Plan):
    """(task, side, codes) of batches of codes: the codes of a batch that go to one side of a task, as one value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _codes(batch)
            row, task, side = plan.places(codes)
            order = np.argsort(task * 2 + side, kind="stable")
            key = (task * 2 + side)[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            width = codes.shape[1] * 8
            # Values of up to some MB each batch, so that offsets stay small.
            for at in range(0, len(starts), 4_096):
                part = np.r_[starts[at : at + 4_096], starts[at + 4_096] if at + 4_096 < len(starts) else len(key)]
                data = codes[row[order[part[0] : part[-1]]]].tobytes()
                offsets = ((part - part[0]) * width).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(part) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(key[part[:-1]] // 2), pa.array((key[part[:-1]] % 2).astype(np.int32)), blobs], names=["task", "side", "codes"])

    return run


def _close(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of codes of a and b within the radius; of a alone, each pair once, if b is None."""
    other = a if b is None else b
    columns = [np.ascontiguousarray(other[:, k]) for k in range(WORDS)]
    for at in range(0, len(a), 64):
        for to in range(at if b is None else 0, len(other), 8_192):
            differ = np.bitwise_count(a[at : at + 64, 0, None] ^ columns[0][to : to + 8_192]).astype(np.uint16)
            for k in range(1, WORDS):
                differ += np.bitwise_count(a[at : at + 64, k, None] ^ columns[k][to : to + 8_192])
            flat = np.flatnonzero(differ.ravel() <= radius)
            if len(flat):
                x, y = np.divmod(flat, differ.shape[1])
                x, y = x + at, y + to
                if b is None:
                    x, y = x[x < y], y[x < y]
                yield x, y


def named(codes: np.ndarray, side: np.ndarray, t: int, plan: Plan) -> np.ndarray:
    """Whether each code of a task of table t has a partner within the radius that it meets here first."""
    out, words = np.zeros(len(codes), bool), np.ascontiguousarray(codes[:, 1:])
    crossed = bool(side.any())

    def compare(rows: np.ndarray, last: int, shared: int) -> None:
        if shared < plan.depth:
            for t2 in range(last + 1, plan.tables):
                key = _substring(words[rows], t2)
                order = np.argsort(key, kind="stable")
                for group in np.split(rows[order], np.flatnonzero(np.diff(key[order])) + 1):
                    if len(group) > 1:
                        compare(group, t2, shared + 1)
            return
        left, right = (rows[side[rows] == 0], rows[side[rows] == 1]) if crossed else (rows, None)
        for x, y in _close(words[left], None if right is None else words[right], plan.radius):
            x, y = left[x], (left if right is None else right)[y]
            differ = words[x] ^ words[y]
            before = sum((_substring(differ, s) == 0).astype(np.int64) for s in range(last)) if last else np.zeros(len(x), np.int64)
            new = before == shared - 1
            out[x[new]] = True
            out[y[new]] = True

    compare(np.arange(len(codes)), t, 1)
    return out


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each task of batches sorted by their first column."""
    current, held = None, []
    for batch in batches:
        tasks = batch.column(0).to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(tasks)) + 1, len(tasks)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if tasks[a] != current and held:
                yield current, pa.Table.from_batches(held)
                held = []
            current = tasks[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


def _name_codes(plan: Plan):
    """(task, class_id) of the codes of each task that have a partner, from rows (task, side, codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, rows in _by_task(batches):
            parts = [np.frombuffer(b.as_buffer(), np.uint64).reshape(-1, WORDS + 1) for b in rows.column(2)]
            codes = np.concatenate(parts)
            side = np.repeat(rows.column(1).to_numpy(), [len(p) for p in parts])
            ids = codes[named(codes, side, plan.table_of(task), plan), 0].view(np.int64)
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), task)), pa.array(ids)], names=["task", "class_id"])

    return run


def best_of(ids: np.ndarray, vectors: np.ndarray, k: int, min_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cosine): the k best others of each of these vectors, of at least min_cosine."""
    ids, at = np.unique(ids, return_index=True)
    vectors, n = vectors[at], len(ids)
    if n < 2:
        return ids[:0], ids[:0], np.zeros(0)
    # Some more than k survive the rough scores, so that rounding can't lose one.
    keep, step, out = min(k + 8, n - 1), max(1, min(512, 16_000_000 // n)), []
    for at in range(0, n, step):
        rough = vectors[at : at + step] @ vectors.T
        rough[np.arange(len(rough)), np.arange(at, at + len(rough))] = -2
        top = np.argpartition(-rough, keep - 1, axis=1)[:, :keep]
        exact = np.einsum("id,ikd->ik", vectors[at : at + step].astype(np.float64), vectors[top].astype(np.float64))
        order = np.lexsort((ids[top], -exact), axis=1)[:, :k]
        exact, top = np.take_along_axis(exact, order, axis=1), np.take_along_axis(top, order, axis=1)
        row, col = np.nonzero(exact >= min_cosine)
        out.append((ids[at + row], ids[top[row, col]], exact[row, col]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _rerank(k: int, min_cosine: float):
    """(a, b, cosine) of the k best others of each vector of a task, from rows (task, class_id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_task(batches):
            a, b, cosine = best_of(rows.column(1).to_numpy(), _matrix(rows.column(2).combine_chunks(), np.float32), k, min_cosine - 1e-6)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(cosine)], names=["a", "b", "cosine"])

    return run


def _differing(min_cosine: float) -> float:
    """Share of the bits in which a pair of this cosine differs."""
    return acos(max(-1.0, min(1.0, min_cosine))) / pi


def hamming_radius(min_cosine: float) -> int:
    """Differing bits of CODE_BITS that a pair of this cosine stays within, but for one in about 160."""
    p = _differing(min_cosine)
    return ceil(CODE_BITS * p + 2.5 * sqrt(CODE_BITS * p * (1 - p)))


def key_plan(size: int, min_cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """(tables, depth) for so many vectors: substrings that a pair must share before it is compared, so that
    about SPLIT_ROWS codes remain, and the tables that give the recall at min_cosine then."""
    depth = 1
    while size > SPLIT_ROWS << depth * KEY_BITS:
        depth += 1
    same = (1 - _differing(min_cosine)) ** KEY_BITS
    for tables in range(depth, CODE_BITS // KEY_BITS + 1):
        if 1 - sum(comb(tables, i) * same**i * (1 - same) ** (tables - i) for i in range(depth)) >= recall:
            break
    return tables, depth


class VectorIndex:
    """Multi-index hash over all usable vectors of a table unit, vector (other columns are ignored).

    Defined results: rows that are not usable have no neighbours; a unit counts once, of several vectors
    of one unit one is taken, the same in every run; equal vectors are neighbours of cosine 1; units of
    equal cosine come in the order of their ids; an empty table gives no rows. Vectors are told apart by a
    64-bit fingerprint; where two different ones share it, the query fails with a message.
    """

    def __init__(self, vectors: DataFrame, min_cosine: float = MIN_COSINE, k: int = K, tables: int | None = None, dimensions: int = DIMENSIONS, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS):
        self.k, self.min_cosine, self.dimensions, self.hot_rows = k, min_cosine, dimensions, hot_rows
        self.rows = usable(vectors.select("unit", "vector"), dimensions)
        self.owners = cut(self.rows.groupBy("unit").agg(F.min("class_id").alias("class_id")))
        self.size = self.owners.count()
        planned, self.depth = key_plan(self.size, min_cosine)
        self.tables, self.block_rows = tables or planned, max(block_rows, 4 * self.size >> KEY_BITS)
        part = F.pmod("class_id", F.lit(max(1, -(-self.size // SAMPLE))))
        sample = self.rows.where(part == 0).select("vector").limit(SAMPLE).toArrow().column(0).combine_chunks()
        matrix = _matrix(sample) if len(sample) else np.zeros((0, dimensions))
        self.rotations = learn_rotations(matrix, ceil(CODE_BITS / dimensions))

    @property
    def vectors(self) -> DataFrame:
        """(class_id, vector) of each class; copies are combined on the map side."""
        return self.rows.groupBy("class_id").agg(F.first("vector").alias("vector"))

    @property
    def classes(self) -> DataFrame:
        """(class_id, units): the first k + 1 units of a class, all that a list of k neighbours can need of it."""
        firsts = self.owners.withColumn("salt", F.pmod(F.xxhash64("unit"), F.lit(64)))
        for keys in (["class_id", "salt"], ["class_id"]):
            order = Window.partitionBy(*keys).orderBy("unit")
            firsts = firsts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= self.k + 1).drop("r")
        return firsts.groupBy("class_id").agg(F.array_sort(F.collect_list("unit")).alias("units"))

    def marks(self) -> DataFrame:
        """(task, class_id) of the vectors that have a partner within the Hamming radius in a bucket."""
        schema = f"class_id long, proof long, {', '.join(f'{w} long' for w in WORD_COLUMNS)}"
        coded = self.rows.select("class_id", F.xxhash64(F.lit("proof"), "vector").alias("proof"), "vector").mapInArrow(_encode(self.rotations), schema)
        once = coded.groupBy("class_id").agg(F.min("proof").alias("low"), F.max("proof").alias("high"), *[F.min(w).alias(w) for w in WORD_COLUMNS])
        clash = F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("two vectors share a fingerprint"))).otherwise(F.col("class_id"))
        codes = cut(once.select(clash.alias("class_id"), *WORD_COLUMNS))
        counted = codes.mapInArrow(_bucket_sizes(self.tables), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        sizes = {r["bucket"]: r["n"] for r in counted.collect()}  # at most tables * 2 ** KEY_BITS rows
        plan = Plan(sizes, self.tables, self.depth, hamming_radius(self.min_cosine), self.block_rows)
        self.parts = max(8, min(8_192, sum(sizes.values()) // 65_536))
        packed = codes.mapInArrow(_pack(plan), "task long, side int, codes binary").repartition(self.parts, "task").sortWithinPartitions("task")
        out = cut(packed.mapInArrow(_name_codes(plan), "task long, class_id long"))
        release(codes)
        return out

    def edges(self) -> DataFrame:
        """(a, b, cosine), both ways: the k best classes of each class that the index finds for it, of at least min_cosine."""
        marks = self.marks()
        sent = marks.join(self.vectors, "class_id").select("task", "class_id", "vector").repartition(self.parts, "task").sortWithinPartitions("task")
        found = cut(sent.mapInArrow(_rerank(self.k, self.min_cosine), "a long, b long, cosine double"))
        release(marks)
        return found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))

    def nearest(self, edges: DataFrame, units: DataFrame | None = None) -> DataFrame:
        """(unit, neighbour, cosine, rank) of the k best by the edges, for the given units or all."""
        order = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
        best = edges.withColumn("r", F.row_number().over(order)).where(F.col("r") <= self.k).drop("r")
        classes = self.classes
        named = best.join(classes.withColumnRenamed("class_id", "b"), "b").select("a", "cosine", F.explode("units").alias("neighbour"))
        lists = named.groupBy(F.col("a").alias("class_id")).agg(F.collect_list(F.struct((-F.col("cosine")).alias("less"), "neighbour")).alias("others"))
        own = F.transform("units", lambda x: F.struct(F.lit(-1.0).alias("less"), x.alias("neighbour")))
        none = F.array().cast("array<struct<less:double,neighbour:string>>")
        full = classes.join(lists, "class_id", "left").where(F.col("others").isNotNull() | (F.size("units") > 1))
        full = full.select("class_id", F.array_sort(F.concat(own, F.coalesce("others", none))).alias("ranked"))
        asked = self.owners if units is None else self.owners.join(units.select("unit").distinct(), "unit", "left_semi")
        with_list = hot_join(asked, full, ["class_id"], "inner", self.hot_rows)
        mine = F.slice(F.filter("ranked", lambda x: x["neighbour"] != F.col("unit")), 1, self.k)
        rows = with_list.select("unit", F.posexplode(mine).alias("at", "n"))
        return rows.select("unit", F.col("n.neighbour").alias("neighbour"), F.least(-F.col("n.less"), F.lit(1.0)).alias("cosine"), (F.col("at") + 1).cast("int").alias("rank"))

    def exact_edges(self, units: DataFrame, rows: int = 32_768) -> DataFrame:
        """(a, b, cosine) of the k + 1 best classes of each class of the given units, by comparing blocks of
        the units' vectors with blocks of all vectors: the exact way for queries the index can't settle.

        Blocks of both sides hold up to rows vectors; the number of bytes sent is quadratic in the input
        over that size."""
        asked = self.owners.join(units.select("unit").distinct(), "unit", "left_semi").select("class_id").distinct()
        pool = cut(self.vectors)
        queries = cut(pool.join(asked, "class_id", "left_semi"))
        blocks, groups = max(1, ceil(self.size / rows)), max(1, ceil(queries.count() / rows))
        left = queries.select("class_id", "vector", F.pmod("class_id", F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        right = pool.select("class_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64("class_id"), F.lit(blocks)).cast("int").alias("block"))
        found = left.groupBy("g", "block").cogroup(right.groupBy("g", "block")).applyInArrow(_block_best(self.k + 1), "a long, b long, cosine double")
        return found.where(F.col("a") != F.col("b"))


def _block_best(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        ids_a, ids_b = left.column("class_id").to_numpy(), right.column("class_id").to_numpy()
        mine, all_b = _matrix(left.column("vector").combine_chunks()), _matrix(right.column("vector").combine_chunks())
        out_a, out_b, out_c = [], [], []
        short = all_b.astype(np.float32).T
        for at in range(0, len(ids_a), 512):
            cosine = mine[at : at + 512].astype(np.float32) @ short
            keep = min(k, len(ids_b))
            top = np.argpartition(-cosine, keep - 1, axis=1)[:, :keep]
            out_a.append(np.repeat(ids_a[at : at + 512], keep))
            out_b.append(ids_b[top].ravel())
            out_c.append(np.einsum("id,ikd->ik", mine[at : at + 512], all_b[top]).ravel())
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b), "cosine": np.concatenate(out_c)})

    return run


def unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "semantic_index").select(F.col("search_unit_id").alias("unit"), F.col("matrix").alias("vector"), "unit_seq")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of units of at least MIN_COSINE of which one is among the 5 nearest of the other."""
    index = VectorIndex(unit_vectors(spark, folder))
    near = index.nearest(index.edges()).where(F.col("cosine") >= MIN_COSINE)
    return near.select(F.least("unit", "neighbour").alias("unit_a"), F.greatest("unit", "neighbour").alias("unit_b")).distinct()


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest units of every unit whose unit_seq is divisible by 20, against all units.

    Queries for which the index finds 5 neighbours of at least MIN_COSINE are settled; the others, whose
    neighbours lie outside the index's radius, are compared with all vectors in blocks.
    """
    rows = unit_vectors(spark, folder)
    index = VectorIndex(rows)
    asked = cut(rows.where(F.col("unit_seq") % 20 == 0).select("unit").distinct())
    near = cut(index.nearest(index.edges(), asked))
    settled = near.where((F.col("rank") == index.k) & (F.col("cosine") >= MIN_COSINE)).select("unit")
    open_units = cut(asked.join(settled, "unit", "left_anti"))
    far = index.nearest(index.exact_edges(open_units), open_units)
    both = near.join(settled, "unit", "left_semi").unionByName(far)
    return both.select(F.col("unit").alias("search_unit_id"), F.col("neighbour").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"), "rank")
