"""Filling containers of fixed capacity (problem 7): conflict-constrained best fit.

Texts longer than a container give whole containers and a rest; every other text stays in one piece.
Items are dealt to lanes of about LANE_ITEMS by their hash, so a lane fits a task whatever the input, and
each lane is packed best fit, largest first: bins lie ordered by residual capacity and carry a bitmap of
their sources and one of their groups of copies; the successor search goes up from the item's size until
it meets the tightest bin in which neither conflicts.

A bin conflicts if it holds a copy of the text or SOURCE_LIMIT texts of its source. If no bin is free of
conflict the source rule gives way; a new bin is opened next, until the lane has SLACK more bins than best
fit without conflicts needs; only beyond that may copies meet, so that a text which makes up a third of
all rows can't leave the containers empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import table
from .tokens import TOKENIZER, with_sizes

CAPACITY = 2_048
LANE_ITEMS = 8_192
SOURCE_LIMIT = 2
SLACK = 0.03


class Bins:
    """Open bins ordered by residual capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residual: list[int] = []
        self.sources: list[list[int]] = []  # level k: sources met more than k times
        self.copies: list[int] = []
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0  # bit r: some bin has residual r

    def open(self, levels: int) -> int:
        self.residual.append(self.capacity)
        self.sources.append([0] * levels)
        self.copies.append(0)
        self._file(len(self.residual) - 1)
        return len(self.residual) - 1

    def _file(self, bin_no: int) -> None:
        r = self.residual[bin_no]
        self.at[r].append(bin_no)
        self.used |= 1 << r

    def put(self, bin_no: int, size: int, source: int, copy: int) -> None:
        r = self.residual[bin_no]
        self.at[r].remove(bin_no)
        if not self.at[r]:
            self.used &= ~(1 << r)
        self.residual[bin_no] = r - size
        for level, seen in enumerate(self.sources[bin_no]):
            if not seen & source:
                self.sources[bin_no][level] |= source
                break
        self.copies[bin_no] |= copy
        self._file(bin_no)

    def tightest(self, size: int, source: int, copy: int) -> int | None:
        """The bin of least residual, at least size, without the source (at its last level) and copy."""
        rest = self.used >> size
        r = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            r += step
            for bin_no in self.at[r]:
                if not (self.copies[bin_no] & copy) and not (source and self.sources[bin_no][-1] & source):
                    return bin_no
            rest >>= step + 1
            r += 1
        return None


def pack(items: list[tuple[int, str | None, str]], capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT, slack: float = SLACK) -> list[int]:
    """Bin number of each item (size, source, copies); sizes are 1 to capacity."""
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(s for _, s, _ in items if s is not None))}
    many = [c for c, n in Counter(c for _, _, c in items).items() if n > 1]
    copy_bit = {c: 1 << k for k, c in enumerate(many)}
    order = sorted(range(len(items)), key=lambda k: (-items[k][0], items[k][2], k))
    free = Bins(capacity)  # what the sizes alone need
    for k in order:
        place = free.tightest(items[k][0], 0, 0)
        free.put(free.open(0) if place is None else place, items[k][0], 0, 0)
    allowed = len(free.residual) * (1 + slack)
    bins, out = Bins(capacity), [0] * len(items)
    # Copies go first, while there is room everywhere: late, the few open bins would all hold one already.
    for k in sorted(order, key=lambda k: items[k][2] not in copy_bit):
        size, source, copies = items[k]
        s, c = source_bit.get(source, 0), copy_bit.get(copies, 0)
        place = bins.tightest(size, s, c)
        if place is None and s:
            place = bins.tightest(size, 0, c)
        if place is None and c and len(bins.residual) >= allowed:
            place = bins.tightest(size, 0, 0)
        if place is None:
            place = bins.open(source_limit)
        bins.put(place, size, s, c)
        out[k] = place
    return out


def _pack_lanes(capacity: int, source_limit: int, slack: float):
    """Rows (lane, doc_id, piece_no, token_start, n_tokens, source, copies) sorted by lane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, lane, held = None, None, []

        def packed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            items = list(zip(*[rows.column(c).to_pylist() for c in ("n_tokens", "source", "copies")]))
            ids = pa.array([f"{lane}-{b}" for b in pack(items, capacity, source_limit, slack)])
            return pa.RecordBatch.from_arrays([ids, *[rows.column(c).combine_chunks() if rows.column(c).num_chunks else pa.array([], rows.schema.field(c).type) for c in ("doc_id", "piece_no", "token_start", "n_tokens", "source")]], names=["container_id", "doc_id", "piece_no", "token_start", "n_tokens", "source"])

        for batch in batches:
            lanes = batch.column(0).to_pylist()
            start = 0
            for at in range(1, len(lanes) + 1):
                if at == len(lanes) or lanes[at] != lanes[start]:
                    if held and lanes[start] != lane:
                        yield packed()
                        held = []
                    lane = lanes[start]
                    held.append(batch.slice(start, at - start))
                    start = at
        if held:
            yield packed()

    return run


def fill_containers(sizes: DataFrame, capacity: int = CAPACITY, lane_items: int = LANE_ITEMS, source_limit: int = SOURCE_LIMIT, slack: float = SLACK) -> DataFrame:
    """(container_id, doc_id, piece_no, token_start, n_tokens, source): where each text's tokens go.

    sizes: doc_id, source, n_tokens, copies (as with_sizes gives them; other columns are ignored).
    Defined results: texts of 0 or null tokens take no place; a null source conflicts with nothing; equal
    sizes are taken in a fixed order; an empty table gives no rows. Texts longer than capacity are cut
    every capacity tokens; their whole pieces are containers of their own.
    """
    kept = sizes.where(F.col("n_tokens") > 0).select("doc_id", "source", "n_tokens", "copies")
    whole = F.floor(F.col("n_tokens") / capacity).cast("int")
    full = kept.where(F.col("n_tokens") >= capacity).select("doc_id", "source", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece_no"))
    full = full.select(F.concat_ws("-", F.lit("whole"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string")).alias("container_id"), "doc_id", "piece_no", (F.col("piece_no") * capacity).alias("token_start"), F.lit(capacity).alias("n_tokens"), "source")
    rest = kept.withColumn("rest", (F.col("n_tokens") % capacity).cast("int")).where(F.col("rest") > 0)
    lanes = max(1, -(-rest.count() // lane_items))
    items = rest.select(F.pmod(F.xxhash64("doc_id"), F.lit(lanes)).cast("int").alias("lane"), "doc_id", whole.alias("piece_no"), (whole * capacity).cast("int").alias("token_start"), F.col("rest").alias("n_tokens"), "source", "copies")
    ordered = items.repartition(min(lanes, 10_000), "lane").sortWithinPartitions("lane", "doc_id")
    schema = f"container_id string, doc_id {dict(sizes.dtypes)['doc_id']}, piece_no int, token_start int, n_tokens int, source string"
    return ordered.mapInArrow(_pack_lanes(capacity, source_limit, slack), schema).unionByName(full)


def p7_containers(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return fill_containers(cut(with_sizes(table(spark, folder, "documents", "doc_id", "source", "text"), tokenizer)))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Number of containers, tokens, share of room used, and the containers whose conflicts were given way to:
    those with more than SOURCE_LIMIT texts of a source, and those with copies of one text."""
    sizes = cut(with_sizes(table(spark, folder, "documents", "doc_id", "source", "text"), TOKENIZER))
    rows = cut(fill_containers(sizes))
    each = rows.groupBy("container_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_texts"))
    sources = rows.where(F.col("source").isNotNull()).groupBy("container_id", "source").agg(F.count(F.lit(1)).alias("n"))
    copies = rows.join(sizes.select("doc_id", "copies"), "doc_id").groupBy("container_id", "copies").agg(F.count_distinct("doc_id").alias("n"))
    beyond = sources.groupBy("container_id").agg(F.max("n").alias("same_source")).join(copies.groupBy("container_id").agg(F.max("n").alias("same_text")), "container_id", "full_outer")
    each = each.join(beyond, "container_id", "left")
    return each.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("n_texts").alias("n_pieces"),
        F.sum("n_tokens").alias("n_tokens"),
        F.round(F.avg(F.col("n_tokens") / CAPACITY), 4).alias("mean_fill"),
        F.max("n_tokens").alias("largest"),
        F.count_if(F.col("same_source") > SOURCE_LIMIT).alias("n_beyond_source_limit"),
        F.count_if(F.col("same_text") > 1).alias("n_with_copies"),
    )


def p7_conserved(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, is_whole) of each document with a text: whether its tokens lie in the containers once each, in
    one piece unless it is longer than a container, and no container it lies in is overfull."""
    sizes = cut(with_sizes(table(spark, folder, "documents", "doc_id", "source", "text"), TOKENIZER))
    rows = cut(fill_containers(sizes))
    full = rows.groupBy("container_id").agg(F.sum("n_tokens").alias("held"))
    item = F.struct("token_start", "n_tokens")
    each = rows.join(full, "container_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("pieces"), F.max("held").alias("held"))
    ends = F.aggregate("pieces", F.lit(0), lambda at, p: F.when(p["token_start"] == at, at + p["n_tokens"]).otherwise(-1))
    joined = sizes.where(F.col("n_tokens") > 0).join(each, "doc_id", "left")
    least = F.ceil(F.col("n_tokens") / CAPACITY)
    return joined.select("doc_id", F.coalesce((ends == F.col("n_tokens")) & (F.col("held") <= CAPACITY) & (F.size("pieces") == least), F.lit(False)).alias("is_whole"))
