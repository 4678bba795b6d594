"""Parent-child links to full hierarchies (problem 6).

A parent counts within its own tree (document) only, so a tree holds whole components.

1. Rows are co-located by tree. A task takes one tree at a time, finds its components and walks each depth
   first with node colouring: white nodes are open, grey ones on the current walk, black ones finished; a
   link to a grey node is a back edge and closes a cycle. Rows leave as they arise, in batches bounded by
   their number of path elements, so paths are never held for a whole tree.
2. A tree of more than TREE_ROWS rows, as one document may hold a third of all, never enters one task. Its
   nodes that have children are split into their connected components by pointer jumping (each round
   doubles the length of every open pointer, so a chain of n nodes takes log2(n) rounds), components are
   co-located and walked as above, and all other nodes take over their parent's result in a join.
3. A component of more than max_component nodes isn't walked either: the jumps have already measured its
   depths, and its paths are put together from segments in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, release
from ..sources.tables import table
from .joins import HOT_ROWS, hot_join

#: Rows of a tree that is walked in one task, and inner nodes of a component of a larger one.
TREE_ROWS = 200_000
#: Rows and path elements of a batch that leaves a walk.
BATCH_ROWS, BATCH_CELLS = 20_000, 500_000

NODE = ["tree", "node", "parent"]
PLACE = "tree string, node string, parent string, root string, depth int, path array<string>, n_descendants long"


def clean_nodes(df: DataFrame) -> DataFrame:
    """One row per (tree, node); of several parents the smallest counts. Rows without a node id are left out."""
    return df.where(F.col("node").isNotNull()).groupBy("tree", "node").agg(F.min("parent").alias("parent"))


def inner_nodes(nodes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Nodes that are a parent within their own tree."""
    named = nodes.where(F.col("parent").isNotNull() & F.col("tree").isNotNull()).select("tree", F.col("parent").alias("node")).distinct()
    return nodes.join(named, ["tree", "node"])


def components(inner: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(tree, node, parent, label, depth): label names the component; parent is null where it is no node.

    Trees get their root as label, components with a cycle the smallest id on it and depth -1.
    """
    own = inner.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    first = hot_join(inner, own, ["tree", "parent"], "left", hot_rows).select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("parent"))
    first = cut(first.withColumns({"ptr": F.coalesce("parent", "node"), "low": F.col("node"), "open": F.col("parent").isNotNull(), "far": F.col("parent").isNotNull().cast("int")}))
    done, state, length = [first.where(~F.col("open"))], first.where(F.col("open")), 1
    all_rows, kept, before = first, [first], None
    # A round that closes no node leaves only walks that end on cycles: an open node of a tree has
    # ancestors at every distance, of which each round closes some. Then the rounds go on until they are
    # longer than any cycle.
    while (left := state.count()) and not (left == before and length >= left):
        before = left
        ahead = all_rows.select("tree", F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"), F.col("open").alias("open2"), F.col("far").alias("far2"))
        state = cut(hot_join(state, ahead, ["tree", "ptr"], "inner", hot_rows).select("tree", "node", "parent", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low"), F.col("open2").alias("open"), (F.col("far") + F.col("far2")).alias("far")))
        kept.append(state)
        done.append(state.where(~F.col("open")))
        state = state.where(F.col("open"))
        length *= 2
        all_rows = done[0]
        for part in [*done[1:], state]:
            all_rows = all_rows.unionByName(part)
    trees = done[0]
    for part in done[1:]:
        trees = trees.unionByName(part)
    trees = trees.select("tree", "node", "parent", F.col("ptr").alias("label"), F.col("far").alias("depth"))
    # What is still open runs into a cycle: after `length` steps every walk is on it and has gone all round.
    ahead = all_rows.where(F.col("open")).select("tree", F.col("node").alias("ptr"), F.col("low").alias("label"))
    cyclic = hot_join(state, ahead, ["tree", "ptr"], "inner", hot_rows).select("tree", "node", "parent", "label", F.lit(-1).alias("depth"))
    out = cut(trees.unionByName(cyclic))
    for df in kept:
        release(df)
    return out


def walk(parent: dict[str, str | None], paths: bool = True) -> Iterator[tuple[str, str | None, str, int, list[str] | None, int, bool]]:
    """Depth-first walk of the components of node -> parent: (node, parent, root, depth, path, number of
    descendants, back edge). A parent that is no node doesn't count and comes out as None.

    Nodes on a cycle, or whose parents run into one, get depth -1, no path, no descendants and the cycle's
    smallest id as root.
    """
    children: dict[str, list[str]] = {}
    roots = []
    for node, up in parent.items():
        if up is None or up not in parent:
            roots.append(node)
        else:
            children.setdefault(up, []).append(node)
    order: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    for root in roots:
        stack.append((root, 0))
        while stack:
            node, depth = stack.pop()
            order.append((node, depth))
            if node in children:
                stack.extend((child, depth + 1) for child in children[node])
    below: dict[str, int] = {}
    for node, depth in reversed(order):
        if depth:
            up = parent[node]
            below[up] = below.get(up, 0) + below.get(node, 0) + 1
    trail: list[str] = []
    root = ""
    for node, depth in order:
        if depth == 0:
            root = node
        if paths:
            del trail[depth:]
            trail.append(node)
        yield node, parent[node] if depth else None, root, depth, trail.copy() if paths else None, below.get(node, 0), False
    if len(order) == len(parent):
        return
    black = {node for node, _ in order}
    for start in parent:
        if start in black:
            continue
        # No root leads here, so walking up ends on a cycle: colour grey until a grey node closes it.
        grey: dict[str, int] = {}
        node = start
        while node not in grey:
            grey[node] = len(grey)
            node = parent[node]
        ring = [x for x, k in grey.items() if k >= grey[node]]
        low = min(ring)
        open_ = [(x, x == ring[-1]) for x in ring]
        while open_:
            node, back = open_.pop()
            if node in black:
                continue
            black.add(node)
            yield node, parent[node], low, -1, None, 0, back
            open_.extend((child, False) for child in children.get(node, ()) if child not in black)


def _walk_groups(keys: int, paths: bool):
    """Rows (tree, node, parent) sorted by tree, or (tree, label, node, parent) sorted by tree and label: each
    group is walked as soon as it is complete. Of several parents of a node the smallest counts."""
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.int64()]
    names = ["tree", "node", "parent", "root", "depth", "path", "n_descendants"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in types]
        cells = 0

        def batch() -> pa.RecordBatch:
            nonlocal cells
            result = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
            for c in out:
                c.clear()
            cells = 0
            return result

        def rows(tree: str, nodes: dict[str, str | None]) -> Iterator[pa.RecordBatch]:
            nonlocal cells
            for row in walk(nodes, paths):
                for column, value in zip(out, (tree, *row)):
                    column.append(value)
                cells += len(row[4] or ())
                if cells >= BATCH_CELLS or len(out[0]) >= BATCH_ROWS:
                    yield batch()

        current, nodes = None, {}
        for part in batches:
            columns = [c.to_pylist() for c in part.columns]
            for key, node, parent in zip(zip(*columns[:keys]), *columns[keys:]):
                if key != current:
                    if nodes:
                        yield from rows(current[0], nodes)
                    current, nodes = key, {}
                old = nodes.get(node)
                nodes[node] = parent if old is None or parent is not None and parent < old else old
        if nodes:
            yield from rows(current[0], nodes)
        if out[0]:
            yield batch()

    return run


def _jump_paths(rows: DataFrame, hot_rows: int) -> DataFrame:
    """(tree, node, path) of components too large for a task, by pointer jumping with path segments; rows:
    tree, node, parent of components without a cycle."""
    state = cut(rows.select("tree", "node", F.col("parent").alias("ptr"), F.array("node").alias("path")))
    while state.where(F.col("ptr").isNotNull()).limit(1).count():
        ahead = state.select("tree", F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("path").alias("path2"))
        joined = hot_join(state, ahead, ["tree", "ptr"], "left", hot_rows)
        longer = F.when(F.col("path2").isNull(), F.col("path")).otherwise(F.concat("path2", "path"))
        after = cut(joined.select("tree", "node", F.col("ptr2").alias("ptr"), longer.alias("path")))
        release(state)
        state = after
    return state.select("tree", "node", "path")


def _large_trees(nodes: DataFrame, paths: bool, max_component: int, hot_rows: int) -> DataFrame:
    """The places of the nodes of trees too large for a task."""
    nodes = cut(clean_nodes(nodes))
    labelled = components(inner_nodes(nodes, hot_rows), hot_rows)
    sizes = labelled.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_component).select("tree", "label")
    giants = cut(sizes)
    usual, parts = labelled, []
    none = F.lit(None).cast("array<string>")
    if giants.count():
        usual = labelled.join(giants, ["tree", "label"], "left_anti")
        large = hot_join(labelled, giants, ["tree", "label"], "inner", hot_rows)
        place = large.select("tree", "node", F.col("label").alias("root"), "depth")
        parts.append(place.join(_jump_paths(large.where(F.col("depth") >= 0), hot_rows), ["tree", "node"], "left") if paths else place.withColumn("path", none))
    near = usual.select("tree", "label", "node", "parent").repartition("tree", "label").sortWithinPartitions("tree", "label")
    parts.append(near.mapInArrow(_walk_groups(2, paths), PLACE).select("tree", "node", "root", "depth", "path"))
    inner = cut(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    up = inner.select("tree", F.col("node").alias("parent"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"), F.col("path").alias("up_path"))
    placed = hot_join(nodes, up, ["tree", "parent"], "left", hot_rows)
    path = F.when(F.col("up_depth").isNull(), F.array("node")).when(F.col("up_depth") >= 0, F.concat("up_path", F.array("node")))
    placed = placed.select(
        "tree",
        "node",
        F.when(F.col("up_depth").isNotNull(), F.col("parent")).alias("parent"),
        F.coalesce("up_root", "node").alias("root"),
        F.when(F.col("up_depth") >= 0, F.col("up_depth") + 1).otherwise(F.coalesce("up_depth", F.lit(0))).cast("int").alias("depth"),
        (path if paths else none).alias("path"),
    )
    if not paths:
        return placed.withColumn("n_descendants", F.lit(None).cast("long"))
    placed = cut(placed)
    below = descendants(placed).groupBy("tree", F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n_descendants"))
    return placed.join(below, ["tree", "node"], "left").withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0).cast("long")))


def hierarchy(nodes: DataFrame, paths: bool = True, tree_rows: int = TREE_ROWS, max_component: int = TREE_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each node's place: tree, node, parent, root, depth, path (root to node), n_descendants.

    nodes: tree, node, parent (strings; other columns are ignored). Without paths, path is null, and
    n_descendants may be. A parent counts only if it is a node of the same tree; otherwise the node is a
    root of depth 0 and its parent comes out null. Nodes on a cycle, or whose parents run into one, have
    depth -1, no path, no descendants and the cycle's smallest id as root. Defined results: repeated rows
    count once; of several parents of one node the smallest counts; a null tree holds roots only; rows
    without node id are left out; an empty table gives no rows; the empty string is an id like any other.
    """
    nodes = nodes.select(*NODE).where(F.col("node").isNotNull())
    sizes = nodes.where(F.col("tree").isNotNull()).groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.where(F.col("n") > tree_rows).select("tree"))
    some = large.count()
    own = nodes.where(F.col("tree").isNotNull())
    near = own.join(large, "tree", "left_anti") if some else own
    out = near.repartition("tree").sortWithinPartitions("tree").mapInArrow(_walk_groups(1, paths), PLACE)
    if some:
        out = out.unionByName(_large_trees(own.join(large, "tree", "left_semi"), paths, max_component, hot_rows))
    alone = nodes.where(F.col("tree").isNull()).select("node").distinct()
    none = F.lit(None).cast("string")
    path = F.array("node") if paths else F.lit(None).cast("array<string>")
    return out.unionByName(alone.select(none.alias("tree"), "node", none.alias("parent"), F.col("node").alias("root"), F.lit(0).alias("depth"), path.alias("path"), F.lit(0).cast("long").alias("n_descendants")))


def descendants(placed: DataFrame) -> DataFrame:
    """All (tree, ancestor, descendant, distance) of a result of hierarchy(); nodes on cycles have none.

    Each row comes from its own node's path, so no node's descendants are ever gathered in one place.
    """
    pairs = placed.where(F.size("path") > 1).select("tree", F.col("node").alias("descendant"), "depth", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("at", "ancestor"))
    return pairs.select("tree", "ancestor", "descendant", (F.col("depth") - F.col("at")).cast("int").alias("distance"))


def evidence_nodes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "evidence", "document_id", "evidence_id", "parent_evidence_id")
    return rows.toDF("tree", "node", "parent")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records of depth 8 or more, and those on a cycle or below one."""
    placed = hierarchy(evidence_nodes(spark, folder), paths=False)
    return placed.where((F.col("depth") >= 8) | (F.col("depth") == -1)).select(F.col("node").alias("evidence_id"), F.col("root").alias("root_id"), "depth")


def p6_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Every evidence record's path, depth, root and number of descendants."""
    out = hierarchy(evidence_nodes(spark, folder))
    return out.select(F.col("tree").alias("document_id"), F.col("node").alias("evidence_id"), F.col("root").alias("root_id"), "depth", F.array_join("path", "/").alias("path"), "n_descendants")


def p6_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """All ancestor-descendant pairs of evidence records with their distance."""
    out = descendants(hierarchy(evidence_nodes(spark, folder)))
    return out.select(F.col("tree").alias("document_id"), F.col("ancestor").alias("ancestor_id"), F.col("descendant").alias("descendant_id"), "distance")
