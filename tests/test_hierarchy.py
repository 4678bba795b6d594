import random

import pytest

from shiori.operators.hierarchy import _walk_groups, descendants, hierarchy

SCHEMA = "tree string, node string, parent string"


def brute(rows):
    parents = {}
    for tree, node, parent in rows:
        if node is not None:
            old = parents.get((tree, node))
            parents[tree, node] = min(p for p in (old, parent) if p is not None) if old is not None or parent is not None else None
    out = {}
    for tree, node in parents:
        path, at = [node], node
        while True:
            up = parents[tree, at]
            if up is None or tree is None or (tree, up) not in parents:
                out[tree, node] = (at, len(path) - 1, path[::-1])
                break
            if up in path:
                out[tree, node] = (min(path[path.index(up) :]), -1, None)
                break
            path.append(up)
            at = up
    return out


def placed(spark, rows, **options):
    df = hierarchy(spark.createDataFrame(rows, SCHEMA), **options)
    return {(r["tree"], r["node"]): (r["root"], r["depth"], r["path"]) for r in df.collect()}, df


@pytest.mark.parametrize("options", [{}, {"tree_rows": 20}, {"tree_rows": 0, "max_component": 3}, {"tree_rows": 0, "max_component": 0, "hot_rows": 5}])
def test_random_forests_with_cycles(spark, options):
    rng = random.Random(5)
    rows = []
    for t in ("a", "b", "", None):
        for k in range(40):
            rows.append((t, f"n{k:02d}", rng.choice([None, "", "missing", f"n{rng.randrange(40):02d}", f"n{rng.randrange(max(1, k)):02d}", f"n{rng.randrange(max(1, k)):02d}"])))
    rows += [("chain", f"c{k:03d}", f"c{k - 1:03d}" if k else None) for k in range(130)]
    rows += [("ring", f"r{k}", f"r{(k + 1) % 9}") for k in range(9)] + [("ring", f"t{k}", f"t{k - 1}" if k else "r4") for k in range(12)] + [("self", "s", "s"), ("self", "u", "s")]
    rows += rows[:30] + [("a", None, "n01"), ("a", "n03", "zz")]
    got, df = placed(spark, rows, **options)
    want = brute(rows)
    assert got == want
    below = {}
    for (tree, _), (_, _, path) in want.items():
        for node in (path or [])[:-1]:
            below[tree, node] = below.get((tree, node), 0) + 1
    assert {(r["tree"], r["node"]): r["n_descendants"] for r in df.collect() if r["n_descendants"]} == below
    bare, _ = placed(spark, rows, paths=False, **options)
    assert bare == {k: (root, depth, None) for k, (root, depth, _) in want.items()}


def test_star_with_a_hot_parent(spark):
    rows = [("d", "root", None)] + [("d", f"x{k}", "root") for k in range(500)]
    got, df = placed(spark, rows, tree_rows=50, hot_rows=100)
    assert got == brute(rows) == placed(spark, rows)[0]
    pairs = descendants(df).collect()
    assert len(pairs) == 500 and {(r["ancestor"], r["distance"]) for r in pairs} == {("root", 1)}


def test_descendants_are_the_paths(spark):
    rows = [("d", "a", None), ("d", "b", "a"), ("d", "c", "b"), ("d", "x", "y"), ("d", "y", "x")]
    _, df = placed(spark, rows)
    assert {(r["ancestor"], r["descendant"], r["distance"]) for r in descendants(df).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_empty_table_and_clashing_columns(spark):
    assert placed(spark, []) [0] == {}
    df = spark.createDataFrame([("d", "a", None, 1, "x")], SCHEMA + ", depth int, label string")
    assert [tuple(r) for r in hierarchy(df).collect()] == [("d", "a", None, "a", 0, ["a"], 0)]


def test_a_long_chain_is_walked_without_holding_its_paths():
    import tracemalloc

    import pyarrow as pa

    n = 200_000
    columns = [pa.array(["d"] * n), pa.array([f"n{k}" for k in range(n)]), pa.array([None] + [f"n{k}" for k in range(n - 1)])]
    rows = pa.RecordBatch.from_arrays(columns, names=["tree", "node", "parent"])
    bare = pa.Table.from_batches(_walk_groups(1, False)(iter([rows])))
    assert bare.column("depth").to_pylist() == list(range(n)) and bare.column("n_descendants")[0].as_py() == n - 1
    tracemalloc.start()
    count = sum(b.num_rows for b in _walk_groups(1, True)(iter([rows.slice(0, 8_000)])))
    assert count == 8_000 and tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()
