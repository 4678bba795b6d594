import numpy as np
import pytest
from pyspark.sql import functions as F

from shiori.llm import neighbours
from shiori.llm.neighbours import VectorIndex, hamming_radius, learn_rotations


def table(spark, vectors):
    rows = [(u, None if v is None else [float(x) for x in v]) for u, v in vectors]
    return spark.createDataFrame(rows, "unit string, vector array<double>").withColumn("vector", F.col("vector").cast("array<float>"))


def groups(n_groups, size, spread, seed=0, dim=96):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_groups, dim))
    return [(f"u{g:03d}-{k:02d}", centres[g] + spread * rng.normal(size=dim)) for g in range(n_groups) for k in range(size)]


def brute(vectors, k=5):
    names = [u for u, _ in vectors]
    m = np.array([np.asarray(v, np.float32) for _, v in vectors], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    c = m @ m.T
    np.fill_diagonal(c, -9)
    return {names[i]: [(names[j], c[i, j]) for j in sorted(range(len(names)), key=lambda j: (-c[i, j], names[j]))[:k]] for i in range(len(names))}


def lists(df):
    out = {}
    for r in df.orderBy("unit", "rank").collect():
        out.setdefault(r["unit"], []).append((r["neighbour"], r["cosine"]))
    return out


def test_recall_against_brute_force(spark):
    vectors = groups(150, 4, 0.35)
    index = VectorIndex(table(spark, vectors))
    got, want = lists(index.nearest(index.edges())), brute(vectors)
    true = {(u, v) for u, l in want.items() for v, c in l if c >= 0.8}
    hits = {(u, v) for u, l in got.items() for v, _ in l}
    assert len(true) > 1000 and len(true & hits) / len(true) >= 0.95
    exact = index.exact_edges(table(spark, vectors).where("unit like '%-00'"), rows=100)
    full = lists(index.nearest(exact, table(spark, vectors).where("unit like '%-00'")))
    assert set(full) == {u for u, _ in vectors if u.endswith("-00")}
    assert all([v for v, _ in full[u]] == [v for v, _ in want[u]] for u in full)


def test_copies_and_unusable_vectors(spark):
    one, two = np.ones(96), np.r_[np.ones(95), 0.5]
    vectors = [(f"c{k:02d}", one) for k in range(30)] + [("near", two), ("near", two)]
    bad = [("null", None), ("zero", np.zeros(96)), ("nan", np.r_[np.ones(95), np.nan]), ("inf", np.r_[np.ones(95), np.inf]), ("short", np.ones(48)), (None, one)]
    index = VectorIndex(table(spark, vectors + bad), hot_rows=5)
    got = lists(index.nearest(index.edges()))
    assert set(got) == {u for u, _ in vectors}
    assert [v for v, _ in got["c00"]] == ["c01", "c02", "c03", "c04", "c05"]
    assert [v for v, _ in got["c29"]] == ["c00", "c01", "c02", "c03", "c04"] and got["c29"][0][1] == pytest.approx(1)
    assert [v for v, _ in got["near"]] == ["c00", "c01", "c02", "c03", "c04"]


def test_buckets_of_any_size(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=96)
    vectors = [(f"v{k:03d}", base + 0.02 * rng.normal(size=96)) for k in range(300)]
    index = VectorIndex(table(spark, vectors), block_rows=16)
    got, want = lists(index.nearest(index.edges())), brute(vectors)
    assert all([v for v, _ in got[u]] == [v for v, _ in want[u]] for u, _ in vectors)


def test_small_tables(spark):
    for vectors in ([], [("a", np.ones(96))], [("z", np.zeros(96))]):
        index = VectorIndex(table(spark, vectors))
        assert index.nearest(index.edges()).count() == 0


def test_rotations_and_radius():
    r = learn_rotations(np.random.default_rng(0).normal(size=(50, 8)), 2, 3)
    assert r.shape == (8, 16) and np.allclose(r[:, :8] @ r[:, :8].T, np.eye(8), atol=1e-5)
    assert hamming_radius(1.0) == 0 and hamming_radius(0.8) == 69 and hamming_radius(-1.0) == 256


def random_codes(n, flips, seed=0):
    """Codes around a few centres, with their class ids before them."""
    rng = np.random.default_rng(seed)
    bits = rng.random((8, 256))[rng.integers(0, 8, n)] < 0.5
    bits ^= rng.random((n, 256)) < flips
    words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return np.c_[rng.permutation(n).astype(np.uint64) * np.uint64(1 << 20), words], bits


def sharing(bits, tables):
    parts = bits[:, : tables * neighbours.KEY_BITS].reshape(len(bits), tables, -1)
    return (parts[:, None] == parts[None]).all(axis=3).sum(axis=2)


@pytest.mark.parametrize("depth, block", [(1, 10_000), (1, 7), (2, 10_000), (2, 40), (3, 10_000)])
def test_every_pair_that_shares_enough_substrings_is_met_once(depth, block):
    codes, bits = random_codes(400, 0.06)
    tables, radius = 12, 60
    sizes = {}
    for t in range(tables):
        for key, n in zip(*np.unique(neighbours._substring(codes[:, 1:], t), return_counts=True)):
            sizes[(t << neighbours.KEY_BITS) + int(key)] = int(n)
    plan = neighbours.Plan(sizes, tables, depth, radius, block)
    row, task, side = plan.places(codes)
    met = set()
    for one in np.unique(task):
        at = task == one
        out = neighbours.named(codes[row[at]], side[at], plan.table_of(one), plan)
        met |= set(row[at][out].tolist())
    distance = (bits[:, None] != bits[None]).sum(axis=2)
    pairs = (sharing(bits, tables) >= depth) & (distance <= radius) & ~np.eye(len(bits), dtype=bool)
    assert met == set(np.flatnonzero(pairs.any(axis=1)).tolist()) and len(met) > 100


def test_codes_within_the_pigeonhole_radius_always_meet():
    codes, bits = random_codes(600, 0.05, seed=4)
    tables = 17
    near = (bits[:, None, : tables * 7] != bits[None, :, : tables * 7]).sum(axis=2) < tables
    assert near.sum() > 5_000 and (sharing(bits, tables)[near] >= 1).all()


def test_a_bucket_of_many_rows_finds_all_pairs():
    codes, _ = random_codes(10_000, 0.0)
    codes[:, 1:] = codes[0, 1:]
    plan = neighbours.Plan({}, 1, 1, 0, 1 << 20)
    assert neighbours.named(codes, np.zeros(len(codes), int), 0, plan).all()
    assert sum(len(x) for x, _ in neighbours._close(codes[:, 1:], None, 0)) == 10_000 * 9_999 // 2


def test_true_neighbours_within_a_hot_topic(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=96)
    hot = [(f"h{k:03d}", base + 0.1 * rng.normal(size=96)) for k in range(300)]
    vectors = hot + groups(100, 4, 0.2, seed=6)
    index = VectorIndex(table(spark, vectors), block_rows=50)
    got, want = lists(index.nearest(index.edges())), brute(vectors)
    assert all([v for v, _ in got[u]] == [v for v, _ in want[u]] for u, _ in hot)


def test_pairs_of_the_least_cosine_share_a_bucket_at_any_size():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 2_000, 96))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.8 * a + 0.6 * b / np.linalg.norm(b, axis=1, keepdims=True)
    rotations = learn_rotations(np.zeros((0, 96)), 3)[:, :256]
    words = [np.packbits(x @ rotations > 0, axis=1, bitorder="little").view(np.uint64) for x in (a, b)]
    close = np.bitwise_count(words[0] ^ words[1]).sum(axis=1) <= hamming_radius(0.8)
    for size in (10_000, 1_000_000, 50_000_000, 5_000_000_000):
        tables, depth = neighbours.key_plan(size, 0.8)
        shared = sum(neighbours._substring(words[0], t) == neighbours._substring(words[1], t) for t in range(tables))
        assert tables <= 36 and ((shared >= depth) & close).mean() >= 0.95, size
