import numpy as np
import pytest

from siltstone.llm import anisotropic_ann as A
from siltstone.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, tile int"


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 20))[rng.integers(0, 30, 700)] + rng.normal(size=(700, 20)) * rng.choice([0.02, 0.1, 0.5], (700, 1))
    return x.astype(np.float32), spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x.astype(np.float32))], SCHEMA)


@pytest.fixture(scope="module")
def hard_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.1, 0.0], 1), (2, [2.0, 0.0, 0.0], None), (3, [0.0, 0.0, 0.0], 3), (4, None, 4), (None, [1.0, 0.0, 0.0], 5), (5, [nan, 0.0, 0.0], 6), (6, [1.0, None, 0.0], 7), (7, [1.0], 8), (8, [], 9), (9, [0.0, 1.0, 0.0], None)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_links(x, threshold):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        low = np.minimum(root, np.where(near, root[None, :], len(x)).min(axis=1))
        if (low == root).all():
            return root, near.sum(axis=1)
        root = low


@pytest.mark.parametrize("threshold", [0.3, 0.9, 0.99])
def test_links_match_brute_force(clustered, threshold):
    x, rows = clustered
    root, n = brute_links(x, threshold)
    got = {r["vec_id"]: (r["class_id"], r["links"]) for r in E.links(rows, threshold, tile_rows=100).collect()}
    assert got == {i: (root[i], n[i]) for i in range(len(x))}


def test_a_third_of_equal_rows_and_a_third_of_near_ones(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 16))
    x[:300] = x[0]
    x[300:600] = x[300] + 0.05 * x[300:600]
    x = x.astype(np.float32)
    root, n = brute_links(x, 0.9)
    out = E.links(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA), tile_rows=128)
    assert {r["vec_id"]: (r["class_id"], r["links"]) for r in out.collect()} == {i: (root[i], n[i]) for i in range(900)}
    assert n[0] >= 299 and n[300] >= 290


def test_unite_joins_what_is_linked():
    i, j = np.array([5, 4, 1, 3]), np.array([4, 3, 2, 5])
    assert E.unite(np.arange(7), i, j).tolist() == [0, 1, 1, 3, 3, 3, 6]


def test_bounds_are_rigorous():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 16)) * 10.0 ** rng.integers(-20, 20, (200, 1))
    u, q, s, f, r = E.quantise(x)
    bound = (q @ q.T).astype(np.float64) * s[:, None] * s[None] + f[:, None] * r[None] + r[:, None] * (f + r)[None]
    assert (bound >= u @ u.T - 1e-12).all()


def test_hard_links(hard_vectors):
    got = sorted(tuple(r) for r in E.links(hard_vectors).collect())
    assert got == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 8, 0), (9, 9, 0)]
    assert E.links(hard_vectors.limit(0)).count() == 0


def test_recall(spark, clustered):
    x, rows = clustered
    product = x.astype(np.float64) @ x.T
    np.fill_diagonal(product, -np.inf)
    true = np.argsort(-product, axis=1)[:, :10]
    got = {}
    for r in A.search(rows, rerank=60, cell_rows=300, query_rows=200).collect():
        got.setdefault(r["vec_id"], []).append(r)
    hits = [len({r["neighbor_id"] for r in got[i]} & set(true[i].tolist())) for i in range(len(x))]
    assert np.mean(hits) >= 9.0
    assert all(sorted(r["rank"] for r in v) == list(range(1, 11)) for v in got.values())
    assert all(abs(r["score"] - product[r["vec_id"], r["neighbor_id"]]) < 1e-4 for v in got.values() for r in v)


def test_groups_larger_than_the_first_candidates(spark):
    """500 and 2,000 near copies, and 400 exact ones, whose ties go to the smaller ids."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3100, 64))
    x[:500] = x[0] + 0.1 * x[:500]
    x[500:2500] = x[500] + 0.3 * x[500:2500]
    x[2500:2900] = x[2500]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    product = np.einsum("ij,kj->ik", x.astype(np.float64), x.astype(np.float64))
    np.fill_diagonal(product, -np.inf)
    true = np.argsort(-product, axis=1, kind="stable")[:, :10]
    got = np.full((3100, 10), -1)
    for r in A.search(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA), query_rows=1000).collect():
        got[r["vec_id"], r["rank"] - 1] = r["neighbor_id"]
    hits = np.array([len(set(a) & set(b)) for a, b in zip(got.tolist(), true.tolist())])
    assert hits[:2500].mean() >= 9.99 and hits[2900:].mean() >= 9.99
    assert all(g == [j for j in range(2500, 2511) if j != i][:10] for i, g in zip(range(2500, 2900), got[2500:2900].tolist()))


def test_recall_over_the_embeddings(spark):
    """Every query of the registered search against brute force."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.stack(rows.orderBy("vec_id").toPandas()["embedding"].to_numpy()).astype(np.float64)
    product = x @ x.T
    np.fill_diagonal(product, -np.inf)
    true = np.argsort(-product, axis=1)[:, :10]
    got = A.query(spark, "/root/testdata/sf0.1").collect()
    assert {r["vec_id"] for r in got} == set(range(0, 2000, 100)) and len(got) == 200
    assert np.mean([r["neighbor_id"] in true[r["vec_id"]] for r in got]) >= 0.9


def test_cells_and_blocks(spark, clustered):
    """Queries in several blocks; a share of the cells, whose hits fall with it."""
    x, rows = clustered
    product = x.astype(np.float64) @ x.T
    np.fill_diagonal(product, -np.inf)
    true = np.argsort(-product, axis=1)[:, :10]

    def recall(share):
        got = A.search(rows, cell_rows=40, query_rows=30, probe_share=share, queries="vec_id % 10 = 0").collect()
        assert {r["vec_id"] for r in got} <= set(range(0, 700, 10))
        return np.mean([r["neighbor_id"] in true[r["vec_id"]] for r in got]) if len(got) == 700 else 0

    assert recall(1.0) == 1.0 and recall(0.99) >= 0.99 and recall(0.5) >= 0.8


def test_anisotropic_codes_lose_less_along_the_vector():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = np.stack([x.reshape(3000, 16, 2)[:16, j] for j in range(16)])

    def parallel(weight):
        b = book
        for _ in range(4):
            b = A.update(b, A.statistics(x, b, weight))
        codes = A.assign(x, b, weight)
        rest = x - b[np.arange(16), codes].reshape(3000, 32)
        return np.abs((rest * x).sum(axis=1)).mean()

    assert parallel(A.parallel_weight(32, 0.5)) < parallel(1.0)


def test_hard_search(hard_vectors):
    got = sorted((r["vec_id"], r["rank"], r["neighbor_id"]) for r in A.search(hard_vectors, k=2).collect())
    assert [g for g in got if g[0] == 9] == [(9, 1, 1), (9, 2, 2)]
    assert all(a != c for a, _, c in got) and {a for a, _, _ in got} == {1, 2, 3, 9}
    assert A.search(hard_vectors.limit(0)).count() == 0
