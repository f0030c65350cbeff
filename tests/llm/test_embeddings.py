"""Tile products against all pairs in double precision."""

import numpy as np

from maskloom.llm import embeddings
from maskloom.llm.components import components


def brute(rows):
    def sound(r):
        return r[0] is not None and r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])

    nodes = [r for r in rows if sound(r)]
    links = {id(r): 0 for r in nodes}
    parent = {id(r): id(r) for r in rows}

    def root(r):
        x = id(r)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(nodes):
        for q in nodes[i + 1 :]:
            if p[2] == q[2] and len(p[1]) == len(q[1]):
                x, y = np.float32(p[1]).astype(float), np.float32(q[1]).astype(float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    links[id(p)] += 1
                    links[id(q)] += 1
                    parent[root(q)] = root(p)
    least = {}
    for r in rows:
        if r[0] is not None:
            least[root(r)] = min(r[0], least.get(root(r), r[0]))
    return sorted(((r[0], links.get(id(r), 0), least.get(root(r)), r[0] is not None and least[root(r)] == r[0]) for r in rows), key=str)


def test_bounds_are_rigorous():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    y = x + rng.normal(size=x.shape) * rng.choice([0.05, 0.2, 0.4], (300, 1))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    (qx, sx, ex), (qy, sy, ey) = embeddings.quantised(x), embeddings.quantised(y)
    approx = (qx.astype(int) @ qy.astype(int).T) * sx[:, None] * sy
    assert (np.abs(x @ y.T - approx) <= ex[:, None] + (1 + ex[:, None]) * ey).all()
    got = {(int(i), int(j)) for a, b in embeddings.tile_links(x, y, 0.93, False) for i, j in zip(a, b, strict=True)}
    assert got == set(map(tuple, np.argwhere(x @ y.T >= 0.93).tolist()))


def test_query(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = [(k, (centres[k % 12] + rng.normal(size=8) * 0.25).tolist(), k % 3 if k % 17 else None) for k in range(240)]
    rows += [(300 + k, rows[5][1], rows[5][2]) for k in range(5)]
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [1.0] * 7 + [None], 1), (403, [float("nan")] * 8, 1), (404, [float("inf")] + [0.0] * 7, 1), (405, [1.0, 2.0], 1), (406, [2.0, 4.0], 1), (407, [], 1), (None, rows[7][1], rows[7][2]), (408, [1e-30] * 8, 1), (409, [1e30] * 8, 1)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, tile int")
    want = brute(rows)
    for tile in (16, 2048):
        got = sorted(map(tuple, embeddings.near_duplicates(table, tile=tile).collect()), key=str)
        assert got == want
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 100), (300, 300), (None, 5)] + [(1000, 2000 + k) for k in range(50)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert {got[k] for k in range(1, 61)} == {1} and got[200] == 100 and got[300] == 300 and got[2049] == 1000


def test_rows_with_one_id(spark):
    """Vectors that share an id are told apart."""
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = spark.createDataFrame([(1, a, 0), (1, b, 0), (2, a, 0), (3, b, 0)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, embeddings.near_duplicates(rows).collect()))
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_products_of_many_columns_are_exact():
    rng = np.random.default_rng(5)
    for columns in (7, 1024, 1025, 5000):
        x, y = (rng.choice(np.array([-127, 126, 127], np.int8), (9, columns)) for _ in range(2))
        assert (embeddings.int_products(x, y) == x.astype(np.int64) @ y.astype(np.int64).T).all()
        assert (embeddings.int_products(np.full((1, columns), 127, np.int8), np.full((1, columns), 127, np.int8)) == 127 * 127 * columns).all()
