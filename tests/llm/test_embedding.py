import numpy as np
import pytest

from schemaloom.llm import embedding_dedup as E


def brute(rows, threshold=0.93):
    ok = [r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if list(a) == list(b) or a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], low[find(i)]) for i in range(n))


def result(df, **how):
    return sorted((r.vec_id, r.n_links, r.component_id) for r in E.dedup(df, **how).collect())


def test_odd_rows_and_tiles(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=8)
    rows = [(i, (centre + 0.05 * rng.normal(size=8)).tolist(), 1) for i in range(60)]
    rows += [(100 + i, rng.normal(size=8).tolist(), 2) for i in range(40)]
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] * 8, 1), (203, [None] * 8, 1), (204, rows[0][1], None), (205, rows[0][1], 1), (206, rows[0][1], 2), (207, [], 1), (208, [1.0], 1), (209, [2.0], 1), (0, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    assert result(df) == want
    assert result(df, tile=16) == want
    assert E.dedup(df.limit(0)).count() == 0


def test_no_width_is_left_out(spark):
    rows = [(w, [1.0] * w, 1) for w in range(1, 1203)] + [(w + 5000, [1.0] * (w - 1) + [1.001], 1) for w in (134, 708, 1196)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.component_id for r in E.dedup(df).collect()}
    assert got == {i: i - 5000 if i > 5000 else i for i, _, _ in rows}


@pytest.mark.parametrize("n,lean", [(4000, 0.0), (200_000_000, 0.0), (4000, 0.7), (4000, 0.95), (4000, 0.999)])
def test_recall_at_the_threshold(n, lean):
    """Pairs at the threshold exactly, of vectors that lean one way with that mean cosine."""
    rng = np.random.default_rng(5)
    centre = E.unit(rng.normal(size=(1, 64)))
    x = E.unit(np.sqrt(lean) * centre + np.sqrt(1 - lean) * E.unit(rng.normal(size=(6000, 64))))
    index = E.fit(x[:4000], n, 0.93)
    assert lean < 0.9 or len(index.pivots) <= 64
    x = x[4000:]
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * E.unit(u)
    p, q, apart = E.meeting(index.permutations(x), index.permutations(y))
    assert np.mean((p >= 0) & (apart <= index.slack)) > 0.95
    assert len(E.fit(x, 10**9, 0.93).pivots) > len(E.fit(x, 1000, 0.93).pivots) or lean > 0.5


def test_meeting_points():
    a, b = np.array([[4, 2, 9], [1, 2, 3]], np.int16), np.array([[9, 7, 4], [4, 5, 3]], np.int16)
    p, q, apart = E.meeting(a, b)
    assert p.tolist() == [4, -1] and q.tolist() == [9, -1] and apart.tolist() == [0, 0]


@pytest.mark.parametrize("lean", [0.0, 0.7])
def test_recall_through_the_index(spark, lean):
    """Against brute force over all rows, with pairs about the threshold and groups of copies."""
    rng = np.random.default_rng(8)
    base = E.unit(np.sqrt(lean) * E.unit(rng.normal(size=(1, 48))) + np.sqrt(1 - lean) * E.unit(rng.normal(size=(700, 48))))
    near = E.unit(np.repeat(base[:150], 4, 0) + E.unit(rng.normal(size=(600, 48))) * rng.uniform(0.0, 0.45, (600, 1)))
    x = np.vstack([base, near])
    hit = (x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in E.dedup(df, tile=300).collect()}
    assert all(got[i] <= k for i, k in enumerate(hit.sum(1)))
    assert sum(got.values()) >= 0.95 * hit.sum() > 500


def test_table_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.op3_embedding_dedup(spark, sf).collect())
    assert got == brute(rows)
