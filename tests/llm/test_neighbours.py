"""Nearest neighbours against brute force, and the registered SQL of this subpackage."""

import numpy as np
import pyarrow as pa

from tests.conftest import SF
from tests.test_queries import bag
from wavecrate.llm import neighbours, queries


def brute(ids, x, k=20):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        order = [j for j in np.lexsort((ids, -scores)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want, got = brute(ids, x), found(neighbours.op5_neighbours(spark, SF))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({a for a, _ in want[q]} & {a for a, _ in got[q]}) / 20 for q in want]) >= 0.9
    assert all(abs(s - x[np.flatnonzero(ids == v)[0]] @ x[np.flatnonzero(ids == q)[0]]) < 1e-12 for q in got for v, s in got[q])


def test_norms_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 8)) * rng.uniform(0.2, 5, (120, 1))
    x[40:80] = x[40]  # a large class of equal vectors
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(3, x[3].tolist(), 0), (500, None, 0), (520, [], 0), (540, [0.0] * 8, 0), (560, [float("nan")] * 8, 0), (580, [None] + [1.0] * 7, 0), (600, [1.0], 0), (None, [1.0] * 8, 0)]
    got = found(neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))
    want = brute(np.arange(120), x)
    assert set(got) == set(want)
    assert np.mean([len({a for a, _ in want[q]} & {a for a, _ in got[q]}) / 20 for q in want]) >= 0.9
    assert [a for a, _ in got[40]][:3] == [a for a, _ in want[40]][:3]


def test_empty(spark):
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_sql(spark, duck):
    for name, sql in queries.oracle_sql().items():
        rows, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(sql).df()
        assert sorted(rows.columns) == sorted(want.columns)
        assert bag(rows, list(rows.columns)) == bag(want, list(rows.columns)), name


def test_scores_do_not_depend_on_the_rest_of_the_table(spark):
    rng = np.random.default_rng(9)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(rng.normal(size=(90, 16)))]
    of = lambda some: {(r.query_id, r.vec_id): r.score for r in neighbours.search(spark.createDataFrame(some, "vec_id long, embedding array<double>, label int")).collect()}
    whole, part = of(rows), of(rows[:60])
    assert all(whole[k] == s for k, s in part.items() if k in whole)
    x = [np.array(r[1]) for r in rows]
    assert all(s == float(np.cumsum(x[a] * x[b])[-1]) for (a, b), s in whole.items())


def test_projections_grow_with_the_table():
    assert [neighbours.hashes(n) for n in (1, 500, 50_000, 10**9)] == [1, 1, 6, 15]
    hashing = neighbours.Hashing(8, 1.0, 0.95, 10**7)
    rng, shares = np.random.default_rng(2), []
    for q in rng.normal(size=(5, 8)):
        q /= np.linalg.norm(q)
        noise = rng.normal(size=(400, 8))
        noise -= (noise @ q)[:, None] * q
        near = 0.95 * q + np.sqrt(1 - 0.95**2) * noise / np.linalg.norm(noise, axis=1)[:, None]
        hit = np.zeros(400, bool)
        for own, visited in zip(hashing.buckets(near), hashing.probes(q), strict=True):
            hit |= np.isin(own, visited)
        shares.append(hit.mean())
    assert np.mean(shares) > 0.95


def test_small_parts_and_blocks_change_no_answer(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(rng.normal(size=(300, 8)))], "vec_id long, embedding array<double>, label int")
    whole = sorted(map(tuple, neighbours.search(rows).collect()))
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "PART_BYTES", 1_000)
    assert sorted(map(tuple, neighbours.search(rows).collect())) == whole


def test_parts_stream_over_batches():
    """Two parts, one without vectors, cut into batches of any size: each query's best of its spots."""
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(500, 6)), rng.normal(size=(600, 6))
    spots = rng.integers(0, 5, 500)
    rows = [(0, False, k, x[k].tolist(), [int(spots[k])]) for k in range(500)]
    rows += [(0, True, 1_000 + k, q[k].tolist(), [k % 5, (k + 1) % 5, 9]) for k in range(600)] + [(1, True, 5_000, q[0].tolist(), [1])]
    names = ["part", "asks", "id", "vector", "spots"]
    for size in (7, 300, 2_000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[lo : lo + size], strict=True)], names) for lo in range(0, len(rows), size)]
        got: dict[int, list] = {}
        for b in neighbours._score(4)(iter(batches)):
            for qid, cid, score in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got.setdefault(qid, []).append((cid, score))
        assert len(got) == 600
        for k in range(600):
            mine = np.flatnonzero(np.isin(spots, (k % 5, (k + 1) % 5)))
            scores = neighbours.in_order(q[k], x[mine])
            assert got[1_000 + k] == [(int(mine[j]), float(scores[j])) for j in np.argsort(-scores)[:4]]
