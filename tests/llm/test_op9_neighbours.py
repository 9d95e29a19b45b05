from __future__ import annotations

import numpy as np
import pytest

from claimhound.llm import neighbours
from claimhound.llm.neighbours import Graph, cosine, nearest, op9_small_world

VEC = "vec_id long, embedding array<float>, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else list(map(float, v)) if None not in v else v, 0) for i, v in rows], VEC)


def brute(rows, queries, k=5):
    use = {}
    for i, v in rows:
        if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v):
            use[i] = np.array(v, dtype=np.float32).astype(float)
    out = {}
    for q in queries:
        if q not in use:
            continue
        ids = [i for i in use if i != q and len(use[i]) == len(use[q])]
        score = {i: float(cosine(use[q][None], use[i][None])[0]) for i in ids}
        out[q] = [(r + 1, i, score[i]) for r, i in enumerate(sorted(ids, key=lambda i: (-score[i], i))[:k])]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_recall_of_the_query(spark):
    """Whole result at sf0.01 against brute force, over several shards too."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 50 == 0])
    got = found(op9_small_world(spark, sf))
    assert set(got) == set(want)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    for q in got:
        scores = dict((i, s) for _, i, s in want[q])
        assert all(abs(s - scores[i]) < 1e-12 for _, i, s in got[q] if i in scores)


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_of_a_full_shard(clustered):
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(4096, 64))
    if clustered:
        unit[:1400] = unit[0] + 0.05 * rng.normal(size=(1400, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    queries = unit[::32]
    sims = queries @ unit.T
    got = np.take_along_axis(sims, Graph.build(unit).search(queries, 6), axis=1)
    true = -np.sort(-sims, axis=1)[:, :6]
    assert (got >= true[:, -1:] - 1e-12).mean() > 0.95
    assert (np.diff(got, axis=1) <= 1e-12).all()


def test_ties_copies_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 8)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 2)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100, 140)]
    rows += [(200, None), (250, []), (300, [0.0] * 4), (350, [1.0, None, 2.0, 3.0]), (400, [float("nan")] * 4), (450, [float("inf")] * 4)]
    rows += [(500, [1.0, 2.0]), (501, [1.0, 1.0]), (550, [5.0])]
    df = frame(spark, rows)
    asked = df.where("vec_id % 50 = 0").unionByName(frame(spark, rows[:1]))
    got = found(nearest(df.unionByName(frame(spark, rows[60:70])), asked))
    assert got == brute(rows, [i for i, _ in rows if i % 50 == 0 and i != 550])
    assert [i for _, i, _ in got[100]] == [101, 102, 103, 104, 105]


def test_empty_tables(spark):
    empty, one = frame(spark, []), frame(spark, [(0, [1.0, 2.0])])
    assert nearest(empty, empty).count() == nearest(one, one).count() == nearest(one, empty).count() == 0
