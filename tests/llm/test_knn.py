import math
import random

import check_oracles as co
import numpy as np
import pytest
from pyspark.sql import functions as F

from bourse.llm import knn

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    use = []
    for i, v, _ in rows:
        if i is not None and v and not any(x is None or not math.isfinite(x) for x in v):
            use.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    found = {}
    for q, a in use:
        if q % every == 0:
            found.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in use if i != q and len(a) == len(b))
    return sorted((q, r + 1, i, -s) for q, hits in found.items() for r, (s, i) in enumerate(sorted(hits)[:k]))


def vectors(n, dim, seed, spread=1.0):
    r = random.Random(seed)
    return [(i, [r.gauss(0, spread) for _ in range(dim)], 0) for i in range(n)]


AWKWARD = [(None, [1.0, 2.0], 1), (200, None, 1), (201, [], 1), (250, [1.0, None], 1), (300, [float("nan"), 1.0], 1), (350, [float("inf"), 1.0], 1),
           (400, [0.5, 0.5], 1), (400, [0.5, 0.25], 1), (401, [0.5, 0.5], 1), (402, [0.5, 0.5], 1), (403, [-3.0, 0.1], None), (450, [0.0, 0.0], 1),
           (-50, [0.5, 0.5], 1), (1000, [1.0, 1.0, 1.0], 1)]


@pytest.mark.parametrize("rows,k", [(vectors(400, 6, 1), 5), (AWKWARD, 5), (AWKWARD + vectors(60, 2, 2), 3), (vectors(3, 4, 3), 5), ([], 5),
                                    ([(i, [0.25, -0.5], 0) for i in range(300)], 5), ([(50, [1.0], 0), (1, [0.5], 0), (1, [0.9], 0), (2, [0.6], 0)], 5),
                                    ([(7, [0.25], 0)] * 400 + [(50, [1.0], 0)] * 9 + [(100, [0.5], 0), (100, [-0.5], 0), (8, [0.2], 0)], 5), (vectors(200, 3, 4, 1e6), 5)])
def test_equals_brute_force(spark, monkeypatch, rows, k):
    for name, value in (("SHARD_ROWS", 64), ("LEAF_ROWS", 8), ("BLOCK_ROWS", 3)):
        monkeypatch.setattr(knn, name, value)
    df = spark.createDataFrame(rows, KIND).withColumn("v", F.lit(1)).withColumn("id", F.lit(1))
    assert sorted(map(tuple, knn.top_k(df, k).collect())) == brute(rows, k, 50)


def test_query_equals_its_sql(spark):
    import __spark_entry__ as entry
    assert co.compare(entry.queries()["op9_top_k"](spark, SF), co.duck(SF), knn.SQL) is None


def test_tree_boxes_are_tight_and_bounds_prune(monkeypatch):
    monkeypatch.setattr(knn, "LEAF_ROWS", 16)
    rng = np.random.default_rng(0)
    centres = rng.integers(-2000, 2000, (12, 4))
    points = np.concatenate([c + rng.integers(-20, 20, (100, 4)) for c in centres]).astype(np.int64)
    t = knn.Tree(np.arange(len(points)), points)
    for (_, _, a, b), low, high in zip(t.links, t.low, t.high, strict=True):
        assert (t.points[a:b].min(0) == low).all() and (t.points[a:b].max(0) == high).all()
    back = knn.Tree.unpack(4, t.pack())
    assert all((getattr(back, f) == getattr(t, f)).all() for f in knn.Tree.FIELDS)
    opened = []
    real = np.lexsort
    monkeypatch.setattr(knn.np, "lexsort", lambda k: opened.append(len(k[0])) or real(k))
    list(t.search(np.array([-1]), points[:1], np.array([knn.LOWEST]), 5))
    assert sum(opened) < len(points) / 2
