import random
import zlib

import numpy as np
import pytest
from corpus import awkward, frame
from pyspark.sql import functions as F

from bourse.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.scored(docs, quality.train(docs, labels)).join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(held) > 800 and (held["predicted"] == held["quality"]).mean() > 0.98
    one, zero = held[held["quality"] == 1]["score"], held[held["quality"] == 0]["score"]
    assert (one.to_numpy()[:, None] > zero.to_numpy()[None, :]).mean() > 0.99


def test_awkward_rows(spark):
    data = awkward()
    df = frame(spark, data, "score", "held_out", "id")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (4, 1, 0), (900, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    got = quality.scored(df, model).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1 if i is not None else False
    assert sorted(str((r.doc_id, r.held_out)) for r in got) == sorted(str((r[0], held(r[0]))) for r in data)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    kept = quality.scored(df, model, keep=True)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.scored(frame(spark, []), model).count() == 0


def test_nothing_to_learn_from(spark):
    df = frame(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    assert {r.score for r in quality.scored(df, quality.train(df, none)).collect()} == {0.5}
    assert all(r.score > 0.9 for r in quality.scored(df, quality.train(df, one)).collect())


def test_held_out_labels_and_a_larger_table_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    a = quality.train(docs, labels)
    flipped = labels.withColumn("quality", F.when(quality.remainder(F.col("doc_id")) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    b = quality.train(docs, flipped)
    assert all((x == y).all() for x, y in zip(a.tables + a.grids, b.tables + b.grids, strict=True))


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = np.zeros((4000, len(quality.FEATURES)))
    x[:, :2] = rng.normal(size=(4000, 2))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x[:3000], y[:3000])
    assert {0, 1} in [set(p) for p in m.pairs] and ((m.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


@pytest.mark.parametrize("seed", range(3))
def test_trees_take_the_best_cut(seed):
    r = np.random.default_rng(seed)
    g, h = r.normal(size=12), r.uniform(0.1, 1, 12)
    best = max(range(1, 12), key=lambda c: quality.gain(g[:c].sum(), h[:c].sum()) + quality.gain(g[c:].sum(), h[c:].sum()))
    values = quality.shallow_tree(g, h)
    assert values[best - 1] != values[best] and len(np.unique(values)) <= quality.LEAVES
    won, grid = quality.cross_tree(g.reshape(3, 4), h.reshape(3, 4))
    cuts = [(i, j) for i in range(1, 3) for j in range(1, 4)]
    g2, h2 = g.reshape(3, 4), h.reshape(3, 4)
    parts = lambda s, i, j: [s[:i, :j].sum(), s[:i, j:].sum(), s[i:, :j].sum(), s[i:, j:].sum()]
    want = max(sum(quality.gain(a, b) for a, b in zip(parts(g2, i, j), parts(h2, i, j), strict=True)) for i, j in cuts) - quality.gain(g.sum(), h.sum())
    assert abs(won - want) < 1e-9 and grid.shape == (3, 4)


def test_long_texts():
    text = " ".join(random.Random(0).choice(["the", "of", "and"]) for _ in range(10 ** 6))
    assert np.isfinite(quality.features(text)).all() and quality.features(text)[0] > 14
