import zlib
from collections import Counter, defaultdict

import numpy as np
from corpus import awkward, frame
from pyspark.sql import functions as F

from bourse.llm import sharding


def check(data, got, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in data)
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_awkward_rows(spark):
    data = awkward()
    check(data, sharding.shard(frame(spark, data, "size", "shard", "g"), shards=4).collect(), 4)
    assert sharding.shard(frame(spark, [])).count() == 0
    assert sharding.shard(frame(spark, [])).columns == sharding.shard(frame(spark, data)).columns


def test_sizes_are_near_equal_and_small_groups_stay_together(spark):
    df = spark.range(12_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 30)).otherwise(
        F.concat(F.repeat(F.lit("w "), (F.col("id") % 97).cast("int")), (F.col("id") / 2).cast("int").cast("string"))).alias("text"))
    got = sharding.shard(df, shards=8).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() <= 1.02 * sums.min()
    rows = got.groupby("shard").size()
    assert rows.max() <= 1.1 * rows.min()
    groups = got[got["size"] != 136].groupby("text_crc32")["shard"].nunique()
    assert groups.max() == 1 and got[got["size"] == 136]["shard"].nunique() == 8


def test_placement_takes_the_highest_dot_product():
    items = np.array([[5.0, 1, 1], [4, 4, 1], [1, 1, 6], [3, 2, 2], [1, 1, 1]])
    total, residual, want = items.sum(0), np.full((2, 3), 0.5), {}
    for i in sorted(range(5), key=lambda i: (-(items[i] / total).max(), i)):
        want[i] = max(range(2), key=lambda s: (float(residual[s] @ (sharding.WEIGHTS * items[i] / total)), -s))
        residual[want[i]] -= items[i] / total
    assert sharding.place(items, 2).tolist() == [want[i] for i in range(5)]


def test_rows_without_an_id_and_repeated_rows_are_spread(spark):
    """A third of all rows is one text without ids, or one row repeated."""
    hot = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 20)).otherwise(F.concat(F.lit("cold "), F.col("id").cast("string"))).alias("text"))
    for same in (F.lit(None).cast("long"), F.lit(7).cast("long")):
        df = hot.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, same).otherwise(F.col("doc_id")))
        got = sharding.shard(df, shards=8).toPandas()
        sums = got.groupby("shard")["size"].sum()
        assert len(sums) == 8 and sums.max() <= 1.05 * sums.min()
        assert all(sorted(v) == list(range(len(v))) for _, v in got.groupby("shard")["slot"])


def test_a_very_long_text(spark):
    rows = [(i, "x y " * 10 ** 6 if i == 3 else f"t{i}") for i in range(50)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    assert sorted(r.size for r in got)[-1] == 4 * 10 ** 6 + 16 and len(got) == 50
