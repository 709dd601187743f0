import hashlib
import re

import pytest
from corpus import awkward, frame
from pyspark.sql import functions as F

from bourse.llm import exact_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute(data):
    groups = {}
    for r in data:
        groups.setdefault(norm(r[1]), []).append(r)
    out = []
    for r in data:
        g = groups[norm(r[1])]
        best = min(g, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        kept = len(r[1] or "") == len(best[1] or "") and r[0] == best[0]
        out.append((r[0], best[0], len(g), kept, hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    return sorted(map(str, out))


# two hash bits: every chain holds several texts, so bytes decide; the small capacity splits to the last bit
FEW = lambda c: F.shiftleft(F.xxhash64(c), 62)


@pytest.mark.parametrize("hashed,capacity", [(F.xxhash64, exact_dedup.CAPACITY), (F.xxhash64, 200), (FEW, 1)])
def test_equals_brute_force(spark, hashed, capacity):
    data = awkward()
    df = frame(spark, data, "h", "norm", "best")
    got = exact_dedup.index(df, hashed=hashed, capacity=capacity)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(data)
    kept = exact_dedup.keep(df, hashed=hashed, capacity=capacity)
    assert kept.columns == df.columns
    texts = [norm(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r[1]) for r in data})
    ids = {(r[0], r[1]) for r in data}
    assert all((r.doc_id, r.text) in ids for r in kept.collect())


def test_directory_splits_only_full_buckets(spark):
    heap = spark.range(4096).select(F.xxhash64("id").alias("h"), F.lit(100).alias("size"))
    cells = exact_dedup.directory(heap, 20_000, depth=12)
    sizes = heap.join(cells, F.shiftrightunsigned("h", 52) == F.col("cell")).groupBy("bucket", "depth").agg(F.sum("size").alias("s")).collect()
    assert len(sizes) > 16 and all(r.s <= 20_000 for r in sizes)
    by_depth = {(r.bucket, r.depth) for r in sizes}
    for b, d in by_depth:  # the bucket one bit up was too large
        up = (b >> (13 - d)) << (13 - d)
        assert sum(r.s for r in sizes if up <= r.bucket < up + (1 << (13 - d))) > 20_000


def test_one_group_of_copies_and_empty_table(spark):
    df = frame(spark, [(i, " same" + "\n" * (1 + i % 2), "en", "s", None) for i in range(500)])
    r = exact_dedup.index(df).agg(F.countDistinct("keep_id"), F.min("keep_id"), F.max("group_size"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(r) == (1, 1, 500, 1)
    assert exact_dedup.index(frame(spark, [])).count() == exact_dedup.keep(frame(spark, [])).count() == 0
