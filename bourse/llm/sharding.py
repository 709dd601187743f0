"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Equal texts form a group that stays together.  What is packed is a bounded list of items, however large the
corpus: groups above 1/PARCELS of all bytes, tokens or rows are items of their own (at most PARCELS of them for
each measure), all others are combined into PARCELS parcels by a hash of the text.  A group that would fill more
than a quarter of a shard is split by a hash of its rows, as no packing could balance it whole.  Items are placed
largest first, each in the shard where the dot product of the item with the shard's residual capacity is highest;
bytes weigh most in it, as the law asks for near equal bytes.

Only totals per item reach the driver (some 16,000 rows at most); rows find their shard by a join with that list.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourse.llm.common import col, stored

SHARDS, PARCELS, RANGES = 40, 4096, 1024
MEASURES = ("size", "tokens", "rows")
WEIGHTS = np.array([16.0, 1.0, 1.0])


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of measures)."""
    total = np.maximum(items.sum(0), 1)
    vectors = items / total
    residual, out = np.full((shards, items.shape[1]), 1.0 / shards), np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -vectors.max(1))):
        out[i] = s = int((residual @ (WEIGHTS * vectors[i])).argmax())
        residual[s] -= vectors[i]
    return out


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row of `docs`, under the law `bytes`.

    size is the text's UTF-8 bytes plus 16; tokens are counted as runs of
    non-blanks.  NULL texts count as empty.  slot numbers the rows of a shard from
    0 without gaps.  Rows of a split group are told apart by their id and their place in
    the table, so rows without an id and repeated rows are spread as well and get a
    place each.  Other columns are ignored.  An empty table gives an empty result.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    rows = stored(docs.select(
        col(id_col).alias("id"), (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("g"),
        F.regexp_count(text, F.lit(r"\S+")).cast("bigint").alias("tokens"), F.monotonically_increasing_id().alias("row")), "shard-rows")
    sums = [F.sum("size").cast("double").alias("size"), F.sum("tokens").cast("double").alias("tokens"), F.count(F.lit(1)).cast("double").alias("rows")]
    total = rows.agg(*sums).first()
    if not total.rows:
        return rows.select(col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                           F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    heavy = F.lit(False)
    pieces = F.lit(1)
    for m in MEASURES:
        heavy = heavy | (F.col(m) * PARCELS > (total[m] or 1))
        pieces = F.greatest(pieces, F.ceil(F.col(m) * (4 * shards) / F.lit(total[m] or 1)))
    # at most PARCELS groups per measure can be above 1/PARCELS of its total
    own = stored(rows.groupBy("g", "crc").agg(*sums).where(heavy).select("g", "crc", pieces.cast("int").alias("pieces")), "shard-heavy")
    item = rows.join(F.broadcast(own), ["g", "crc"], "left").withColumns({
        "parcel": F.when(F.col("pieces").isNull(), F.pmod("g", F.lit(PARCELS))).otherwise(F.col("g")),
        "piece": F.when(F.col("pieces").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("id", "row", F.lit(13)), F.col("pieces")).cast("int"))})
    found = sorted(tuple(r) for r in item.groupBy("parcel", "piece").agg(*sums).collect())
    spots = place(np.array([r[2:] for r in found]), shards)
    spark = docs.sparkSession
    plan = spark.createDataFrame([(r[0], r[1], int(s)) for r, s in zip(found, spots, strict=True)], "parcel bigint, piece int, shard int")
    placed = item.join(F.broadcast(plan), ["parcel", "piece"]).withColumn("range", F.pmod(F.xxhash64("id", "row", F.lit(17)), F.lit(RANGES)))
    # a shard is numbered through by ranges: first the ranges' counts, then rows within a range
    counts = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "range", before.alias("start"))  # shards * RANGES rows at most
    slot = F.col("start") + F.row_number().over(W.partitionBy("shard", "range").orderBy("id", "crc", "size", "row")) - 1
    return placed.join(F.broadcast(starts), ["shard", "range"]).select(
        col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        slot.cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
