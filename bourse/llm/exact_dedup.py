"""Exact deduplication with an extendible-hash index on shared files (DataFrame operators only).

Three files make up the index, all in the shared folder:

* the heap: one row per distinct normalised text with its bytes.  Rows are grouped by (hash, bytes), so texts
  whose hashes collide are told apart by comparing bytes; copies are combined before the shuffle.
* the directory: hash prefixes.  It starts as one bucket; while a bucket holds more than `capacity` bytes the
  directory doubles and that bucket splits on the next bit, up to MAX_DEPTH bits.  It has at most 2**MAX_DEPTH
  rows, whatever the corpus.
* the buckets: (bucket, hash) -> chain of heap entries, dealt to owner tasks by ranges of the hash.

A row is looked up by its hash.  A chain of one entry settles it: all rows with that hash had equal bytes when
the heap was built.  Where a chain is longer the row's own bytes are compared with the entries of the chain.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourse.llm.common import col, fresh, stored

BLANKS = " \t\n\x0b\x0c\r"
MAX_DEPTH = 16
#: bytes of distinct text that a bucket holds before it splits
CAPACITY = 64 << 20
ID_SPAN, LEN_SPAN = Decimal(1 << 63), Decimal(1 << 65)


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def claim(text: Column, id_: Column) -> Column:
    """Larger for the row that should stay: more code points, then the smaller id, then any id before none.

    One DECIMAL, so that its maximum is kept by hash aggregation: length * 2**65 + (2**63 - id, or 0).
    """
    length = F.coalesce(F.length(text), F.lit(0)).cast("decimal(10,0)")
    return length * F.lit(LEN_SPAN).cast("decimal(20,0)") + F.coalesce(
        F.lit(ID_SPAN).cast("decimal(20,0)") - id_.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))


def claimed_id(best: Column) -> Column:
    left = best % F.lit(LEN_SPAN).cast("decimal(20,0)")
    return F.when(left > 0, (F.lit(ID_SPAN).cast("decimal(20,0)") - left).cast("bigint"))


def directory(heap: DataFrame, capacity: int, depth: int = MAX_DEPTH) -> DataFrame:
    """cell (hash prefix of `depth` bits) -> bucket (its first cell) and the bucket's own depth."""
    cells = heap.groupBy(F.shiftrightunsigned("h", 64 - depth).alias("cell")).agg(F.sum("size").alias("size"))
    steps = cells.select("cell", "size", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    prefix = F.expr(f"shiftright(cell, {depth} - d)")
    full = (steps.groupBy("d", prefix.alias("p")).agg(F.sum("size").alias("size"))
            .where(F.col("size") > capacity).select("d", "p"))
    split = steps.select("cell", "d", prefix.alias("p")).join(full, ["d", "p"])
    # a bucket within a full one may be full as well; its depth is the number of splits on the way down
    depths = split.groupBy("cell").agg(F.least(F.count(F.lit(1)), F.lit(depth)).cast("int").alias("depth"))
    out = cells.select("cell").join(depths, "cell", "left").select("cell", F.coalesce("depth", F.lit(0)).alias("depth"))
    return out.select("cell", "depth", F.expr(f"shiftleft(shiftright(cell, {depth} - depth), {depth} - depth)").alias("bucket"))


def build(docs: DataFrame, id_col: str, text_col: str, hashed: Callable[[Column], Column], capacity: int) -> tuple[DataFrame, DataFrame]:
    """(heap, buckets)"""
    norm = normalised(col(text_col))
    heap = stored(docs.select(hashed(norm).alias("h"), norm.alias("norm"), claim(col(text_col), col(id_col)).alias("claim"))
                  .groupBy("h", "norm").agg(F.max("claim").alias("best"), F.count(F.lit(1)).alias("n"))
                  .withColumns({"size": F.octet_length("norm") + F.lit(64), "sha": F.sha2(F.encode("norm", "utf-8"), 256)}),
                  "dedup-heap")
    cells = directory(heap.select("h", "size"), capacity)
    entries = heap.select("h", "best", "n", "sha", F.shiftrightunsigned("h", 64 - MAX_DEPTH).alias("cell"))
    buckets = stored(entries.join(F.broadcast(cells), "cell")  # at most 2**MAX_DEPTH rows
                     .repartitionByRange("bucket", "h")
                     .withColumn("chain", F.count(F.lit(1)).over(W.partitionBy("bucket", "h")))
                     .select("bucket", "depth", "h", "chain", "best", "n", "sha"), "dedup-buckets")
    return heap, buckets


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          hashed: Callable[[Column], Column] = F.xxhash64, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of `docs`: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when they agree after deleting blanks, tabs, line and page
    breaks; NULL counts as empty.  The row with most code points stays, then the
    smallest id; rows without an id come last, and keep_id is NULL where no row has
    one.  Repeated rows with the same id and text are one document listed twice:
    all of them get `kept` true (`keep` returns one of them).  Ids are integers.
    """
    heap, buckets = build(docs, id_col, text_col, hashed, capacity)
    norm = normalised(col(text_col))
    rows = docs.select(col(id_col).cast("bigint").alias("id"), hashed(norm).alias("h"), claim(col(text_col), col(id_col)).alias("claim"), norm.alias("norm"))
    found = rows.drop("norm").join(buckets.where("chain = 1").select("h", "best", "n", "sha"), "h").drop("h")
    if not (shared := buckets.where("chain > 1")).isEmpty():
        chains = heap.join(shared.select("h").distinct(), "h", "left_semi").select("h", "norm", "best", "n", "sha")
        found = found.unionByName(rows.join(chains, ["h", "norm"]).drop("h", "norm"))
    return found.select(F.col("id").alias(id_col), claimed_id(F.col("best")).alias("keep_id"), F.col("n").alias("group_size"),
                        (F.col("claim") == F.col("best")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         hashed: Callable[[Column], Column] = F.xxhash64, capacity: int = CAPACITY) -> DataFrame:
    """The rows of `docs` that stay, one per text.

    They are found by (hash, claim), which differs between the copies of a text,
    so a large group of copies is spread over all tasks.
    """
    heap, buckets = build(docs, id_col, text_col, hashed, capacity)
    h, claim_, n_ = fresh(docs, "__h", "__claim", "__norm")
    norm = normalised(col(text_col))
    rows = docs.withColumns({h: hashed(norm), claim_: claim(col(text_col), col(id_col))})
    single = buckets.where("chain = 1").select(F.col("h").alias(h), F.col("best").alias(claim_))
    kept = rows.join(single, [h, claim_], "left_semi").dropDuplicates([h, claim_])
    if not (shared := buckets.where("chain > 1")).isEmpty():
        chains = heap.join(shared.select("h").distinct(), "h", "left_semi").select(
            F.col("h").alias(h), F.col("best").alias(claim_), F.col("norm").alias(n_))
        kept = kept.withColumn(n_, F.lit("")).unionByName(
            rows.withColumn(n_, norm).join(chains, [h, claim_, n_], "left_semi").dropDuplicates([h, claim_, n_]))
    return kept.select(*map(col, docs.columns))


SQL = r"""
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS c,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
    FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY t ORDER BY c DESC, doc_id)
"""
