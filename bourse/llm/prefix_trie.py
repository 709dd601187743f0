"""Prefix trie of conversations from vertical bitmaps, one shard of conversations at a time.

A conversation is the sequence of its turns' digests (SHA-256 of role and text), written one after another; texts
are never shuffled.  Conversations are range-sorted by that path, so a trie node's members stand side by side, and
cut into shards of SHARD rows.  A shard indexes (position, turn) to the bitset of its conversations; starting from
all of them, the bitset of a node is intersected with the postings of the next position.  Each non-empty
intersection is a child, its popcount the number of members, and the members that end there are the node's end list.

All numbers of a node are sums over shards: what a node is counted for once (its own saving, being a child) is
credited to its first shard, being childless to its last.  A shard sees from the last path before it and the first
path behind it which of its nodes go on there.  Those open nodes, at most one path on each side of a shard, are
merged by the digest of their prefix; all others are final.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourse.llm.common import col, small, stored

#: conversations of a shard (a power of two), of a sorted part, and the largest number of parts
SHARD, PART, PARTS = 2048, 4096, 8192
#: ids per piece of an end list
PIECE = 4096
#: bytes of a turn's digest
KEY = 32
EMPTY = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
          "ends_sha256 string, node string, parent string, first_end bigint, ends string")


def turn_key(role: Column, text: Column) -> Column:
    """Hex digest of one turn; the length of the role keeps (role, text) apart."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def threads(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, path, words): a conversation's turn digests by turn, no number first, equal numbers by digest; and their word counts.

    Rows without a conv_id take no part; NULL roles and texts are empty.  A row holds the digests of one
    conversation (32 bytes a turn), which is the unit the trie is made of.
    """
    role, text = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(col(conv_col).isNotNull()).select(
        col(conv_col).cast("bigint").alias("conv_id"),
        F.struct(col(turn_col).alias("turn"), turn_key(role, text).alias("key"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words")).alias("t"))
    sorted_ = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _by_turn).alias("t"))
    return sorted_.select("conv_id", F.unhex(F.array_join("t.key", "")).alias("path"), F.col("t.words").alias("words"))


def _by_turn(a: Column, b: Column) -> Column:
    """No turn number before any; then by number, then by digest."""
    below = (a["turn"].isNull() & b["turn"].isNotNull()) | (a["turn"] < b["turn"]) | (a["turn"].eqNullSafe(b["turn"]) & (a["key"] < b["key"]))
    same = a["turn"].eqNullSafe(b["turn"]) & (a["key"] == b["key"])
    return F.when(same, 0).when(F.coalesce(below, F.lit(False)), -1).otherwise(1)


def rebuilt(rows: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Conversation c takes its first h turns from conversation c - c % family, h = crc32(c as text) % heads."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = rows.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.substring("path", 1, KEY * heads).alias("head"), F.slice("words", 1, heads).alias("head_words"))
    joined = rows.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % family}).join(base, "base", "left")
    return joined.select(
        "conv_id",
        F.concat(F.coalesce(F.expr(f"substring(head, 1, h * {KEY})"), F.lit(b"")), F.expr(f"substring(path, h * {KEY} + 1)")).alias("path"),
        F.concat(F.coalesce(F.expr("slice(head_words, 1, h)"), F.array().cast("array<bigint>")), F.expr("slice(words, h + 1, size(words))")).alias("words"))


def shared_turns(a: bytes | None, b: bytes) -> int:
    """Turns two paths have in common at their start; -1 without a first path."""
    if a is None:
        return -1
    n = min(len(a), len(b)) // KEY
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid * KEY] == b[:mid * KEY] else (low, mid - 1)
    return low


def bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


@dataclass
class Node:
    members: int
    depth: int
    parent: int
    #: a member whose path the node lies on
    on: int
    children: int = 0
    leaves: int = 0
    saved: int = 0


def shard_nodes(ids: list[int], paths: list[bytes], words: list[list[int]], before: bytes | None, behind: bytes | None) -> Iterator[tuple]:
    """Rows of SCHEMA for conversations sorted by (path, id); `before` and `behind` are the paths next to the shard."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    ids, paths, words = ([x[i] for i in order] for x in (ids, paths, words))
    first, last = order.index(0), order.index(len(ids) - 1)
    size = [len(p) // KEY for p in paths]
    postings: list[dict[bytes, int]] = [defaultdict(int) for _ in range(sorted(size)[-2] if len(size) > 1 else 0)]
    ends: dict[int, int] = defaultdict(int)
    for i, p in enumerate(paths):
        ends[size[i]] |= 1 << i
        # where only one conversation is left there is nothing to intersect
        for d in range(min(size[i], len(postings))):
            postings[d][p[d * KEY:(d + 1) * KEY]] |= 1 << i
    opened, closing = shared_turns(before, paths[first]), shared_turns(behind, paths[last])

    def goes_back(n: Node) -> bool:
        return n.depth <= opened and n.members >> first & 1 == 1

    def goes_on(n: Node) -> bool:
        return n.depth <= closing and n.members >> last & 1 == 1

    nodes, todo = [Node((1 << len(ids)) - 1, 0, -1, 0)], [0]
    while todo:
        at = todo.pop()
        node = nodes[at]
        rest = node.members & ~ends[node.depth]
        while rest:
            i = (rest & -rest).bit_length() - 1
            alone = rest == 1 << i
            child = rest if alone else rest & postings[node.depth][paths[i][node.depth * KEY:(node.depth + 1) * KEY]]
            rest ^= child
            todo.append(len(nodes))
            nodes.append(Node(child, node.depth + 1, at, i))
    for n in reversed(nodes):
        fresh = not goes_back(n)
        if n.depth:
            n.saved += (n.members.bit_count() - fresh) * words[n.on][n.depth - 1]
        if n.members & ~ends[n.depth] == 0 and not goes_on(n):
            n.leaves = 1
        if n.parent >= 0:
            up = nodes[n.parent]
            up.children += fresh
            up.leaves += n.leaves
            up.saved += n.saved

    def digest(n: Node) -> str:
        return hashlib.sha256(paths[n.on][:n.depth * KEY]).hexdigest()

    def smallest(n: Node) -> int:
        return ids[(n.members & -n.members).bit_length() - 1]

    for n in nodes:
        up = nodes[n.parent] if n.parent >= 0 else None
        own = [ids[i] for i in bits(n.members & ends[n.depth])]
        open_, up_open = goes_back(n) or goes_on(n), up is not None and (goes_back(up) or goes_on(up))
        row = (smallest(n), n.depth, None if up is None or up_open else smallest(up), n.members.bit_count(), n.children, n.leaves, n.saved)
        if not open_:
            yield (*row, hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), None, digest(up) if up_open else None, None, None)
            continue
        cut = [own[a:a + PIECE] for a in range(0, len(own), PIECE)] or [[]]
        for j, piece in enumerate(cut):
            numbers = row if j == 0 else (row[0], row[1], None, 0, 0, 0, 0)
            yield (*numbers, None, digest(n), digest(up) if up else None, piece[0] if piece else None, ",".join(map(str, piece)) if piece else None)


def sharded(rows: DataFrame) -> DataFrame:
    """The rows by (path, id) with the number of their sorted part and of their shard within it."""
    n = min(PARTS, max(1, -(-rows.count() // PART)))
    place = F.monotonically_increasing_id()  # part * 2**33 + place in the part
    laid = rows.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").select(
        "conv_id", "path", "words", F.shiftright(place, 33).alias("part"), F.shiftright(place.bitwiseAND(F.lit((1 << 33) - 1)), SHARD.bit_length() - 1).alias("shard"))
    return stored(laid, "trie-shards")


def edges(laid: DataFrame) -> DataFrame:
    """(part, shard, before, behind): the paths next to each shard."""
    at = F.struct("path", "conv_id")
    ends = laid.groupBy("part", "shard").agg(F.min(at).alias("low"), F.max(at).alias("high"))
    within = W.partitionBy("part").orderBy("shard")
    inner = ends.select("part", "shard", F.lag("high.path").over(within).alias("before"), F.lead("low.path").over(within).alias("behind"))
    # one row per part, at most PARTS
    parts = ends.groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    across = W.orderBy("part")
    outer = parts.select("part", F.lag("high.path").over(across).alias("part_before"), F.lead("low.path").over(across).alias("part_behind"))
    return inner.join(F.broadcast(outer), "part").select(
        "part", "shard", F.coalesce("before", "part_before").alias("before"), F.coalesce("behind", "part_behind").alias("behind"))


def trie(rows: DataFrame) -> DataFrame:
    """One row per distinct prefix of the paths of `rows` (conv_id, path, words); see SCHEMA up to ends_sha256.

    `rows` has one row per conversation; an empty path counts as a member and an end of the root.  No rows, no root.
    """
    laid = sharded(rows)
    mark = edges(laid)
    members = laid.select("part", "shard", F.lit(0).alias("mark"), "conv_id", "path", "words")
    none = F.array().cast("array<bigint>")
    for sign, name in ((-1, "before"), (1, "behind")):
        members = members.unionByName(mark.where(F.col(name).isNotNull()).select(
            "part", "shard", F.lit(sign).alias("mark"), F.lit(None).cast("bigint").alias("conv_id"), F.col(name).alias("path"), none.alias("words")))

    def run(table: pa.Table) -> pa.Table:
        cols = {n: table.column(n).to_pylist() for n in ("mark", "conv_id", "path", "words")}
        side = {m: p for m, p in zip(cols["mark"], cols["path"], strict=True) if m}
        own = sorted((p, i, w) for m, i, p, w in zip(cols["mark"], cols["conv_id"], cols["path"], cols["words"], strict=True) if not m)
        got = list(zip(*shard_nodes([x[1] for x in own], [x[0] for x in own], [x[2] for x in own], side.get(-1), side.get(1)), strict=True))
        return pa.Table.from_arrays([pa.array(c, pa.string() if k == "string" else pa.int64()) for c, (_, k) in zip(got, fields, strict=True)], [n for n, _ in fields])

    fields = [tuple(f.split()) for f in SCHEMA.split(", ")]
    found = stored(members.groupBy("part", "shard").applyInArrow(run, SCHEMA), "trie-nodes")
    open_ = found.where("node is not null")
    merged = open_.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    merged = stored(merged.join(_digests(open_.where("ends is not null")), "node", "left")
                    .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))), "trie-open")
    numbers = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = small(merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")), 200_000)
    rows_ = (found.where("node is null").select(*numbers, "parent", "parent_conv_id")
             .unionByName(merged.select(*numbers, "parent", F.lit(None).cast("bigint").alias("parent_conv_id"))))
    return rows_.join(above, "parent", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), *numbers[2:])


def _digests(pieces: DataFrame) -> DataFrame:
    """(node, ends_sha256): pieces of end lists hashed in order, one piece in memory at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            names, done = [], []
            for own, ends in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if own != node:
                    if node is not None:
                        names.append(node)
                        done.append(state.hexdigest())
                    node, state = own, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(done, pa.string())], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    return (pieces.select("node", "first_end", "ends").repartition("node").sortWithinPartitions("node", "first_end")
            .mapInArrow(run, "node string, ends_sha256 string"))


def conversation_trie(turns: DataFrame, **columns: str) -> DataFrame:
    """The trie of the rebuilt conversations.  Repeated rows are turns of their own; other columns are ignored."""
    return trie(stored(rebuilt(threads(turns, **columns)), "trie-threads"))


SQL = r"""
WITH RECURSIVE crc(c, left_, v) AS (
    SELECT conv_id, conv_id::VARCHAR, 4294967295::BIGINT FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
    UNION ALL
    SELECT c, left_[2:], list_reduce(list_prepend(xor(v, ord(left_)::BIGINT), range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)
    FROM crc WHERE left_ <> ''),
h AS (SELECT c AS conv_id, xor(v, 4294967295) % 4 AS h FROM crc WHERE left_ = ''),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
    FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT h.conv_id, k, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND k > h
    UNION ALL SELECT h.conv_id, k, role, text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 20 AND k <= h),
c AS (SELECT h.conv_id, coalesce(list({'r': role, 't': text} ORDER BY k) FILTER (k IS NOT NULL), []) AS p FROM h LEFT JOIN r USING (conv_id) GROUP BY h.conv_id),
m AS (SELECT conv_id, unnest(range(len(p) + 1)) AS depth, p FROM c),
n AS (SELECT p[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(p) = depth), '')) AS ends_sha256
    FROM m GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[depth].t, '[^\x20\x09-\x0D]+')) END AS own FROM n),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT w.*, coalesce(n_children, 0) AS n_children FROM w LEFT JOIN k USING (path)),
s AS (SELECT path[1:up] AS path, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
    FROM (SELECT path, own, n_children, unnest(range(depth + 1)) AS up FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, n.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (path) LEFT JOIN n ON f.depth > 0 AND n.path = f.path[1:f.depth - 1]
"""
