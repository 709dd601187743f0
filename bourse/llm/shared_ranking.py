"""Ranked lexical search for many queries at once: common subexpressions are evaluated once per document.

A query (item) is a bag of terms and its score a sum over them, so items that share terms share partial sums.
`mined` finds the shared term sets of a block of items: the two operands that stand together in most items become
one new operand, again and again until no two stand together twice.  The result is a DAG: leaves are
terms, inner nodes are partial sums of two nodes, and an item is a sum of nodes.  A task turns a batch of documents
into one accumulator per leaf, adds up every inner node once, level by level, and combines the nodes
into all items' scores.  Only each item's best documents leave a task.

Items travel in blocks of about BLOCK terms, so what a task and the driver hold is bounded whatever the number of
items; every block is held against all documents.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourse.llm.common import col, pieces

#: (item, term) rows of a block, documents of a batch, operands among which shared pairs are sought
BLOCK, BATCH, SEGMENT = 16_384, 128, 64
#: first-round groups in which the best documents of an item are merged
SLOTS = 256

#: fixed values: what a term is made of, and which letters are lower-cased
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: the same on UTF-8 bytes: letters folded, everything that is no part of a term a blank
_BLANK = bytes(set(range(128)) - set((UPPER + LOWER + "0123456789").encode()))
FOLD = bytes.maketrans(_BLANK + UPPER.encode(), b" " * len(_BLANK) + LOWER.encode())


def found_in(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order."""
    return text.encode().translate(FOLD).split() if text else []


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


@dataclass
class Plan:
    """A block of items as a DAG over its vocabulary."""

    items: list
    vocabulary: dict[bytes, int]
    #: per level the new nodes (a range) and the two nodes each of them adds up
    levels: list[tuple[int, int, np.ndarray, np.ndarray]]
    nodes: int
    #: item, node and factor of every operand that is left in an item, by item
    uses: tuple[np.ndarray, np.ndarray, np.ndarray]

    def scores(self, leaves: np.ndarray) -> np.ndarray:
        """Items by documents, from leaves (terms) by documents."""
        acc = np.empty((self.nodes, leaves.shape[1]), np.int64)
        acc[:len(leaves)] = leaves
        for first, end, a, b in self.levels:
            np.add(acc[a], acc[b], out=acc[first:end])
        item, node, factor = self.uses
        out = np.zeros((len(self.items), leaves.shape[1]), np.int64)
        if len(item):
            starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
            out[item[starts]] = np.add.reduceat(acc[node] * factor[:, None], starts, axis=0)
        return out


def mined(bags: list[tuple[object, dict[bytes, int]]]) -> Plan:
    """The sharing DAG of (item, {term: occurrences})."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, bag in bags for t in bag}))}
    common = Counter(t for _, bag in bags for t in bag)
    # occurrences are written in binary, so a bag is a sum of sets with factors 1, 2, 4, ...; long sets are cut
    sets: list[set[int]] = []
    owner: list[tuple[int, int]] = []
    for i, (_, bag) in enumerate(bags):
        for bit in range(max(bag.values(), default=0).bit_length()):
            own = sorted((t for t, n in bag.items() if n >> bit & 1), key=lambda t: (-common[t], t))
            for at in range(0, len(own), SEGMENT):
                sets.append({vocabulary[t] for t in own[at:at + SEGMENT]})
                owner.append((i, 1 << bit))
    held: dict[tuple[int, int], set[int]] = defaultdict(set)
    for s, nodes in enumerate(sets):
        own = sorted(nodes)
        for i, a in enumerate(own):
            for b in own[i + 1:]:
                held[a, b].add(s)
    heap = [(-len(s), p) for p, s in held.items() if len(s) > 1]
    heapify(heap)
    level, parts = [0] * len(vocabulary), []
    while heap:
        n, (a, b) = heappop(heap)
        on = held.get((a, b), ())
        if len(on) < 2:
            continue
        if len(on) != -n:
            heappush(heap, (-len(on), (a, b)))
            continue
        new = len(level)
        level.append(max(level[a], level[b]) + 1)
        parts.append((a, b))
        for s in sorted(on):
            sets[s] -= {a, b}
            for x in sets[s]:
                held[min(a, x), max(a, x)].discard(s)
                held[min(b, x), max(b, x)].discard(s)
                held[x, new].add(s)
            sets[s].add(new)
        del held[a, b]
        for x in {x for s in on for x in sets[s]} - {new}:
            if len(held[x, new]) > 1:
                heappush(heap, (-len(held[x, new]), (x, new)))
    # nodes are numbered by level, so that a level is one addition
    order = sorted(range(len(level)), key=lambda k: (level[k], k))
    place = {k: i for i, k in enumerate(order)}
    levels, at = [], len(vocabulary)
    while at < len(order):
        end = at
        while end < len(order) and level[order[end]] == level[order[at]]:
            end += 1
        pairs = np.array([[place[x] for x in parts[k - len(vocabulary)]] for k in order[at:end]], np.int64)
        levels.append((at, end, pairs[:, 0], pairs[:, 1]))
        at = end
    uses = sorted((i, place[k], f) for s, (i, f) in zip(sets, owner, strict=True) for k in s)
    return Plan([i for i, _ in bags], vocabulary, levels, len(order),
                tuple(np.array([u[c] for u in uses], np.int64) for c in range(3)))


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms in all, and documents per term of the vocabulary, over all rows of `docs` (text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, known, n, total = np.zeros(len(vocabulary), np.int64), vocabulary.keys(), 0, 0
        for b in pieces(batches):
            for text in b.column(0).to_pylist():
                found = found_in(text)
                n, total = n + bool(found), total + len(found)
                df[[vocabulary[t] for t in known & set(found)]] += 1
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *on.tolist()], pa.int64()), pa.array([n, total, *df[on].tolist()], pa.int64())], ["k", "n"])

    # at most two rows more than the vocabulary
    got = {r.k: r.n for r in docs.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    return got.get(-2, 0), got.get(-1, 0), np.array([got.get(k, 0) for k in range(len(vocabulary))], np.int64)


def best(scores: np.ndarray, none: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the k highest scores, equal ones by id, ids before none."""
    order = np.lexsort((ids, none, -scores), axis=-1)[:, :k]
    return tuple(np.take_along_axis(x, order, -1) for x in (scores, none, ids))


def ranked(docs: DataFrame, plan: Plan, n_docs: int, n_terms: int, df: np.ndarray, k: int) -> DataFrame:
    """(item, slot, doc_id, score): every task's k best documents of each item of the block."""
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)

    def leaves(batch: pa.RecordBatch) -> np.ndarray:
        known, at, doc, tf, m = plan.vocabulary.keys(), [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            counts = Counter(found := found_in(text))
            on = known & counts.keys()
            at += [plan.vocabulary[t] for t in on]
            tf += [counts[t] for t in on]
            doc += [i] * len(on)
            m += [75 + 25 * len(found) * n_docs // max(1, n_terms)] * len(on)
        out = np.zeros((len(plan.vocabulary), batch.num_rows), np.int64)
        tf_, m_ = np.array(tf, np.int64), np.array(m, np.int64)
        out[at, doc] = weight[at] * (1_000_000_000 * tf_ // (1000 * tf_ + 12 * m_)) if at else 0
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = len(plan.items)
        top = tuple(np.zeros((rows, 0), np.int64) for _ in range(3))
        for b in pieces(batches, BATCH):
            scores = plan.scores(leaves(b))
            none = np.asarray(b.column(0).is_null().to_numpy(zero_copy_only=False)).astype(np.int64)
            ids = b.column(0).fill_null(0).to_numpy()
            new = (scores, *(np.broadcast_to(x, scores.shape) for x in (none, ids)))
            top = best(*(np.concatenate(x, axis=1) for x in zip(top, new, strict=True)), k)
        item, place = np.nonzero(top[0] > 0)
        score, none, ids = (x[item, place] for x in top)
        yield pa.RecordBatch.from_arrays(
            [pa.array([plan.items[i] for i in item], pa.int64()), pa.array(np.full(len(item), TaskContext.get().partitionId() % SLOTS, np.int32)),
             pa.array(ids, pa.int64(), mask=none.astype(bool)), pa.array(score, pa.int64())], ["item", "slot", "doc_id", "score"])

    return docs.mapInArrow(run, "item bigint, slot int, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0, equal scores by smaller id.

    Every row of `docs` is a document: repeated rows are ranked each, rows without an
    id after those with one.  Rows of `items` that share an id (or have none) are one
    item with all their terms.  NULL and empty texts have no terms: such
    documents are no hits, such items get no rows.  Whole texts count, other
    columns are ignored.  Ids are integers.
    """
    rows = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).alias("text"))
    bags = (items.select(col(item_id).cast("bigint").alias("item"), F.explode(terms(col(item_text))).alias("term"))
            .groupBy("item", "term").agg(F.count(F.lit(1)).alias("n")))
    blocks = max(1, -(-bags.count() // block))
    number = F.pmod(F.xxhash64("item"), F.lit(blocks))
    found = None
    for number_ in range(blocks):
        own: dict[int | None, dict[bytes, int]] = defaultdict(dict)
        for r in bags.where(number == number_).collect():  # about `block` rows
            own[r.item][r.term.encode()] = r.n
        plan = mined(sorted(own.items(), key=lambda kv: (kv[0] is None, kv[0] or 0)))
        part = ranked(rows, plan, *counted(rows.select("text"), plan.vocabulary), k)
        found = part if found is None else found.unionByName(part)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    for group in (["item", "slot"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
    return found.select(F.col("item").alias(item_id), "rank", F.col("doc_id").alias(id_col), "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, len(t)::BIGINT AS n, term, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
q AS (SELECT item_id, term, count(*) AS q
    FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
    GROUP BY ALL),
x AS (SELECT item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 20
"""
