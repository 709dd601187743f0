"""Near-duplicate classes by ProbMinHash, banding and verification.

Words are runs of characters between ASCII white space, in lower case; a shingle is five words in a row (all
words of a shorter text).  Two texts are linked when the Jaccard similarity of their shingle sets is 0.8 or more;
classes are the connected components.  Every shingle weighs 1 in the signature, however often its text repeats it:
then the probability Jaccard similarity that the registers estimate is the one that decides a link.

1. One Arrow pass over the texts gives two 64-bit hashes of the word sequence and the ProbMinHash signature:
   every shingle is a Poisson process whose rate is its weight, arrivals fall on random registers, and each
   register keeps its earliest shingle.  Arrivals are made in rounds up to a time by which all registers are
   filled with high probability (then later ones cannot win, and generation stops); texts with an empty register
   are repeated with twice the time.  Equal registers estimate the Jaccard similarity of the sets.
2. Copies are combined: only the first text of a word sequence goes on.
3. Texts that agree in all ROWS registers of one of the BANDS bands share a bucket.  In buckets of up to SMALL
   texts every pair is a candidate; in larger ones every text against the bucket's first text.
4. Candidates are verified exactly, in the order that settles most: first each text against its first partner,
   then all pairs whose ends are not in one class yet (the others cannot change a class).
5. Larger buckets that still hold several classes are compared block by block: the texts outside the first text's
   class against all of the bucket.  The comparison is exact: a text that shares none of its rarest shingles with
   another's rarest can't be linked to it, for all others the common shingles are counted; only links leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourse.llm.common import col, fresh, pieces, small, stored
from bourse.llm.components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
SMALL, BLOCK = 32, 4096
#: up to this many ids (8 bytes each) are sent to all tasks
FEW = 2_000_000
#: a longer run without white space counts as several words
CHUNK = 1 << 20
#: ids of texts that occur only without an id start here
UNNAMED = 1 << 62

_U = np.uint64
_rng = np.random.default_rng(20250101)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_MULT = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(CHUNK + 1, base, np.uint64)) * _U(pow(base, -1, 1 << 64))


_BASE = 0x9E3779B97F4A7C15
_POWER, _BACK = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit permutation."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def chunks(raw: bytes) -> Iterator[bytes]:
    """Parts of at most CHUNK bytes, cut at white space where there is any."""
    at = 0
    while len(raw) - at > CHUNK:
        space = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8, CHUNK, at)])
        end = at + (int(space[-1]) + 1 if len(space) else CHUNK)
        yield raw[at:end]
        at = end
    yield raw[at:]


def hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of at most CHUNK bytes"""
    b = np.frombuffer(raw, np.uint8)
    space = np.concatenate(([True], _SPACE[b], [True]))
    start, end = np.flatnonzero(space[:-2] & ~space[1:-1]), np.flatnonzero(~space[1:-1] & space[2:]) + 1
    total = np.concatenate(([_U(0)], np.cumsum(_BYTE[b] * _POWER[:len(b)])))
    return start, mix((total[end] - total[start]) * _BACK[start] + (end - start).astype(np.uint64))


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, first word of each text and the end)"""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    batch: list[bytes] = []
    owner: list[int] = []

    def flush():
        if batch:
            start, h = hash_words(b" ".join(batch))
            at = np.cumsum([0] + [len(x) + 1 for x in batch[:-1]])
            np.add.at(counts, owner, np.diff(np.append(np.searchsorted(start, at), len(start))))
            hashes.append(h)
            batch.clear()
            owner.clear()

    size = 0
    for i, t in enumerate(texts):
        for part in chunks((t or "").lower().encode("utf-8", "surrogatepass")):
            if size + len(part) + 1 > CHUNK:
                flush()
                size = 0
            batch.append(part)
            owner.append(i)
            size += len(part) + 1
    flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(counts)))


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of the distinct shingles sorted by text and shingle; two hashes of each word sequence"""
    w, at = words_of(texts)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(texts)), n)
    place = (np.arange(len(w)) - at[doc]).astype(np.uint64)
    left = n[doc] - place.astype(np.int64)
    sums = []
    for k in (5, 6):
        total = np.concatenate(([_U(0)], np.cumsum(mix(w + (place + _U(1)) * _MULT[k]))))
        sums.append(mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)))
    padded = np.concatenate((w, np.zeros(WORDS, np.uint64)))
    s = np.zeros(len(w), np.uint64)
    for k in range(WORDS):
        s += np.where(left > k, padded[k:k + len(w)], _U(0)) * _MULT[k]
    full = (left >= WORDS) | (place == 0)
    doc, s = doc[full], mix(s[full])
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])))) if len(s) else np.zeros(0, np.int64)
    return doc[new], s[new], np.diff(np.append(new, len(s))), sums[0], sums[1]


def signatures(doc: np.ndarray, s: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """[n, REGISTERS] shingle hashes; rows of texts without shingles stay 0."""
    out = np.zeros((n, REGISTERS), np.uint64)
    total = np.bincount(doc, weight, n)
    todo, factor = total > 0, np.log(REGISTERS) + 3
    while todo.any():
        bound = np.where(todo, factor * REGISTERS / np.maximum(total, 1e-9), -1.0)
        active = np.flatnonzero(todo[doc])
        time, arrival, found = np.zeros(len(active)), 0, []
        while len(active):
            arrival += 1
            h = mix(s[active] + _U(arrival * int(_MULT[7]) % (1 << 64)))
            time = time - np.log(((h >> _U(12)).astype(np.float64) + 0.5) * 2.0 ** -52) / weight[active]
            on = time <= bound[doc[active]]
            active, time, h = active[on], time[on], h[on]
            register = (mix(h) % _U(REGISTERS)).astype(np.int64)
            found.append((doc[active] * REGISTERS + register, time, active))
        flat, when, which = (np.concatenate(x) for x in zip(*found, strict=True))
        late = np.argsort(-when, kind="stable")  # the earliest is written last
        hit = np.zeros(n * REGISTERS, bool)
        hit[flat] = True
        got = np.zeros(n * REGISTERS, np.uint64)
        got[flat[late]] = s[which[late]]
        done = todo & hit.reshape(n, REGISTERS).all(1)
        out[done] = got.reshape(n, REGISTERS)[done]
        todo &= ~done
        factor *= 2
    return out


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2, bands) per row; bands are NULL for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            doc, s, _, k1, k2 = shingles(b.column(1).to_pylist())
            parts = signatures(doc, s, np.ones(len(s)), b.num_rows).reshape(b.num_rows, BANDS, ROWS)
            sig = np.zeros((b.num_rows, BANDS), np.uint64)
            for r in range(ROWS):
                sig = mix(sig * _MULT[0] + parts[:, :, r])
            sig = mix(sig + np.arange(BANDS, dtype=np.uint64) * _MULT[1])
            have = np.bincount(doc, minlength=b.num_rows) > 0
            values = pa.array([x if ok else None for x, ok in zip(sig.view(np.int64), have, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), values],
                                             ["id", "k1", "k2", "bands"])

    return docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).alias("text")).mapInArrow(
        run, "id bigint, k1 bigint, k2 bigint, bands array<bigint>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(id, shingles) per row of (id, text)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            doc, s, *_ = shingles(b.column(1).to_pylist())
            at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            sets = pa.array([s[x:y].view(np.int64) for x, y in pairwise(at)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), sets], ["id", "shingles"])

    return texts.select("id", "text").mapInArrow(run, "id bigint, shingles array<bigint>")


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted shingle sets have a Jaccard similarity of THRESHOLD or more."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if len(small) == 0 or len(small) < THRESHOLD * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return both >= THRESHOLD * (len(x) + len(y) - both)


def owners(codes: np.ndarray, n: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the owners sorted by code, where each of the n codes starts and the end)"""
    return owner[np.argsort(codes, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=n))))


def links_between(xs: list[np.ndarray], ys: list[np.ndarray], may: Callable[[int], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j with may(i)[j] whose sets xs[i] and ys[j] are alike), where there are any.

    Sets whose similarity is THRESHOLD or more have a common member among the first n - THRESHOLD n + 1 of each
    in any one order; in the order used here, rarest first, what most texts share comes last.
    """
    sets = [*xs, *ys]
    sizes = np.array([len(s) for s in sets], np.int64)
    if not len(xs) or not len(ys) or not sizes.any():
        return
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(values))
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((rank[code], owner))
    code = rank[code][order]
    at = np.concatenate(([0], np.cumsum(sizes)))
    lead = sizes - np.ceil(THRESHOLD * sizes - 1e-9).astype(np.int64) + 1
    leading = np.arange(len(code)) - at[owner] < lead[owner]
    right = owner >= len(xs)
    mine = owner - len(xs)
    head, head_at = owners(code[right & leading], len(values), mine[right & leading])
    full, full_at = owners(code[right], len(values), mine[right])
    size = sizes[len(xs):]
    for i in range(len(xs)):
        n, c = sizes[i], code[at[i]:at[i + 1]]
        met = [head[head_at[k]:head_at[k + 1]] for k in c[:lead[i]] if head_at[k] < head_at[k + 1]]
        if not met:
            continue
        fits = np.zeros(len(ys), bool)
        fits[np.concatenate(met)] = True
        fits &= may(i) & (size >= THRESHOLD * n) & (size * THRESHOLD <= n)
        if fits.any():
            both = np.zeros(len(ys), np.int64)
            for k in c:
                both[full[full_at[k]:full_at[k + 1]]] += 1
            if len(near := np.flatnonzero(fits & (both >= THRESHOLD * (n + size - both)))):
                yield i, near


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts have a Jaccard similarity of THRESHOLD or more."""
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 128):
            sides = []
            for c in (2, 3):
                unique = b.column(c).dictionary_encode()
                doc, s, *_ = shingles(unique.dictionary.to_pylist())
                at = np.searchsorted(doc, np.arange(len(unique.dictionary) + 1))
                sides.append([s[at[i]:at[i + 1]] for i in unique.indices.to_pylist()])
            ok = [alike(x, y) for x, y in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def relabel(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Labels of the components of the old classes joined by new edges."""
    if labels is not None:
        edges = edges.unionByName(labels.select(F.col("id").alias("a"), F.col("label").alias("b")))
    return components(edges)


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different classes."""
    return (pairs.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a", "left")
            .join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b", "left")
            .where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b"))


def candidates(members: DataFrame) -> DataFrame:
    """(a, b) with a < b: all pairs of small buckets, every text with the first one of larger ones."""
    ids = F.array_sort(F.collect_set("id"))
    few = members.where(F.col("n") <= SMALL).groupBy("g").agg(ids.alias("ids"))
    pair = "flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> struct(x as a, y as b))))"
    within = few.select(F.explode(F.expr(pair)).alias("p")).select("p.a", "p.b")
    star = members.where((F.col("n") > SMALL) & (F.col("id") != F.col("first"))).select(F.col("first").alias("a"), F.col("id").alias("b"))
    return within.unionByName(star).distinct()


def block_links(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Further links within larger buckets that hold several classes; None where there are no such buckets."""
    lab = labels.select("id", "label")
    big = (members.where(F.col("n") > SMALL).join(lab, "id", "left").withColumn("label", F.coalesce("label", "id"))
           .join(lab.select(F.col("id").alias("first"), F.col("label").alias("head")), "first", "left")
           .withColumn("head", F.coalesce("head", "first")))
    open_ = big.where("label <> head").groupBy("g").agg(F.count(F.lit(1)).alias("outside"))
    if open_.isEmpty():
        return None
    big = stored(big.join(open_, "g").select(
        "g", "id", "label", (F.col("label") != F.col("head")).alias("outer"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.col("outside") / BLOCK).cast("int").alias("rows")), "near-open")
    # the (at most BANDS) open buckets of each text
    own = big.groupBy("id").agg(F.array_sort(F.collect_set("g")).alias("gs"))
    facts = stored(shingle_sets(texts.join(own.select("id"), "id", "left_semi")).join(own, "id"), "near-facts")
    spot = F.xxhash64("id", F.lit(11))
    told = ["id", "label", "gs", "shingles"]
    left = big.where("outer").withColumns({"i": F.pmod(spot, F.col("rows")).cast("int"), "j": F.explode(F.expr("sequence(0, blocks - 1)"))})
    right = big.withColumns({"i": F.explode(F.expr("sequence(0, rows - 1)")), "j": F.pmod(spot, F.col("blocks")).cast("int")})
    left, right = (x.select("g", "i", "j", "id", "label").join(facts, "id").select("g", "i", "j", *told).toDF("g", "i", "j", *told) for x in (left, right))

    def compare(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        ids, labs, gs = y["id"].to_numpy(), y["label"].to_numpy(), list(y["gs"])
        own, lab_, mine = x["id"].to_numpy(), x["label"].to_numpy(), list(x["gs"])
        for i, near in links_between(list(x["shingles"]), list(y["shingles"]), lambda i: labs != lab_[i]):
            for k in near:
                # a pair is told in the first bucket that both are in
                if min(set(mine[i].tolist()).intersection(gs[k].tolist())) == key[0]:
                    a.append(own[i])
                    b.append(ids[k])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j")).applyInPandas(compare, "a bigint, b bigint")


def node(docs: DataFrame, id_col: str, text_col: str):
    """The id of a row, or for a row without one a number made from its text."""
    return F.coalesce(col(id_col).cast("bigint"), F.lit(UNNAMED) + F.xxhash64(F.coalesce(col(text_col), F.lit(""))).bitwiseAND(F.lit(UNNAMED - 1)))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, class) per row of `docs`; the class is the smallest node in it."""
    keyed = docs.select(node(docs, id_col, text_col).alias("id"), col(text_col).alias("text"))
    rows = stored(signed(keyed, "id", "text"), "near-signatures")
    first = rows.groupBy("k1", "k2").agg(F.min("id").alias("first"))
    copies = stored(rows.select("id", "k1", "k2").join(first, ["k1", "k2"]).select("id", "first"), "near-copies")
    # (id, words) differ between the copies of a text, so a large group of them is spread over all tasks
    banded = rows.where("bands is not null").join(first.withColumnRenamed("first", "id"), ["id", "k1", "k2"], "left_semi")
    banded = banded.select("id", F.posexplode("bands").alias("i", "v")).select("id", F.xxhash64("i", "v").alias("g"))
    banded = stored(banded, "near-bands")
    buckets = banded.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1")
    members = stored(banded.join(buckets, "g"), "near-members")
    pairs = stored(candidates(members), "near-pairs")
    asked = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "near-asked")
    # all texts would be shuffled to find a few
    texts = stored(keyed.join(small(asked, FEW), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "near-texts")

    leading = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    labels = relabel(None, verified(leading, texts))
    rest = across(pairs.join(leading, ["a", "b"], "left_anti"), labels)
    labels = relabel(labels, verified(rest, texts))
    if (more := block_links(members, labels, texts)) is not None:
        labels = relabel(labels, more)
    return copies.join(labels.withColumnsRenamed({"id": "first"}), "first", "left").select(
        "id", F.coalesce("label", "first").alias("class"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, class_id, class_size, kept).

    The class id is the smallest id of the class, whose row is the one kept.
    NULL and blank texts have no words: they are copies of one another and of
    nothing else.  A row without an id keeps its NULL, and its class id is NULL
    where no row of the class has one; rows that share an id are one document.
    Ids are integers below 2**62.
    """
    found = stored(classes(docs, id_col, text_col), "near-classes")
    sizes = found.groupBy("class").agg(F.count(F.lit(1)).alias("class_size"))
    named = lambda c: F.when(F.col(c) < UNNAMED, F.col(c))
    return found.join(sizes, "class").select(named("id").alias(id_col), named("class").alias("class_id"), "class_size",
                                             (F.col("id") == F.col("class")).alias("kept"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one per class."""
    (n,) = fresh(docs, "__node")
    kept = classes(docs, id_col, text_col).where("id = class").select(F.col("id").alias(n)).distinct()
    rows = docs.withColumn(n, node(docs, id_col, text_col))
    return rows.join(kept, n, "left_semi").dropDuplicates([n]).select(*map(col, docs.columns))
