"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

    P(word | context) = P(class | context) * P(word | class, context)

The HEAD most frequent words are dealt to classes of SLOTS words that end alike; all other words fall into TAIL
classes by their last two bytes.  Both factors are softmaxes over the sum of a bias (log frequency) and one row of
weights per context feature; features are the word before, the two words before, and a skip over
one word, hashed to table rows (for the second factor together with the class).  In a tail class a word has
the weight of its count plus ADD, and one unknown word per class has the weight ADD, so all
probabilities of a context add up to 1.

Counts are taken over all training documents.  Weights are trained over all of them in ROUNDS rounds, each on
its own slice: tasks score their tokens in numpy batches and sum up the gradient (seen minus expected counts of every
feature and class) and its scale; the sums over tasks are one update.  A round has one task per core at
most, so what they send grows with the cluster and not with the corpus.

Words are looked up in tasks where more than one token in 2**HEAVY is that word, which at most 2**HEAVY words
are; the counts of all others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bourse.llm.common import col, pieces
from bourse.session import stored, work_folder

ADD = 0.1
HEAVY, LONG = 20, 64
SLOTS, TAIL, CLASSES = 64, 16, 64
HEAD = SLOTS * (CLASSES - TAIL)
#: ids of tail words: their class and SPREAD values of a hash; START stands before a text
SPREAD, START = 3840, 65_535
#: table rows per feature, features of the two factors
ROWS, FEATURES, WORD_FEATURES = 4096, 3, 2
ROUNDS, STEP, PRIOR, BATCH = 6, 1.2, 32.0, 4096
#: table rows that are summed up together, distinct words a task counts before it sends them on
BLOCK, HOLD = 32, 200_000
_WIDE = np.arange(CLASSES)


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 10 (a NULL id counts as the empty text)"""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 10


def words(text: str | None) -> list[bytes]:
    """Lower-cased words; bytes know no letters and blanks but those of ASCII."""
    return text.encode().lower().split() if text else []


def tail_class(word: bytes) -> int:
    return crc32(word[-2:]) % TAIL


def counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the texts of `docs` (text); the empty word is the end of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for b in pieces(batches):
            for text in b.column(0).to_pylist():
                seen.update(words(text))
                if len(seen) > HOLD:
                    yield flush()
            seen[b""] += b.num_rows
        yield flush()

    return stored(docs.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")


@dataclass
class Lexicon:
    """What tasks know of words; at most 2**HEAVY of them."""

    total: int
    distinct: int
    #: word -> its place in `log_count` and `ids`
    place: Places
    log_count: np.ndarray
    ids: np.ndarray
    class_of: np.ndarray
    class_bias: np.ndarray
    slot_bias: np.ndarray
    #: log10 of the weights of a tail class
    tail_total: np.ndarray


def logs(x: np.ndarray) -> np.ndarray:
    """Natural logarithms, very low ones of 0."""
    return np.where(x > 0, np.log(np.maximum(x, 1e-300)), -1e4)


def lexicon(table: DataFrame) -> Lexicon:
    """The lexicon of a table of counts; HEAD words and 2**HEAVY counts at most reach the driver."""
    all_ = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tails = (table.groupBy((F.crc32(F.substring("word", -2, 2)) % TAIL).cast("int").alias("k"))
             .agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect())
    rows = table.where((F.col("n") > F.lit(all_.n / (1 << HEAVY))) & (F.octet_length("word") <= LONG) | (F.octet_length("word") == 0)).toArrow()
    known = dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True))
    known.setdefault(b"", 0)
    by_count = sorted(known, key=lambda w: (w != b"", -known[w], w))
    head = sorted(by_count[:HEAD], key=lambda w: w[::-1])
    n_k, v_k = np.zeros(TAIL), np.zeros(TAIL)
    for r in tails:
        n_k[r.k], v_k[r.k] = r.n, r.v
    for w in head:
        if known[w]:
            n_k[tail_class(w)] -= known[w]
            v_k[tail_class(w)] -= 1
    place = Places((w, i) for i, w in enumerate([*head, *by_count[HEAD:]]))
    log_count = np.log10(np.array([known[w] for w in place], float) + ADD)
    ids = np.array([i if i < len(head) else tail_id(w) for i, w in enumerate(place)], np.int64)
    # heads fill whole classes; as many as are needed are in use
    used = -(-len(head) // SLOTS)
    slots = np.zeros((CLASSES - TAIL, SLOTS))
    slots.flat[:len(head)] = [known[w] + ADD for w in head]
    mass = np.concatenate([slots.sum(1), n_k + ADD * (v_k + 1)])
    mass[used:CLASSES - TAIL] = 0
    class_of = np.concatenate([np.arange(HEAD) // SLOTS, CLASSES - TAIL + np.arange(TAIL * SPREAD) // SPREAD])
    return Lexicon(all_.n, all_.v, place, log_count, ids, class_of.astype(np.int64), logs(mass / mass.sum()).astype(np.float32),
                   logs(slots / np.maximum(slots.sum(1, keepdims=True), ADD)).astype(np.float32), np.log10(n_k + ADD * (v_k + 1)))


def tail_id(word: bytes) -> int:
    return HEAD + crc32(word[-2:]) % TAIL * SPREAD + crc32(word) % SPREAD


class Places(dict):
    """Word to place; of a word without one minus its tail id."""

    def __missing__(self, word: bytes) -> int:
        return -tail_id(word)


def coded(spark: SparkSession, docs: DataFrame, lex) -> DataFrame:
    """The documents as ids, in folders by slice (held-out documents in the last one), with all sums that need no model.

    `docs` has doc_id, held_out and text; `lex` is a broadcast lexicon.  Columns: row (a number of the row), doc_id, held_out,
    ids (16 bits each), n_tokens, known, base and tail (sums of log10 counts, of all and of tail words),
    rare (words whose counts are joined) and times.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lex.value
        places, log_count, ids = own.place, own.log_count, own.ids
        end = places[b""]
        for b in pieces(batches):
            out: list[list] = [[] for _ in range(7)]
            for text in b.column(3).to_pylist():
                found = words(text)
                at = np.fromiter(map(places.__getitem__, found), np.int64, len(found))
                at = np.append(at, end)
                inside = at >= 0
                on = at[inside]
                id_ = -at
                id_[inside] = ids[on]
                rare = Counter([found[i] for i in np.flatnonzero(~inside).tolist()])
                values = log_count[on]
                for c, v in zip(out, (id_.astype("<u2").tobytes(), len(at), int((values > -0.99).sum()), float(values.sum()),
                                      float(values[ids[on] >= HEAD].sum()), list(rare), list(rare.values())), strict=True):
                    c.append(v)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]],
                                             ["row", "doc_id", "held_out", "ids", "n_tokens", "known", "base", "tail", "rare", "times"])

    schema = f"row bigint, doc_id {kind}, held_out boolean, ids binary, n_tokens bigint, known bigint, base double, tail double, rare array<binary>, times array<bigint>"
    path = work_folder(spark, "lm-coded")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    out = numbered.mapInArrow(run, schema).withColumn("slice", F.when(F.col("held_out"), ROUNDS).otherwise(F.col("row") % ROUNDS).cast("int"))
    out.write.partitionBy("slice").parquet(path)
    return spark.read.schema(f"{schema}, slice int").parquet(path)


def batches_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, id, and the ids one and two before) of BATCH tokens at a time."""
    start = np.full(2, START, np.int64)
    ids = [np.frombuffer(t, "<u2").astype(np.int64) for t in texts]
    line = np.concatenate([x for own in ids for x in (start, own)]) if ids else start
    text = np.repeat(np.arange(len(ids)), [len(x) + 2 for x in ids])
    on = np.flatnonzero(line != START)
    for a in range(0, len(on), BATCH):
        at = on[a:a + BATCH]
        yield text[at], line[at], line[at - 1], line[at - 2]


def mixed(*parts: np.ndarray) -> np.ndarray:
    """A table row from several ids."""
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(ROWS)).astype(np.int64)


def class_rows(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """Rows of the first factor: frequent words have rows of their own, pairs and other words share theirs."""
    def single(x: np.ndarray) -> np.ndarray:
        return np.where(x < HEAD, x, HEAD + x % (ROWS - HEAD))

    return [single(one), ROWS + single(two), 2 * ROWS + mixed(two, one)]


def word_rows(classes: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    return [k * ROWS + mixed(*x) for k, x in enumerate(((classes, one), (classes, two)))]


def softmax(bias: np.ndarray, table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Weights stay within ROUNDS * STEP and biases below 0, so nothing overflows."""
    z = table.take(rows[0], 0)
    for r in rows[1:]:
        z += table.take(r, 0)
    z += bias
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


class Gradient:
    """Seen and expected counts of every (row, class) of a table."""

    def __init__(self, rows: int):
        self.seen, self.expected = np.zeros((rows, CLASSES), np.float32), np.zeros((rows, CLASSES), np.float32)

    def add(self, rows: list[np.ndarray], hit: np.ndarray, p: np.ndarray) -> None:
        cells = np.empty((len(hit), CLASSES), np.int64)
        # arrays that came over the network carry a type object of their own, with which add.at is 30 times slower
        p = p.view(np.float32).reshape(-1)
        for r in rows:
            at = r * CLASSES
            np.add.at(self.seen.reshape(-1), at + hit, np.float32(1))
            np.add.at(self.expected.reshape(-1), np.add(at[:, None], _WIDE, out=cells).reshape(-1), p)


@dataclass
class Model:
    classes: np.ndarray
    slots: np.ndarray

    @classmethod
    def flat(cls) -> Model:
        return cls(np.zeros((FEATURES * ROWS, CLASSES), np.float32), np.zeros((WORD_FEATURES * ROWS, SLOTS), np.float32))

    def scores(self, lex: Lexicon, texts: list[bytes], learn: tuple[Gradient, Gradient] | None = None) -> np.ndarray:
        """log10 probability of every text but for the counts of its tail words; with `learn` gradients are added up."""
        out = np.zeros(len(texts))
        for text, ids, one, two in batches_of(texts):
            rows, hit = class_rows(one, two), lex.class_of[ids]
            p = softmax(lex.class_bias, self.classes, rows)
            took = np.log10(np.maximum(p[np.arange(len(ids)), hit], 1e-30))
            if learn:
                learn[0].add(rows, hit, p)
            head = np.flatnonzero(ids < HEAD)
            took[ids >= HEAD] -= lex.tail_total[hit[ids >= HEAD] - (CLASSES - TAIL)]
            if len(head):
                rows, slot = word_rows(hit[head], one[head], two[head]), ids[head] % SLOTS
                p = softmax(lex.slot_bias[hit[head]], self.slots, rows)
                took[head] += np.log10(np.maximum(p[np.arange(len(head)), slot], 1e-30))
                if learn:
                    learn[1].add(rows, slot, p)
            out += np.bincount(text, took, len(texts))
        return out


def round_sums(rows: DataFrame, lex, model, tasks: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, seen, expected) of BLOCK rows at a time of both tables, one under the other, summed over all `rows` (ids)."""
    width = 2 * BLOCK * CLASSES

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learn = Gradient(FEATURES * ROWS), Gradient(WORD_FEATURES * ROWS)
        for b in pieces(batches):
            model.value.scores(lex.value, b.column(0).to_pylist(), learn)
        seen, expected = (np.concatenate([getattr(g, n) for g in learn]).reshape(-1, BLOCK * CLASSES) for n in ("seen", "expected"))
        both = np.concatenate([seen, expected], axis=1)
        task = TaskContext.get().partitionId()
        on = np.flatnonzero(expected.any(1))
        for a in range(0, len(on), 64):
            yield pa.RecordBatch.from_arrays([pa.array(on[a:a + 64], pa.int32()), pa.array(np.full(len(on[a:a + 64]), task), pa.int32()),
                                              pa.array([both[i].tobytes() for i in on[a:a + 64]], pa.binary())], ["block", "task", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(block: int, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["block", "sums"])

        block, total = None, np.zeros(width)
        for b in pieces(batches):
            for own, sums in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if own != block:
                    if block is not None:
                        yield row(block, total)
                    block, total = own, np.zeros(width)
                total += np.frombuffer(sums, np.float32)
        if block is not None:
            yield row(block, total)

    parts = rows.coalesce(tasks).mapInArrow(gradients, "block int, task int, sums binary")
    got = parts.repartition("block").sortWithinPartitions("block", "task").mapInArrow(added, "block int, sums binary").toArrow()
    for block, sums in zip(got.column("block").to_pylist(), got.column("sums"), strict=True):
        seen, expected = np.frombuffer(sums.as_buffer(), np.float32).reshape(2, BLOCK, CLASSES)
        yield block * BLOCK, seen, expected


def train(spark: SparkSession, rows: DataFrame, lex) -> Model:
    """ROUNDS updates, each from the gradient over a slice of the training documents."""
    model = Model.flat()
    tasks, split = max(1, spark.sparkContext.defaultParallelism), FEATURES * ROWS
    for number in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)
        for at, seen, expected in round_sums(rows.where(F.col("slice") == number).select("ids"), lex, sent, tasks):
            scale = np.maximum(seen, expected) + PRIOR / CLASSES
            step = STEP * (seen - expected) / scale
            if at < split:
                model.classes[at:at + BLOCK] += step / FEATURES
            else:
                model.slots[at - split:at - split + BLOCK] += step / WORD_FEATURES
        sent.destroy()
    return model


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs`.

    The model and the counts are learnt from rows whose remainder is not 0.  NULL texts are empty and have
    one token, the end; a NULL id counts as the empty text and stays NULL.  Repeated rows count and are
    returned each; other columns are ignored.  Without training rows every word is unknown and base_score is 0.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).alias("doc_id"), (remainder(col(id_col)) == 0).alias("held_out"), col(text_col).alias("text"))
    table = counts(rows.where(~F.col("held_out")).select("text"))
    lex_ = lexicon(table)
    lex = spark.sparkContext.broadcast(lex_)
    codes = coded(spark, rows, lex)
    model = spark.sparkContext.broadcast(train(spark, codes, lex))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            own = model.value.scores(lex.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(own, pa.float64())],
                                             ["row", "doc_id", "held_out", "n_tokens", "known", "base", "tail", "own"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = codes.select("row", "ids", "doc_id", "held_out", "n_tokens", "known", "base", "tail").mapInArrow(
        run, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, tail double, own double")
    rare = codes.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    looked = rare.join(table, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(n + ADD)).alias("rare_sum"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    total, rare_sum = float(np.log10(lex_.total + ADD * (lex_.distinct + 1))), F.coalesce("rare_sum", F.lit(0.0))
    return scored.join(looked, "row", "left").select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lex_.total).cast("bigint").alias("train_tokens"), (F.col("base") + rare_sum - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("own") + F.col("tail") + rare_sum).alias("score"))
