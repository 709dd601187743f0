"""Quality classifier: a generalised additive model with pairwise interactions.

    score = sigmoid(intercept + sum of table_f[bin_f] + sum of table_fg[bin_f, bin_g])

The tables are learnt by cyclic boosting: in every round each feature in turn
gets one shallow tree over its bins, fitted to the gradient of the log loss, and
the tree's leaf values are added to the feature's table.  The strongest pairs of
features then get tables on a coarse grid in the same way.  Scoring looks bins up
and adds, for a whole Arrow batch at once.

The fit runs on a bounded sample of labelled rows (`SAMPLE` expected rows, drawn
by a hash of the id); every row is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourse.llm.common import col, pieces

#: expected number of labelled rows the model is fitted on
SAMPLE = 20_000
BINS, GRID, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 64, 8, 8, 150, 60, 0.15, 4

FEATURES = ("length", "word_length", "upper", "digits", "stops", "symbols", "bars", "exclaims", "lines", "distinct_words",
            "repeated_neighbours", "distinct_lines", "non_ascii", "byte_entropy", "commonest_byte", "punctuated_words")

_CLASS = np.zeros((256, 9))
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?",
                             b"#$%&*@^~<>{}[]=+_\\/\"`", b"|", b"!", b"\n")):
    _CLASS[list(_chars), _i] = 1
_CLASS[128:, 8] = 1


def features(text: str | None) -> list[float]:
    """Numbers that describe a whole text, in the order of FEATURES; all 0 for an empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits, stops, symbols, bars, exclaims, lines, high = counts @ _CLASS
    words, rows = text.split(), text.split("\n")
    n, size, letters = max(1, len(words)), len(raw), max(1.0, upper + lower + high)
    p = counts[counts > 0] / size
    return [np.log1p(size), size / n, upper / letters, digits / size, stops / n, symbols / n, bars / n, exclaims / n, lines / n,
            len(set(words)) / n, sum(map(str.__eq__, words, words[1:])) / n, len(set(rows)) / len(rows), high / size,
            float(-(p * np.log2(p)).sum()), counts.max() / size, (stops + symbols + exclaims) / n]


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total, bins = np.full(len(x), self.intercept), self.bins(x)
        for b, table in zip(bins, self.tables, strict=True):
            total += table[b]
        coarse = [b * GRID // (len(e) + 1) for b, e in zip(bins, self.edges, strict=True)]
        for (f, g), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[coarse[f], coarse[g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def gain(g, h):
    return g * g / (h + 1.0)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of a tree with up to LEAVES leaves over ordered bins with these gradient sums."""
    cuts = [0, len(g)]
    for _ in range(LEAVES - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
                won = gain(cg[:-1], ch[:-1]) + gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - gain(cg[-1], ch[-1])
                i = int(won.argmax())
                best = max(best, (float(won[i]), a + i + 1))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best pair of cuts, one on each axis of a grid of gradient sums."""
    def quarters(s):
        c = s.cumsum(0).cumsum(1)
        a, left, top, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return a, left - a, top - a, all_ - left - top + a
    gs, hs = quarters(g), quarters(h)
    won = sum(gain(x, y) for x, y in zip(gs, hs, strict=True)) - gain(g.sum(), h.sum())
    i, j = np.unravel_index(int(won.argmax()), won.shape)
    v = [x[i, j] / (y[i, j] + 1.0) for x, y in zip(gs, hs, strict=True)]
    out = np.empty(g.shape)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = v
    return float(won[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of the 0/1 marks `y` of the rows of `x`; a constant where there is nothing to learn."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(p / (1 - p))))
    p = y.mean()
    m = Model(float(np.log(p / (1 - p))))
    for f in range(x.shape[1]):
        e = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        m.edges.append(e)
        m.tables.append(np.zeros(len(e) + 1))
    bins, total = m.bins(x), np.full(len(y), m.intercept)

    def slopes():
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(ROUNDS):
        for b, table in zip(bins, m.tables, strict=True):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)))
            table += step
            total += step[b]
    coarse = [b * GRID // (len(e) + 1) for b, e in zip(bins, m.edges, strict=True)]

    def grid_sums(f, k, s):
        return np.bincount(coarse[f] * GRID + coarse[k], s, GRID * GRID).reshape(GRID, GRID)

    g, h = slopes()
    ranked = sorted(((cross_tree(grid_sums(f, k, g), grid_sums(f, k, h))[0], f, k)
                     for f in range(x.shape[1]) for k in range(f)), reverse=True)
    m.pairs = [(f, k) for _, f, k in ranked[:PAIRS]]
    m.grids = [np.zeros((GRID, GRID)) for _ in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for (f, k), grid in zip(m.pairs, m.grids, strict=True):
            g, h = slopes()
            step = RATE * cross_tree(grid_sums(f, k, g), grid_sums(f, k, h))[1]
            grid += step
            total += step[coarse[f], coarse[k]]
    return m


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3 (a NULL id counts as the empty text)"""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
          label_id: str = "doc_id", label_col: str = "quality") -> Model:
    """Fit on labelled documents whose remainder is not 1.

    NULL ids and NULL marks are left out; an id with several marks counts with the
    lowest.  About `sample` labelled ids are drawn by a hash, so what the driver
    gets (one row of 16 numbers each) and the broadcast list of ids are bounded.
    """
    marked = (labels.select(col(label_id).alias("id"), col(label_col).cast("int").alias("y"))
              .where(F.col("id").isNotNull() & F.col("y").isNotNull() & (remainder(F.col("id")) != 1)))
    n = marked.count()
    if n > sample:
        marked = marked.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < F.lit(int((1 << 30) * sample / n)))
    marked = marked.groupBy("id").agg(F.min("y").alias("y"))
    rows = (docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
            .join(F.broadcast(marked), "id").select("id", "y", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = [[float(v) for v in features(t)] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}[id_col]
    got = sorted((str(r.id), r.y, list(r.x)) for r in rows.mapInArrow(run, f"id {kind}, y int, x array<double>").collect())
    if not got:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.array([r[2] for r in got]), np.array([float(r[1] > 0) for r in got]))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id, held_out, score, predicted) for every row, or with `keep` the rows of `docs` that are not rejected.

    NULL texts count as empty and get the score of an empty text.  One narrow pass, no shuffle.
    """
    names = docs.columns
    rows = docs.select(*map(col, names)) if keep else docs.select(
        col(id_col), (remainder(col(id_col)) == 1).alias("held_out"), col(text_col).alias("text"))
    at = names.index(text_col) if keep else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            p = model.score(np.array([features(t) for t in b.column(at).to_pylist()]))
            if keep:
                yield b.filter(pa.array(p >= 0.5))
            else:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    [id_col, "held_out", "score", "predicted"])

    if keep:
        return rows.mapInArrow(run, docs.schema)
    kind = rows.schema.fields[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
