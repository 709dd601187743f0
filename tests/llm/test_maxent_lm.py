import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import awkward, frame

from bourse.llm import maxent_lm as lm

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def split(text):
    return [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def base(rows):
    """Expected (id, held_out, n_tokens, n_known, train_tokens, base_score) of (id, text) rows."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in split(t))
    total = sum(c.values())
    z = math.log10(total + 0.1 * (len(c) + 1))
    return [(i, held(i), len(split(t)), sum(w in c for w in split(t)), total, sum(math.log10(c[w] + 0.1) - z for w in split(t))) for i, t in rows]


def same(got, want):
    order = lambda r: (str(r[0]), r[2], round(r[5], 4))
    got, want = sorted((tuple(r[c] for c in COLUMNS[:6]) for r in got), key=order), sorted(want, key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want))


@pytest.mark.parametrize("heavy", [lm.HEAVY, 3])
def test_base_equals_its_formula_on_awkward_rows(spark, monkeypatch, heavy):
    """With few words looked up in tasks, nearly all counts are joined."""
    monkeypatch.setattr(lm, "HEAVY", heavy)
    monkeypatch.setattr(lm, "HOLD", 5)
    monkeypatch.setattr(lm, "ROUNDS", 1)
    data = awkward() + [(1000, "é\x1c\x85É ZÄ z" + " long" * 10 ** 5 + " " + "w" * 5000, None, None, None)]
    df = frame(spark, data, "word", "row", "n", "score").repartition(3)
    got = lm.lm_scores(df)
    assert got.columns == COLUMNS
    rows = got.collect()
    same(rows, base([r[:2] for r in data]))
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    df = spark.createDataFrame([(held, "a b"), (held, None), (None, "")], "doc_id long, text string")
    got = lm.lm_scores(df).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got) == [(1, 0, 0, 0.0), (1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert all(math.isfinite(r.score) for r in got)
    assert lm.lm_scores(df.where("false")).count() == 0


def _lexicon(spark, texts):
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    table = lm.counts(docs)
    return table, lm.lexicon(table)


def test_probabilities_add_up_to_one(spark):
    """Over all known words, the end and one unknown word per tail class, in any context."""
    r = random.Random(1)
    words = [f"{r.choice('abcdefgh')}{r.choice('xyz')}{i}" for i in range(4000)]
    table, lex = _lexicon(spark, [" ".join(r.choices(words, weights=range(1, 4001), k=400)) for _ in range(60)])
    count = {bytes(x.word): x.n for x in table.collect()}
    assert len(count) > lm.HEAD
    rng = np.random.default_rng(0)
    m = lm.Model(rng.normal(size=(lm.FEATURES * lm.ROWS, lm.CLASSES)).astype(np.float32), rng.normal(size=(lm.WORD_FEATURES * lm.ROWS, lm.SLOTS)).astype(np.float32))
    places = lex.place
    for before in ([], [b"ax1"], [words[3].encode(), b"never seen"]):
        ctx = [lex.ids[places[w]] if places[w] >= 0 else -places[w] for w in before]
        start = m.scores(lex, [np.array(ctx, "<u2").tobytes()])[0]
        total = 0.0
        for k in range(lm.TAIL):  # the unknown words
            total += 10 ** (m.scores(lex, [np.array([*ctx, lm.HEAD + k * lm.SPREAD], "<u2").tobytes()])[0] - start + math.log10(lm.ADD))
        ids = {w: (int(lex.ids[places[w]]) if places[w] >= 0 else -places[w]) for w in count}
        got = m.scores(lex, [np.array([*ctx, i], "<u2").tobytes() for i in ids.values()]) - start
        total += sum(10 ** (g + (math.log10(count[w] + lm.ADD) if i >= lm.HEAD else 0.0)) for g, (w, i) in zip(got, ids.items()))
        assert math.isclose(total, 1.0, rel_tol=1e-4)


def test_gradient_is_the_slope_of_the_log_likelihood(spark):
    _, lex = _lexicon(spark, ["a b c a b d", "b a c c", "d d a b"] * 5)
    rng = np.random.default_rng(2)
    m = lm.Model(rng.normal(size=(lm.FEATURES * lm.ROWS, lm.CLASSES)).astype(np.float64), rng.normal(size=(lm.WORD_FEATURES * lm.ROWS, lm.SLOTS)).astype(np.float64))
    places = lex.place
    text = [lex.ids[[places[w] for w in b"a b d c a a b".split()] + [places[b""]]].astype("<u2").tobytes()]
    m32 = lm.Model(m.classes.astype(np.float32), m.slots.astype(np.float32))
    learn = lm.Gradient(lm.FEATURES * lm.ROWS), lm.Gradient(lm.WORD_FEATURES * lm.ROWS)
    m32.scores(lex, text, learn)
    for table, g in ((m32.classes, learn[0]), (m32.slots, learn[1])):
        slope = g.seen - g.expected
        for row, k in list(zip(*np.nonzero(np.abs(slope) > 0.05)))[:6]:
            old, step = table[row, k], np.float32(0.01)
            table[row, k] = old + step
            up = m32.scores(lex, text)[0]
            table[row, k] = old - step
            down = m32.scores(lex, text)[0]
            table[row, k] = old
            assert math.isclose((up - down) / (2 * float(step)) * math.log(10), float(slope[row, k]), rel_tol=0.05, abs_tol=0.02)


def test_the_model_beats_the_base_on_held_out_texts(spark):
    rows = lm.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert gain * math.log2(10) > 0.5 and sum(r.score > r.base_score for r in rows) > 0.9 * len(rows)
