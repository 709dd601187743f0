import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from corpus import awkward, frame

from bourse.llm import near_dedup as nd
from bourse.llm.components import components


def shingle_set(t):
    w = (t or "").lower().translate({c: " " for c in b"\t\n\x0b\x0c\r"}).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(data):
    """class per row: index of its first row"""
    sets, parent = [shingle_set(r[1]) for r in data], list(range(len(data)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    words = [tuple(x for x in (r[1] or "").lower().translate({c: " " for c in b"\t\n\x0b\x0c\r"}).split(" ") if x) for r in data]
    for i, j in combinations(range(len(data)), 2):
        a, b = sets[i], sets[j]
        same_id = data[i][0] is not None and data[i][0] == data[j][0]
        if words[i] == words[j] or same_id or (a and b and len(a & b) >= 0.8 * len(a | b)):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(data))]


def expected(data):
    members = defaultdict(list)
    cls = brute(data)
    for r, c in zip(data, cls, strict=True):
        members[c].append(r[0])
    out = []
    for r, c in zip(data, cls, strict=True):
        ids = [i for i in members[c] if i is not None]
        out.append((r[0], min(ids) if ids else None, len(members[c])))
    return sorted(map(str, out))


def family(r, n, size, edits, vocabulary=100000):
    base = [f"w{r.randrange(vocabulary)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(size)] = f"e{r.randrange(10 ** 9)}"
        out.append(" ".join(w))
    return out


def corpus():
    r = random.Random(3)
    texts = []
    for _ in range(6):
        texts += family(r, r.randint(2, 9), r.randint(60, 300), 2)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"w{r.randrange(10 ** 9)}" for _ in range(40)) for _ in range(60)]
    texts += family(r, 60, 200, 3)  # a larger group, not all of whose pairs are linked
    return [(i, t, "en", "s", None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [nd.SMALL, 4])
def test_equals_brute_force(spark, monkeypatch, small):
    """With small buckets only, the large ones go by their first text and by blocks of signatures."""
    monkeypatch.setattr(nd, "SMALL", small)
    monkeypatch.setattr(nd, "BLOCK", 16)
    data = corpus()
    got = nd.near_dedup(frame(spark, data, "id", "class"))
    assert sorted(str((r.doc_id, r.class_id, r.class_size)) for r in got.collect()) == expected(data)


def test_awkward_rows(spark):
    data = [r for r in awkward() if r[0] != 7 or r[1] is not None]
    df = frame(spark, data, "bands")
    got = nd.near_dedup(df).collect()
    assert sorted(str((r.doc_id, r.class_id, r.class_size)) for r in got) == expected(data)
    kept = nd.keep(df)
    assert kept.columns == df.columns and kept.count() == len(set(brute(data)))
    assert nd.near_dedup(frame(spark, [])).count() == nd.keep(frame(spark, [])).count() == 0


def test_registers_estimate_probability_jaccard():
    r = random.Random(1)
    errors = []
    for _ in range(60):
        base = [f"w{r.randrange(10 ** 9)}" for _ in range(200)]
        other = base[:150] + [f"v{r.randrange(10 ** 9)}" for _ in range(50)]
        doc, s, count, *_ = nd.shingles([" ".join(base), " \n".join(other)])
        sig = nd.signatures(doc, s, 1 + np.log(count), 2)
        a, b = set(s[doc == 0]), set(s[doc == 1])
        errors.append((sig[0] == sig[1]).mean() - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_weights_count():
    # one shingle holds nearly all the weight, so nearly all registers
    doc, s, w = np.zeros(101, np.int64), nd.mix(np.arange(101, dtype=np.uint64)), np.array([1.0] * 100 + [900.0])
    assert abs((nd.signatures(doc, s, w, 1)[0] == s[100]).mean() - 0.9) < 0.1


def test_long_texts_are_read_whole():
    words = [f"w{i}" for i in range(300_000)]
    doc, s, *_ = nd.shingles([" ".join(words), " ".join(words[:-1] + ["end"]), "x" * (3 << 20)])
    a, b = set(s[doc == 0]), set(s[doc == 1])
    assert len(a) == 299_996 and len(a ^ b) == 2 and (doc == 2).sum() == 1


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 6000 + i) for i in range(50)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_blocks_find_what_the_first_text_does_not_link(spark, monkeypatch):
    """A bucket whose first text is alone: the rest are linked only by comparing blocks."""
    monkeypatch.setattr(nd, "SMALL", 3)
    monkeypatch.setattr(nd, "BLOCK", 4)
    r = random.Random(9)
    texts = [" ".join(f"z{r.randrange(10 ** 9)}" for _ in range(100))] + family(r, 9, 200, 1) + family(r, 6, 150, 1)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    members = spark.createDataFrame([(1, i, 0, len(texts)) for i in range(len(texts))], "g long, id long, first long, n long")
    labels = components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"))
    got = {(min(x.a, x.b), max(x.a, x.b)) for x in nd.block_links(members, labels, df).collect()}
    linked = {(a, b) for a, b in combinations(range(len(texts)), 2)
              if len(shingle_set(texts[a]) & shingle_set(texts[b])) >= 0.8 * len(shingle_set(texts[a]) | shingle_set(texts[b]))}
    # pairs within {1, 2, 3} are one class already
    assert got == {p for p in linked if not set(p) <= {1, 2, 3}} and len(got) > 40


def repeated_lines(r, n, base=220, line=20, times=20):
    """Texts with one half of plain words in common, and each with its own line many times."""
    common = " ".join(f"c{r.randrange(10 ** 9)}" for _ in range(base))
    return [common + "\n" + "\n".join([" ".join(f"l{r.randrange(10 ** 9)}" for _ in range(line))] * times) for _ in range(n)]


@pytest.mark.parametrize("times", [5, 20])
def test_changed_repeated_lines_equal_brute_force(spark, times):
    """How often a differing shingle is repeated says nothing about the sets."""
    r = random.Random(17)
    texts = [t for _ in range(40) for t in repeated_lines(r, 2, times=times)]
    data = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    assert len(set(brute(data))) == 40
    got = nd.near_dedup(frame(spark, data)).collect()
    assert sorted(str((x.doc_id, x.class_id, x.class_size)) for x in got) == expected(data)


def test_blocks_link_changed_repeated_lines(spark, monkeypatch):
    monkeypatch.setattr(nd, "SMALL", 3)
    monkeypatch.setattr(nd, "BLOCK", 4)
    r = random.Random(18)
    texts = [" ".join(f"z{r.randrange(10 ** 9)}" for _ in range(100))] + repeated_lines(r, 12)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    members = spark.createDataFrame([(1, i, 0, len(texts)) for i in range(len(texts))], "g long, id long, first long, n long")
    labels = components(spark.createDataFrame([(1, 2)], "a long, b long"))
    got = {(min(x.a, x.b), max(x.a, x.b)) for x in nd.block_links(members, labels, df).collect()}
    assert got == set(combinations(range(1, 13), 2)) - {(1, 2)}


def test_block_links_are_all_alike_pairs():
    r = np.random.default_rng(4)
    common = r.integers(0, 1 << 62, 400)
    sets = [np.unique(np.concatenate((r.choice(common, r.integers(0, 60), False), common[:r.integers(0, 300)]))).astype(np.int64) for _ in range(150)]
    sets += [np.zeros(0, np.int64), common[:5].copy(), common[:4].copy()]
    xs, ys = sets[:70] + sets[-3:], sets[50:]
    may = np.arange(len(ys)) % 7 != 3
    got = {(i, j) for i, near in nd.links_between(xs, ys, lambda i: may) for j in near.tolist()}
    want = {(i, j) for i, x in enumerate(xs) for j, y in enumerate(ys) if may[j] and nd.alike(np.sort(x), np.sort(y))}
    assert got == want and len(got) > 100


def test_the_documents_table_equals_brute_force(spark):
    """Every class of the whole table, and with it every linked pair: a recall of 1."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    data = [(r.doc_id, r.text) for r in rows]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = sorted(str((r.doc_id, r.class_id, r.class_size)) for r in nd.near_dedup(df).collect())
    want = expected(data)
    assert got == want and sum(", 1)" not in w for w in want) > 50
