import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from corpus import awkward, frame

from bourse.llm import shared_ranking as sr

FOLD = str.maketrans(sr.UPPER, sr.LOWER)


def split(text):
    return re.findall(sr.TERM, (text or "").translate(FOLD))


def brute(docs, items, k):
    """(item, rank, id, score) of (id, text) rows against (item, text) rows, straight from the formula."""
    terms = [split(t) for _, t in docs]
    n_docs, n_terms = sum(bool(t) for t in terms), sum(map(len, terms))
    df = Counter(w for t in terms for w in set(t))
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for w, n in df.items()}
    bags = {}
    for item, text in items:
        bags.setdefault(item, []).extend(split(text))
    out = set()
    for item, bag in bags.items():
        hits = []
        for (id_, _), t in zip(docs, terms):
            tf = Counter(t)
            m = 100 - 25 + 25 * len(t) * n_docs // n_terms if t else 0
            score = sum(weight[w] * (1_000_000_000 * tf[w] // (1000 * tf[w] + 12 * m)) for w in bag if w in tf)
            if score > 0:
                hits.append((-score, id_ is None, id_ or 0))
        out |= {(item, r, None if none else id_, -s) for r, (s, none, id_) in enumerate(sorted(hits)[:k], 1)}
    return out


def found(spark, docs, items, **options):
    got = sr.search(docs, spark.createDataFrame(items, "item_id long, text string"), **options)
    return {(r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()}


ITEMS = [(0, "alpha beta gamma"), (1, "alpha beta gamma délta alpha alpha"), (2, "ALPHA beta 42 x1 ε"), (3, None), (4, ""), (5, "no such words"), (6, "token 漢字 σΣς"),
         (7, "alpha " * 300 + "beta"), (7, "gamma x1"), (None, "alpha 42"), (8, "alpha beta gamma délta"), (9, "a" * 3000)]


@pytest.mark.parametrize("block", [sr.BLOCK, 4])
def test_equals_brute_force_on_awkward_rows(spark, block):
    data = awkward()
    docs = frame(spark, data, "item_id", "rank", "score", "term").repartition(5)
    assert found(spark, docs, ITEMS, k=6, block=block) == brute([r[:2] for r in data], ITEMS, 6)


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force_on_random_texts(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    docs = [(i // 2, " ".join(r.choices(words, k=r.randint(0, 60)))) for i in range(300)]  # every id twice
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 25)))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found(spark, df, items) == brute(docs, items, 20)


def test_empty_tables(spark):
    some = spark.createDataFrame([(1, "alpha")], "doc_id long, text string")
    assert found(spark, some.where("false"), ITEMS) == set() and found(spark, some, []) == set()
    assert found(spark, some.selectExpr("doc_id", "'..' AS text"), ITEMS) == set()


def test_terms_of_bytes_and_of_text_agree(spark):
    texts = ["Ab-cD\x00e\x7f9ÄÖß ſK x", "\t\n _a^b`c{d", "", None, "é" * 10 ** 5 + " z"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(sr.terms(sr.F.col("text"))).collect()
    for t, row in zip(texts, got):
        assert [w.decode() for w in sr.found_in(t)] == split(t) == list(row[0])


@pytest.mark.parametrize("seed", range(5))
def test_shared_sums_are_computed_once_and_add_up(seed):
    """The plan's scores are plain sums over the bags, from fewer additions."""
    r = random.Random(seed)
    core = [f"c{i}".encode() for i in range(12)]
    bags = [(i, Counter(r.sample(core, 8) + [f"own{i}{j}".encode() for j in range(3)] + [core[0]] * r.randint(0, 5))) for i in range(30)]
    plan = sr.mined(bags)
    leaves = np.random.default_rng(seed).integers(0, 1000, (len(plan.vocabulary), 7))
    want = np.array([sum(n * leaves[plan.vocabulary[t]] for t, n in bag.items()) for _, bag in bags])
    assert (plan.scores(leaves) == want).all()
    additions = sum(len(a) for _, _, a, _ in plan.levels) + len(plan.uses[0])
    assert additions < sum(len(bag) for _, bag in bags) and plan.levels
    for first, _, a, b in plan.levels:
        assert (a < first).all() and (b < first).all()


def test_query_equals_its_sql(spark):
    import __spark_entry__ as entry
    import check_oracles as co
    sf = "/root/testdata/sf0.01"
    assert co.compare(entry.queries()["op11_shared_ranking"](spark, sf), co.duck(sf), sr.SQL) is None
