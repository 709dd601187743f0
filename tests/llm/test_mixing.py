import random
from hashlib import md5

import check_oracles as co
import pytest
from corpus import awkward, frame
from pyspark.sql import functions as F

from bourse.llm import mixing

SF = "/root/testdata/sf0.001"
ALL = ({"": 1}, {"": 1}, {"": 1})


def share_out(budget, children):
    """[(name, cap, weight)] -> {name: got}: fill up one by one, largest remainders first."""
    budget, got, left = min(budget, sum(c for _, c, w in children)), {n: 0 for n, _, _ in children}, [c for c in children if c[2] > 0]
    while left:
        total = sum(w for *_, w in left)
        full = [c for c in left if c[1] * total <= budget * c[2]]
        if not full:
            parts = sorted(((budget * w) // total, -((budget * w) % total), n) for n, _, w in left)
            spare = budget - sum(p[0] for p in parts)
            for i, (g, _, n) in enumerate(sorted(parts, key=lambda p: p[1:])):
                got[n] = g + (i < spare)
            return got
        n, c, w = min(full, key=lambda c: (c[1] / c[2], c[0]))
        got[n], budget = c, budget - c
        left = [x for x in left if x[0] != n]
    return got


def brute_budgets(leaves, weights, share, epochs):
    wd, wl, ws = weights
    at = lambda w, k: w.get(k, w.get("", 0))
    cap = {k: t * epochs * (at(wd, k[0]) * at(wl, k[1]) * at(ws, k[2]) > 0) for k, t in leaves.items()}
    out = {}
    top = share_out(sum(leaves.values()) * share[0] // share[1],
                    [(d, sum(c for k, c in cap.items() if k[0] == d), at(wd, d)) for d in {k[0] for k in leaves}])
    for d, b in top.items():
        mid = share_out(b, [(x, sum(c for k, c in cap.items() if k[:2] == (d, x)), at(wl, x)) for x in {k[1] for k in leaves if k[0] == d}])
        for x, b2 in mid.items():
            low = share_out(b2, [(s, cap[d, x, s], at(ws, s)) for s in {k[2] for k in leaves if k[:2] == (d, x)}])
            out |= {(d, x, s): g for s, g in low.items()}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_budgets_equal_recursion(spark, seed):
    r = random.Random(seed)
    leaves = {(f"d{r.randrange(3)}", f"l{r.randrange(3)}", f"s{i}"): r.choice([0, 1, 7, 100, 5000, 10 ** 14]) for i in range(25)}
    weights = ({"d0": 5, "d1": r.randrange(3), "": 1}, {"l0": 3, "l2": 0, "": 2}, {"s1": 9, "s2": 0, "": 1})
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    for share, epochs in (((6, 10), 3), ((1, 1), 1), ((5, 1), 2), ((1, 10 ** 6), 1)):
        got = {(x.domain, x.lang, x.source): x.budget for x in mixing.budgets(df, weights, share, epochs).collect()}
        assert got == brute_budgets(leaves, weights, share, epochs)


def test_shortage_goes_to_siblings_first(spark):
    df = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("b", "x", "s3", 1000)], "domain string, lang string, source string, tokens long")
    got = {x.source: x.budget for x in mixing.budgets(df, ALL, (800, 2010), 1).collect()}
    assert got == {"s1": 10, "s2": 390, "s3": 400}


def test_prefixes_equal_brute_force(spark):
    data = awkward(60, 4)
    df = frame(spark, data, "key", "range", "part")
    got = [(r.doc_id, r.domain, r.lang, r.source, r.tokens, r.budget, r.copies) for r in mixing.plan(df).collect()]
    leaf = lambda r: ("other" if not r[3] else f"domain{int(r[3][3:]) % 4}", r[2] or "unknown", r[3] or "unknown")
    tokens = lambda r: -(-len((r[1] or "").encode()) // 4)
    leaves = {}
    for r in data:
        leaves[leaf(r)] = leaves.get(leaf(r), 0) + tokens(r)
    budgets = brute_budgets(leaves, (mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, mixing.SOURCE_WEIGHTS), mixing.SHARE, mixing.EPOCHS)
    want = []
    for r in data:
        total, b = leaves[leaf(r)], budgets[leaf(r)]
        full, part = divmod(b, total) if total else (0, 0)
        key = lambda x: md5(f"{mixing.SEED}:{full}:{'null' if x[0] is None else x[0]}:{md5((x[1] or '').encode()).hexdigest()}".encode()).hexdigest()  # noqa: B023, E731
        start = sum(tokens(x) for x in data if leaf(x) == leaf(r) and key(x) < key(r))
        want.append((r[0], *leaf(r), tokens(r), b, full + (start < part)))
    assert sorted(map(str, got)) == sorted(map(str, want))
    rows = mixing.mixed(df)
    assert rows.columns == df.columns and rows.count() == sum(w[-1] for w in want)
    empty = frame(spark, [])
    assert mixing.plan(empty).count() == mixing.mixed(empty).count() == 0


def test_query_equals_its_sql(spark):
    import __spark_entry__ as entry
    assert co.compare(entry.queries()["op2_mix_sources"](spark, SF), co.duck(SF), mixing.SQL) is None


def test_mix_meets_its_weights(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 40).alias("text"), F.lit("en").alias("lang"),
                                    F.when(F.col("id") % 3 == 0, "src0").otherwise(F.concat(F.lit("src"), F.col("id") % 8)).alias("source"))
    rows = mixing.plan(df, share=(1, 4)).where("copies > 0").groupBy("domain", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.max("budget").alias("b")).collect()
    assert all(0 <= r.t - r.b < 10 for r in rows) and sum(r.b for r in rows) == 50_000


def test_rows_without_ids_do_not_overrun_a_budget(spark):
    """Half the ids are missing: rows are told apart by their texts."""
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.format_string("%040d", "id").alias("text"),
                                  F.lit("en").alias("lang"), F.lit("src0").alias("source"))
    for seed in "abcd":
        r = mixing.plan(df, share=(1, 4), seed=seed).agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.max("budget").alias("b")).first()
        assert r.b == 10_000 and 0 <= r.t - r.b < 10


def test_a_very_long_text_is_one_document(spark):
    rows = [(i, "x" * (10 ** 6 if i == 5 else 40), "en", "src0") for i in range(30)]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert sorted(r.tokens for r in got)[-2:] == [10, 250_000] and len(got) == 30
