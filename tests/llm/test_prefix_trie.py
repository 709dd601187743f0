import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from bourse.llm import prefix_trie as pt

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def rebuilt(rows):
    """conversation -> list of (role, text), as the contract rebuilds it"""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - int(c / 20) * 0 - (c % 20 if c >= 0 else -(-c % 20)), [])
        out[c] = base[:h] + turns[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        leaf = lambda p: not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in nodes)
        saved = sum((len(nodes[p]) - 1) * len(re.findall(pt.WORD, p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(path))
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below),
                 sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def tuples(df):
    return {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def awkward(seed, n=60):
    r = random.Random(seed)
    said = ["hi", "hello there\x0bfriend", "", None, "a b  c", "漢字 ok", "x " * 5000]
    rows = []
    for c in range(-25, n):
        for turn in range(r.choice([1, 1, 2, 3, 6])):
            rows.append((c, r.choice([turn, turn, turn, None, 0]), r.choice(["user", "assistant", "", None]), r.choice(said[:4] if turn < 3 else said)))
    return rows + rows[:5] + [(None, 0, "user", "lost"), (10 ** 15, 1, "user", "far")] + [(200 + i, 0, "user", "common") for i in range(40)]


@pytest.fixture(params=[(2048, 4096), (4, 16), (1, 3)])
def layout(request, monkeypatch):
    """One shard, many shards, a shard per conversation."""
    monkeypatch.setattr(pt, "SHARD", request.param[0])
    monkeypatch.setattr(pt, "PART", request.param[1])
    monkeypatch.setattr(pt, "PIECE", 3)


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, layout, seed):
    rows = awkward(seed)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS path", "2 AS words", "'x' AS node").repartition(3)
    got = pt.conversation_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows_ = tuples(got)
    assert rows_ == brute(rebuilt(rows)) and len(rows_) == got.count()


def test_conversations_without_turns_and_long_ones(spark, layout):
    # 21 takes its only turn from conversation 20, which does not exist; 40 is long, 59 repeats most of it
    none = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    rows = [(none, 0, "user", "gone")] + [(40, i, "user", f"turn {i}") for i in range(300)] + [(59, i, "user", f"turn {i}") for i in range(290)]
    rows += [(60 + i, 0, "user", "same") for i in range(9)]
    assert tuples(pt.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rebuilt(rows))


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pt.conversation_trie(empty).count() == 0
    assert pt.conversation_trie(spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)).count() == 0


def test_role_and_text_are_kept_apart(spark):
    rows = [(0, 0, "a", "b"), (20, 0, "ab", ""), (40, 0, "", "ab")]
    assert len(tuples(pt.conversation_trie(spark.createDataFrame(rows, SCHEMA)))) == 4


def test_query_equals_its_sql(spark):
    import __spark_entry__ as entry
    import check_oracles as co
    sf = "/root/testdata/sf0.01"
    assert co.compare(entry.queries()["op12_conversation_trie"](spark, sf), co.duck(sf), pt.SQL) is None
