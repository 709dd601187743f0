"""Mixing sources to target weights by hierarchical budgets (DataFrame operators only).

The tree is domain - language - source.  A budget of tokens flows down from the root by weight.  A node cannot
give more than its capacity, the tokens of its documents times the number of epochs allowed; what it cannot give
goes to its siblings by their weights, and only what a whole family cannot give goes to its parent's siblings.
Because capacities are summed up the tree before budgets come down, one step per level does this exactly: children
sorted by capacity per weight fill up one after the other until the rest can share by weight.

A leaf takes its budget from a stream of epochs, each one all its documents in a seeded order.  So every document
is taken `budget div tokens` times, and once more if it starts within the remaining prefix of the next epoch.
The end of that prefix is found by totals over 4096 key ranges per leaf and then within one range, never by
sorting a leaf.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourse.llm.common import col, fresh, stored

#: relative weights (integers); what is not named has the weight under ""
Weights = Mapping[str, int]
DOMAIN_WEIGHTS: Weights = {"domain0": 4, "domain1": 3, "domain2": 2, "": 1}
LANG_WEIGHTS: Weights = {"en": 50, "de": 20, "fr": 20, "es": 10, "": 5}
SOURCE_WEIGHTS: Weights = {"src0": 2, "": 1}
SHARE, EPOCHS, SEED = (6, 10), 3, "mix-1"
LEVELS = ("domain", "lang", "source")
#: up to this many leaves (some 100 bytes each) their table is sent to all tasks
LEAVES = 100_000


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo 4, or `other`."""
    n = F.try_to_number(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1), F.lit("999999999")).cast("int")
    return F.coalesce(F.concat(F.lit("domain"), F.pmod(n, F.lit(4)).cast("string")), F.lit("other"))


def tokens_of(text: Column) -> Column:
    """An estimate that does not need a vocabulary: a token for every four bytes begun."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("bigint")


def weight(c: Column, weights: Weights) -> Column:
    out = F.lit(weights.get("", 0))
    for name, w in weights.items():
        if name:
            out = F.when(c == name, F.lit(w)).otherwise(out)
    return out.cast("decimal(10,0)")


def shared(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `got` to children (columns: parent.., name, cap, w, budget): the parent's budget shared out.

    Children without weight get nothing.  Whole tokens; those left over by
    rounding go to the largest remainders, then by name.
    """
    by_fill = W.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), name)
    before, after = by_fill.rowsBetween(W.unboundedPreceding, -1), by_fill.rowsBetween(0, W.unboundedFollowing)
    some = children.where("w > 0").withColumns({
        "left": F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)), "weights": F.sum("w").over(after)})
    # full: its capacity is not above its share of what those before it left
    some = some.withColumn("full", (F.col("cap") * F.col("weights") <= F.col("left") * F.col("w")).cast("int"))
    full = W.partitionBy(*parent)
    some = some.withColumns({
        "rest": F.greatest(F.col("budget") - F.sum(F.col("cap") * F.col("full")).over(full), F.lit(0)),
        "open": F.sum(F.col("w") * (1 - F.col("full"))).over(full)})
    some = some.withColumns({"whole": F.expr("if(full = 1, cap, (rest * w) div open)").cast("decimal(20,0)"),
                             "over": F.expr("if(full = 1, -1, (rest * w) % open)").cast("decimal(20,0)")})
    spare = F.col("rest") - F.sum(F.col("whole") * (1 - F.col("full"))).over(full)
    place = F.row_number().over(W.partitionBy(*parent).orderBy(F.desc("over"), name))
    some = some.withColumns({"spare": spare, "place": place})
    got = (F.col("whole") + ((F.col("full") == 0) & (F.col("place") <= F.col("spare"))).cast("int")).cast("decimal(20,0)")
    return some.withColumn("got", got).drop("left", "weights", "full", "rest", "open", "whole", "over", "spare", "place", "budget")


def budgets(leaves: DataFrame, weights: tuple[Weights, Weights, Weights], share: tuple[int, int], epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) of every leaf; share is the total budget as a fraction of all tokens."""
    size = F.col("tokens").cast("decimal(20,0)")
    tree = leaves.withColumns({"cap": (size * epochs).cast("decimal(20,0)")} | {
        f"w_{c}": weight(F.col(c), w) for c, w in zip(LEVELS, weights, strict=True)})
    # a node none of whose leaves may be used has no capacity
    usable = F.col("w_domain") * F.col("w_lang") * F.col("w_source") > 0
    tree = tree.withColumn("cap", F.when(usable, F.col("cap")).otherwise(F.lit(0)).cast("decimal(20,0)"))
    total = leaves.agg(F.sum(size)).first()[0] or 0
    # one row per leaf all the way; every level shares out its parents' budgets
    level = tree.withColumns({"root": F.lit(0), "budget": F.lit(Decimal(int(total) * share[0] // share[1])).cast("decimal(20,0)")})
    kept = level
    for depth, name in enumerate(LEVELS):
        parent = ["root", *LEVELS[:depth]]
        nodes = kept.groupBy(*parent, name).agg(F.sum("cap").cast("decimal(20,0)").alias("cap"), F.max(f"w_{name}").alias("w"), F.max("budget").alias("budget"))
        nodes = nodes.withColumn("budget", F.least("budget", F.sum("cap").over(W.partitionBy(*parent))).cast("decimal(20,0)"))
        got = shared(nodes, parent, name).select(*parent, name, F.col("got").alias("budget"))
        kept = kept.drop("budget").join(got, [*parent, name], "left").withColumn("budget", F.coalesce("budget", F.lit(0).cast("decimal(20,0)")))
    return kept.select(*LEVELS, "tokens", F.col("budget").cast("bigint").alias("budget"))


def sort_key(epoch: Column, id_: Column, text_md5: Column, seed: str) -> Column:
    """The place of a document in an epoch's order; only rows with one id and one text share a place."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit("null")), text_md5).cast("binary"))


def md5_of(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def plan(docs: DataFrame, weights=(DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS), share: tuple[int, int] = SHARE, epochs: int = EPOCHS,
         seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
         names: tuple[str, ...] = ("domain", "lang", "source", "tokens", "budget", "copies")) -> DataFrame:
    """All columns of `docs` that are asked for by the caller, plus `names`: how often each row is taken.

    NULL languages and sources count as `unknown`.  Texts without bytes have no
    tokens: they are placed like others and taken where they fall.  Rows that
    share an id and a text within a leaf are taken together.
    """
    source = F.coalesce(col(source_col), F.lit("unknown"))
    leaf = {"domain": domain_of(col(source_col)), "lang": F.coalesce(col(lang_col), F.lit("unknown")), "source": source, "tokens": tokens_of(col(text_col))}
    narrow = docs.select(col(id_col).alias("id"), md5_of(col(text_col)).alias("text_md5"), *[c.alias(n) for n, c in leaf.items()])
    leaves = stored(narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    shares = stored(budgets(leaves, weights, share, epochs).withColumns({
        "full": F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)),
        "part": F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(F.lit(0))}).withColumnRenamed("tokens", "all"), "mix-shares")
    few = shares.count() <= LEAVES
    near = F.broadcast if few else (lambda df: df)
    keyed = narrow.join(near(shares.select(*LEVELS, "full", "part")), list(LEVELS)).withColumn("key", sort_key(F.col("full"), F.col("id"), F.col("text_md5"), seed))
    keyed = keyed.where("part > 0").withColumn("range", F.substring("key", 1, 3))
    ranges = keyed.groupBy(*LEVELS, "range", "part").agg(F.sum("tokens").alias("tokens"))
    upto = W.partitionBy(*LEVELS).orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = (ranges.withColumn("end", F.sum("tokens").over(upto)).where("end - tokens < part and end >= part")
            .select(*LEVELS, "range", (F.col("end") - F.col("tokens")).alias("start")))
    inside = (keyed.join(near(last), [*LEVELS, "range"]).groupBy(*LEVELS, "key", "part", "start").agg(F.sum("tokens").alias("tokens")))
    inside = inside.withColumn("end", F.col("start") + F.sum("tokens").over(W.partitionBy(*LEVELS).orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow)))
    cut = inside.where("end - tokens < part").groupBy(*LEVELS).agg(F.max("key").alias("cut"))
    ends = stored(shares.join(cut, list(LEVELS), "left").select(*LEVELS, "budget", "full", "cut"), "mix-ends")
    own = dict(zip(("budget", "full", "cut"), fresh(docs, "__budget", "__full", "__cut"), strict=True))
    keys = dict(zip(LEVELS, fresh(docs, "__domain", "__lang", "__source"), strict=True))
    rows = docs.withColumns({keys[n]: leaf[n] for n in LEVELS})
    rows = rows.join(near(ends.withColumnsRenamed(keys | own)), list(keys.values()))
    more = F.coalesce((sort_key(F.col(own["full"]), col(id_col), md5_of(col(text_col)), seed) <= F.col(own["cut"])).cast("int"), F.lit(0))
    made = (*(F.col(keys[n]) for n in LEVELS), tokens_of(col(text_col)), F.col(own["budget"]), (F.col(own["full"]) + more).cast("int"))
    return rows.select(*[col(c) for c in docs.columns if c not in names], *[c.alias(n) for n, c in zip(names, made, strict=True)])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    names = fresh(docs, "__d", "__l", "__s", "__t", "__b", "__copies")
    rows = plan(docs, names=tuple(names), **options).where(F.col(names[5]) > 0)
    return rows.withColumn(names[0], F.explode(F.sequence(F.lit(1), F.col(names[5])))).select(*map(col, docs.columns))


def _case(c: str, weights: Weights) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items() if k) + f" ELSE {weights.get('', 0)} END"


def _share_sql(name: str, parent: str) -> str:
    """CTEs that share budgets among the children of one level; `kept` is the table one level up."""
    up = f"kept_{parent}" if parent else "kept"
    by = "root" + "".join(f", {c}" for c in LEVELS[:LEVELS.index(name)])
    return f"""
n_{name} AS (SELECT {by}, {name}, sum(cap)::HUGEINT AS cap, max(w_{name})::HUGEINT AS w, max(budget)::HUGEINT AS b0 FROM {up} GROUP BY ALL),
b_{name} AS (SELECT *, least(b0, sum(cap) OVER (PARTITION BY {by}))::HUGEINT AS budget FROM n_{name}),
l_{name} AS (SELECT *, budget - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
    sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM b_{name} WHERE w > 0 WINDOW f AS (PARTITION BY {by} ORDER BY cap / w, {name})),
f_{name} AS (SELECT *, (cap * ws <= lft * w)::INT AS fl FROM l_{name}),
r_{name} AS (SELECT *, greatest(budget - sum(cap * fl) OVER (PARTITION BY {by}), 0)::HUGEINT AS rest, sum(w * (1 - fl)) OVER (PARTITION BY {by})::HUGEINT AS opn FROM f_{name}),
w_{name} AS (SELECT *, CASE WHEN fl = 1 THEN cap ELSE (rest * w) // opn END AS whole, CASE WHEN fl = 1 THEN -1 ELSE (rest * w) % opn END AS ovr FROM r_{name}),
g_{name} AS (SELECT *, whole + (fl = 0 AND row_number() OVER (PARTITION BY {by} ORDER BY ovr DESC, {name})
    <= rest - sum(whole * (1 - fl)) OVER (PARTITION BY {by}))::INT AS got FROM w_{name}),
kept_{name} AS (SELECT k.* EXCLUDE (budget), coalesce(g.got, 0) AS budget FROM {up} k LEFT JOIN g_{name} g USING ({by}, {name})),"""


SQL = f"""
WITH d AS (
    SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
        coalesce('domain' || (try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INT) % 4), 'other') AS domain,
        (coalesce(strlen(text), 0) + 3) // 4 AS tokens, md5(coalesce(text, '')) AS text_md5
    FROM documents),
kept AS (SELECT 0 AS root, domain, lang, source, sum(tokens) AS tokens, {_case('domain', DOMAIN_WEIGHTS)} AS w_domain,
        {_case('lang', LANG_WEIGHTS)} AS w_lang, {_case('source', SOURCE_WEIGHTS)} AS w_source,
        sum(tokens) * {EPOCHS} AS cap, (SELECT sum(tokens) * {SHARE[0]} // {SHARE[1]} FROM d) AS budget FROM d GROUP BY ALL),
{_share_sql('domain', '')}{_share_sql('lang', 'domain')}{_share_sql('source', 'lang')}
s AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS part FROM kept_source),
k AS (SELECT d.*, s.budget, s.whole, s.part, md5('{SEED}:' || s.whole || ':' || coalesce(doc_id::VARCHAR, 'null') || ':' || text_md5) AS key
    FROM d JOIN s USING (domain, lang, source)),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) - sum(tokens) OVER (PARTITION BY domain, lang, source, key) AS start FROM k)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, budget::BIGINT AS budget, (whole + (start < part)::INT)::INT AS copies FROM c
"""
