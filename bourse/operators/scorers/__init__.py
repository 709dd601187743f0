"""The ten rule-based scorers, run together over one snapshot."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourse.functions.columns import safe_div
from bourse.operators.scorers import (ackman, buffett, druckenmiller, fisher, fundamentals, graham,
                                      lynch, munger, valuation, wood)
from bourse.operators.scorers.base import Scorer, apply, results_long

SCORERS: dict[str, Scorer] = {m.SCORER.key: m.SCORER for m in (
    graham, ackman, wood, munger, lynch, fisher, druckenmiller, buffett, valuation, fundamentals)}


def choose(agents: Iterable[str] | None = None) -> list[Scorer]:
    """Scorers by key or display name; all of them by default."""
    if agents is None:
        return list(SCORERS.values())
    by_name = {s.name: k for k, s in SCORERS.items()}
    agents = [agents] if isinstance(agents, str) else list(agents)
    agents = [by_name.get(a, a) for a in agents]
    unknown = [a for a in agents if a not in SCORERS]
    if unknown:
        raise ValueError(f"unknown scorer(s) {unknown}; known: {sorted(SCORERS)}")
    return [SCORERS[a] for a in dict.fromkeys(agents)]


def score(snapshot: DataFrame, agent: str, literal: bool = True) -> DataFrame:
    """One scorer: ticker, signal, score, max_score, confidence, blocks and values as columns."""
    (s,) = choose(agent)
    df = apply(snapshot, [s], literal)
    cols = [s.col("signal").alias("signal")]
    if s.score:
        cols += [s.col("score").alias("score"), F.lit(s.max_score).alias("max_score")]
    if s.confidence:
        cols.append(s.col("confidence").alias("confidence"))
    return df.select("ticker", *cols, *[s.col(n).alias(n) for n in s.part_names() + s.value_names()])


def score_all(snapshot: DataFrame, agents: Iterable[str] | None = None, literal: bool = True) -> DataFrame:
    """Long form: one row per ticker and scorer."""
    chosen = choose(agents)
    return results_long(apply(snapshot, chosen, literal), chosen)


def reasons(snapshot: DataFrame, agents: Iterable[str] | None = None, literal: bool = True) -> DataFrame:
    """(ticker, agent, block, details): the reasons of every block."""
    rows = []
    for s in choose(agents):
        for block, text in s.reason_columns(literal).items():
            rows.append(F.struct(F.lit(s.key).alias("agent"), F.lit(block).alias("block"), text.alias("details")))
    return snapshot.select("ticker", F.explode(F.array(*rows)).alias("r")).select("ticker", "r.*")


def display(long: DataFrame) -> DataFrame:
    """Share of the maximum score, or the confidence where there is no score, in percent."""
    pct = safe_div("score", "max_score") * 100.0
    return long.withColumn("percent", F.coalesce(pct, F.col("confidence")))


def summary(snapshot: DataFrame, agents: Iterable[str] | None = None, literal: bool = True) -> DataFrame:
    """One row per ticker: votes, total score, majority signal, price ratios."""
    chosen = choose(agents)
    ratios = choose(["fundamentals"])[0]
    with_ratios = ratios in chosen
    scored = apply(snapshot, chosen, literal)
    votes = vote_columns([s.col("signal") for s in chosen])
    total = sum([F.coalesce(s.col("score"), F.lit(0.0)) for s in chosen if s.score], F.lit(0.0))
    return scored.select(
        "ticker", "company_name", majority(votes["bullish"], votes["bearish"], votes["neutral"]).alias("signal"),
        total.alias("score"), *[c.alias(n) for n, c in votes.items()],
        *[(F.nullif(ratios.col(r), F.lit(0.0)) if with_ratios else F.lit(None).cast("double")).alias(r)
          for r in ("pe_ratio", "pb_ratio", "ps_ratio")])


def vote_columns(signals: list) -> dict:
    """Counts over signal columns; anything not NULL and not bullish/bearish is neutral."""
    def count(test):
        flags = [F.when(test(s), 1).otherwise(0) for s in signals]
        return sum(flags[1:], flags[0])
    return {"bullish": count(lambda s: s == "bullish"), "bearish": count(lambda s: s == "bearish"),
            "neutral": count(lambda s: s.isNotNull() & ~s.isin("bullish", "bearish"))}


def majority(bullish, bearish, neutral):
    """Most frequent vote; ties go to Bullish, then Bearish, then Neutral."""
    top = F.greatest(bullish, bearish, neutral)
    return F.when(bullish == top, "Bullish").when(bearish == top, "Bearish").otherwise("Neutral")


def vote_summary(long: DataFrame) -> DataFrame:
    """The same votes from stored long results."""
    g = long.where(F.col("signal").isNotNull()).groupBy("ticker").agg(
        F.count_if(F.col("signal") == "bullish").alias("bullish"),
        F.count_if(F.col("signal") == "bearish").alias("bearish"),
        F.count_if(~F.col("signal").isin("bullish", "bearish")).alias("neutral"),
        F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
    return g.withColumn("signal", majority(F.col("bullish"), F.col("bearish"), F.col("neutral")))
