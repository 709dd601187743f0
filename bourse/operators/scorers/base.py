"""What a scorer is, and how several run over one snapshot in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourse.functions.rules import Rules
from bourse.operators.scorers.snapshot import Snap

#: block columns by scorer, per Spark application: they name columns only, so one set serves every snapshot
_BUILT: dict[str, dict] = {}


def _built() -> dict:
    return _BUILT.setdefault(SparkContext.getOrCreate().applicationId, {})


PartsFn = Callable[[Snap, bool], dict[str, Rules]]
#: block and value names by scorer, filled when its columns are first built
_NAMES: dict[str, tuple[list[str], list[str]]] = {}


@dataclass(frozen=True)
class Scorer:
    key: str
    name: str
    #: rule blocks by name
    parts: PartsFn
    #: scaled block score from its raw points; default: the raw points
    scale: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    #: total from the block scores; None for scorers without a score
    score: Callable[[Callable[[str], Column]], Column] | None = None
    max_score: float | None = None
    #: signal from total and values
    signal: Callable[[Callable[[str], Column]], Column] = None
    #: named numbers beside the blocks (intrinsic value, margin of safety, ratios)
    values: Callable[[Snap], dict[str, Column]] = field(default=lambda s: {})
    confidence: Callable[[Callable[[str], Column]], Column] | None = None

    def part_columns(self, literal: bool, snap: Snap | None = None) -> dict[str, Column]:
        memo = _built()
        if (self.key, literal) in memo:
            return memo[self.key, literal]
        s = memo.setdefault("snap", snap or Snap())
        parts, values = self.parts(s, literal), self.values(s)
        _NAMES[self.key] = (list(parts), list(values))
        out = {}
        for name, rules in parts.items():
            raw = rules.raw()
            out[f"{self.key}_{name}"] = self.scale[name](raw) if name in self.scale else raw
        memo[self.key, literal] = out | {f"{self.key}_{name}": col for name, col in values.items()}
        return memo[self.key, literal]

    def reason_columns(self, literal: bool = True) -> dict[str, Column]:
        return {n: r.reasons() for n, r in self.parts(Snap(), literal).items()}

    def _names(self) -> tuple[list[str], list[str]]:
        if self.key not in _NAMES:
            self.part_columns(True)
        return _NAMES[self.key]

    def part_names(self) -> list[str]:
        return self._names()[0]

    def value_names(self) -> list[str]:
        return self._names()[1]

    def col(self, name: str) -> Column:
        return F.col(f"{self.key}_{name}")


def share_signal(max_score: float, high: float = 0.7, low: float = 0.3):
    """bullish from `high` of the maximum, bearish up to `low` of it."""
    def signal(c):
        s = c("score")
        return (F.when(s >= F.lit(high * max_score), "bullish")
                .when(s <= F.lit(low * max_score), "bearish").otherwise("neutral"))
    return signal


def ten_point_signal(c):
    s = c("score")
    return F.when(s >= 7.5, "bullish").when(s <= 4.5, "bearish").otherwise("neutral")


def scaled_to_ten(out_of: float):
    return lambda raw: F.least(F.lit(10.0), raw / F.lit(float(out_of)) * 10.0)


def apply(snapshot: DataFrame, scorers: Iterable[Scorer], literal: bool = True) -> DataFrame:
    """Snapshot plus every scorer's block, score, signal and confidence columns.

    All blocks are columns of the same row: the snapshot is read once however
    many scorers run.
    """
    scorers = list(scorers)
    snap = Snap()
    df = snapshot.withColumns({n: c for s in scorers for n, c in s.part_columns(literal, snap).items()})
    df = df.withColumns({f"{s.key}_score": s.score(s.col) for s in scorers if s.score})
    df = df.withColumns({f"{s.key}_signal": s.signal(s.col) for s in scorers})
    conf = {f"{s.key}_confidence": s.confidence(s.col) for s in scorers if s.confidence}
    return df.withColumns(conf) if conf else df


def results_long(scored: DataFrame, scorers: Iterable[Scorer]) -> DataFrame:
    """(ticker, agent, signal, score, max_score, confidence, parts): one row per ticker and scorer.

    A scorer without a signal failed for that ticker and gives no row.
    """
    rows = []
    null = F.lit(None).cast("double")
    for s in scorers:
        entries = [x for p in s.part_names() for x in (F.lit(p), s.col(p).cast("double"))]
        parts = F.create_map(*entries).cast("map<string,double>")
        rows.append(F.struct(
            F.lit(s.key).alias("agent"), s.col("signal").alias("signal"),
            (s.col("score") if s.score else null).alias("score"),
            (F.lit(float(s.max_score)) if s.max_score else null).alias("max_score"),
            (s.col("confidence").cast("double") if s.confidence else null).alias("confidence"),
            parts.alias("parts")))
    return (scored.select("ticker", "company_name", F.explode(F.array(*rows)).alias("r"))
            .select("ticker", "company_name", "r.*").where(F.col("signal").isNotNull()))
