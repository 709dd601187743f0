"""Rule tables: points and reasons of one scorer block.

A block is a list of groups; in each group the first branch whose condition
holds gives its points and its reason.  A NULL condition does not hold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bourse.functions.columns import total

Branch = tuple[Column | None, "float | Column", "str | Column"]


def _points(p) -> Column:
    return p.cast("double") if isinstance(p, Column) else F.lit(float(p))


class Rules:
    def __init__(self, guard: Column | None = None, otherwise: str = "insufficient data"):
        self.guard, self.otherwise = guard, otherwise
        self.groups: list[list[Branch]] = []

    def first(self, *branches: Branch) -> "Rules":
        """Branches tried in order; a None condition always holds."""
        self.groups.append(list(branches))
        return self

    def add(self, cond: Column, points: float, text: str | Column) -> "Rules":
        return self.first((cond, points, text))

    def raw(self) -> Column:
        """Sum of the points, 0 where the guard does not hold."""
        cols = []
        for g in self.groups:
            expr = None
            for cond, points, _ in g:
                cond = F.lit(True) if cond is None else cond
                expr = F.when(cond, _points(points)) if expr is None else expr.when(cond, _points(points))
            cols.append(expr.otherwise(F.lit(0.0)))
        points = total(cols)
        return points if self.guard is None else F.when(self.guard, points).otherwise(F.lit(0.0))

    def reasons(self) -> Column:
        """The reasons of the branches that held, joined by '; '."""
        cols = []
        for g in self.groups:
            expr = None
            for cond, _, text in g:
                cond = F.lit(True) if cond is None else cond
                text = F.lit(text) if isinstance(text, str) else text
                expr = F.when(cond, text) if expr is None else expr.when(cond, text)
            cols.append(expr)
        text = F.concat_ws("; ", *cols)
        return text if self.guard is None else F.when(self.guard, text).otherwise(F.lit(self.otherwise))
