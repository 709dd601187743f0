"""Column expressions: arithmetic helpers, valuation formulas, rule tables."""
