"""Technical indicators over bar tables.

`add_indicators(bars, names)` adds any set of indicator columns in one plan.
An indicator is declared as columns in a few levels; columns of one level may
use only earlier levels.  All window columns of a level share one window, so
the whole request needs a single exchange on the series key:

    lag     previous-row values
    base    row-wise expressions over those
    roll    rolling statistics of base columns
    derived row-wise expressions over rolling statistics
    roll2   rolling statistics of derived columns
    ewm     exponential averages (see `_add_ewm`)
    out     the indicator itself
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.columns import flag, roll, safe_div
from bourse.operators.series import Series, open_series

#: rows per exponential segment; weights inside one segment stay well inside the
#: double range for every span from 3 up (q = 1/2 gives 2 ** 512 ~ 1e154)
SEGMENT = 512
#: an exponential average forgets a value once its weight is below exp(-40)
FORGET = 40.0


class Levels:
    def __init__(self):
        self.lag: dict[str, str] = {}
        self.base: dict[str, Column] = {}
        self.roll: dict[str, tuple] = {}
        self.derived: dict[str, Column] = {}
        self.roll2: dict[str, tuple] = {}
        self.ewm: dict[str, tuple[str, int, bool]] = {}
        self.out: dict[str, Column] = {}
        self.memory = 1

    def prev(self, col: str) -> Column:
        self.lag[f"_prev_{col}"] = col
        return F.col(f"_prev_{col}")

    def step(self, name: str, expr: Column) -> str:
        self.base[name] = expr
        return name

    def rolling(self, agg: Callable, col: str, n: int) -> Column:
        name = f"_{agg.__name__}{n}_{col}"
        self.roll[name] = (agg, col, n)
        self.need(n)
        return F.col(name)

    def rolling2(self, agg: Callable, col: str, n: int) -> Column:
        name = f"_{agg.__name__}{n}_{col}"
        self.roll2[name] = (agg, col, n)
        return F.col(name)

    def ema(self, col: str, span: int, adjust: bool = False) -> Column:
        name = f"_ewm{span}{'a' if adjust else ''}_{col}"
        self.ewm[name] = (col, span, adjust)
        self.need(math.ceil(FORGET / -math.log1p(-alpha(span))))
        return F.col(name)

    def need(self, rows: int):
        self.memory = max(self.memory, rows + 1)


def alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


# ------------------------------------------------------------------ indicators
def _ema(span):
    def add(lv, name):
        lv.out[name] = lv.ema("close", span)
    return add


def _trend(fast, slow):
    def add(lv, name):
        lv.out[name] = flag(lv.ema("close", fast) > lv.ema("close", slow))
    return add


def _zscore(lv, name, n=50):
    lv.out[name] = safe_div(F.col("close") - lv.rolling(F.avg, "close", n),
                            lv.rolling(F.stddev_samp, "close", n))


def _stoch_rsi(rsi_period, stoch_period=14):
    def add(lv, name):
        delta = F.col("close") - lv.prev("close")
        gain = lv.rolling(F.avg, lv.step("_gain", F.greatest(delta, F.when(delta.isNotNull(), 0.0))), rsi_period)
        loss = lv.rolling(F.avg, lv.step("_loss", -F.least(delta, F.when(delta.isNotNull(), 0.0))), rsi_period)
        rsi = f"_rsi{rsi_period}"
        lv.derived[rsi] = (F.when(loss > 0, 100.0 - 100.0 / (1.0 + gain / loss))
                           .when(gain > 0, F.lit(100.0)))
        lo, hi = lv.rolling2(F.min, rsi, stoch_period), lv.rolling2(F.max, rsi, stoch_period)
        lv.need(rsi_period + stoch_period)
        lv.out[name] = safe_div(F.col(rsi) - lo, hi - lo)
    return add


def _macd(lv, name, fast=12, slow=26):
    lv.out[name] = lv.ema("close", fast) - lv.ema("close", slow)


def _true_range(lv) -> str:
    pc = lv.prev("close")
    return lv.step("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc),
                                     F.abs(F.col("low") - pc)))


def _atr(lv, name, n=14):
    lv.out[name] = lv.rolling(F.avg, _true_range(lv), n)


def _price_momentum(lv, name):
    ret = lv.step("_ret", safe_div("close", lv.prev("close")) - 1.0)
    lv.out[name] = (0.4 * lv.rolling(F.sum, ret, 21) + 0.3 * lv.rolling(F.sum, ret, 63)
                    + 0.3 * lv.rolling(F.sum, ret, 126))
    lv.need(127)


def _volume_momentum(lv, name):
    lv.out[name] = safe_div("volume", lv.rolling(F.avg, "volume", 21))


def _bollinger(lv, name, n=20, k=2.0):
    mean, sd = lv.rolling(F.avg, "close", n), lv.rolling(F.stddev_samp, "close", n)
    lower = mean - k * sd
    lv.out[name] = safe_div(F.col("close") - lower, (mean + k * sd) - lower)


def _keltner(sign):
    def add(lv, name):
        center = lv.ema("close", 20, adjust=True)
        width = lv.rolling(F.avg, lv.step("_hl", F.col("high") - F.col("low")), 10)
        lv.out[name] = center + sign * 2.0 * width
    return add


def _adx(lv, name, n=14):
    atr = lv.rolling(F.avg, _true_range(lv), n)
    dh, dl = F.col("high") - lv.prev("high"), F.col("low") - lv.prev("low")
    up = lv.rolling(F.avg, lv.step("_up", F.when(dh.isNotNull(), F.greatest(dh, F.lit(0.0)))), n)
    down = lv.rolling(F.avg, lv.step("_down", F.when(dl.isNotNull(), F.greatest(-dl, F.lit(0.0)))), n)
    pos, neg = 100.0 * safe_div(up, atr), 100.0 * safe_div(down, atr)
    lv.derived["_dx"] = 100.0 * safe_div(F.abs(pos - neg), pos + neg)
    lv.out[name] = lv.rolling2(F.avg, "_dx", n)
    lv.need(2 * n)


def _engulfing(bullish):
    def add(lv, name):
        o, c, po, pc = F.col("open"), F.col("close"), lv.prev("open"), lv.prev("close")
        up = c > o
        prev_up = F.coalesce(pc > po, F.lit(False))
        bigger = F.abs(c - o) > F.abs(pc - po)
        hit = (up & ~prev_up & (o <= pc) & (c >= po)) if bullish else (~up & prev_up & (o >= pc) & (c <= po))
        lv.out[name] = flag(hit & bigger)
    return add


def _williams(lv, name, n=14):
    hi, lo = lv.rolling(F.max, "high", n), lv.rolling(F.min, "low", n)
    lv.out[name] = -safe_div(hi - F.col("close"), hi - lo)


INDICATORS: dict[str, Callable] = {
    "ema_20": _ema(20), "ema_50": _ema(50), "ema_200": _ema(200),
    "trend_short": _trend(8, 21), "trend_long": _trend(21, 55),
    "z_score": _zscore,
    "stoch_rsi14": _stoch_rsi(14), "stoch_rsi28": _stoch_rsi(28),
    "macd": _macd, "atr": _atr, "adx": _adx, "b_percent": _bollinger,
    "price_momentum": _price_momentum, "volume_momentum": _volume_momentum,
    "keltner_upper": _keltner(1.0), "keltner_lower": _keltner(-1.0),
    "bullish_engulfing": _engulfing(True), "bearish_engulfing": _engulfing(False),
    "williams_r": _williams,
}


# ------------------------------------------------------------------ plan
def add_indicators(bars: DataFrame, names: Iterable[str], key: str = "ticker", time: str = "date",
                   chunk_rows: int | None = None) -> DataFrame:
    """Add the named indicator columns to a bar table."""
    return add_to_series(lambda memory: open_series(bars, memory, key, time, chunk_rows), bars, names)


def memory_of(names: Iterable[str]) -> int:
    """How many rows the named indicators look back on."""
    lv = Levels()
    for n in dict.fromkeys(names):
        INDICATORS[n](lv, n)
    return lv.memory


def add_to_series(opened: Callable[[int], Series], bars: DataFrame, names: Iterable[str]) -> DataFrame:
    """The same on a series that `opened` lays out, or has laid out, for a number of rows to look back on."""
    names = list(dict.fromkeys(names))
    unknown = [n for n in names if n not in INDICATORS]
    if unknown:
        raise ValueError(f"unknown indicator(s) {unknown}; known: {sorted(INDICATORS)}")
    if not names:
        return bars
    lv = Levels()
    for n in names:
        INDICATORS[n](lv, n)
    s = opened(lv.memory)
    w = s.w()
    s = s.with_columns({n: F.lag(c).over(w) for n, c in lv.lag.items()})
    s = s.with_columns(lv.base)
    s = s.with_columns({n: roll(a, c, k, s) for n, (a, c, k) in lv.roll.items()})
    s = s.with_columns(lv.derived)
    s = s.with_columns({n: roll(a, c, k, s) for n, (a, c, k) in lv.roll2.items()})
    helpers = list(lv.lag) + list(lv.base) + list(lv.roll) + list(lv.derived) + list(lv.roll2)
    if lv.ewm:
        s = _add_ewm(s, lv.ewm)
        helpers += list(lv.ewm)
    return s.with_columns(lv.out).close().drop(*helpers)


def _add_ewm(s: Series, specs: dict[str, tuple[str, int, bool]]) -> Series:
    """Exponential averages without a recursive step.

    y_t = sum_i w_i x_i q^(t-i) with q = 1 - alpha is a running sum of
    x_i q^-i, which overflows on long series.  The series is therefore cut into
    segments of SEGMENT rows; the running sum is taken inside a segment and the
    weighted ends of the few earlier segments that still matter are added.
    `adjust=False` starts from the first value; `adjust=True` divides by the summed weights.

    A NULL has no weight, ages the values before it, and repeats the last
    average.  With `adjust=False` a value x that comes d rows after the value
    before it gives (q^d y + alpha x) / (q^d + alpha): the divisor is 1 unless
    rows are missing, and the product of all divisors is carried as a running
    sum of logarithms (`_age`).
    """
    seg_w = Window.partitionBy(*s.keys, "_seg").orderBy(s.time)
    inside = seg_w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*s.keys, "_seg")
    by_seg = Window.partitionBy(*s.keys).orderBy("_seg")
    pos = F.row_number().over(s.w()) - 1
    s = s.with_columns({"_i": pos})
    s = s.with_columns({"_seg": F.floor(F.col("_i") / SEGMENT), "_j": (F.col("_i") % SEGMENT).cast("double")})
    inputs = sorted({col for col, _, _ in specs.values()})
    before = s.w().rowsBetween(Window.unboundedPreceding, -1)
    # rows since the value before; NULL at the first value
    s = s.with_columns({f"_gap_{c}": F.col("_i") - F.max(F.when(F.col(c).isNotNull(), F.col("_i"))).over(before) for c in inputs})

    ages = {n: (c, span) for n, (c, span, adjust) in specs.items() if not adjust}

    def divisor(c, span):
        a = alpha(span)
        # exactly 0 where no row is missing
        return F.when(F.col(c).isNotNull() & (F.col(f"_gap_{c}") > 1), F.ln(F.pow(F.lit(1.0 - a), F.col(f"_gap_{c}")) + a)).otherwise(F.lit(0.0))

    s = s.with_columns({f"{n}_step": divisor(c, span) for n, (c, span) in ages.items()})
    s = s.with_columns({f"{n}_age": F.sum(f"{n}_step").over(s.upto()) for n in ages})
    s = s.with_columns({f"{n}_age0": F.max(f"{n}_age").over(whole) for n in ages})

    sums: dict[str, tuple[Column, float, str | None]] = {}
    for name, (col, span, adjust) in specs.items():
        a = alpha(span)
        x = F.col(col)
        if adjust:
            sums[f"{name}_n"] = (x, 1.0 - a, None)
            sums[f"{name}_d"] = (F.when(x.isNotNull(), F.lit(1.0)), 1.0 - a, None)
        else:
            start = F.when(F.col(f"_gap_{col}").isNull(), F.lit(1.0)).otherwise(F.lit(a))
            early = F.col(f"{name}_age") - F.col(f"{name}_step") - F.col(f"{name}_age0")
            sums[f"{name}_n"] = (x * start * F.exp(early), 1.0 - a, name)
    s = s.with_columns({n: F.pow(F.lit(q), F.col("_j")) * F.sum(v * F.pow(F.lit(1.0 / q), F.col("_j"))).over(inside)
                        for n, (v, q, _) in sums.items()})
    s = s.with_columns({f"{name}_n": F.col(f"{name}_n") * F.exp(F.col(f"{name}_age0") - F.col(f"{name}_age")) for name in ages})

    def carried(n, q, aged):
        last = F.col("_j") == SEGMENT - 1
        back = math.ceil(FORGET / (-math.log(q) * SEGMENT))
        out, seen = F.coalesce(F.col(n), F.lit(0.0)), F.col(n).isNotNull()
        for m in range(1, back + 1):
            there = by_seg.rangeBetween(-m, -m)
            end = F.max(F.when(last, F.col(n))).over(there)
            old = end * F.lit(q ** ((m - 1) * SEGMENT)) * F.pow(F.lit(q), F.col("_j") + 1.0)
            if aged:
                old = old * F.exp(F.max(F.when(last, F.col(f"{aged}_age"))).over(there) - F.col(f"{aged}_age"))
            out, seen = out + F.coalesce(old, F.lit(0.0)), seen | end.isNotNull()
        return F.when(seen, out)

    s = s.with_columns({f"{n}_t": carried(n, q, aged) for n, (_, q, aged) in sums.items()})

    def average(name, col, adjust):
        y = F.col(f"{name}_n_t") / F.col(f"{name}_d_t") if adjust else F.col(f"{name}_n_t")
        return F.last(F.when(F.col(col).isNotNull(), y), ignorenulls=True).over(s.upto())

    s = s.with_columns({name: average(name, col, adjust) for name, (col, _, adjust) in specs.items()})
    drop = ["_i", "_seg", "_j"] + [f"_gap_{c}" for c in inputs] + [f"{n}_{x}" for n in ages for x in ("step", "age", "age0")]
    drop += [c for n in sums for c in (n, f"{n}_t")]
    return Series(s.df.drop(*drop), s.keys, s.time, s.chunked)
