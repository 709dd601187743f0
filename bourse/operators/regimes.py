"""Market regimes: a three-state Gaussian hidden Markov model over bars.

One sequence per ticker.  The expectation step runs on runs of bars and returns sums; the sums are added up by
Spark, and only the 48 numbers of the model travel between the driver and the tasks.  Products of the
steps of short pieces carry what is known before and after a piece, so all pieces are stepped together, and
a long series is spread over many tasks.  The best path is found by scans over rows (`decode`).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.columns import total
from bourse.operators.aggregates import exact_quantile_lists
from bourse.operators.scan import scanned
from bourse.operators.series import is_daily, with_position
from bourse.operators.windows import returns_and_range

FEATURES = ["ret", "range", "volume"]
# fixed value: names by rising mean return
REGIMES = ["Bearish", "Neutral", "Bullish"]
K, D = 3, 3
#: rows that are worked on together, of a run of a long series, and of a piece that is stepped in one go
BUCKET_ROWS, RUN, PIECE = 200_000, 65_536, 32
#: stands for the logarithm of 0
LOWEST = -1e300


@dataclass
class Hmm:
    start: np.ndarray
    trans: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    converged: bool = False
    log_likelihood: float = float("nan")
    rounds: int = 0
    rows: int = 0
    history: list[float] = field(default_factory=list)

    @property
    def free_parameters(self) -> int:
        return (K - 1) + K * (K - 1) + K * D + K * D * (D + 1) // 2

    @property
    def bic(self) -> float:
        return -2 * self.log_likelihood + self.free_parameters * math.log(self.rows)

    @property
    def aic(self) -> float:
        return -2 * self.log_likelihood + 2 * self.free_parameters

    def labels(self) -> dict[int, str]:
        return {int(s): REGIMES[i] for i, s in enumerate(np.argsort(self.means[:, 0]))}


def features(bars: DataFrame) -> DataFrame:
    return returns_and_range(bars).select("ticker", "date", *FEATURES)


def _log_density(x: np.ndarray, m: Hmm) -> np.ndarray:
    out = np.empty((len(x), K))
    for k in range(K):
        chol = np.linalg.cholesky(m.covs[k])
        z = np.linalg.solve(chol, (x - m.means[k]).T)
        out[:, k] = -0.5 * (D * math.log(2 * math.pi) + (z * z).sum(axis=0)) - np.log(np.diag(chol)).sum()
    return out


@dataclass
class Sequences:
    """Runs of bars one after another: features [rows, D], lengths, and which of them start a series."""

    x: np.ndarray
    length: np.ndarray
    heads: np.ndarray

    def __post_init__(self):
        """Every run is laid out in pieces of PIECE rows: piece and place of every row, pieces of every run."""
        at = np.arange(self.length.sum()) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        self.pieces = -(-self.length // PIECE)
        self.first = np.cumsum(self.pieces) - self.pieces
        self.piece, self.place = np.repeat(self.first, self.length) + at // PIECE, at % PIECE
        self.on = np.zeros((int(self.pieces.sum()), PIECE), bool)
        self.on[self.piece, self.place] = True

    def laid(self, rows: np.ndarray, fill: float) -> np.ndarray:
        out = np.full((*self.on.shape, rows.shape[1]), fill)
        out[self.piece, self.place] = rows
        return out


def _weights(seq: Sequences, m: Hmm) -> tuple[np.ndarray, np.ndarray]:
    """(densities [pieces, PIECE, K] over the highest of their row, those highest logarithms)"""
    logb = _log_density(seq.x, m)
    top = logb.max(axis=1, keepdims=True)
    return seq.laid(np.exp(logb - top), 1.0), top[:, 0]


def products(seq: Sequences, m: Hmm, b: np.ndarray | None = None) -> np.ndarray:
    """[pieces, K, K]: the product of a piece's steps (move, then weigh the bar), each scaled to a sum of 1.

    The first step of a series moves from anywhere to its starting state.
    """
    b = _weights(seq, m)[0] if b is None else b
    out = np.broadcast_to(np.eye(K), (len(b), K, K))
    starts = np.zeros(len(b), bool)
    starts[seq.first[seq.heads]] = True
    for t in range(PIECE):
        moved = np.where(starts[:, None, None], out.sum(2, keepdims=True) * m.start, out @ m.trans) if t == 0 else out @ m.trans
        step = moved * b[:, t, None, :]
        out = np.where(seq.on[:, t, None, None], step / step.sum((1, 2), keepdims=True), out)
    return out


def run_products(seq: Sequences, m: Hmm) -> np.ndarray:
    """[runs, K, K]: the product of all pieces of each run."""
    own, out = products(seq, m), np.broadcast_to(np.eye(K), (len(seq.length), K, K))
    for c in range(int(seq.pieces.max(initial=0))):
        live = np.flatnonzero(c < seq.pieces)
        step = out[live] @ own[seq.first[live] + c]
        out = out.copy()
        out[live] = step / step.sum((1, 2), keepdims=True)
    return out


def forward_backward(seq: Sequences, m: Hmm, entry: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, state weights per row, summed transition weights.

    `entry` holds the weights of the state before each run that starts no series, `leave` the likelihood of
    what follows by the state at its end.  Products of pieces carry both over a run; then all pieces step together.
    """
    b, top = _weights(seq, m)
    runs, n = len(seq.length), len(b)
    own = products(seq, m, b)
    enters, leaves = np.full((n, K), 1.0 / K), np.ones((n, K))
    ahead = np.full((runs, K), 1.0 / K) if entry is None else entry / entry.sum(1, keepdims=True)
    behind = np.ones((runs, K)) if leave is None else leave / leave.sum(1, keepdims=True)
    most = int(seq.pieces.max(initial=0))
    for c in range(most):
        live = np.flatnonzero(c < seq.pieces)
        at = seq.first[live] + c
        enters[at] = ahead[live]
        step = np.einsum("nj,njk->nk", ahead[live], own[at])
        ahead[live] = step / step.sum(1, keepdims=True)
    for c in range(most - 1, -1, -1):
        live = np.flatnonzero(c < seq.pieces)
        at = seq.first[live] + c
        leaves[at] = behind[live]
        step = np.einsum("njk,nk->nj", own[at], behind[live])
        behind[live] = step / step.sum(1, keepdims=True)
    starts = np.zeros(n, bool)
    starts[seq.first[seq.heads]] = True
    alpha, before, scale = np.zeros((n, PIECE, K)), np.zeros((n, PIECE, K)), np.ones((n, PIECE))
    a = enters
    for t in range(PIECE):
        before[:, t] = a
        moved = np.where(starts[:, None], m.start, a @ m.trans) if t == 0 else a @ m.trans
        step = moved * b[:, t]
        total = step.sum(1)
        live = seq.on[:, t]
        scale[:, t] = np.where(live, total, 1.0)
        a = np.where(live[:, None], step / total[:, None], a)
        alpha[:, t] = a
    g, xi, beta = np.zeros((n, PIECE, K)), np.zeros((K, K)), leaves
    for t in range(PIECE - 1, -1, -1):
        live = seq.on[:, t]
        own_g = alpha[:, t] * beta
        g[:, t] = own_g / own_g.sum(1, keepdims=True)
        w = b[:, t] * beta
        back = w @ m.trans.T
        moves = live & ~starts if t == 0 else live
        total = (before[:, t] * back).sum(1)
        xi += m.trans * ((before[:, t] / total[:, None])[moves].T @ w[moves])
        beta = np.where(live[:, None], back / back.sum(1, keepdims=True), beta)
    return float(np.log(scale[seq.on]).sum() + top.sum()), g[seq.piece, seq.place], xi


def _packed(feats: DataFrame, shift: np.ndarray, scale: np.ndarray, rows: int) -> DataFrame:
    """(ticker, run, head, x): scaled features of a run of bars in order, one after another.

    A daily series is one run.  Longer ones are cut into runs of RUN rows, which go to tasks of their own.
    """
    long = not is_daily(feats, "date")
    if long:
        feats = with_position(feats).withColumn("run", F.floor(F.col("_pos") / RUN))
    else:
        feats = feats.withColumn("run", F.lit(0).cast("bigint"))
    x = F.array(*[(F.col(c).cast("double") - float(shift[i])) / float(scale[i]) for i, c in enumerate(FEATURES)])
    n = max(feats.sparkSession.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))
    g = feats.repartition(n, "ticker", "run").groupBy("ticker", "run").agg(F.array_sort(F.collect_list(F.struct("date", x.alias("x")))).alias("bars"))
    return g.select("ticker", "run", (F.col("run") == 0).alias("head"), F.flatten(F.transform("bars", lambda v: v["x"])).alias("x"))


def _sequences(batch: pa.RecordBatch) -> Sequences:
    x = batch.column("x")
    return Sequences(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, D), np.diff(x.offsets.to_numpy()) // D,
                     batch.column("head").to_numpy(zero_copy_only=False))


def _carried(packed: DataFrame, m: Hmm) -> DataFrame:
    """(ticker, run, entry, leave): what `forward_backward` needs of the runs before and after each run."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                own = run_products(_sequences(b), m).reshape(-1, K * K)
                yield pa.RecordBatch.from_arrays([b.column("ticker"), b.column("run"), pa.array(own.tolist(), pa.list_(pa.float64()))], ["ticker", "run", "p"])

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row per RUN bars of a ticker."""
        pdf = pdf.sort_values("run", ignore_index=True)
        p = np.stack(pdf["p"].to_numpy()).reshape(-1, K, K)
        entry, leave = np.full((len(p), K), 1.0 / K), np.ones((len(p), K))
        for i in range(1, len(p)):
            step = entry[i - 1] @ p[i - 1]
            entry[i] = step / step.sum()
        for i in range(len(p) - 2, -1, -1):
            step = p[i + 1] @ leave[i + 1]
            leave[i] = step / step.sum()
        return pd.DataFrame({"ticker": pdf["ticker"], "run": pdf["run"], "entry": list(entry), "leave": list(leave)})

    return packed.mapInArrow(run, "ticker string, run bigint, p array<double>").groupBy("ticker").applyInPandas(
        carry, "ticker string, run bigint, entry array<double>, leave array<double>")


_STATS = ["loglik", "n", *[f"start{k}" for k in range(K)], *[f"w{k}" for k in range(K)],
          *[f"x{k}{i}" for k in range(K) for i in range(D)],
          *[f"xx{k}{i}{j}" for k in range(K) for i in range(D) for j in range(D)],
          *[f"t{k}{j}" for k in range(K) for j in range(K)]]


def _sums(seq: Sequences, m: Hmm, *sides: np.ndarray) -> list[float]:
    """Expected counts and moments of some runs, in the order of _STATS."""
    ll, g, xi = forward_backward(seq, m, *sides)
    first = g[(np.cumsum(seq.length) - seq.length)[seq.heads]].sum(axis=0)
    return [ll, float(len(seq.x)), *first, *g.sum(axis=0), *(g.T @ seq.x).ravel(),
            *np.einsum("tk,ti,tj->kij", g, seq.x, seq.x, optimize=True).ravel(), *xi.ravel()]


def _expectation(packed: DataFrame, m: Hmm, long: bool) -> dict[str, float]:
    """The sums over all tickers: one row per statistic."""
    def step(batches):
        for batch in batches:
            if batch.num_rows:
                sides = [np.stack(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("entry", "leave")] if long else []
                values = _sums(_sequences(batch), m, *sides)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values, pa.float64())], ["stat", "value"])

    rows = packed.join(_carried(packed, m), ["ticker", "run"]) if long else packed
    parts = rows.mapInArrow(step, "stat int, value double")
    return {_STATS[r["stat"]]: r["value"] for r in parts.groupBy("stat").agg(F.sum("value").alias("value")).collect()}


def _maximisation(s: dict[str, float], m: Hmm, floor: float) -> Hmm:
    get = lambda names, shape: np.array([s[c] for c in names]).reshape(shape)
    start = get([f"start{k}" for k in range(K)], K)
    w = get([f"w{k}" for k in range(K)], K)
    x = get([f"x{k}{i}" for k in range(K) for i in range(D)], (K, D))
    xx = get([f"xx{k}{i}{j}" for k in range(K) for i in range(D) for j in range(D)], (K, D, D))
    t = get([f"t{k}{j}" for k in range(K) for j in range(K)], (K, K))
    means = x / w[:, None]
    covs = xx / w[:, None, None] - np.einsum("ki,kj->kij", means, means)
    covs = covs + np.eye(D) * floor
    return Hmm(start / start.sum(), t / t.sum(axis=1, keepdims=True), means, covs, m.shift, m.scale)


def one_round(feats: DataFrame, m: Hmm, floor: float = 1e-6) -> Hmm:
    """The model after one round from `m`, with the log-likelihood under `m`."""
    packed = _packed(feats, m.shift, m.scale, feats.count())
    s = _expectation(packed, m, not is_daily(feats, "date"))
    out = _maximisation(s, m, floor)
    out.log_likelihood, out.rounds, out.rows, out.history = s["loglik"], 1, int(s["n"]), [s["loglik"]]
    return out


def _free(m: Hmm) -> np.ndarray:
    """The model as numbers without bounds: logarithms of probabilities, Cholesky factors with logarithms on the diagonal."""
    low = np.linalg.cholesky(m.covs)
    low[:, np.arange(D), np.arange(D)] = np.log(low[:, np.arange(D), np.arange(D)])
    return np.concatenate([np.log(np.maximum(m.start, 1e-300)), np.log(np.maximum(m.trans, 1e-300)).ravel(), m.means.ravel(), low.ravel()])


def _bound(v: np.ndarray, m: Hmm) -> Hmm:
    """The inverse of `_free`; probabilities are scaled to add up to 1."""
    start, trans, means, low = np.split(v, [K, K + K * K, K + K * K + K * D])
    start, trans = np.exp(start - start.max()), np.exp(trans.reshape(K, K) - trans.reshape(K, K).max(axis=1, keepdims=True))
    low = np.tril(low.reshape(K, D, D))
    low[:, np.arange(D), np.arange(D)] = np.exp(np.clip(low[:, np.arange(D), np.arange(D)], -50, 50))
    return Hmm(start / start.sum(), trans / trans.sum(axis=1, keepdims=True), means.reshape(K, D), low @ low.transpose(0, 2, 1), m.shift, m.scale)


#: how many times the last direction a leap may go at most
FARTHEST = 16.0


def _leap(a: Hmm, b: Hmm, c: Hmm, floor: float) -> Hmm:
    """Where three models, each one round after the last, are heading (squared extrapolation); the last one if that is no model."""
    x, y, z = _free(a), _free(b), _free(c)
    r, v = y - x, z - 2 * y + x
    if not v.any():
        return c
    length = -min(max(float(np.linalg.norm(r) / np.linalg.norm(v)), 1.0), FARTHEST)
    out = _bound(x - 2 * length * r + length * length * v, a)
    try:
        sound = np.isfinite(np.linalg.cholesky(out.covs)).all() and (np.linalg.eigvalsh(out.covs) > floor / 2).all()
    except np.linalg.LinAlgError:
        sound = False
    return out if sound else c


def _climb(sums: Callable[[Hmm], dict[str, float]], m: Hmm, max_rounds: int, tol: float, floor: float) -> Hmm:
    """Rounds from `m` until the likelihood rises by less than `tol`.

    Two rounds give a direction in which the third starts further on; a start that turns out less likely is taken back.
    """
    history: list[float] = []
    trail, safe, converged, rounds, rows = [m], None, False, 0, 0
    while rounds < max_rounds:
        s = sums(m)
        rounds, rows = rounds + 1, int(s["n"])
        if safe is not None and not (math.isfinite(s["loglik"]) and s["loglik"] >= history[-1]):
            m, safe, trail = safe, None, [safe]
            continue
        leapt, safe = safe is not None, None
        history.append(s["loglik"])
        if len(history) > 1 and not leapt and history[-1] - history[-2] < tol:
            converged = True
            break
        m = _maximisation(s, m, floor)
        trail.append(m)
        if len(trail) == 3:
            leap = _leap(*trail, floor)
            safe, m = (m, leap) if leap is not m else (None, m)
            trail = [m]
    if safe is not None:
        m = safe  # a last leap that no round has tried
    m.converged, m.log_likelihood, m.rounds, m.rows, m.history = converged, history[-1], rounds, rows, history
    return m


_PARTS = ("start", "trans", "means", "covs")


def _climb_in_one_task(packed: DataFrame, *options) -> Hmm:
    """All rounds in one task, for a table that is no larger than what tasks work on at a time."""
    m = options[0]

    def run(batches):
        table = pa.Table.from_batches(batches)
        seq = _sequences(table.combine_chunks().to_batches()[0])
        got = _climb(lambda own: dict(zip(_STATS, _sums(seq, own), strict=True)), *options)
        yield pa.RecordBatch.from_pylist([{"converged": got.converged, "rounds": got.rounds, "history": got.history, **{n: getattr(got, n).ravel().tolist() for n in _PARTS}}])

    r = packed.coalesce(1).mapInArrow(run, "converged boolean, rounds bigint, history array<double>, " + ", ".join(f"{n} array<double>" for n in _PARTS)).first()
    start, trans, means, covs = (np.array(r[n]).reshape(getattr(m, n).shape) for n in _PARTS)
    return Hmm(start, trans, means, covs, m.shift, m.scale, r["converged"], r["history"][-1], r["rounds"], 0, list(r["history"]))


def fit(feats: DataFrame, max_rounds: int = 100, tol: float = 1e-2, floor: float = 1e-6) -> Hmm:
    """Expectation-maximisation from a deterministic start (terciles of the return).

    The features are kept for the passes of the start (lost blocks are recomputed).  Runs of bars are packed
    once and kept, so a round moves no bars but sums.  A daily table of up to BUCKET_ROWS bars is what one
    task works on anyway and spends all its rounds there.
    """
    feats = feats.select("ticker", "date", *FEATURES).persist()
    try:
        return _fitted(feats, max_rounds, tol, floor)
    finally:
        feats.unpersist()


def _fitted(feats: DataFrame, max_rounds: int, tol: float, floor: float) -> Hmm:
    stats = feats.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in FEATURES for n, f in
                      (("avg", F.avg), ("sd", F.stddev_pop))]).first()
    shift = np.array([stats[f"avg_{c}"] for c in FEATURES])
    scale = np.array([stats[f"sd_{c}"] or 1.0 for c in FEATURES])
    low, high = exact_quantile_lists(feats, ["ret"], [1 / 3, 2 / 3])["ret"]
    z = [(F.col(c) - float(shift[i])) / float(scale[i]) for i, c in enumerate(FEATURES)]
    state = F.when(F.col("ret") <= low, 0).when(F.col("ret") <= high, 1).otherwise(2)
    rows = {r["s"]: r for r in feats.groupBy(state.alias("s")).agg(
        *[F.avg(z[i]).alias(f"m{i}") for i in range(D)],
        *[F.covar_pop(z[i], z[j]).alias(f"c{i}{j}") for i in range(D) for j in range(D)]).collect()}
    means = np.array([[rows[k][f"m{i}"] for i in range(D)] for k in range(K)])
    covs = np.array([[[rows[k][f"c{i}{j}"] for j in range(D)] for i in range(D)] for k in range(K)]) + np.eye(D) * floor
    long = not is_daily(feats, "date")
    packed = _packed(feats, shift, scale, stats["n"])
    first = Hmm(np.full(K, 1 / K), np.full((K, K), 0.1) + np.eye(K) * 0.7, means, covs, shift, scale)
    if stats["n"] <= BUCKET_ROWS and not long:
        m = _climb_in_one_task(packed, first, max_rounds, tol, floor)
        m.rows = stats["n"]
        return m
    packed = packed.persist()
    try:
        return _climb(lambda own: _expectation(packed, own, long), first, max_rounds, tol, floor)
    finally:
        packed.unpersist()


def model_table(spark, m: Hmm) -> DataFrame:
    """The fitted model as rows: one per state, with the fit measures."""
    names = m.labels()
    raw = m.means * m.scale + m.shift
    rows = [(k, names[k], *map(float, raw[k]), *map(float, m.trans[k]), m.converged,
             float(m.log_likelihood), float(m.bic), float(m.aic), m.rounds) for k in range(K)]
    return spark.createDataFrame(rows, "state int, regime string, mean_return double, mean_range double, "
                                       "mean_volume double, to_0 double, to_1 double, to_2 double, converged boolean, "
                                       "log_likelihood double, bic double, aic double, rounds int")


def parameter_table(spark, m: Hmm) -> DataFrame:
    """All parameters in the units of the features, one row per state, and the log-likelihood they were estimated at."""
    means, covs = m.means * m.scale + m.shift, m.covs * np.outer(m.scale, m.scale)
    rows = [(k, float(m.start[k]), *map(float, m.trans[k]), *map(float, means[k]), *[float(covs[k, i, j]) for i in range(D) for j in range(i + 1)],
             float(m.log_likelihood)) for k in range(K)]
    names = ["start", *[f"to_{k}" for k in range(K)], *[f"mean_{c}" for c in FEATURES], *[f"cov_{FEATURES[i]}_{FEATURES[j]}" for i in range(D) for j in range(i + 1)]]
    return spark.createDataFrame(rows, "state int, " + ", ".join(f"{n} double" for n in names) + ", log_likelihood double")


def save_model(spark, m: Hmm, path: str, fmt: str = "parquet") -> None:
    """All parameters as a table: one row per state."""
    rows = [(k, float(m.start[k]), *([float(v) for v in a] for a in (m.trans[k], m.means[k], m.covs[k].ravel(), m.shift, m.scale))) for k in range(K)]
    kinds = ", ".join(f"{c} array<double>" for c in ("trans", "mean", "cov", "shift", "scale"))
    spark.createDataFrame(rows, f"state int, start double, {kinds}").coalesce(1).write.mode("errorifexists").format(fmt).save(path)


def load_model(spark, path: str, fmt: str = "parquet") -> Hmm:
    """A model stored by `save_model` (three rows)."""
    rows = sorted(spark.read.format(fmt).load(path).collect(), key=lambda r: r["state"])
    get = lambda c: np.array([r[c] for r in rows])
    return Hmm(get("start"), get("trans"), get("mean"), get("cov").reshape(K, D, D), np.array(rows[0]["shift"]), np.array(rows[0]["scale"]))


def _log_densities(m: Hmm) -> list[Column]:
    """The log densities of a bar by state; a bar with a missing feature fits all states alike."""
    x = [(F.col(c).cast("double") - float(m.shift[i])) / float(m.scale[i]) for i, c in enumerate(FEATURES)]
    out = []
    for k in range(K):
        chol = np.linalg.cholesky(m.covs[k])
        inv = np.linalg.inv(chol)
        z = [total([(x[j] - float(m.means[k][j])) * float(inv[i, j]) for j in range(i + 1)]) for i in range(D)]
        constant = -0.5 * D * math.log(2 * math.pi) - float(np.log(np.diag(chol)).sum())
        out.append(F.coalesce(total([v * v for v in z]) * -0.5 + constant, F.lit(0.0)))
    return out


def _highest(values: list[Column]) -> Column:
    """Index of the highest of three values, the first of equal ones."""
    a, b, c = values
    return F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2)


def _best_ways(first: dict, then: dict) -> dict:
    """Best log weight from state j before to state k after two stretches of bars."""
    return {f"_v{j}{k}": F.greatest(*[first[f"_v{j}{i}"] + then[f"_v{i}{k}"] for i in range(K)]) for j in range(K) for k in range(K)}


def _back_through(first: dict, then: dict) -> dict:
    """Look-ups one after the other: the later bar's answer is looked up in the earlier bar's table."""
    return {f"_f{k}": F.when(first[f"_f{k}"] == 0, then["_f0"]).when(first[f"_f{k}"] == 1, then["_f1"]).otherwise(then["_f2"]) for k in range(K)}


def _with_ends(df: DataFrame) -> DataFrame:
    """Mark the first and the last bar of every ticker."""
    if is_daily(df, "date"):
        w = Window.partitionBy("ticker").orderBy("date")
        return df.withColumns({"_first": F.lag("date").over(w).isNull(), "_last": F.lead("date").over(w).isNull()})
    ends = df.groupBy("ticker").agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    return df.join(ends, "ticker").withColumns({"_first": F.col("date") == F.col("_from"), "_last": F.col("date") == F.col("_to")}).drop("_from", "_to")


def decode(feats: DataFrame, m: Hmm, chunk: int | None = None) -> DataFrame:
    """Most likely state path of each ticker, with the regime name, on series of any length.

    Forward, a bar is a matrix of log weights from state to state; the best path up to a bar is the product of
    all matrices up to it, with maximum for plus and plus for times.  Backward, a bar is a table that tells the
    best state before each state of the next bar; the path is the tables looked up one after the other.
    """
    with np.errstate(divide="ignore"):
        lt, ls = np.maximum(np.log(m.trans), LOWEST), np.maximum(np.log(m.start), LOWEST)
    ways = {f"_v{j}{k}": F.when(F.col("_first"), float(ls[k])).otherwise(float(lt[j, k])) + F.col(f"_d{k}") for j in range(K) for k in range(K)}
    identity = {f"_v{j}{k}": 0.0 if j == k else LOWEST for j in range(K) for k in range(K)}
    bars = _with_ends(feats.select("ticker", "date", *[d.alias(f"_d{k}") for k, d in enumerate(_log_densities(m))]))
    best = scanned(bars, ways, _best_ways, identity, chunk=chunk)
    ended = _highest([F.col(f"_v0{j}") for j in range(K)])
    tables = {f"_f{k}": F.when(F.col("_last"), ended).otherwise(_highest([F.col(f"_v0{j}") + float(lt[j, k]) for j in range(K)])) for k in range(K)}
    path = scanned(best.select("ticker", "date", "_last", *[f"_v0{j}" for j in range(K)]), tables, _back_through,
                   {f"_f{k}": k for k in range(K)}, reverse=True, chunk=chunk)
    names = m.labels()
    name = F.element_at(F.array(*[F.lit(names[k]) for k in range(K)]), F.col("_f0") + 1)
    return path.select("ticker", "date", F.col("_f0").alias("state"), name.alias("regime"))


def state_names(states: DataFrame) -> DataFrame:
    """(state, regime) by rising mean return of the states."""
    means = states.groupBy("state").agg(F.avg("ret").alias("mean_return"))
    order = F.row_number().over(Window.orderBy("mean_return", "state"))  # one row per state
    return means.select("state", "mean_return", F.element_at(F.array(*[F.lit(r) for r in REGIMES]), order).alias("regime"))


def label(states: DataFrame) -> DataFrame:
    """Rows with the name of their state; the name table has one row per state."""
    return states.join(F.broadcast(state_names(states).select("state", "regime")), "state")


def summary(labelled: DataFrame) -> DataFrame:
    """Per ticker and regime: rows, mean return, price range."""
    return labelled.groupBy("ticker", "regime").agg(
        F.count(F.lit(1)).alias("bars"), F.avg("ret").alias("mean_return"),
        F.min("close").alias("low_close"), F.max("close").alias("high_close"))
