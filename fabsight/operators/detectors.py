"""Multivariate detectors: distributed sufficient statistics, small algebra on the driver, vectorized scoring.

Models are per process type. What reaches the driver has a size fixed by channels and window length:
30 x 30 for components, 9 x 9 for the autoregression, 37 x 37 (+ targets) for conditional reconstruction.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from fabsight import constants as K
from fabsight.operators.scoring import limit_quantile
from fabsight.operators.windows import ALL_FEATURES, CHANNEL_FEATURES, feature_matrix
from fabsight.plans.series import exact_quantiles
from fabsight.session import durable

C = len(K.CHANNELS)


def standardize_fit(df: DataFrame, cols: Sequence[str] = ALL_FEATURES, key: str = "process_type") -> DataFrame:
    """Mean and population standard deviation per feature (zero deviation becomes 1)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    wide = df.groupBy(key).agg(*aggs)
    scale = [F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in cols]
    return wide.select(key, "n", F.array(*[F.col(f"m_{c}") for c in cols]).alias("mean"), F.array(*scale).alias("scale"))


def gram_matrices(df: DataFrame, key: str, columns: Sequence[str], build: Callable[[str, pd.DataFrame], np.ndarray],
                  width: int) -> DataFrame:
    """(key, i, value): flattened ``M'M`` of the rows ``build`` makes; each task sums its own part first."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for k, part in pdf.groupby(key):
                m = build(k, part)
                sums[k] = sums.get(k, 0.0) + m.T @ m
        for k, g in sums.items():
            yield pd.DataFrame({key: [k] * (width * width), "i": np.arange(width * width), "value": g.ravel()})

    parts = df.select(key, *columns).mapInPandas(partial, f"{key} string, i long, value double")
    return parts.groupBy(key, "i").agg(F.sum("value").alias("value"))


def to_matrices(grams: DataFrame, key: str, width: int) -> dict[str, np.ndarray]:
    """Bounded collect: width x width numbers per process type."""
    out: dict[str, np.ndarray] = {}
    for r in grams.collect():
        out.setdefault(r[key], np.zeros(width * width))[r["i"]] = r["value"]
    return {k: v.reshape(width, width) for k, v in out.items()}


def tensor(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["x"].to_numpy()).reshape(len(pdf), -1, C)


def window_feature_matrix(x: np.ndarray) -> np.ndarray:
    """The columns ALL_FEATURES of windows (n, window, channels), as ``window_features`` defines them."""
    return feature_matrix(x)


@dataclass
class PcaState:
    process_type: str
    features: list
    mean: list
    scale: list
    components: list
    center: list
    variance: list
    t2_limit: float
    spe_limit: float
    train_rows: int
    quantile: float


@dataclass
class VarState:
    process_type: str
    lag: int
    coef: list
    whitening: list
    limit: float
    train_rows: int


@dataclass
class ReconState:
    process_type: str
    mean: list
    std: list
    weights: list
    limit: float


def states_to_df(spark: SparkSession, states: Sequence) -> DataFrame:
    """Model table: one row per process type, parameters as JSON text."""
    rows = [(type(s).__name__, s.process_type, json.dumps(asdict(s))) for s in states]
    return spark.createDataFrame(rows, "kind string, process_type string, state string")


def states_from_df(df: DataFrame) -> list:
    kinds = {c.__name__: c for c in (PcaState, VarState, ReconState)}
    return [kinds[r["kind"]](**json.loads(r["state"])) for r in df.collect()]  # one row per process type


# ---- principal components ----------------------------------------------------------------------

def covariance_gram(features: DataFrame, scaler: dict, cols: Sequence[str] = ALL_FEATURES) -> DataFrame:
    """Second moments of the standardized features (and a constant) per process type."""
    def build(k, part):
        mean, scale = scaler[k]
        z = (part[list(cols)].to_numpy(float) - mean) / scale
        return np.hstack([z, np.ones((len(z), 1))])
    return gram_matrices(features, "process_type", list(cols), build, len(cols) + 1)


def scaler_of(features: DataFrame, cols: Sequence[str] = ALL_FEATURES) -> dict:
    return {r["process_type"]: (np.array(r["mean"]), np.array(r["scale"])) for r in standardize_fit(features, cols).collect()}


def keep_components(values: np.ndarray, share: float) -> int:
    ratio = np.cumsum(values) / values.sum()
    return min(len(values), int(np.searchsorted(ratio, share, side="right")) + 1)


def spectrum(gram: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, center, and variances with components by falling variance, of a Gram matrix with its constant."""
    n = gram[-1, -1]
    center = gram[-1, :-1] / n
    values, vectors = np.linalg.eigh((gram[:-1, :-1] - n * np.outer(center, center)) / (n - 1))
    order = np.argsort(values)[::-1]
    return n, center, np.clip(values[order], 0, None), vectors[:, order].T


def pca_fit(features: DataFrame, share: float = K.PCA_VARIANCE, quantile: float = K.LIMIT_QUANTILE,
            cols: Sequence[str] = ALL_FEATURES) -> list[PcaState]:
    cols = list(cols)
    scaler = scaler_of(features, cols)
    grams = to_matrices(covariance_gram(features, scaler, cols), "process_type", len(cols) + 1)
    drafts = []
    for p, g in sorted(grams.items()):
        n, center, values, vectors = spectrum(g)
        k = keep_components(values, share)
        if share >= 1.0:
            k = int((values > 1e-10).sum())
        comp = vectors[:k]
        comp = comp * np.sign(comp[np.arange(k), np.abs(comp).argmax(axis=1)])[:, None]
        mean, scale = scaler[p]
        drafts.append(PcaState(p, cols, mean.tolist(), scale.tolist(), comp.tolist(), center.tolist(), values[:k].tolist(),
                               1.0, 1.0, int(round(n)), quantile))
    stats = durable(pca_statistics(features, drafts).select("process_type", "t2", "spe"))
    t2 = {r["process_type"]: r["q"] for r in exact_quantiles(stats, ["process_type"], "t2", {"q": quantile}).collect()}
    spe = {r["process_type"]: r["q"] for r in exact_quantiles(stats, ["process_type"], "spe", {"q": quantile}).collect()}
    for s in drafts:
        s.t2_limit, s.spe_limit = max(t2[s.process_type], 1e-12), max(spe[s.process_type], 1e-12)
    return drafts


def feature_channels(cols: Sequence[str]) -> np.ndarray:
    """0/1 matrix of features by channels: a feature belongs to every channel that its name ends with or pairs."""
    names = [c.split("_", 1)[1].split("__") for c in cols]
    return np.array([[float(ch in n) for ch in K.CHANNELS] for n in names])


def pca_statistics(features: DataFrame, states: Sequence[PcaState]) -> DataFrame:
    """T2, SPE, squared norm of the centered row, and the channel of the largest residual, per window."""
    params = {s.process_type: (np.array(s.mean), np.array(s.scale), np.array(s.components), np.array(s.center), np.array(s.variance))
              for s in states}
    cols = list(states[0].features)
    base = ["equipment_id", "process_type", "win"]
    share = feature_channels(cols)

    def run(batches):
        for pdf in batches:
            for p, part in pdf.groupby("process_type"):
                if p not in params:
                    continue
                mean, scale, comp, center, var = params[p]
                z = (part[cols].to_numpy(float) - mean) / scale - center
                proj = z @ comp.T
                resid = (z - proj @ comp) ** 2
                yield pd.DataFrame({
                    "equipment_id": part["equipment_id"], "process_type": part["process_type"], "win": part["win"],
                    "t2": (proj ** 2 / var).sum(axis=1), "spe": resid.sum(axis=1), "norm": (z ** 2).sum(axis=1),
                    "channel": np.array(K.CHANNELS)[(resid @ share).argmax(axis=1)]})

    return features.select(*base, *cols).mapInPandas(
        run, "equipment_id string, process_type string, win long, t2 double, spe double, norm double, channel string")


def pca_score(features: DataFrame, states: Sequence[PcaState], statistic: str = "both") -> DataFrame:
    limits = _by_process({s.process_type: (s.t2_limit, s.spe_limit) for s in states})
    t2, spe = F.col("t2") / limits[0], F.col("spe") / limits[1]
    pick = {"both": F.greatest(t2, spe), "t2": t2, "spe": spe}[statistic]
    return pca_statistics(features, states).select("equipment_id", "process_type", "win", pick.alias("raw"), "channel")


def _by_process(values: dict[str, tuple]) -> list[Column]:
    """One column per tuple position: the constant of the row's process type (NULL when it has none)."""
    n = len(next(iter(values.values())))
    out = []
    for i in range(n):
        expr = F.lit(None).cast("double")
        for p, v in values.items():
            expr = F.when(F.col("process_type") == p, F.lit(float(v[i]))).otherwise(expr)
        out.append(expr)
    return out


# ---- many kept variances at once ---------------------------------------------------------------

@dataclass
class PcaBasis:
    """The components of a process type by falling variance; a model that keeps less variance has the first of them."""

    process_type: str
    features: list
    mean: list
    scale: list
    center: list
    components: list
    variance: list

    def kept(self, share: float) -> int:
        return keep_components(np.array(self.variance), share)


def pca_bases(features: DataFrame, cols: Sequence[str] = ALL_FEATURES) -> list[PcaBasis]:
    """One pass for the Gram matrices; whatever share of the variance is kept later, they are not made again."""
    cols = list(cols)
    scaler = scaler_of(features, cols)
    out = []
    for p, g in sorted(to_matrices(covariance_gram(features, scaler, cols), "process_type", len(cols) + 1).items()):
        _, center, values, vectors = spectrum(g)
        some = values > 1e-10
        out.append(PcaBasis(p, cols, scaler[p][0].tolist(), scaler[p][1].tolist(), center.tolist(), vectors[some].tolist(), values[some].tolist()))
    return out


def nested_statistics(features: DataFrame, bases: Sequence[PcaBasis], shares: Sequence[float], limits: dict | None = None, margin: float = 1e-9) -> DataFrame:
    """(process_type, t2_<share>, spe_<share>): a window is projected once, running sums give the models of all shares.

    With ``limits``, per process type those of (t2 or spe, share, quantile): (equipment_id, win, share, quantile) of the windows beyond.
    """
    params = {b.process_type: (np.array(b.mean), np.array(b.scale), np.array(b.center), np.array(b.components), np.array(b.variance),
                               np.array([b.kept(x) for x in shares]) - 1) for b in bases}
    cols, n = list(bases[0].features), len(shares)
    head = ["process_type"] if limits is None else ["process_type", "equipment_id", "win"]

    def run(batches):
        for b in batches:
            codes = b.column(0).dictionary_encode()
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[len(head):]], axis=1)
            for i, p in enumerate(codes.dictionary.to_pylist()):
                at = pc.indices_nonzero(pc.equal(codes.indices, i))
                if p not in params or limits is not None and p not in limits:
                    continue
                mean, scale, center, comp, var, last = params[p]
                z = (x[at.to_numpy()] - mean) / scale - center
                squares = (z @ comp.T) ** 2
                t2, spe = np.cumsum(squares / var, axis=1)[:, last], (z ** 2).sum(axis=1)[:, None] - np.cumsum(squares, axis=1)[:, last]
                if limits is None:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), *[pa.array(v, from_pandas=True) for v in (*t2.T.copy(), *spe.T.copy())]], names=names)
                    continue
                row, share, quantile = np.nonzero(np.maximum(t2[:, :, None] / limits[p][0], spe[:, :, None] / limits[p][1]) > 1 + margin)
                mine = at.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([b.column(1).take(mine), b.column(2).take(mine), pa.array(share.astype(np.int32)), pa.array(quantile.astype(np.int32))],
                                                 names=["equipment_id", "win", "share", "quantile"])

    names = ["process_type", *[f"{s}_{j}" for s in ("t2", "spe") for j in range(n)]]
    kind = ", ".join(["process_type string", *[f"{c} double" for c in names[1:]]]) if limits is None else "equipment_id string, win long, share int, quantile int"
    return features.select(*head, *cols).mapInArrow(run, kind)


def grid_fired(fit: DataFrame, scored: DataFrame, bases: Sequence[PcaBasis], shares: Sequence[float], quantiles: Sequence[float],
               margin: float = 1e-9) -> DataFrame:
    """(equipment_id, win, share, quantile): windows of ``scored`` beyond the limits that the windows of ``fit`` give.

    ``share`` and ``quantile`` are places in the two lists.  Limits of all shares and quantiles are a few numbers per process type.
    """
    own, n = durable(nested_statistics(fit, bases, shares)), len(shares)
    limits: dict[str, np.ndarray] = {}
    for i, stat in enumerate(("t2", "spe")):
        each = own.select("process_type", F.posexplode(F.array(*[f"{stat}_{j}" for j in range(n)])).alias("share", "value"))
        for r in exact_quantiles(each, ["process_type", "share"], "value", {f"q{k}": q for k, q in enumerate(quantiles)}).collect():
            limits.setdefault(r["process_type"], np.full((2, n, len(quantiles)), 1e-12))[i, r["share"]] = np.fmax(np.array([r[f"q{k}"] for k in range(len(quantiles))], dtype=float), 1e-12)
    return nested_statistics(scored, bases, shares, limits, margin)


# ---- vector autoregression ---------------------------------------------------------------------

def _design(x: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    n, w, _ = x.shape
    past = np.stack([x[:, i - lag:i, :].reshape(n, -1) for i in range(lag, w)], axis=1)
    bias = np.ones((*past.shape[:2], 1))
    return np.concatenate([past, bias], axis=2), x[:, lag:, :]


def var_fit(windows: DataFrame, lag: int = K.VAR_LAG, quantile: float = K.LIMIT_QUANTILE, ridge: float = K.VAR_RIDGE) -> list[VarState]:
    """Ridge least squares on the lags inside each window; residual covariance follows from the same sums."""
    p = lag * C + 1

    def build(_, part):
        d, y = _design(tensor(part), lag)
        return np.hstack([d.reshape(-1, p), y.reshape(-1, C)])

    drafts = []
    for ptype, g in sorted(to_matrices(gram_matrices(windows, "process_type", ["x"], build, p + C), "process_type", p + C).items()):
        xx, xy, yy, n = g[:p, :p], g[:p, p:], g[p:, p:], g[p - 1, p - 1]
        coef = np.linalg.solve(xx + ridge * np.eye(p), xy)
        rr = yy - coef.T @ xy - xy.T @ coef + coef.T @ xx @ coef
        total = g[p - 1, p:] - xx[p - 1] @ coef
        cov = (rr - np.outer(total, total) / n) / (n - 1) + ridge * np.eye(C)
        rows = int(round(n)) // (K.WINDOW - lag)
        drafts.append(VarState(ptype, lag, coef.T.tolist(), np.linalg.inv(np.linalg.cholesky(cov)).tolist(), 1.0, rows))
    stats = var_statistics(windows, drafts)
    q = {r["process_type"]: r["limit"] for r in limit_quantile(stats, ["process_type"], "stat", quantile).collect()}
    for s in drafts:
        s.limit = q[s.process_type]
    return drafts


def whitened_distance(residual: np.ndarray, whitening: np.ndarray) -> np.ndarray:
    """Squared length of residuals of unit covariance: the inverse Cholesky factor of the covariance makes them so."""
    return ((residual @ whitening.T) ** 2).sum(axis=-1)


def var_statistics(windows: DataFrame, states: Sequence[VarState]) -> DataFrame:
    params = {s.process_type: (s.lag, np.array(s.coef), np.array(s.whitening)) for s in states}

    def run(batches):
        for pdf in batches:
            for p, part in pdf.groupby("process_type"):
                if p not in params:
                    continue
                lag, coef, whitening = params[p]
                d, y = _design(tensor(part), lag)
                r = y - d @ coef.T
                yield pd.DataFrame({
                    "equipment_id": part["equipment_id"], "process_type": part["process_type"], "win": part["win"],
                    "stat": whitened_distance(r, whitening).mean(axis=1),
                    "mean_residual": r.mean(axis=(1, 2)), "channel": np.array(K.CHANNELS)[np.abs(r).mean(axis=1).argmax(axis=1)]})

    return windows.select("equipment_id", "process_type", "win", "x").mapInPandas(
        run, "equipment_id string, process_type string, win long, stat double, mean_residual double, channel string")


def var_score(windows: DataFrame, states: Sequence[VarState]) -> DataFrame:
    limit = _by_process({s.process_type: (s.limit,) for s in states})[0]
    return var_statistics(windows, states).select("equipment_id", "process_type", "win", (F.col("stat") / limit).alias("raw"), "channel")


# ---- conditional reconstruction ----------------------------------------------------------------

def recon_fit(windows: DataFrame, quantile: float = K.LIMIT_QUANTILE, ridge: float = 1.0, width: int = K.WINDOW) -> list[ReconState]:
    """Each channel's window from the other channels' windows by ridge regression (all channels from one Gram matrix)."""
    size = width * C + 1
    raw = to_matrices(gram_matrices(windows, "process_type", ["x"], lambda _, part: np.hstack(
        [tensor(part).reshape(len(part), -1), np.ones((len(part), 1))]), size), "process_type", size)
    scale = {}
    for p, g in raw.items():
        n = g[-1, -1] * width
        mean = g[-1, :-1].reshape(width, C).sum(axis=0) / n
        square = np.diag(g)[:-1].reshape(width, C).sum(axis=0) / n
        scale[p] = (mean, np.sqrt(np.clip(square - mean ** 2, 0, None)) + 1e-9)

    def build(k, part):
        mean, std = scale[k]
        return np.hstack([((tensor(part) - mean) / std).reshape(len(part), -1), np.ones((len(part), 1))])

    drafts = []
    for p, g in sorted(to_matrices(gram_matrices(windows, "process_type", ["x"], build, size), "process_type", size).items()):
        # one matrix for all channels: a channel's own past has no weight in its columns
        channel = np.append(np.tile(np.arange(C), width), -1)
        weights = np.zeros((size, size - 1))
        for c in range(C):
            use, own = np.flatnonzero(channel != c), np.flatnonzero(channel == c)
            weights[np.ix_(use, own)] = np.linalg.solve(g[np.ix_(use, use)] + ridge * np.eye(len(use)), g[np.ix_(use, own)])
        drafts.append(ReconState(p, scale[p][0].tolist(), scale[p][1].tolist(), weights.tolist(), 1.0))
    stats = recon_statistics(windows, drafts)
    q = {r["process_type"]: r["limit"] for r in limit_quantile(stats, ["process_type"], "stat", quantile).collect()}
    for s in drafts:
        s.limit = q[s.process_type]
    return drafts


def recon_statistics(windows: DataFrame, states: Sequence[ReconState]) -> DataFrame:
    by_type = {s.process_type: s for s in states}

    def run(batches):
        for pdf in batches:
            for s, part in ((by_type[p], rows) for p, rows in pdf.groupby("process_type") if p in by_type):
                weights = np.array(s.weights)
                flat = ((tensor(part) - np.array(s.mean)) / np.array(s.std)).reshape(len(part), -1)
                gap = flat - flat @ weights[:-1] - weights[-1]
                by_channel = np.square(gap).reshape(len(part), -1, C).mean(axis=1)
                yield part[["equipment_id", "process_type", "win"]].assign(
                    stat=by_channel.sum(axis=1), channel=np.array(K.CHANNELS)[by_channel.argmax(axis=1)])

    return windows.select("equipment_id", "process_type", "win", "x").mapInPandas(
        run, "equipment_id string, process_type string, win long, stat double, channel string")


def recon_score(windows: DataFrame, states: Sequence[ReconState]) -> DataFrame:
    limit = _by_process({s.process_type: (s.limit,) for s in states})[0]
    return recon_statistics(windows, states).select("equipment_id", "process_type", "win", (F.col("stat") / limit).alias("raw"), "channel")


# ---- isolation forest --------------------------------------------------------------------------

def _path_length(n: np.ndarray | float):
    n = np.asarray(n, float)
    out = np.where(n > 2, 2.0 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2.0 * (n - 1) / np.maximum(n, 1), 0.0)
    return np.where(n == 2, 1.0, out)


def tree_samples(base: DataFrame, cols: Sequence[str], trees: int, sample: int) -> DataFrame:
    """(process_type, tree, _id, cols): for every tree the rows with the smallest hash of (tree, row), out of all rows.

    Each task keeps ``sample`` rows per process type and tree, so no more than that of a task is shuffled.
    """
    cols = list(cols)

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, list] = {}
        mixed = (np.arange(trees, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for pdf in batches:
            for p, part in pdf.groupby("process_type"):
                ident, x = part["_id"].to_numpy().astype(np.int64), part[cols].to_numpy(float)
                own = kept.setdefault(p, [None] * trees)
                for t in range(trees):
                    h = (ident.view(np.uint64) ^ mixed[t]) * np.uint64(0xD6E8FEB86659FD93)
                    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
                    h ^= h >> np.uint64(33)
                    i, rows = ident, x
                    if own[t] is not None:
                        h, i, rows = (np.concatenate([a, b]) for a, b in zip(own[t], (h, ident, x)))
                    near = np.lexsort((i, h))[:sample]
                    own[t] = (h[near], i[near], rows[near])
        for p, own in kept.items():
            for t, (h, i, rows) in enumerate(own):
                yield pd.DataFrame(rows, columns=cols).assign(process_type=p, tree=t, _h=h.view(np.int64) ^ np.int64(-2**63), _id=i)

    kind = "process_type string, tree int, _h long, _id long, " + ", ".join(f"`{c}` double" for c in cols)
    near = base.mapInPandas(lambda b: (f[["process_type", "tree", "_h", "_id", *cols]] for f in smallest(b)), kind)
    rn = F.row_number().over(W.partitionBy("process_type", "tree").orderBy("_h", "_id"))
    return near.withColumn("_k", rn).where(F.col("_k") <= sample)


def forest_fit(features: DataFrame, trees: int = 200, sample: int = 256, seed: int = 0, cols: Sequence[str] = ALL_FEATURES) -> dict:
    """Random trees, each grown in its own group on a sample of all rows of a process type."""
    cols = list(cols)
    scaler = scaler_of(features, cols)
    ident = F.xxhash64(F.lit(seed), F.col("equipment_id"), F.col("win"))
    base = features.select("process_type", *cols, ident.alias("_id"))
    chosen = tree_samples(base, cols, trees, sample)
    schema = "process_type string, tree int, n long, feature array<int>, threshold array<double>, left array<int>, right array<int>, size array<double>"

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        p, t = pdf["process_type"].iat[0], int(pdf["tree"].iat[0])
        mean, scale = scaler[p]
        x = (pdf.sort_values("_id")[cols].to_numpy(float) - mean) / scale
        rng = np.random.default_rng([seed, t])
        depth = int(np.ceil(np.log2(max(len(x), 2))))
        feature, threshold, left, right, size = [], [], [], [], []

        def node(rows, level):
            me = len(feature)
            for a, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (size, float(len(rows)))):
                a.append(v)
            spread = np.ptp(x[rows], axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
            open_cols = np.flatnonzero(spread > 0)
            if level >= depth or len(rows) <= 1 or not len(open_cols):
                return me
            f = int(rng.choice(open_cols))
            cut = float(rng.uniform(x[rows, f].min(), x[rows, f].max()))
            go = x[rows, f] <= cut
            feature[me], threshold[me] = f, cut
            left[me] = node(rows[go], level + 1)
            right[me] = node(rows[~go], level + 1)
            return me

        node(np.arange(len(x)), 0)
        return pd.DataFrame({"process_type": [p], "tree": [t], "n": [len(x)], "feature": [feature], "threshold": [threshold],
                             "left": [left], "right": [right], "size": [size]})

    forest: dict = {}
    for r in chosen.groupBy("process_type", "tree").applyInPandas(grow, schema).orderBy("process_type", "tree").collect():
        forest.setdefault(r["process_type"], []).append(
            (r["n"], np.array(r["feature"]), np.array(r["threshold"]), np.array(r["left"]), np.array(r["right"]), np.array(r["size"])))
    return {"scaler": scaler, "trees": forest, "cols": cols, "limits": {}}


def forest_statistics(features: DataFrame, model: dict) -> DataFrame:
    scaler, forest, cols = model["scaler"], model["trees"], model["cols"]

    def run(batches):
        for pdf in batches:
            for p, part in pdf.groupby("process_type"):
                if p not in forest:
                    continue
                mean, scale = scaler[p]
                x = (part[cols].to_numpy(float) - mean) / scale
                total = np.zeros(len(x))
                for n, feature, threshold, left, right, size in forest[p]:
                    at, depth = np.zeros(len(x), int), np.zeros(len(x))
                    live = feature[at] >= 0
                    while live.any():
                        i = np.flatnonzero(live)
                        f = feature[at[i]]
                        at[i] = np.where(x[i, f] <= threshold[at[i]], left[at[i]], right[at[i]])
                        depth[i] += 1
                        live = feature[at] >= 0
                    total += depth + _path_length(size[at])
                mean_depth = total / len(forest[p])
                base = float(_path_length(forest[p][0][0]))
                yield pd.DataFrame({"equipment_id": part["equipment_id"], "process_type": part["process_type"], "win": part["win"],
                                    "stat": 2.0 ** (-mean_depth / max(base, 1e-12))})

    return features.select("equipment_id", "process_type", "win", *cols).mapInPandas(
        run, "equipment_id string, process_type string, win long, stat double")


def forest_score(features: DataFrame, model: dict, train: DataFrame | None = None, quantile: float = K.LIMIT_QUANTILE) -> DataFrame:
    stats = forest_statistics(train if train is not None else features, model)
    if not model["limits"]:
        model["limits"] = {r["process_type"]: r["limit"] for r in limit_quantile(stats, ["process_type"], "stat", quantile).collect()}
    limit = _by_process({p: (v,) for p, v in model["limits"].items()})[0]
    return forest_statistics(features, model).withColumn("raw", F.col("stat") / limit)
