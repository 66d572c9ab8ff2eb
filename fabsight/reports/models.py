"""Given models: literal states, scored by the operators and by SQL alike."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fabsight import constants as K
from fabsight.operators import detectors as D, serving as Sv, windows as Wn
from fabsight.views import SQL_VIEWS, TEST_PROFILES

TYPES = ("P0", "P1")
#: Sets of features that one component each weighs evenly; their supports are disjoint, so the components are orthonormal.
GROUPS = [[f"{s}_{c}" for s in ("mean", "max") for c in K.CHANNELS], [f"{s}_{c}" for s in ("std", "dstd") for c in K.CHANNELS], list(Wn.PAIR_FEATURES)]
VARIANCES, T2_LIMIT, SPE_LIMIT = {"P0": (2.0, 0.5, 1.5), "P1": (1.0, 0.75, 2.5)}, {"P0": 6.0, "P1": 5.0}, {"P0": 14.0, "P1": 18.0}
#: Autoregression: weights of a channel's own last and second last value, of pressure in temperature, bias as share of mu0.
OWN1, OWN2, CROSS, BIAS, VAR_LIMIT = 0.4, 0.2, 0.0001, 0.3, {"P0": 6.0, "P1": 9.0}
#: A score that counts as a jump in these reports.
JUMP = 1.5
#: Limits of the accumulated scores: by process type for both paths, and own ones.
EWMA_LIMIT, VAR_EWMA_LIMIT, OWN_LIMIT = {"P0": 0.9, "P1": 0.8}, {"P0": 0.7, "P1": 0.5}, {"EQP-003": 0.6, "EQP-004": 1.1}


def _mean_scale(feature: str, p: str) -> tuple[float, float]:
    if feature.startswith("corr"):
        return 0.0, 0.5
    stat, channel = feature.split("_", 1)
    mu, sigma = TEST_PROFILES[p][channel][:2]
    return {"mean": (mu, sigma / 3), "min": (mu - sigma, sigma), "max": (mu + sigma, sigma), "std": (sigma, sigma / 2), "slope": (0.0, sigma / 5), "dstd": (sigma, sigma)}[stat]


def pca_states() -> list[D.PcaState]:
    cols, out = list(Wn.ALL_FEATURES), []
    for p in TYPES:
        mean, scale = zip(*[_mean_scale(c, p) for c in cols])
        comp = [[1 / np.sqrt(len(g)) if c in g else 0.0 for c in cols] for g in GROUPS]
        out.append(D.PcaState(p, cols, list(mean), list(scale), comp, [0.0] * len(cols), list(VARIANCES[p]), T2_LIMIT[p], SPE_LIMIT[p], 0, 0.999))
    return out


def pca_bases() -> list[D.PcaBasis]:
    return [D.PcaBasis(x.process_type, x.features, x.mean, x.scale, x.center, x.components, x.variance) for x in pca_states()]


def var_states() -> list[D.VarState]:
    out, n = [], len(K.CHANNELS)
    for p in TYPES:
        coef = np.zeros((n, 2 * n + 1))
        for i, c in enumerate(K.CHANNELS):
            coef[i, i], coef[i, n + i], coef[i, -1] = OWN2, OWN1, BIAS * TEST_PROFILES[p][c][0]
        coef[0, n + 1] = CROSS
        whitening = np.diag([1 / TEST_PROFILES[p][c][1] for c in K.CHANNELS])
        whitening[1, 0] = 0.5 * whitening[1, 1]
        out.append(D.VarState(p, 2, coef.tolist(), whitening.tolist(), VAR_LIMIT[p], 0))
    return out


#: Two trees by (feature, cut, left, right); a leaf is its number of rows.  Cuts are on standardized features.
TREES = [("mean_gas_flow", 0.1, ("std_pressure", -0.2, 1, ("max_temperature", 0.3, 5, 2)), ("slope_rf_power", 0.013, 40, 16)),
         ("min_pressure", -0.3, 3, ("corr_temperature__pressure", 0.2, ("dstd_gas_flow", 0.4, 30, 1), 30))]


def forest_model() -> dict:
    cols, trees = list(Wn.ALL_FEATURES), []
    for tree in TREES:
        rows: list[list] = []

        def add(node) -> int:
            me = len(rows)
            rows.append([-1, 0.0, -1, -1, 0.0])
            if isinstance(node, tuple):
                rows[me][:2] = cols.index(node[0]), node[1]
                rows[me][2] = add(node[2])
                rows[me][3] = add(node[3])
            else:
                rows[me][4] = float(node)
            return me

        add(tree)
        trees.append((64, *[np.array(column) for column in zip(*rows)]))
    scaler = {p: tuple(np.array(x) for x in zip(*[_mean_scale(c, p) for c in cols])) for p in TYPES}
    return {"scaler": scaler, "trees": {p: trees for p in TYPES}, "cols": cols, "limits": {"P0": 0.55, "P1": 0.6}}


def fitted(spark) -> Sv.Fitted:
    limits = spark.createDataFrame([(p, EWMA_LIMIT[p], VAR_EWMA_LIMIT[p], 1000) for p in TYPES], "process_type string, ewma_limit double, var_ewma_limit double, train_windows long")
    own = spark.createDataFrame([(e, x, 500) for e, x in OWN_LIMIT.items()], "equipment_id string, ewma_limit double, train_windows long")
    return Sv.Fitted(pca_states(), var_states(), limits, own)


# ---- the same in SQL ---------------------------------------------------------------------------

def _by_type(values: dict) -> str:
    return f"CASE process_type WHEN 'P0' THEN CAST({values['P0']!r} AS DOUBLE) ELSE CAST({values['P1']!r} AS DOUBLE) END"


def _argmax(values: list[str]) -> str:
    most = f"greatest({', '.join(values)})"
    return "CASE " + " ".join(f"WHEN {v} = {most} THEN '{c}'" for v, c in zip(values, K.CHANNELS)) + " END"


def _path(n: float) -> float:
    return float(D._path_length(n))


def _tree(node, depth: int) -> str:
    if not isinstance(node, tuple):
        return f"CAST({depth + _path(node)!r} AS DOUBLE)"
    return f"CASE WHEN z_{node[0]} <= {node[1]!r} THEN {_tree(node[2], depth + 1)} ELSE {_tree(node[3], depth + 1)} END"


def sql_views(rows: str, prefix: str, window: int = K.WINDOW, stride: int = K.STRIDE) -> dict[str, str]:
    """Scores of the given models over the windows of a table (equipment_id, process_type, tick and channels)."""
    wide = ", ".join(f"{c} - lag({c}) OVER (PARTITION BY equipment_id ORDER BY tick) AS d_{c}" for c in K.CHANNELS)
    z = ", ".join(f"({c} - {_by_type({p: _mean_scale(c, p)[0] for p in TYPES})}) / {_by_type({p: _mean_scale(c, p)[1] for p in TYPES})} AS z_{c}" for c in Wn.ALL_FEATURES)
    member = {c: i for i, g in enumerate(GROUPS) for c in g}
    proj = ", ".join(f"({' + '.join('z_' + c for c in g)}) / sqrt({len(g)}) AS p{i}" for i, g in enumerate(GROUPS))
    gap = {c: f"(z_{c} - p{member[c]} / sqrt({len(GROUPS[member[c]])})) ** 2" if c in member else f"z_{c} ** 2" for c in Wn.ALL_FEATURES}
    channels = [" + ".join(f"r_{c}" for c in Wn.ALL_FEATURES if ch in c.split("_", 1)[1].split("__")) for ch in K.CHANNELS]
    t2 = " + ".join(f"p{i} ** 2 / {_by_type({p: VARIANCES[p][i] for p in TYPES})}" for i in range(len(GROUPS)))
    lags = ", ".join(f"lag({c}, {k}) OVER (PARTITION BY equipment_id ORDER BY tick) AS l{k}_{c}" for c in K.CHANNELS for k in (1, 2))
    residual = ", ".join(
        f"{c} - ({OWN1} * l1_{c} + {OWN2} * l2_{c} + {_by_type({p: BIAS * TEST_PROFILES[p][c][0] for p in TYPES})}{f' + {CROSS} * l1_pressure' if c == 'temperature' else ''}) AS r_{c}"
        for c in K.CHANNELS)
    white = [f"(r_{c} / {_by_type({p: TEST_PROFILES[p][c][1] for p in TYPES})})" for c in K.CHANNELS]
    white[1] = f"({white[1]} + 0.5 * r_temperature / {_by_type({p: TEST_PROFILES[p]['pressure'][1] for p in TYPES})})"
    starts = f"unnest(range(CAST(greatest(0, ceil((tick - {window - 1}) / {stride}.0)) AS BIGINT), tick // {stride} + 1))"
    out = {
        f"{prefix}_rows": f"SELECT t.*, k AS win, CAST(tick - k * {stride} AS DOUBLE) AS off FROM (SELECT *, {starts} AS k, {wide} FROM {rows}) t",
        f"{prefix}_feats": SQL_VIEWS["win_feats"].replace("win_rows", f"{prefix}_rows").replace("count(*) = 12", f"count(*) = {window}"),
        f"{prefix}_z": f"SELECT equipment_id, process_type, win, {z} FROM {prefix}_feats",
        f"{prefix}_parts": f"SELECT *, {', '.join(f'{e} AS r_{c}' for c, e in gap.items())} FROM (SELECT *, {proj} FROM {prefix}_z) a",
        f"{prefix}_pca": f"""SELECT equipment_id, process_type, win, ({t2}) / {_by_type(T2_LIMIT)} AS t2, ({' + '.join(f'r_{c}' for c in Wn.ALL_FEATURES)}) / {_by_type(SPE_LIMIT)} AS spe,
 {_argmax([f'({c})' for c in channels])} AS channel FROM {prefix}_parts""",
        f"{prefix}_res": f"SELECT equipment_id, process_type, tick, {residual} FROM (SELECT *, {lags} FROM {rows}) a",
        f"{prefix}_var": f"""SELECT equipment_id, process_type, win, stat / {_by_type(VAR_LIMIT)} AS raw, {_argmax([f'a_{c}' for c in K.CHANNELS])} AS channel FROM (
SELECT w.equipment_id, w.process_type, w.win, avg(s) AS stat, {', '.join(f'avg(abs(r_{c})) AS a_{c}' for c in K.CHANNELS)}
FROM {prefix}_rows w JOIN {prefix}_feats f ON w.equipment_id = f.equipment_id AND w.win = f.win
JOIN (SELECT *, {' + '.join(f'{x} ** 2' for x in white)} AS s FROM {prefix}_res) r ON w.equipment_id = r.equipment_id AND w.tick = r.tick WHERE off >= 2 GROUP BY 1, 2, 3) x""",
        f"{prefix}_forest": f"""SELECT equipment_id, process_type, win, 2 ** (-({' + '.join(_tree(t, 0) for t in TREES)}) / {len(TREES)} / {_path(64)!r})
 / {_by_type(forest_model()['limits'])} AS raw FROM {prefix}_z""",
    }
    return out


def sql_series(prefix: str, live: bool = False) -> str:
    """Statement head that ends in ``series`` (equipment_id, win, masked, fired, channel, score): both paths accumulated, confirmed and merged.

    ``live``: as a stream sees it, which has no accumulated score before the first unmasked window.
    """
    own = "CASE equipment_id " + " ".join(f"WHEN '{e}' THEN CAST({x!r} AS DOUBLE)" for e, x in OWN_LIMIT.items()) + f" ELSE {_by_type(EWMA_LIMIT)} END"
    unseen = "CASE WHEN win < coalesce(start, win + 1) THEN 0 ELSE 1 END * " if live else ""
    return f"""WITH RECURSIVE m AS MATERIALIZED (SELECT p.equipment_id, p.process_type, p.win, greatest(t2, spe) AS raw, v.raw AS vraw, p.channel, v.channel AS vchannel,
 max(CAST(greatest(t2, spe) >={JUMP!r} AS INT)) OVER (PARTITION BY p.equipment_id ORDER BY p.win ROWS {K.TRANSITION_SETTLE} PRECEDING) = 1 AS masked
 FROM {prefix}_pca p JOIN {prefix}_var v ON p.equipment_id = v.equipment_id AND p.win = v.win),
f AS MATERIALIZED (SELECT equipment_id, arg_min(least(raw, {K.SCORE_CLIP}), win) AS seed, arg_min(least(vraw, {K.SCORE_CLIP}), win) AS vseed, min(win) AS start FROM m WHERE NOT masked GROUP BY 1),
r AS (SELECT m.equipment_id, m.win, coalesce(seed, 0.0) AS y, coalesce(vseed, 0.0) AS vy FROM m LEFT JOIN f ON m.equipment_id = f.equipment_id WHERE m.win = 0
 UNION ALL SELECT m.equipment_id, m.win, CASE WHEN m.masked THEN r.y ELSE {K.EWMA_ALPHA} * least(m.raw, {K.SCORE_CLIP}) + {1 - K.EWMA_ALPHA} * r.y END,
  CASE WHEN m.masked THEN r.vy ELSE {K.EWMA_ALPHA} * least(m.vraw, {K.SCORE_CLIP}) + {1 - K.EWMA_ALPHA} * r.vy END
 FROM r JOIN m ON m.equipment_id = r.equipment_id AND m.win = r.win + 1),
s AS (SELECT *, {unseen}y / ({own}) AS score, {unseen}vy / {_by_type(VAR_EWMA_LIMIT)} AS vscore FROM (
 SELECT m.*, r.y, r.vy, f.start FROM m JOIN r ON m.equipment_id = r.equipment_id AND m.win = r.win LEFT JOIN f ON m.equipment_id = f.equipment_id) x),
c AS (SELECT *, sum(CAST(score > 1 AS INT)) OVER w = {K.CONFIRM_K} AND NOT masked AS a, sum(CAST(vscore > 1 AS INT)) OVER w = {K.CONFIRM_K} AND NOT masked AS b FROM s
 WINDOW w AS (PARTITION BY equipment_id ORDER BY win ROWS {K.CONFIRM_K - 1} PRECEDING)),
series AS (SELECT equipment_id, win, masked, greatest(raw, 0) AS pca, vraw AS var, a OR b AS fired, CASE WHEN a THEN channel WHEN b THEN vchannel END AS channel, greatest(score, vscore) AS score FROM c)
"""


SQL_VIEWS |= sql_views("telemetry", "given")
SQL_VIEWS["late_rows_of"] = f"""SELECT equipment_id, process_type, row_number() OVER (PARTITION BY equipment_id ORDER BY tick) - 1 AS tick, {', '.join(K.CHANNELS)} FROM (
SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY tick DESC) AS rn FROM telemetry) x WHERE rn <= {K.LOOKBACK_ROWS}"""
SQL_VIEWS |= sql_views("late_rows_of", "late")


# ---- grid of windows, strides, shares of variance and quantiles ---------------------------------

#: Parameters of the grid; a stride beyond its window is left out.
SHARES, GRID_QUANTILES = (0.2, 0.45, 0.9), (0.99, 0.999)
SHAPES = [(w, s) for w in (12, 24) for s in (12, 24) if s <= w]


def grid_points() -> list[tuple]:
    """(point, window, stride, variance, quantile)."""
    return [(i, *p) for i, p in enumerate((w, s, share, q) for w, s in SHAPES for share in SHARES for q in GRID_QUANTILES)]


def _grid_sql() -> dict[str, str]:
    out = {"fit_rows_of": f"SELECT equipment_id, process_type, pos AS tick, {', '.join(K.CHANNELS)} FROM train_rows WHERE win = pos // 6"}
    kept = {b.process_type: [b.kept(x) for x in SHARES] for b in pca_bases()}
    total = " + ".join(f"z_{c} ** 2" for c in Wn.ALL_FEATURES)

    def stats(j: int) -> str:
        t2 = {p: " + ".join(f"p{i} ** 2 / {VARIANCES[p][i]!r}" for i in range(kept[p][j])) for p in TYPES}
        used = {p: " + ".join(f"p{i} ** 2" for i in range(kept[p][j])) for p in TYPES}
        pick = lambda x: f"CASE process_type WHEN 'P0' THEN {x['P0']} ELSE {x['P1']} END"
        return f"{pick(t2)} AS t2_{j}, {total} - ({pick(used)}) AS spe_{j}"

    said, fired = ", ".join(stats(j) for j in range(len(SHARES))), []
    for w, s in SHAPES:
        fit, grid = f"fit_{w}_{s}", f"grid_{w}_{s}"
        out |= sql_views("fit_rows_of", fit, w, s) | sql_views("telemetry", grid, w, s)
        out |= {f"{x}_stats": f"SELECT equipment_id, process_type, win, {said} FROM {x}_parts" for x in (fit, grid)}
        out[f"{fit}_limits"] = f"SELECT process_type, {', '.join(f'quantile_cont({t}_{j}, {q!r}) AS {t}_{j}_{n}' for t in ('t2', 'spe') for j in range(len(SHARES)) for n, q in enumerate(GRID_QUANTILES))} FROM {fit}_stats GROUP BY 1"
        for i, _, _, share, q in [p for p in grid_points() if p[1:3] == (w, s)]:
            j, n = SHARES.index(share), GRID_QUANTILES.index(q)
            fired.append(f"SELECT {i} AS point, equipment_id, win * {s} + {w - 1} AS tick FROM {grid}_stats JOIN {fit}_limits USING (process_type) WHERE greatest(t2_{j} / t2_{j}_{n}, spe_{j} / spe_{j}_{n}) > 1 + 1e-9")
    out["grid_fired"] = " UNION ALL ".join(fired)
    out["grid_params"] = f"SELECT * FROM (VALUES {', '.join(map(str, grid_points()))}) g(point, window_, stride, variance, quantile)"
    return out


SQL_VIEWS |= _grid_sql()
