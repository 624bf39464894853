"""Co-moments of assets' returns as blocks of Gram matrices: partial states of spans of days, merged by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Assets on a side of a block.
BLOCK = 128
#: Calendar days whose rows one task turns into a partial state.
SPAN = 1024

# Planes of a state, each a block of pairs (i, j) of assets. N days have both; MI and MJ are the
# means over those days, C the sum of products of what deviates from them. With fourth moments:
# UU, VV, UUV, UVV, UUVV are sums of such products of powers, and OWN_N, OWN_M the days and
# mean of an asset whether or not the other has those days.
N, MI, MJ, C, UU, VV, UUV, UVV, UUVV, OWN_NI, OWN_MI, OWN_NJ, OWN_MJ = range(13)


def shifted(s: np.ndarray, d: np.ndarray, e: np.ndarray, su: np.ndarray | float = 0.0, sv: np.ndarray | float = 0.0) -> np.ndarray:
    """Sums of products of u + d and v + e from those of u and v, whose own sums are su and sv. Planes N, MI and MJ stay as they are."""
    out, n, c = s.copy(), s[N], s[C]
    out[C] = c + e * su + d * sv + n * d * e
    if len(s) > 4:
        uu, vv, uuv, uvv = s[UU], s[VV], s[UUV], s[UVV]
        out[UU] = uu + 2 * d * su + n * d * d
        out[VV] = vv + 2 * e * sv + n * e * e
        out[UUV] = uuv + 2 * d * c + d * d * sv + e * uu + 2 * d * e * su + n * d * d * e
        out[UVV] = uvv + 2 * e * c + e * e * su + d * vv + 2 * d * e * sv + n * d * e * e
        out[UUVV] = s[UUVV] + 2 * e * uuv + e * e * uu + 2 * d * uvv + 4 * d * e * c + 2 * d * e * e * su + d * d * vv + 2 * d * d * e * sv + n * (d * e) ** 2
    return out


def state_of(x: np.ndarray, y: np.ndarray, fourth: bool) -> np.ndarray:
    """State of the days (rows) of two blocks of assets; NaN where an asset lacks a day."""
    k, m = (~np.isnan(z) for z in (x, y))
    centre = [np.where(b.any(axis=0), np.where(b, z, 0.0).sum(axis=0) / np.maximum(b.sum(axis=0), 1), 0.0) for z, b in ((x, k), (y, m))]
    u, v = np.where(k, x - centre[0], 0.0), np.where(m, y - centre[1], 0.0)
    a, b = k.astype(float), m.astype(float)
    s = np.zeros((13 if fourth else 4, x.shape[1], y.shape[1]))
    s[N], su, sv, s[C] = a.T @ b, u.T @ b, a.T @ v, u.T @ v
    if fourth:
        s[UU], s[VV], s[UUV], s[UVV], s[UUVV] = (u * u).T @ b, a.T @ (v * v), (u * u).T @ v, u.T @ (v * v), (u * u).T @ (v * v)
        s[OWN_NI], s[OWN_NJ] = a.sum(axis=0)[:, None], b.sum(axis=0)[None]
        s[OWN_MI], s[OWN_MJ] = centre[0][:, None], centre[1][None]
    d, e = (np.divide(z, s[N], out=np.zeros_like(z), where=s[N] > 0) for z in (su, sv))
    s = shifted(s, -d, -e, su, sv)
    s[MI], s[MJ] = centre[0][:, None] + d, centre[1][None] + e
    return s


def merged(states: list[np.ndarray]) -> np.ndarray:
    """State of disjoint sets of days: each is moved to the common means before it is added, so nothing is subtracted."""
    if len(states) == 1:
        return states[0]
    s = np.stack(states)

    def mean(weight, of):
        n = s[:, weight].sum(axis=0)
        return n, np.divide((s[:, weight] * s[:, of]).sum(axis=0), n, out=np.zeros_like(n), where=n > 0)

    n, mi = mean(N, MI)
    _, mj = mean(N, MJ)
    out = sum(shifted(x, x[MI] - mi, x[MJ] - mj) for x in s)
    out[N], out[MI], out[MJ] = n, mi, mj
    for weight, of in ((OWN_NI, OWN_MI), (OWN_NJ, OWN_MJ)) if len(out) > 4 else ():
        out[weight], out[of] = mean(weight, of)
    return out


def two_stacks(states: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(states of all up to each one, states of all from each one on)."""
    upto, onward = [], []
    for some, out in ((states, upto), (states[::-1], onward)):
        for s in some:
            out.append(merged([out[-1], s]) if out else s)
    return upto, onward[::-1]


def blocks(p: int, block: int) -> list[tuple[int, int]]:
    """Pairs of blocks of p assets, each once."""
    n = -(-p // block)
    return [(i, j) for i in range(n) for j in range(i, n)]


def dense(table: pa.Table, day: str, p: int, zeros: bool) -> tuple[np.ndarray, np.ndarray]:
    """(days in order, their returns by asset) of rows (day, pos, ret); a null return is NaN, or 0."""
    days, at = np.unique(table.column(day).to_numpy(), return_inverse=True)
    ret = np.asarray(table.column("ret").to_numpy(), np.float64)  # nulls come as NaN
    out = np.full((len(days), p), np.nan)
    out[at, table.column("pos").to_numpy()] = np.nan_to_num(ret, nan=0.0, posinf=np.inf, neginf=-np.inf) if zeros else ret
    return days, out


def universe(returns: DataFrame, assets: list[str] | None) -> list[str]:
    """The assets, or where none are given those of returns: a row for each reaches the driver."""
    return list(assets) if assets is not None else sorted(r["asset"] for r in returns.select("asset").distinct().collect())


def with_positions(returns: DataFrame, assets: list[str]) -> DataFrame:
    """Rows of the assets, with the place of each in the list as `pos`."""
    place = F.array_position(F.lit(assets), F.col("asset")) - 1
    return returns.withColumn("pos", place.cast("int")).where("pos >= 0")


_ROWS = "asset_i string, asset_j string, n long, mean_i double, mean_j double, c double, s double, q double"


def finished(states: list[np.ndarray], at: tuple[int, int], assets: list[str], block: int) -> list[pa.Array]:
    """Columns of _ROWS of a block's pairs, each in both orders, that have a day in common.

    s and q are the means of the products, and of the squared products, of what deviates
    from the assets' own means; NaN without fourth moments.
    """
    s = merged(states)
    own = shifted(s, s[MI] - s[OWN_MI], s[MJ] - s[OWN_MJ]) if len(s) > 4 else np.full((13, *s.shape[1:]), np.nan)
    i, j = np.nonzero(s[N] > 0)
    n = s[N][i, j]
    names = np.array(assets, object)
    a, b = names[i + at[0] * block], names[j + at[1] * block]
    values = [n.astype(np.int64), s[MI][i, j], s[MJ][i, j], s[C][i, j], own[C][i, j] / n, own[UUVV][i, j] / n]
    if at[0] != at[1]:
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        values = [np.tile(v, 2) for v in (values[0], *values[3:])]
        means = [np.concatenate([s[x][i, j], s[y][i, j]]) for x, y in ((MI, MJ), (MJ, MI))]
        values = [values[0], *means, *values[1:]]
    return [pa.array(a, pa.string()), pa.array(b, pa.string()), *(pa.array(v) for v in values)]


def finish_blocks(states: DataFrame, group: list[str], assets: list[str], fourth: bool, block: int = BLOCK) -> DataFrame:
    """(group, asset_i, asset_j, n, mean_i, mean_j, c, s, q) of states (group, bi, bj, state), merged by group and block."""
    kinds = [(c, states.schema[c].dataType) for c in group]
    schema = ", ".join([*(f"`{c}` {t.simpleString()}" for c, t in kinds), _ROWS])
    names = [*group, *(x.split()[0] for x in _ROWS.split(", "))]

    def run(table: pa.Table) -> pa.Table:
        at = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        shape = [13 if fourth else 4, *(min(block, len(assets) - k * block) for k in at)]
        some = [np.frombuffer(x, np.float64).reshape(shape) for x in table.column("state").to_pylist()]
        rows = finished(some, at, assets, block)
        keys = [pa.array([table.column(c)[0].as_py()] * len(rows[0]), to_arrow_type(t)) for c, t in kinds]
        return pa.Table.from_arrays([*keys, *rows], names=names)

    return states.groupBy(*group, "bi", "bj").applyInArrow(run, schema)


def co_moments(returns: DataFrame, group: tuple[str, ...] = (), assets: list[str] | None = None, fourth: bool = False, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """(group, asset_i, asset_j, n, mean_i, mean_j, c, s, q) of every ordered pair of assets with a day in common.

    Each task takes a span of days, lays them out as vectors, one a day, and turns every
    pair of blocks of assets into a partial Gram state; states are merged by block. Days
    never meet themselves in a join, and what is shuffled after the rows are states, as
    many as spans. A null return leaves a day out; with `fourth` it is 0.
    """
    assets = universe(returns, assets)
    return finish_blocks(span_states(returns, list(group), assets, fourth, block, span), list(group), assets, fourth, block)


def span_states(returns: DataFrame, group: list[str], assets: list[str], fourth: bool, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """(group, span, bi, bj, state): the partial states of co_moments()."""
    kinds = [(c, returns.schema[c].dataType) for c in group]
    rows = with_positions(returns, assets).select(*group, F.floor(F.unix_date("day") / span).cast("int").alias("span"), "day", "pos", F.col("ret").cast("double").alias("ret"))

    def run(table: pa.Table) -> pa.Table:
        _, x = dense(table, "day", len(assets), fourth)
        at = blocks(len(assets), block)
        found = [state_of(x[:, i * block : (i + 1) * block], x[:, j * block : (j + 1) * block], fourth).tobytes() for i, j in at]
        keys = [pa.array([table.column(c)[0].as_py()] * len(at), to_arrow_type(t)) for c, t in kinds]
        spans = pa.array([table.column("span")[0].as_py()] * len(at), pa.int32())
        return pa.Table.from_arrays([*keys, spans, pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), pa.array(found, pa.binary())], names=[*group, "span", "bi", "bj", "state"])

    schema = ", ".join([*(f"`{c}` {t.simpleString()}" for c, t in kinds), "span int, bi int, bj int, state binary"])
    return rows.groupBy(*group, "span").applyInArrow(run, schema)


def window_co_moments(returns: DataFrame, dates: DataFrame, window: int, assets: list[str] | None = None, fourth: bool = False, block: int = BLOCK) -> DataFrame:
    """co_moments() of each rebalance date's sample: its day and the `window` positions before it.

    Positions are cut into stretches as long as a sample, so a sample is the end of one
    stretch and the start of the next. A task takes a stretch, cuts it where samples begin
    and end, makes a state of each piece once, and merges them from both ends; a date gets
    its two halves, whatever the length of the sample. Nothing is ever subtracted.
    """
    assets, length = universe(returns, assets), window + 1
    day = dates.schema["rebalance_date"].dataType
    stretch = lambda c: F.floor(c / length).cast("long")
    rows = with_positions(returns, assets).select(stretch(F.col("loc")).alias("stretch"), F.col("loc").cast("long").alias("loc"), "pos", F.col("ret").cast("double").alias("ret"))
    ends = dates.select("rebalance_date", F.col("loc").cast("long").alias("at"), F.lit(True).alias("upto"))
    begins = ends.select("rebalance_date", (F.col("at") - window).alias("at"), F.lit(False).alias("upto")).where(F.pmod("at", F.lit(length)) != 0)
    asks = ends.union(begins).select(stretch(F.col("at")).alias("stretch"), "rebalance_date", "at", "upto")

    def run(key, table: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if len(table) and len(asked):
            locs, x = dense(table, "loc", len(assets), fourth)
            at, upto = asked.column("at").to_numpy(), np.array(asked.column("upto").to_pylist())
            cuts = np.unique(np.searchsorted(locs, at + upto))  # places that a piece begins at
            places = np.unique(np.concatenate([[0], cuts[cuts < len(locs)]]))
            which = np.searchsorted(places, np.searchsorted(locs, at + upto), side="left")
            for i, j in blocks(len(assets), block):
                pieces = [state_of(*(z[:, k * block : (k + 1) * block] for z, k in ((part, i), (part, j))), fourth) for part in np.split(x, places[1:])]
                before, onward = two_stacks(pieces)
                for date, w, up in zip(asked.column("rebalance_date").to_pylist(), which.tolist(), upto.tolist(), strict=True):
                    half = (before[w - 1] if w else None) if up else (onward[w] if w < len(onward) else None)
                    if half is not None:
                        for o, v in zip(out, (date, i, j, half.tobytes()), strict=True):
                            o.append(v)
        return pa.Table.from_arrays([pa.array(o, t) for o, t in zip(out, (to_arrow_type(day), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["rebalance_date", "bi", "bj", "state"])

    halves = rows.groupBy("stretch").cogroup(asks.groupBy("stretch")).applyInArrow(run, f"rebalance_date {day.simpleString()}, bi int, bj int, state binary")
    return finish_blocks(halves, ["rebalance_date"], assets, fourth, block)
