"""Gap filling of fields of any size: a field is cut into tiles, and no task holds more than a few.

Relaxation: before some sweeps, each tile gets strips of its neighbours, as wide as those sweeps can
reach; it repeats their work there and so comes to what one task would have.
Multigrid: every level is such a table of tiles, half as wide as the one above; a correction is judged
by sums over all tiles; from the level on that has at most ``coarse`` cells, a field is one task.
Low pass: the Gaussian of frequencies is a product, so one direction is filtered after the other, in
strips of tiles; a round begins with the direction that the last one ended with, so that it takes one
shuffle. A task holds one strip (``tile`` lines of the field).

After each round the tiles are a written table. Rounds go on until every field has stopped; a field
stops with the sweep that leaves less than ``epsilon``, whatever the others do.

Defined cases: cells of a field that have no row are gaps that take part, but are not given back; cells
count from 0, those of negative or missing places are left out; of repeated cells the largest value
counts, and each gets the result; a field without gaps comes back with 0 iterations, one without values
starts from 0; NULL keys of ``by`` are keys; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import saved

from .fill import _around, cycle, low_pass
from .stats import _real

_COLS = ["k", "nx", "ny", "tx", "ty", "u", "gap", "rhs"]
_TILE = "k string, nx long, ny long, tx long, ty long, u array<double>, gap array<boolean>, rhs array<double>"
_KEY = ["k", "tx", "ty"]


def field_key(by: list[str]) -> Column:
    """One text for each field."""
    return F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(by)]), {"ignoreNullFields": "false"}) if by else F.lit("")


def tiled(df: DataFrame, value: str, by: list[str], tile: int, guess: str) -> tuple[DataFrame, DataFrame]:
    """All cells that are asked for, and the tiles of all fields, gaps filled by a first guess
    (``zonal``: the mean of their iy; ``global``: of all; ``zero``)."""
    if guess not in ("zonal", "global", "zero"):
        raise ValueError(f"no first guess {guess!r}")
    if tile < 4 or tile & (tile - 1):
        raise ValueError("tiles are a power of two wide, at least 4")
    cells = df.select(field_key(by).alias("k"), *[F.col(f"`{c}`").alias(f"b{i}") for i, c in enumerate(by)], F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), _real(F.col(f"`{value}`")).alias("v"))
    cells = saved(cells.where("ix >= 0 and iy >= 0"))
    size = saved(cells.groupBy("k").agg((F.max("ix") + 1).alias("nx"), (F.max("iy") + 1).alias("ny")))
    known = saved(cells.where("v is not null").groupBy("k", "ix", "iy").agg(F.max("v").alias("v")))
    part = F.struct(F.expr(f"int(iy % {tile})").alias("j"), F.col("m")).alias("e")
    if guess == "zonal":
        mean = known.groupBy("k", "iy").agg(F.avg("v").alias("m"))
    else:
        mean = known.groupBy("k").agg((F.avg("v") if guess == "global" else F.lit(0.0)).alias("m")).join(size, "k").select("k", F.explode(F.expr("sequence(0L, ny - 1)")).alias("iy"), "m")
    means = mean.select("k", F.expr(f"iy div {tile}").alias("ty"), part).groupBy("k", "ty").agg(F.collect_list("e").alias("means"))
    cell = F.struct(F.expr(f"int(ix % {tile})").alias("i"), F.expr(f"int(iy % {tile})").alias("j"), "v").alias("e")
    own = known.select("k", F.expr(f"ix div {tile}").alias("tx"), F.expr(f"iy div {tile}").alias("ty"), cell).groupBy(*_KEY).agg(F.collect_list("e").alias("cells"))
    frame = size.withColumn("tx", F.explode(F.expr(f"sequence(0L, (nx - 1) div {tile})"))).withColumn("ty", F.explode(F.expr(f"sequence(0L, (ny - 1) div {tile})")))

    def build(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                w, h = min(tile, r.nx - r.tx * tile), min(tile, r.ny - r.ty * tile)
                m = np.zeros(h)
                for e in r.means if r.means is not None else ():
                    m[e["j"]] = e["m"]
                u, gap = np.tile(m, (w, 1)), np.ones((w, h), bool)
                for e in r.cells if r.cells is not None else ():
                    u[e["i"], e["j"]], gap[e["i"], e["j"]] = e["v"], False
                out.append((r.k, r.nx, r.ny, r.tx, r.ty, u.ravel(), gap.ravel(), None))
            yield pd.DataFrame(out, columns=_COLS)

    d = frame.join(means, ["k", "ty"], "left").join(own, _KEY, "left")
    return cells, saved(d.mapInPandas(build, _TILE))


def _overlaps(n: int, step: int, at: int, halo: int, wrap: bool):
    """Along one axis, for the part ``at`` of n cells: (part that wants some of it, first and end of what
    it wants, where that begins in its own array). Each part wants ``halo`` cells on both sides of it,
    beyond the ends none, or those around the circle."""
    parts = -(-n // step)
    lo, hi = at * step, min((at + 1) * step, n)
    circle = wrap and parts > 1
    reach = halo // step + 2
    for other in {(at + d) % parts if circle else at + d for d in range(-reach, reach + 1)}:
        if not 0 <= other < parts:
            continue
        a, b = other * step - halo, min((other + 1) * step, n) + halo
        if not circle:
            a, b = max(a, 0), min(b, n)
        for turn in (-n, 0, n) if circle else (0,):
            x, y = max(lo + turn, a), min(hi + turn, b)
            if x < y:
                yield other, x - turn - lo, y - turn - lo, x - a


def exchange(state: DataFrame, work, schema: str, step: int, halo: int, wrap: bool, extra: list[str] = ()) -> DataFrame:
    """``work(row, u, gap, rhs, inner, colour, circle)`` for each tile, with ``halo`` cells around it:
    arrays of the tile and its surroundings, slices of the tile itself, the colour of each cell of the
    whole field, and whether the array closes to a circle in x. Columns ``extra`` come with ``row``."""
    own = [f"{c} {state.schema[c].dataType.simpleString()}" for c in extra]
    sent = ", ".join(["k string, nx long, ny long, tx long, ty long, ox long, oy long, w long, h long, u array<double>, gap array<boolean>, rhs array<double>", *own])

    def send(frames):
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                shape = (min(step, r["nx"] - r["tx"] * step), min(step, r["ny"] - r["ty"] * step))
                arrays = [None if r[c] is None else np.asarray(r[c]).reshape(shape) for c in ("u", "gap", "rhs")]
                for tx, x0, x1, ox in _overlaps(r["nx"], step, r["tx"], halo, wrap):
                    for ty, y0, y1, oy in _overlaps(r["ny"], step, r["ty"], halo, False):
                        cut = [None if a is None else a[x0:x1, y0:y1].ravel() for a in arrays]
                        out.append((r["k"], r["nx"], r["ny"], tx, ty, ox, oy, x1 - x0, y1 - y0, *cut, *(r[c] for c in extra)))
            yield pd.DataFrame(out, columns=["k", "nx", "ny", "tx", "ty", "ox", "oy", "w", "h", "u", "gap", "rhs", *extra])

    def gather(g: pd.DataFrame) -> pd.DataFrame:
        r = g.iloc[0]
        nx, ny, x0, y0 = int(r["nx"]), int(r["ny"]), int(r["tx"]) * step, int(r["ty"]) * step
        x1, y1 = min(x0 + step, nx), min(y0 + step, ny)
        around = wrap and nx > step
        left, low = (halo if around else min(halo, x0)), min(halo, y0)
        right, high = (halo if around else min(halo, nx - x1)), min(halo, ny - y1)
        shape = (left + x1 - x0 + right, low + y1 - y0 + high)
        u, gap, rhs = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape)
        for m in g.itertuples(index=False):
            at = (slice(m.ox, m.ox + m.w), slice(m.oy, m.oy + m.h))
            u[at], gap[at] = np.asarray(m.u).reshape(m.w, m.h), np.asarray(m.gap).reshape(m.w, m.h)
            if m.rhs is not None:
                rhs[at] = np.asarray(m.rhs).reshape(m.w, m.h)
        gx, gy = (x0 - left + np.arange(shape[0])) % nx, y0 - low + np.arange(shape[1])
        inner = (slice(left, left + x1 - x0), slice(low, low + y1 - y0))
        return work(r, u, gap, rhs, inner, np.add.outer(gx, gy) % 2, wrap and not around)

    return state.select(*_COLS, *extra).mapInPandas(send, sent).groupBy(*_KEY).applyInPandas(gather, schema)


def _sweeps(step: int, wanted: int) -> int:
    return max(1, min(wanted, step // 2))


def _tile_row(r, u, inner, gap, rhs=None, **more) -> pd.DataFrame:
    out = {c: [r[c]] for c in ("k", "nx", "ny", "tx", "ty")}
    return pd.DataFrame(out | {"u": [u[inner].ravel()], "gap": [gap[inner].ravel()], "rhs": [None if rhs is None else rhs[inner].ravel()]} | {n: [v] for n, v in more.items()})


def _given_back(cells: DataFrame, ends: list[DataFrame], by: list[str], step: int) -> DataFrame:
    """(by, ix, iy, filled, iterations, residual) of the cells, from the tiles of fields that stopped."""
    d = ends[0]
    for e in ends[1:]:
        d = d.union(e)

    def spread(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                w = min(step, r.nx - r.tx * step)
                h = len(r.u) // w
                i, j = np.divmod(np.arange(w * h), h)
                yield pd.DataFrame({"k": r.k, "ix": r.tx * step + i, "iy": r.ty * step + j, "filled": r.u, "iterations": r.iterations, "residual": r.residual})

    values = d.mapInPandas(spread, "k string, ix long, iy long, filled double, iterations long, residual double")
    out = cells.join(values, ["k", "ix", "iy"])
    return out.select(*[F.col(f"b{i}").alias(c) for i, c in enumerate(by)], "ix", "iy", "filled", "iterations", "residual")


def _open(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tiles of fields that have gaps, and those of the others as they end."""
    some = state.groupBy("k").agg(F.bool_or(F.expr("exists(gap, g -> g)")).alias("some"))
    d = state.join(some, "k")
    return d.where("some").drop("some"), d.where("not some").select(*_COLS[:6], F.lit(0).cast("long").alias("iterations"), F.lit(0.0).alias("residual"))


def gauss_seidel(df: DataFrame, value: str, by: list[str], tile: int = 512, iterations: int = 2000, epsilon: float = 1e-4, relaxation: float = 1.0, guess: str = "zonal", is_periodic: bool = False, sweeps: int = 32) -> DataFrame:
    """Red-black relaxation of Laplace's equation in the gaps: what ``fill.solve_gauss_seidel`` gives.
    ``sweeps`` are made between two exchanges of strips."""
    cells, state = tiled(df, value, by, tile, guess)
    state, still = _open(state)
    state, ends, done = saved(state), [still], 0

    def work(r, u, gap, rhs, inner, colour, circle):
        left = []
        for _ in range(int(r["n"])):
            worst = 0.0
            for c in (0, 1):
                m = gap & (colour == c)
                d = _around(u, circle) / 4 - u
                u[m] += relaxation * d[m]
                mine = np.zeros_like(m)
                mine[inner] = m[inner]
                worst = max(worst, float(np.abs(d[mine]).max(initial=0.0)))
            left.append(worst)
        return _tile_row(r, u, inner, gap, None, left=left)

    def run(tiles: DataFrame, n: int) -> DataFrame:
        return saved(exchange(tiles, work, f"{_TILE}, left array<double>", tile, 2 * n, is_periodic, ["n"]))

    while done < iterations and not state.isEmpty():
        n = min(_sweeps(tile, sweeps), iterations - done)
        new = run(state.withColumn("n", F.lit(n).cast("long")), n)
        worst = new.select("k", F.posexplode("left").alias("at", "left")).groupBy("k", "at").agg(F.max("left").alias("left"))
        last = F.lit(n - 1) if done + n == iterations else F.lit(None).cast("int")
        stop = worst.groupBy("k").agg(F.coalesce(F.min(F.expr(f"if(left < {epsilon!r}D, at, null)")), last).alias("at"))
        stop = saved(stop.where("at is not null").join(worst, ["k", "at"]).withColumnRenamed("left", "residual"))
        # fields that stopped before the last of these sweeps make only theirs
        early = state.join(stop.where(F.col("at") < n - 1).select("k", (F.col("at") + 1).cast("long").alias("n")), "k")
        again = run(early, n) if not stop.where(F.col("at") < n - 1).isEmpty() else new.limit(0)
        full = new.join(stop.where(F.col("at") == n - 1).select("k"), "k", "left_semi")
        ended = again.union(full).join(stop, "k").select(*_COLS[:6], (F.col("at") + 1 + done).cast("long").alias("iterations"), "residual")
        ends.append(saved(ended))
        state, done = new.drop("left").join(stop.select("k"), "k", "left_anti"), done + n
    return _given_back(cells, ends, by, tile)


def multigrid(df: DataFrame, value: str, by: list[str], tile: int = 512, iterations: int = 100, epsilon: float = 1e-4, pre: int = 2, post: int = 2, guess: str = "zonal", is_periodic: bool = False, coarse: int = 1 << 18) -> DataFrame:
    """V-cycles for the same equation: what ``fill.solve_multigrid`` gives."""
    cells, state = tiled(df, value, by, tile, guess)
    state, still = _open(state)
    state, ends = saved(state), [still]
    for it in range(1, iterations + 1):
        if state.isEmpty():
            break
        state = _v_cycle(state, tile, pre, post, is_periodic, coarse)

        def rest(r, u, gap, rhs, inner, colour, circle):
            d = np.where(gap, rhs + _around(u, circle) - 4 * u, 0.0)[inner]
            return pd.DataFrame({"k": [r["k"]], "left": [float(np.abs(d).max()) / 4]})

        left = exchange(state, rest, "k string, left double", tile, 1, is_periodic).groupBy("k").agg(F.max("left").alias("residual"))
        left = saved(left)
        stop = left if it == iterations else left.where(F.col("residual") < epsilon)
        ends.append(saved(state.join(stop, "k").select(*_COLS[:6], F.lit(it).cast("long").alias("iterations"), "residual")))
        state = saved(state.join(stop, "k", "left_anti").select(*_COLS))
    return _given_back(cells, ends, by, tile)


def _smoothed(state: DataFrame, n: int, step: int, wrap: bool) -> DataFrame:
    def work(r, u, gap, rhs, inner, colour, circle):
        for _ in range(m):
            for c in (0, 1):
                at = gap & (colour == c)
                u[at] = (_around(u, circle)[at] + rhs[at]) / 4
        return _tile_row(r, u, inner, gap, rhs)

    while n > 0:
        m = _sweeps(step, n)
        state = saved(exchange(state, work, _TILE, step, 2 * m, wrap))
        n -= m
    return state


def _v_cycle(state: DataFrame, step: int, pre: int, post: int, wrap: bool, coarse: int) -> DataFrame:
    small = F.expr(f"nx * ny <= {coarse}") | F.lit(step < 8)

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        nx, ny = int(g["nx"].iloc[0]), int(g["ny"].iloc[0])
        u, gap, rhs = np.zeros((nx, ny)), np.zeros((nx, ny), bool), np.zeros((nx, ny))
        places = []
        for r in g.itertuples(index=False):
            at = (slice(r.tx * step, min((r.tx + 1) * step, nx)), slice(r.ty * step, min((r.ty + 1) * step, ny)))
            places.append(at)
            shape = u[at].shape
            u[at], gap[at] = np.asarray(r.u).reshape(shape), np.asarray(r.gap).reshape(shape)
            if r.rhs is not None:
                rhs[at] = np.asarray(r.rhs).reshape(shape)
        u = cycle(u, rhs, gap, pre, post, wrap)
        return g.assign(u=[u[at].ravel() for at in places])[_COLS]

    low = saved(state.where(small).groupBy("k").applyInPandas(whole, _TILE))
    thin = F.expr("least(nx, ny) <= 4")
    slim = state.where(~small & thin)
    if not slim.isEmpty():
        low = low.union(_smoothed(slim, 50, step, wrap))
    state = state.where(~small & ~thin)
    if state.isEmpty():
        return low

    first = _smoothed(state, pre, step, wrap)

    def restrict(r, u, gap, rhs, inner, colour, circle):
        d = np.where(gap, rhs + _around(u, circle) - 4 * u, 0.0)[inner]
        half, holes = d[::2, ::2] * 4, gap[inner][::2, ::2]
        row = {"k": [r["k"]], "nx": [-(-int(r["nx"]) // 2)], "ny": [-(-int(r["ny"]) // 2)], "tx": [r["tx"]], "ty": [r["ty"]]}
        return pd.DataFrame(row | {"u": [np.zeros(half.size)], "gap": [holes.ravel()], "rhs": [half.ravel()], "total": [float(np.abs(d).sum())]})

    below = saved(exchange(first, restrict, f"{_TILE}, total double", step, 1, wrap))
    total = below.groupBy("k").agg(F.sum("total").alias("total"))
    e = _v_cycle(below.drop("total"), step // 2, pre, post, wrap, coarse)

    def prolong(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                w, h = min(step, r.nx - r.tx * step), min(step, r.ny - r.ty * step)
                e = np.asarray(r.e).reshape(-(-w // 2), -(-h // 2))
                up = np.repeat(np.repeat(e, 2, 0), 2, 1)[:w, :h].ravel()
                out.append((r.k, r.nx, r.ny, r.tx, r.ty, np.where(r.gap, np.asarray(r.u) + up, r.u), r.gap, r.rhs))
            yield pd.DataFrame(out, columns=_COLS)

    trial = saved(first.join(e.select(*_KEY, F.col("u").alias("e")), _KEY).mapInPandas(prolong, _TILE))

    def judge(r, u, gap, rhs, inner, colour, circle):
        d = np.where(gap, rhs + _around(u, circle) - 4 * u, 0.0)[inner]
        return pd.DataFrame({"k": [r["k"]], "now": [float(np.abs(d).sum())]})

    now = exchange(trial, judge, "k string, now double", step, 1, wrap).groupBy("k").agg(F.sum("now").alias("now"))
    good = saved(now.join(total, "k").where("now < 2 * total").select("k"))
    best = trial.join(good, "k", "left_semi").union(first.join(good, "k", "left_anti").select(*_COLS))
    return low.union(_smoothed(best.select(*_COLS), post, step, wrap).select(*_COLS))


def low_pass_fill(df: DataFrame, value: str, by: list[str], tile: int = 512, iterations: int = 500, epsilon: float = 1e-4, sigma: float = 10.0, guess: str = "zonal", is_periodic: bool = False) -> DataFrame:
    """Repeated low pass with known cells put back: what ``fill.solve_fft`` gives."""
    cells, state = tiled(df, value, by, tile, guess)
    state, still = _open(state)
    state, ends = saved(state.drop("rhs")), [still]
    names = _COLS[:7]
    kinds = "k string, nx long, ny long, tx long, ty long, u array<double>, gap array<boolean>"

    def strip(g: pd.DataFrame, axis: int):
        """Tiles of one strip side by side along ``axis``."""
        g = g.sort_values("ty" if axis else "tx")
        other = "tx" if axis else "ty"
        width = min(tile, int(g["nx" if axis else "ny"].iloc[0]) - int(g[other].iloc[0]) * tile)
        shaped = lambda a: np.asarray(a).reshape((width, -1) if axis else (-1, width))
        return g, shaped

    def passed(axis: int, last: bool):
        def run(g: pd.DataFrame) -> pd.DataFrame:
            g, shaped = strip(g, axis)
            line = np.concatenate([shaped(a) for a in g["s"]], axis)
            s = low_pass(line, axis, sigma, is_periodic)
            ends_ = np.cumsum([shaped(a).shape[axis] for a in g["s"]])[:-1]
            parts = [p.ravel() for p in np.split(s, ends_, axis)]
            if not last:
                return g.assign(s=parts)[[*names, "s"]]
            left, new = [], []
            for u, gap, p in zip(g["u"], g["gap"], parts, strict=True):
                u, gap = np.asarray(u).copy(), np.asarray(gap)
                left.append(float(np.abs(p[gap] - u[gap]).max(initial=0.0)))
                u[gap] = p[gap]
                new.append(u)
            return g.assign(u=new, s=new, left=left)[[*names, "s", "left"]]

        return run

    key = {0: "ty", 1: "tx"}
    state = state.withColumn("s", F.col("u"))
    axis, now = 0, saved(state.groupBy("k", key[0]).applyInPandas(passed(0, False), f"{kinds}, s array<double>"))
    for it in range(1, iterations + 1):
        if now.isEmpty():
            break
        axis = 1 - axis
        new = saved(now.groupBy("k", key[axis]).applyInPandas(passed(axis, True), f"{kinds}, s array<double>, left double"))
        left = saved(new.groupBy("k").agg(F.max("left").alias("residual")))
        stop = left if it == iterations else left.where(F.col("residual") < epsilon)
        ends.append(saved(new.join(stop, "k").select(*_COLS[:6], F.lit(it).cast("long").alias("iterations"), "residual")))
        # the next round begins in the direction that these strips lie
        rest = new.join(stop.select("k"), "k", "left_anti").drop("left")
        now = saved(rest.groupBy("k", key[axis]).applyInPandas(passed(axis, False), f"{kinds}, s array<double>"))
    return _given_back(cells, ends, by, tile)


SOLVERS = {"gauss_seidel": gauss_seidel, "multigrid": multigrid, "fft_inpaint": low_pass_fill}


def solve(df: DataFrame, value: str, method: str, by: list[str] = (), **options) -> DataFrame:
    """(by..., ix, iy, filled, iterations, residual) by one of the solvers, fields of any size."""
    return SOLVERS[method](df, value, list(by), **options)
