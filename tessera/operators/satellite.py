"""Ground tracks: crossovers, decomposition, swaths, passes.

A track is rows (track, idx, lon, lat), in order of idx."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geodesy import WGS84, Spheroid, haversine

from tessera.session import saved

from . import kernels


def _segments(t: DataFrame, by: list[str], name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("idx")
    s = t.select(*by, "idx", F.col("lon").alias("x0"), F.col("lat").alias("y0"), F.lead("lon").over(w).alias("x1"), F.lead("lat").over(w).alias("y1")).where("x1 is not null")
    # across the date line: the segment on either side of it
    turn = F.when(F.col("x1") - F.col("x0") > 180, F.lit(-360.0)).when(F.col("x1") - F.col("x0") < -180, F.lit(360.0)).otherwise(F.lit(0.0))
    copies = F.array_distinct(F.array(F.struct(F.lit(0.0).alias("a"), turn.alias("b")), F.struct((-turn).alias("a"), F.lit(0.0).alias("b"))))
    s = s.withColumn("c", F.explode(copies)).withColumns({"x0": F.col("x0") + F.col("c.a"), "x1": F.col("x1") + F.col("c.b")}).drop("c")
    return s.select(*[F.col(c).alias(f"{name}_{c}") for c in by], F.struct("idx", "x0", "y0", "x1", "y1").alias(name))


def _tiles(df: DataFrame, s: str, size: float) -> DataFrame:
    """A row for each tile that the box of a segment meets."""
    r = lambda a, b: F.sequence(F.floor(F.least(f"{s}.{a}", f"{s}.{b}") / size).cast("long"), F.floor(F.greatest(f"{s}.{a}", f"{s}.{b}") / size).cast("long"))
    return df.withColumn("tx", F.explode(r("x0", "x1"))).withColumn("ty", F.explode(r("y0", "y1")))


def find_crossovers(a: DataFrame, b: DataFrame, by: list[str] = (), limit: float | None = None, tile: float = 2.0, spheroid: Spheroid = WGS84, allow_multiple: bool = True) -> DataFrame:
    """Points where tracks of ``a`` and ``b`` cross, with the nearest vertex on either side and its
    distance in metres; with ``limit`` only crossings whose nearest vertices are no farther. With
    ``allow_multiple`` False, a pair of tracks that crosses more than once is an error.

    Segments meet by an equality join on the tiles that they touch."""
    by = list(by)
    p, q = _tiles(_segments(a, by, "p"), "p", tile), _tiles(_segments(b, by, "q"), "q", tile)
    j = p.join(q, ["tx", "ty"])
    dx1, dy1 = F.col("p.x1") - F.col("p.x0"), F.col("p.y1") - F.col("p.y0")
    dx2, dy2 = F.col("q.x1") - F.col("q.x0"), F.col("q.y1") - F.col("q.y0")
    det = dx1 * dy2 - dy1 * dx2
    ex, ey = F.col("q.x0") - F.col("p.x0"), F.col("q.y0") - F.col("p.y0")
    j = j.withColumn("det", det).where("abs(det) > 1e-15").withColumns({"t": (ex * dy2 - ey * dx2) / F.col("det"), "u": (ex * dy1 - ey * dx1) / F.col("det")}).where("t between 0 and 1 and u between 0 and 1")
    lon, lat = F.col("p.x0") + F.col("t") * dx1, F.col("p.y0") + F.col("t") * dy1
    j = j.withColumns({"lon": F.when(F.abs(lon) > 180, F.pmod(lon + 180.0, F.lit(360.0)) - 180.0).otherwise(lon), "lat": lat})

    def vertex(s: str) -> Column:
        d0 = haversine(F.col("lon"), F.col("lat"), F.col(f"{s}.x0"), F.col(f"{s}.y0"), spheroid.mean_radius)
        d1 = haversine(F.col("lon"), F.col("lat"), F.col(f"{s}.x1"), F.col(f"{s}.y1"), spheroid.mean_radius)
        return F.struct(F.least(d0, d1).alias("d"), F.when(d0 <= d1, F.col(f"{s}.idx")).otherwise(F.col(f"{s}.idx") + 1).alias("i"))

    j = j.withColumns({"v": vertex("p"), "w": vertex("q")})
    out = j.select(*[F.col(f"p_{c}").alias(f"{c}_a") for c in by], *[F.col(f"q_{c}").alias(f"{c}_b") for c in by], "lon", "lat", F.col("v.i").alias("idx_a"), F.col("w.i").alias("idx_b"), F.col("v.d").alias("distance_a"), F.col("w.d").alias("distance_b"))
    if limit is not None:
        out = out.where((F.col("distance_a") <= limit) & (F.col("distance_b") <= limit))
    # a crossing in a vertex belongs to two segments, and a segment to several tiles
    names = [f"{c}_{s}" for s in "ab" for c in by]
    key = [F.round("lon", 9).alias("rl"), F.round("lat", 9).alias("rb")]
    out = out.groupBy(*names, *key).agg(*[F.min(c).alias(c) for c in ("lon", "lat", "idx_a", "idx_b", "distance_a", "distance_b")]).drop("rl", "rb")
    if not allow_multiple:
        n = F.count("*").over(Window.partitionBy(*names))
        out = out.withColumn("lon", F.when(n > 1, F.raise_error(F.lit("tracks cross more than once")).cast("double")).otherwise(F.col("lon")))
    return out


def infer_direction(t: DataFrame, by: list[str] = (), first: int = 10) -> DataFrame:
    """prograde or retrograde by the signs of the first steps in longitude; a tie is retrograde."""
    w = Window.partitionBy(*by).orderBy("idx")
    d = t.select(*by, "idx", (F.lead("lon").over(w) - F.col("lon")).alias("d"), F.row_number().over(w).alias("r")).where(F.col("r") <= first)
    s = F.sum(F.when(F.col("d") > 0, 1).when(F.col("d") < 0, -1).otherwise(0))
    return d.groupBy(*by).agg(F.when(s > 0, F.lit("prograde")).otherwise(F.lit("retrograde")).alias("direction"))


def decompose(t: DataFrame, by: list[str] = (), strategy: str = "latitude_bands", south: float = -50.0, north: float = 50.0, min_edge: int = 10, swath_km: float = 0.0) -> DataFrame:
    """Runs of a track: latitude bands (south, middle, north) or stretches of monotonic latitude.
    A first or last run of fewer than ``min_edge`` points joins its neighbour. Each run has its
    index range, box (widened by half a swath) and zone or direction."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy("idx")
    if strategy == "latitude_bands":
        tag = F.when(F.col("lat") < south, F.lit("south")).when(F.col("lat") > north, F.lit("north")).otherwise(F.lit("mid"))
        d = t.withColumn("tag", tag)
    elif strategy == "monotonic":
        step = F.coalesce(F.lead("lat").over(w) - F.col("lat"), F.col("lat") - F.lag("lat").over(w), F.lit(0.0))
        d = t.withColumn("tag", F.when(step >= 0, F.lit("ascending")).otherwise(F.lit("descending")))
    else:
        raise ValueError(f"no strategy {strategy!r}")
    d = d.withColumn("new", F.when(F.coalesce(F.lag("tag").over(w) != F.col("tag"), F.lit(True)), 1).otherwise(0)).withColumn("run", F.sum("new").over(w))
    runs = d.groupBy(*by, "run").agg(F.count("*").alias("n"), F.min("tag").alias("tag"))
    r = Window.partitionBy(*by)
    runs = runs.withColumns({"last": F.max("run").over(r)})
    to = F.when((F.col("run") == 1) & (F.col("n") < min_edge) & (F.col("last") > 1), F.col("run") + 1).when((F.col("run") == F.col("last")) & (F.col("n") < min_edge) & (F.col("last") > 1), F.col("run") - 1).otherwise(F.col("run"))
    runs = runs.withColumn("to", to)
    d = d.drop("tag").join(runs.select(*by, "run", "to"), [*by, "run"])
    tags = runs.where("run = to").select(*by, F.col("to"), "tag")
    half = swath_km / 2 / 111.32
    out = d.groupBy(*by, "to").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n"), F.min("lon").alias("xmin"), F.max("lon").alias("xmax"), F.min("lat").alias("ymin"), F.max("lat").alias("ymax"))
    wide = F.lit(half) / F.greatest(F.cos(F.radians(F.greatest(F.abs("ymin"), F.abs("ymax")))), F.lit(0.05))
    out = out.withColumns({"xmin": F.col("xmin") - wide, "xmax": F.col("xmax") + wide, "ymin": F.greatest(F.col("ymin") - half, F.lit(-90.0)), "ymax": F.least(F.col("ymax") + half, F.lit(90.0))})
    return out.join(tags, [*by, "to"], "left").drop("to")


def merge_by_area(runs: DataFrame, by: list[str], ratio: float = 1.5, most: int = 0) -> DataFrame:
    """Neighbouring runs of ``decompose`` joined, the pair whose common box grows least first, while
    the box is at most ``ratio`` times as large as the two together, or while a track has more than
    ``most`` runs (0: no bound). The larger run gives the tag."""
    box = ["xmin", "ymin", "xmax", "ymax"]
    schema = runs.select(*by, "first", "last", "n", "tag", *box).schema

    def size(b: np.ndarray) -> np.ndarray:
        return np.abs(b[..., 2] - b[..., 0]) * np.abs(np.sin(np.radians(b[..., 3])) - np.sin(np.radians(b[..., 1])))

    def join(g: pd.DataFrame) -> pd.DataFrame:
        rows = g.sort_values("first")[["first", "last", "n", "tag"]].values.tolist()
        b = g.sort_values("first")[box].to_numpy(float)
        while len(rows) > 1:
            both = np.concatenate([np.minimum(b[:-1, :2], b[1:, :2]), np.maximum(b[:-1, 2:], b[1:, 2:])], 1)
            apart = size(b[:-1]) + size(b[1:])
            growth = np.where(apart > 0, size(both) / np.where(apart > 0, apart, 1), np.inf)
            i = int(growth.argmin())
            if not growth[i] <= ratio and not 0 < most < len(rows):
                break
            (first, _, n, tag), (_, last, m, other) = rows[i], rows[i + 1]
            rows[i : i + 2] = [[first, last, n + m, other if m > n else tag]]
            b = np.concatenate([b[:i], both[i : i + 1], b[i + 2 :]])
        out = pd.DataFrame(rows, columns=["first", "last", "n", "tag"])
        return pd.DataFrame({**{c: g[c].iloc[0] for c in by}, **out, **{c: b[:, k] for k, c in enumerate(box)}})[[f.name for f in schema]]

    return runs.select(*[f.name for f in schema]).groupBy(*by).applyInPandas(join, schema)


def filter_by_extent(segments: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    return segments.where((F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin))


def calculate_swath(t: DataFrame, by: list[str], across_km: float = 2.0, half_km: float = 70.0, gap_km: float = 2.0, central: bool = False, spheroid: Spheroid = WGS84) -> DataFrame:
    """Pixels (pixel, x_ac in km, swath_lon, swath_lat) on both sides of each track point: the
    point, on the sphere of its geocentric radius, is turned about the direction of flight."""
    by = list(by)
    half = int(half_km / across_km) - int(gap_km / across_km) + 1 if half_km > gap_km else 1
    p = t.withColumn("e", spheroid.lla_to_ecef(F.col("lon"), F.col("lat"))).select("*", *[F.col(f"e.{c}").alias(c) for c in "xyz"])
    w = Window.partitionBy(*by).orderBy("idx")
    ahead, behind = (lambda c: F.coalesce(F.lead(c).over(w), F.col(c))), (lambda c: F.coalesce(F.lag(c).over(w), F.col(c)))
    p = p.withColumns({f"d{c}": ahead(c) - behind(c) for c in "xyz"})
    size = F.sqrt(sum((F.col(f"d{c}") * F.col(f"d{c}") for c in "xyz"), F.lit(0.0)))
    p = p.withColumn("size", size).where("size > 0").withColumns({f"d{c}": F.col(f"d{c}") / F.col("size") for c in "xyz"})
    # what all pixels of a line share: the parts of its turn along the point, across and along the flight
    p = p.withColumns({"r": spheroid.geocentric_radius(F.col("lat")), "dot": F.col("x") * F.col("dx") + F.col("y") * F.col("dy") + F.col("z") * F.col("dz")})
    p = p.withColumns({f"v{a}": F.col(f"d{b}") * F.col(c) - F.col(f"d{c}") * F.col(b) for a, b, c in ("xyz", "yzx", "zxy")} | {f"u{a}": F.col(f"d{a}") * F.col("dot") for a in "xyz"})
    steps = [j for j in range(-half, half + 1) if j or central]
    pix = F.array(*[F.struct(F.lit(i).alias("pixel"), F.lit((abs(j) - 1) * across_km + gap_km if j else 0.0).alias("ac"), F.lit(float((j > 0) - (j < 0))).alias("side")) for i, j in enumerate(steps)])
    line = [*by, "idx", *[f"{m}{c}" for m in ("", "v", "u") for c in "xyz"]]
    q = p.select(*line, "r", F.explode(pix).alias("k")).select(*line, "r", F.col("k.pixel").alias("pixel"), (F.col("k.ac") * F.col("k.side")).alias("x_ac"))
    q = q.withColumn("angle", F.col("x_ac") * 1000.0 / F.col("r")).withColumns({"c": F.cos("angle"), "s": F.sin("angle")})
    q = q.select(*by, "idx", "pixel", "x_ac", *[(F.col(a) * F.col("c") + F.col(f"v{a}") * F.col("s") + F.col(f"u{a}") * (1 - F.col("c"))).alias(f"q{a}") for a in "xyz"])
    return spheroid.with_lla(q, "qx", "qy", "qz", "swath_lon", "swath_lat").select(*by, "idx", "pixel", "x_ac", "swath_lon", "swath_lat")


def mask_swath(swath: DataFrame, inner_km: float, outer_km: float) -> DataFrame:
    return swath.where(F.abs("x_ac").between(inner_km, outer_km))


def insert_central_pixel(swath: DataFrame, t: DataFrame, by: list[str]) -> DataFrame:
    """The swath with the nadir point of each line as its middle pixel; pixels beyond it move by one."""
    by, half = list(by), F.when(F.col("x_ac") > 0, 1).otherwise(0)
    sides = swath.withColumn("pixel", F.col("pixel") + half)
    lines = swath.where("x_ac < 0").groupBy(*by, "idx").agg((F.max("pixel") + 1).alias("pixel"))
    middle = lines.join(t, [*by, "idx"]).select(*by, "idx", "pixel", F.lit(0.0).alias("x_ac"), F.col("lon").alias("swath_lon"), F.col("lat").alias("swath_lat"))
    return sides.select(*middle.columns).union(middle)


def delta_t(t: DataFrame, by: list[str]) -> DataFrame:
    """The mean time between the points of each track, in the unit of ``time``."""
    return t.groupBy(*by).agg(((F.max("time") - F.min("time")) / F.nullif(F.count("*") - 1, F.lit(0))).alias("delta_t"))


# orbits
def passes(t: DataFrame, by: list[str] = ()) -> DataFrame:
    """Adds ``pass_no``: a new pass begins at each extreme of latitude."""
    w = Window.partitionBy(*by).orderBy("idx")
    up = F.signum(F.coalesce(F.lead("lat").over(w) - F.col("lat"), F.col("lat") - F.lag("lat").over(w)))
    d = t.withColumn("up", up)
    turned = F.when(F.coalesce(F.lag("up").over(w) != F.col("up"), F.lit(True)), 1).otherwise(0)
    return d.withColumn("turned", turned).withColumn("pass_no", F.sum("turned").over(w)).drop("up", "turned")


def rotate_to_first_pass(t: DataFrame, n: int, shift: int) -> DataFrame:
    """Indices turned around the cycle so that ``shift`` becomes 0."""
    return t.withColumn("idx", F.pmod(F.col("idx") - shift, F.lit(n)))


def equator_crossing(t: DataFrame, by: list[str]) -> DataFrame:
    """Where and when each pass crosses the equator, linear between its points."""
    w = Window.partitionBy(*by).orderBy("idx")
    d = t.withColumns({f"{c}1": F.lead(c).over(w) for c in ("lon", "lat", "time")}).where("lat * lat1 <= 0 and lat <> lat1")
    f = F.col("lat") / (F.col("lat") - F.col("lat1"))
    turn = F.pmod(F.col("lon1") - F.col("lon") + 180.0, F.lit(360.0)) - 180.0
    d = d.select(*by, "idx", (F.pmod(F.col("lon") + f * turn + 180.0, F.lit(360.0)) - 180.0).alias("equator_lon"), (F.col("time") + f * (F.col("time1") - F.col("time"))).alias("equator_time"))
    return d.groupBy(*by).agg(F.min_by("equator_lon", "idx").alias("equator_lon"), F.min_by("equator_time", "idx").alias("equator_time"))


def select_pass(t: DataFrame, number: int, box: tuple[float, float, float, float] | None = None, least: int = 5) -> DataFrame:
    """The points of one pass, inside a box if given; none if fewer than ``least``."""
    p = t.where(F.col("pass_no") == number)
    n = p.agg(F.count("*").alias("n")).where(F.col("n") >= least)
    p = p.join(F.broadcast(n), F.lit(True), "left_semi")  # one row
    if box:
        p = p.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    return p


class Orbit:
    """Arithmetic of a repeating orbit."""

    def __init__(self, cycle_us: int, passes_per_cycle: int):
        self.cycle_us, self.passes_per_cycle = cycle_us, passes_per_cycle

    def cycle_duration(self) -> int:
        return self.cycle_us

    def orbit_duration(self) -> float:
        return self.cycle_us / (self.passes_per_cycle / 2)

    def pass_duration(self) -> float:
        """Of one pass, if all take equally long; ``pass_durations`` measures them on a track."""
        return self.cycle_us / self.passes_per_cycle

    @staticmethod
    def pass_durations(t: DataFrame, by: list[str] = ()) -> DataFrame:
        """Of each pass (rows with ``pass_no``) from its first point to that of the next one."""
        starts = t.groupBy(*by, "pass_no").agg(F.min("time").alias("start"), F.max("time").alias("last"))
        after = F.lead("start").over(Window.partitionBy(*by).orderBy("pass_no"))
        return starts.select(*by, "pass_no", (F.coalesce(after, F.col("last")) - F.col("start")).alias("duration"))

    def encode_absolute_pass_number(self, cycle: Column, number: Column) -> Column:
        return F.when(number.between(1, self.passes_per_cycle), (cycle - 1) * self.passes_per_cycle + number)

    def decode_absolute_pass_number(self, absolute: Column) -> Column:
        return F.struct((F.floor((absolute - 1) / self.passes_per_cycle) + 1).cast("long").alias("cycle"), (F.pmod(absolute - 1, F.lit(self.passes_per_cycle)) + 1).alias("pass"))

    def iterate(self, spark, first_us: int, last_us: int) -> DataFrame:
        """(cycle, pass_no, start_us) of every pass that begins in the time given."""
        each = self.cycle_us / self.passes_per_cycle
        n = max(0, math.ceil((last_us - first_us) / each))
        d = spark.range(n).select((F.floor(F.col("id") / self.passes_per_cycle) + 1).cast("long").alias("cycle"), (F.col("id") % self.passes_per_cycle + 1).alias("pass_no"), (F.lit(first_us) + F.floor(F.col("id") * each)).cast("long").alias("start_us"))
        return d


def _resampled(t: DataFrame, axis: str, step: float, spheroid: Spheroid, carry: list[str] = ()) -> DataFrame:
    """(track, k, at, lon, lat, *carry) at every ``step`` of the rising column ``axis``: cubic splines of
    the geocentric coordinates over six points around, ``carry`` linear; each place is joined with
    its window by index."""
    p = t.withColumn("e", spheroid.lla_to_ecef(F.col("lon"), F.col("lat"))).select("track", "idx", F.col(axis).cast("double").alias("s"), "e.x", "e.y", "e.z", *carry)
    w = Window.partitionBy("track").orderBy("idx")
    near = F.collect_list(F.struct("s", "x", "y", "z")).over(w.rowsBetween(-2, 3))
    d = p.withColumns({"w": near, "next": F.lead("s").over(w), "first": F.min("s").over(Window.partitionBy("track")), **{f"{c}1": F.lead(c).over(w) for c in carry}}).where("next is not null")
    k0, k1 = F.ceil((F.col("s") - F.col("first")) / step), F.ceil((F.col("next") - F.col("first")) / step) - 1
    d = d.where(k1 >= k0).select("*", F.explode(F.sequence(k0, k1)).alias("k")).withColumn("at", F.col("first") + F.col("k") * step)

    @F.pandas_udf("struct<x:double,y:double,z:double>")
    def spline(s: pd.Series, at: pd.Series) -> pd.DataFrame:
        out = np.full((len(s), 3), np.nan)
        size = s.map(len).to_numpy()
        for n in np.unique(size):
            i = np.flatnonzero(size == n)
            a = np.array([[[q["s"], q["x"], q["y"], q["z"]] for q in s.iloc[r]] for r in i], float)
            base, scale = a[:, :1, 0], max(float(step), 1e-300)
            for c in range(3):
                out[i, c] = kernels.univariate((a[:, :, 0] - base) / scale, a[:, :, 1 + c], (at.to_numpy()[i] - base[:, 0]) / scale, "c_spline" if n >= 4 else "linear")[0]
        return pd.DataFrame(out, columns=["x", "y", "z"])

    f = (F.col("at") - F.col("s")) / (F.col("next") - F.col("s"))
    d = spheroid.with_lla(d.withColumn("q", spline("w", "at")), "q.x", "q.y", "q.z")
    return d.select("track", "k", "at", "lon", "lat", *[(F.col(c) + f * (F.col(f"{c}1") - F.col(c))).alias(c) for c in carry])


def interpolate_orbit(t: DataFrame, every_us: int, spheroid: Spheroid = WGS84) -> DataFrame:
    """The track resampled every ``every_us``."""
    d = _resampled(t, "time", every_us, spheroid)
    return d.select("track", F.col("k").alias("idx"), F.col("at").cast("long").alias("time"), "lon", "lat")


def _turns(t: DataFrame) -> DataFrame:
    """Adds ``up`` (a southern extreme: the latitude begins to rise) and ``down``, around the cycle."""
    w = Window.partitionBy("track").orderBy("idx")
    ends = t.groupBy("track").agg(F.max_by("lat", "idx").alias("last"))
    d = t.join(ends, "track").withColumn("dy", F.coalesce(F.lag("lat").over(w), F.col("last")) - F.col("lat"))
    final = d.groupBy("track").agg(F.max_by("dy", "idx").alias("dy_last"))
    before = F.coalesce(F.lag("dy").over(w), F.col("dy_last"))
    return d.join(final, "track").withColumns({"up": (F.col("dy") < 0) & (before >= 0), "down": (F.col("dy") > 0) & (before <= 0)}).drop("last", "dy", "dy_last")


def calculate_orbit(t: DataFrame, cycle_us: int | None = None, along_km: float = 2.0, spheroid: Spheroid = WGS84) -> DataFrame:
    """(track, idx, x_al in km, time, lon, lat, pass_no) of one cycle of each track (track, idx, time in
    microseconds, lon, lat): coarse tracks resampled to half a second, clipped to the cycle, turned to
    begin with the first pass (at a southern extreme), measured along the ground by Thomas
    distances and resampled at even distances."""
    t = t.withColumn("lon", F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0)
    coarse = delta_t(t, ["track"]).agg(F.max("delta_t")).first()[0] or 0
    t = interpolate_orbit(t, 500_000, spheroid) if coarse > 500_000 else t.select("track", "idx", "time", "lon", "lat")
    if cycle_us is not None:
        t = t.where(F.col("time") < cycle_us)
    place = F.row_number().over(Window.partitionBy("track").orderBy("idx")) - 1
    t = saved(t.withColumn("idx", place))
    u = _turns(t).where("up").groupBy("track").agg(F.min("idx").alias("a"), F.avg("idx").alias("m"), F.max("idx").alias("b"))
    n = t.groupBy("track").agg(F.count("*").alias("n"), (F.max("time") + F.max(F.when(F.col("idx") == 1, F.col("time"))) - F.min("time")).alias("span"))
    shift = n.join(u, "track", "left").withColumn("shift", F.when(F.col("a") >= F.floor("m"), F.col("b")).otherwise(0)).select("track", "n", "span", "shift")
    start = t.join(shift, "track").where("idx = shift").select("track", F.col("time").alias("t0"))
    d = t.join(shift, "track").join(start, "track").withColumns({"idx": F.pmod(F.col("idx") - F.col("shift"), F.col("n")), "time": F.when(F.col("shift") == 0, F.col("time")).otherwise(F.pmod(F.col("time") - F.col("t0"), F.col("span")))})
    w = Window.partitionBy("track").orderBy("idx")
    step = F.coalesce(spheroid.thomas(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")), F.lit(0.0)) / 1000
    d = d.select("track", "idx", "time", "lon", "lat", "n", step.alias("step")).withColumn("x_al", F.sum("step").over(w)).where(F.col("idx") < F.col("n") - 1)
    out = _resampled(d, "x_al", along_km, spheroid, ["time"]).select("track", F.col("k").alias("idx"), F.col("at").alias("x_al"), F.round("time").cast("long").alias("time"), "lon", "lat")
    return passes(out, ["track"])


def pass_times(t: DataFrame) -> DataFrame:
    """(track, pass_no, time): when each pass of ``calculate_orbit`` begins."""
    return t.groupBy("track", "pass_no").agg(F.min("time").alias("time"))
