"""Geohash codes as bit arithmetic on BIGINT and base-32 strings.

A code of p characters holds 5p bits, longitude in the first, third, ... bit. Up to 12 characters
fit a BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import saved

from .let import let

#: Fixed value: the base-32 alphabet of geohash
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _check(precision: int) -> None:
    if not 1 <= precision <= 12:
        raise ValueError("precision must be 1 to 12")


def cell_size(precision: int) -> tuple[float, float]:
    """Degrees of longitude and latitude of a cell of ``precision`` characters."""
    bits = 5 * precision
    return 360.0 / (1 << -(-bits // 2)), 180.0 / (1 << bits // 2)


def _step(shifted, n: int, mask: int):
    return lambda v: v.bitwiseOR(shifted(v, n)).bitwiseAND(F.lit(mask))


def _spread(x: Column) -> Column:
    """Puts 32 bits on every second place of 64."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = let(x, _step(F.shiftleft, shift, mask))
    return x


def _gather(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = let(x, _step(F.shiftrightunsigned, shift, mask))
    return x


def _quantise(c: Column, half: float) -> Column:
    q = F.floor((c + half) / (2 * half) * F.lit(float(1 << 32))).cast("long")
    return F.greatest(F.least(q, F.lit((1 << 32) - 1)), F.lit(0))


def encode_int(lon: Column, lat: Column, precision: int = 12) -> Column:
    """The code's 5 * precision bits as a BIGINT; longitude is wrapped into [-180, 180)."""
    _check(precision)
    x = F.pmod(lon.cast("double") + 180.0, F.lit(360.0)) - 180.0
    n = 5 * precision
    lon_bits, lat_bits = -(-n // 2), n // 2
    a = F.shiftrightunsigned(_quantise(x, 180.0), 32 - lon_bits)
    b = F.shiftrightunsigned(_quantise(lat.cast("double"), 90.0), 32 - lat_bits)

    def mixed(q: Column) -> Column:
        x, y = _spread(q["a"]), _spread(q["b"])
        return F.shiftleft(x, 1).bitwiseOR(y) if n % 2 == 0 else x.bitwiseOR(F.shiftleft(y, 1))

    return let(F.struct(a.alias("a"), b.alias("b")), mixed)


def int_to_string(code: Column, precision: int) -> Column:
    _check(precision)
    digit = lambda c, i: F.substring(F.lit(ALPHABET), F.shiftright(c, 5 * (precision - 1 - i)).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
    return let(code, lambda c: F.concat(*[digit(c, i) for i in range(precision)]))


def string_to_int(code: Column) -> Column:
    chars = F.filter(F.split(code, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: F.shiftleft(a, 5).bitwiseOR((F.instr(F.lit(ALPHABET), c) - 1).cast("long")))


def encode(lon: Column, lat: Column, precision: int = 12) -> Column:
    return int_to_string(encode_int(lon, lat, precision), precision)


def _box(code: Column, bits: Column) -> Column:
    """lon0, lat0, lon1, lat1 of a code of ``bits`` bits."""
    def parted(c: Column) -> Column:
        shifted, even = F.shiftrightunsigned(c, 1), bits % 2 == 0
        return F.struct(_gather(F.when(even, shifted).otherwise(c)).alias("a"), _gather(F.when(even, c).otherwise(shifted)).alias("b"))

    def edges(q: Column) -> Column:
        dx = F.lit(360.0) / F.pow(F.lit(2.0), F.ceil(bits / 2))
        dy = F.lit(180.0) / F.pow(F.lit(2.0), F.floor(bits / 2))
        x, y = q["a"] * dx - 180.0, q["b"] * dy - 90.0
        return F.struct(x.alias("lon0"), y.alias("lat0"), (x + dx).alias("lon1"), (y + dy).alias("lat1"))

    return let(let(code, parted), edges)


def bounding_box(code: Column) -> Column:
    return _box(string_to_int(code), F.length(code) * 5)


def decode(code: Column, rounded: bool = False) -> Column:
    """The cell's centre; ``rounded`` to the coarsest power of ten that stays inside the cell."""
    def centre(b: Column) -> Column:
        x, y = (b["lon0"] + b["lon1"]) / 2, (b["lat0"] + b["lat1"]) / 2
        if rounded:
            def tidy(c: Column, lo: Column, hi: Column) -> Column:
                p = F.pow(F.lit(10.0), F.floor(F.log10(hi - lo)))
                return F.greatest(F.ceil(lo / p) * p, F.round(c / p) * p)

            x, y = tidy(x, b["lon0"], b["lon1"]), tidy(y, b["lat0"], b["lat1"])
        return F.struct(x.alias("lon"), y.alias("lat"))

    return let(bounding_box(code), centre)


#: Neighbours clockwise from north as steps of (longitude, latitude)
DIRECTIONS = (("N", 0, 1), ("NE", 1, 1), ("E", 1, 0), ("SE", 1, -1), ("S", 0, -1), ("SW", -1, -1), ("W", -1, 0), ("NW", -1, 1))


def neighbors(code: Column, precision: int) -> Column:
    """The eight cells around, clockwise from north; longitude wraps, latitude stops at the poles."""
    dx, dy = cell_size(precision)
    at = lambda c, i, j: encode(c["lon"] + i * dx, F.greatest(F.least(c["lat"] + j * dy, F.lit(90.0 - dy / 2)), F.lit(-90.0 + dy / 2)), precision)
    return let(decode(code), lambda c: F.array(*[at(c, i, j) for _, i, j in DIRECTIONS]))


def area(code: Column, a: float = 6378137.0, f: float = 1 / 298.257223563) -> Column:
    """Square metres of the cell on the spheroid: a strip between two latitudes, closed form."""
    e = (f * (2 - f)) ** 0.5

    def q(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        return (1 - e * e) * (s / (1 - e * e * s * s) + F.log((1 + e * s) / (1 - e * s)) / (2 * e))

    return let(bounding_box(code), lambda b: F.lit(a * a / 2) * F.radians(b["lon1"] - b["lon0"]) * F.abs(q(b["lat1"]) - q(b["lat0"])))


def grid_properties(df: DataFrame, lon0: str, lat0: str, lon1: str, lat1: str, precision: int) -> DataFrame:
    """The first cell and the number of cells each way that cover the box of each row."""
    dx, dy = cell_size(precision)
    ix = lambda c: F.floor((F.col(c) + 180.0) / dx).cast("long")
    iy = lambda c: F.least(F.floor((F.col(c) + 90.0) / dy).cast("long"), F.lit(round(180 / dy) - 1))
    return df.withColumns({"ix0": ix(lon0), "iy0": iy(lat0), "nx": ix(lon1) - ix(lon0) + 1, "ny": iy(lat1) - iy(lat0) + 1})


def cover_boxes(df: DataFrame, lon0: str, lat0: str, lon1: str, lat1: str, precision: int) -> DataFrame:
    """A row for each cell that meets the box of each row, by latitude then longitude, in ``code``."""
    dx, dy = cell_size(precision)
    g = grid_properties(df, lon0, lat0, lon1, lat1, precision)
    g = g.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)).alias("j")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)).alias("i"))
    x, y = (F.col("ix0") + F.col("i") + 0.5) * dx - 180.0, (F.col("iy0") + F.col("j") + 0.5) * dy - 90.0
    return g.withColumn("code", encode(x, y, precision)).drop("ix0", "iy0", "nx", "ny")


def cover_shapes(df: DataFrame, shape: str, precision: int) -> DataFrame:
    """A row for each cell that meets the area of each row's geometry: cells of its box, less those
    that do not intersect it."""
    from tessera.operators import geometry, noding

    b = geometry.bounds(F.col(shape))
    names = ("__x0", "__y0", "__x1", "__y1")
    own = F.explode(F.array(F.struct(*[b[c].alias(n) for n, c in zip(names, ("xmin", "ymin", "xmax", "ymax"), strict=True)])))  # once a row
    d = df.select("*", own.alias("__b")).select(*df.columns, "__b.*")
    dx, dy = cell_size(precision)
    x = (F.floor((F.col("__x0") + 180.0) / dx) + F.col("i")) * dx - 180.0
    y = (F.least(F.floor((F.col("__y0") + 90.0) / dy), F.lit(180 / dy - 1)) + F.col("j")) * dy - 90.0
    cell = geometry.box(x, y, x + dx, y + dy)
    d = cover_boxes(d, *names, precision).select(*df.columns, "code", F.explode(F.array(cell)).alias("__cell"))
    d = saved(d.withColumn("__pair", F.monotonically_increasing_id()))
    met = noding.relations(d, ["__pair"], shape, "__cell")
    met = met.where(noding.predicate("intersects", F.col("relation"), F.col("dim_a"), F.col("dim_b"))).select("__pair")
    return d.join(met, "__pair", "left_semi").drop("__cell", "__pair")


def zoom_out(df: DataFrame, code: str, precision: int) -> DataFrame:
    return df.select(F.substring(code, 1, precision).alias("code")).distinct()


def zoom_in(df: DataFrame, code: str, precision: int) -> DataFrame:
    """Each code's children of ``precision`` characters."""
    out = df.select(F.col(code).alias("code"))
    letters = F.array(*[F.lit(c) for c in ALPHABET])
    for n in range(1, 13):
        if n > precision:
            break
        out = out.select(F.explode(F.when(F.length("code") < n, F.transform(letters, lambda c: F.concat("code", c))).otherwise(F.array("code"))).alias("code"))
    return out


def where(df: DataFrame, code: str, row: str, column: str) -> DataFrame:
    """For each code the bounds of the rows and columns where it stands in a raster."""
    return df.groupBy(F.col(code).alias("code")).agg(F.min(row).alias("i0"), F.max(row).alias("i1"), F.min(column).alias("j0"), F.max(column).alias("j1"))


def to_raster(df: DataFrame, code: str, value: str, precision: int) -> DataFrame:
    """Cells (ix, iy, lon, lat, value) of the raster of all codes of one precision; of equal codes the sum."""
    dx, dy = cell_size(precision)
    c = decode(F.col("code"))
    out = df.groupBy(F.col(code).alias("code")).agg(F.sum(value).alias("value")).withColumn("c", c)
    return out.select(F.floor((F.col("c.lon") + 180) / dx).cast("long").alias("ix"), F.floor((F.col("c.lat") + 90) / dy).cast("long").alias("iy"), F.col("c.lon").alias("lon"), F.col("c.lat").alias("lat"), "value")
