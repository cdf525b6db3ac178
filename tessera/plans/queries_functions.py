"""Dates, geohash and geodesy over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dates, geodesy, geohash
from tessera.functions.geodesy import WGS84

from .base import andoyer_sql, register, table

POINT = ("cast((c_custkey * 37) % 360 - 180 as double) + 0.125 as lon", "cast((c_custkey * 17) % 179 - 89 as double) + 0.0625 as lat")
SQL_POINT = "((c_custkey * 37) % 360 - 180)::DOUBLE + 0.125 AS lon, ((c_custkey * 17) % 179 - 89)::DOUBLE + 0.0625 AS lat"


def points(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", *POINT)


@register("""SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second, isoyear(ts)::INT AS iso_year, week(ts)::INT AS iso_week,
isodow(ts)::INT AS iso_weekday, dayofweek(ts)::INT AS weekday, epoch_us(ts) - epoch_us(date_trunc('year', ts)) AS since_january FROM events""")
def date_parts(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", dates.date(ts).alias("d"), dates.time(ts).alias("t"), dates.isocalendar(ts).alias("i"), dates.weekday(ts).alias("weekday"), dates.since_january(ts).alias("since_january")).select("event_id", "d.*", "t.*", F.col("i.iso_year").cast("int").alias("iso_year"), "i.iso_week", "i.iso_weekday", "weekday", "since_january")


_BITS = """, lon_q AS (SELECT *, (floor((lon + 180) / 360 * 4294967296))::BIGINT AS qx, (floor((lat + 90) / 180 * 4294967296))::BIGINT AS qy FROM p),
bits AS (SELECT c_custkey, list_sum(list_transform(range(0, {n}), lambda k: (CASE WHEN k % 2 = 0 THEN (qx >> (31 - k // 2)) & 1 ELSE (qy >> (31 - k // 2)) & 1 END)::BIGINT << ({n} - 1 - k)))::BIGINT AS code FROM lon_q)"""


@register("WITH p AS (SELECT c_custkey, " + SQL_POINT + " FROM customer)" + _BITS.replace("{n}", "30") + """
SELECT c_custkey, code, array_to_string(list_transform(range(0, 6), lambda i: substr('0123456789bcdefghjkmnpqrstuvwxyz', ((code >> (5 * (5 - i))) & 31)::INT + 1, 1)), '') AS hash FROM bits""")
def geohash_encode(spark, sf_dir):
    lon, lat = F.col("lon"), F.col("lat")
    return points(spark, sf_dir).select("c_custkey", geohash.encode_int(lon, lat, 6).alias("code"), geohash.encode(lon, lat, 6).alias("hash"))


def _once(c):
    """The fields of a struct as columns; a struct that is only selected from is worked out for each of them."""
    return F.inline(F.array(c))


@register("WITH p AS (SELECT c_custkey, " + SQL_POINT + """ FROM customer)
SELECT c_custkey, round((floor((lon + 180) / (360.0 / 8388608)) + 0.5) * (360.0 / 8388608) - 180, 9) AS lon, round((floor((lat + 90) / (180.0 / 4194304)) + 0.5) * (180.0 / 4194304) - 90, 9) AS lat FROM p""")
def geohash_decode(spark, sf_dir):
    c = points(spark, sf_dir).select("c_custkey", _once(geohash.decode(geohash.encode(F.col("lon"), F.col("lat"), 9))))
    return c.select("c_custkey", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


@register("WITH p AS (SELECT c_custkey, " + SQL_POINT + """ FROM customer), g AS (SELECT c_custkey, floor((lon + 180) / 11.25)::BIGINT AS i, floor((lat + 90) / 5.625)::BIGINT AS j FROM p)
SELECT i, j, count(*) AS n FROM g GROUP BY 1, 2""")
def geohash_zoom_out(spark, sf_dir):
    """Two characters of a longer code are the coarser cell: counts by cell."""
    p = points(spark, sf_dir).select(F.substring(geohash.encode(F.col("lon"), F.col("lat"), 8), 1, 2).alias("code"), F.lit(1).alias("one"))
    return geohash.to_raster(p, "code", "one", 2).select(F.col("ix").alias("i"), F.col("iy").alias("j"), F.col("value").cast("long").alias("n"))


@register("""WITH b AS (SELECT n_nationkey, (n_nationkey * 13 % 340 - 170)::DOUBLE AS x, (n_nationkey * 7 % 150 - 75)::DOUBLE AS y FROM nation)
SELECT n_nationkey, ((floor((x + 6 + 180) / 1.40625) - floor((x + 180) / 1.40625) + 1) * (floor((y + 4 + 90) / 1.40625) - floor((y + 90) / 1.40625) + 1))::BIGINT AS cells FROM b""")
def geohash_cover(spark, sf_dir):
    b = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "cast(n_nationkey * 13 % 340 - 170 as double) x0", "cast(n_nationkey * 7 % 150 - 75 as double) y0").selectExpr("*", "x0 + 6 x1", "y0 + 4 y1")
    return geohash.cover_boxes(b, "x0", "y0", "x1", "y1", 3).groupBy("n_nationkey").agg(F.countDistinct("code").alias("cells"))


@register("WITH p AS (SELECT c_custkey, " + SQL_POINT + """ FROM customer), k AS (SELECT 0.0818191908426215 AS e, 6378137.0 AS a),
b AS (SELECT c_custkey, floor((lat + 90) / 5.625) * 5.625 - 90 AS y0 FROM p),
q AS (SELECT c_custkey, e, a, sin(radians(y0)) AS s, sin(radians(y0 + 5.625)) AS t FROM b, k)
SELECT c_custkey, round(a * a / 2 * radians(11.25) * (1 - e * e) * ((t / (1 - e * e * t * t) + ln((1 + e * t) / (1 - e * t)) / (2 * e)) - (s / (1 - e * e * s * s) + ln((1 + e * s) / (1 - e * s)) / (2 * e))) / 1e6, 2) AS km2 FROM q""")
def geohash_area(spark, sf_dir):
    return points(spark, sf_dir).select("c_custkey", F.round(geohash.area(geohash.encode(F.col("lon"), F.col("lat"), 2)) / 1e6, 2).alias("km2"))


@register("WITH p AS (SELECT c_custkey, " + SQL_POINT + """ FROM customer), g AS (SELECT c_custkey, floor((lon + 180) / 1.40625)::BIGINT AS i, floor((lat + 90) / 1.40625)::BIGINT AS j FROM p)
SELECT c_custkey, d.k::INT AS k, ((i + dx + 256) % 256)::BIGINT AS i, greatest(least(j + dy, 127), 0)::BIGINT AS j FROM g, (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, -1), (5, -1, -1), (6, -1, 0), (7, -1, 1)) d(k, dx, dy)""")
def geohash_neighbors(spark, sf_dir):
    n = points(spark, sf_dir).select("c_custkey", F.posexplode(geohash.neighbors(geohash.encode(F.col("lon"), F.col("lat"), 3), 3)).alias("k", "code"))
    c = n.select("c_custkey", "k", _once(geohash.decode(F.col("code"))))
    return c.select("c_custkey", "k", F.floor((F.col("lon") + 180) / 1.40625).cast("long").alias("i"), F.floor((F.col("lat") + 90) / 1.40625).cast("long").alias("j"))


@register("WITH p AS (SELECT c_custkey, c_acctbal AS h, " + SQL_POINT + """ FROM customer), q AS (SELECT *, 6378137.0 / sqrt(1 - 0.006694379990141316 * sin(radians(lat)) ** 2) AS n FROM p)
SELECT c_custkey, round((n + h) * cos(radians(lat)) * cos(radians(lon)), 3) AS x, round((n + h) * cos(radians(lat)) * sin(radians(lon)), 3) AS y, round((n * (1 - 0.006694379990141316) + h) * sin(radians(lat)), 3) AS z,
round(lon, 9) AS lon, round(lat, 9) AS lat, round(h, 4) AS alt FROM q""")
def geocentric_round_trip(spark, sf_dir):
    p = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_acctbal as h", *POINT)
    e = p.withColumn("e", WGS84.lla_to_ecef(F.col("lon"), F.col("lat"), F.col("h")))
    back = WGS84.ecef_to_lla(F.col("e.x"), F.col("e.y"), F.col("e.z"))
    e = e.select("c_custkey", "e", back.alias("b"))
    return e.select("c_custkey", *[F.round(F.col(f"e.{c}"), 3).alias(c) for c in "xyz"], F.round("b.lon", 9).alias("lon"), F.round("b.lat", 9).alias("lat"), F.round("b.alt", 4).alias("alt"))


@register("WITH p AS (SELECT c_custkey, " + SQL_POINT + """ FROM customer), q AS (SELECT *, lead(lon, 1, 0.0) OVER (ORDER BY c_custkey) AS lon2, lead(lat, 1, 0.0) OVER (ORDER BY c_custkey) AS lat2 FROM p)
SELECT c_custkey, round(2 * 6371008.771415059 * asin(sqrt(least(1.0, sin(radians(lat2 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(lat2)) * sin(radians(lon2 - lon) / 2) ** 2))), 2) AS haversine FROM q""")
def great_circle_distance(spark, sf_dir):
    """Each point to the point of the next key."""
    p = points(spark, sf_dir)
    n = p.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    q = p.join(n, "c_custkey", "left").fillna(0.0, ["lon2", "lat2"])
    return q.select("c_custkey", F.round(geodesy.haversine(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 2).alias("haversine"))


@register(f"""WITH RECURSIVE k AS MATERIALIZED (SELECT 1 / 298.257223563 AS f, 6378137.0 AS a, 6378137.0 * (1 - 1 / 298.257223563) AS b),
p AS MATERIALIZED (SELECT c_custkey AS id, lon, lat, radians((2.0 - lon + 540) % 360 - 180) AS dl, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2
  FROM (SELECT *, atan((1 - f) * tan(radians(lat))) AS u1, atan((1 - f) * tan(radians(48.0))) AS u2 FROM (SELECT c_custkey, {SQL_POINT} FROM customer), k)),
r AS (SELECT 0 AS n, id, dl, s1, c1, s2, c2, dl AS lam, false AS done FROM p UNION ALL
  SELECT n + 1, id, dl, s1, c1, s2, c2, new, abs(new - lam) < 1e-12 FROM (SELECT *, dl + (1 - k) * f * sa * (sig + k * ss * (cm + k * cs * (2 * cm * cm - 1))) AS new FROM (
    SELECT *, f / 16 * ca2 * (4 + f * (4 - 3 * ca2)) AS k, CASE WHEN ca2 > 1e-15 THEN cs - 2 * s1 * s2 / ca2 ELSE 0 END AS cm FROM (
      SELECT *, 1 - sa * sa AS ca2, atan2(ss, cs) AS sig FROM (
        SELECT *, CASE WHEN ss > 0 THEN c1 * c2 * sin(lam) / ss ELSE 0 END AS sa FROM (
          SELECT r.*, f, sqrt((c2 * sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * cos(lam)) ** 2) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM r, k WHERE n < 100))))) ),
v AS (SELECT r.*, a, b, f, lon, lat, sqrt((c2 * sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * cos(lam)) ** 2) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM (SELECT r.*, p.lon, p.lat FROM r JOIN p USING (id) WHERE n = 100) r, k),
w AS (SELECT *, CASE WHEN ss > 0 THEN c1 * c2 * sin(lam) / ss ELSE 0 END AS sa, atan2(ss, cs) AS sig FROM v),
x AS (SELECT *, CASE WHEN 1 - sa * sa > 1e-15 THEN cs - 2 * s1 * s2 / (1 - sa * sa) ELSE 0 END AS cm, (1 - sa * sa) * (a * a - b * b) / (b * b) AS w2 FROM w),
y AS (SELECT *, 1 + w2 / 16384 * (4096 + w2 * (-768 + w2 * (320 - 175 * w2))) AS big, w2 / 1024 * (256 + w2 * (-128 + w2 * (74 - 47 * w2))) AS small FROM x),
z AS (SELECT *, radians(lat) AS y1, radians(48.0) AS y2 FROM y),
g AS (SELECT id, round(CASE WHEN ss = 0 THEN 0 WHEN done THEN b * big * (sig - small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3))))
  ELSE (2 * a + b) / 3 * acos(greatest(least(sin(y1) * sin(y2) + cos(y1) * cos(y2) * cos(dl), 1), -1)) END, 3) AS vincenty,
  CASE WHEN done THEN atan2(c2 * sin(lam), c1 * s2 - s1 * c2 * cos(lam)) ELSE atan2(cos(y2) * sin(dl), cos(y1) * sin(y2) - sin(y1) * cos(y2) * cos(dl)) END AS az FROM z)
SELECT id AS c_custkey, round({andoyer_sql('lon', 'lat', '2.0', '48.0')}, 1) AS andoyer, vincenty, round(CASE WHEN az < 0 THEN az + 2 * pi() ELSE az END, 9) AS azimuth FROM g JOIN p USING (id)""")
def geodesic_distance(spark, sf_dir):
    """Andoyer and Vincenty distances of each point to one meridian point."""
    p = points(spark, sf_dir)
    args = (F.col("lon"), F.col("lat"), F.lit(2.0), F.lit(48.0))
    v = p.select("c_custkey", WGS84.andoyer(*args).alias("andoyer"), WGS84.vincenty(*args).alias("v"))
    return v.select("c_custkey", F.round("andoyer", 1).alias("andoyer"), F.round("v.distance", 3).alias("vincenty"), F.round("v.azimuth", 9).alias("azimuth"))
