"""Interval algebra over the sample tables: each event as a ten-minute interval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import period

from .base import register, table

TEN = 600_000_000


def intervals(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", us.alias("begin"), (us + TEN - 1).alias("last"))


_P = "p AS (SELECT event_id, user_id, epoch_us(ts) AS b, epoch_us(ts) + 600000000 - 1 AS l FROM events)"
_ISLANDS = _P + """, m AS (SELECT *, max(l) OVER (PARTITION BY user_id ORDER BY b, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM p),
k AS (SELECT *, sum(CASE WHEN far IS NULL OR b > far + 1 + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY b, l) AS isl FROM m),
i AS (SELECT user_id, min(b) AS begin_, max(l) AS last_, count(*) AS n FROM k GROUP BY user_id, isl)"""


@register("WITH " + _ISLANDS.replace("{gap}", "3600000000") + " SELECT user_id, begin_ AS begin, last_ AS last, n FROM i")
def period_join_adjacent(spark, sf_dir):
    return period.islands(intervals(spark, sf_dir), ["user_id"], 3_600_000_000)


@register("WITH " + _ISLANDS.replace("{gap}", "0") + " SELECT user_id, sum(last_ + 1 - begin_)::BIGINT AS covered FROM i GROUP BY user_id")
def period_coverage(spark, sf_dir):
    return period.coverage(intervals(spark, sf_dir), ["user_id"])


@register("WITH " + _ISLANDS.replace("{gap}", "0") + """, t AS (SELECT event_id, user_id, epoch_us(ts) + 900000000 AS t FROM events)
SELECT event_id, i.begin_ AS p_begin, i.last_ AS p_last, i.begin_ IS NOT NULL AS belongs FROM t LEFT JOIN i ON i.user_id = t.user_id AND t.t BETWEEN i.begin_ AND i.last_""")
def period_find_containing(spark, sf_dir):
    p = intervals(spark, sf_dir)
    pts = p.select("event_id", "user_id", (F.col("begin") + 900_000_000).alias("t"))
    out = period.find_containing(pts, "t", period.islands(p, ["user_id"]), ["user_id"])
    return out.select("event_id", "p_begin", "p_last", F.col("p_begin").isNotNull().alias("belongs"))


@register("WITH " + _P + """, q AS (SELECT *, lead(b) OVER w AS b2, lead(l) OVER w AS l2 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY b, event_id))
SELECT event_id, l + 1 - b AS duration, coalesce(b <= l2 AND b2 <= l, false) AS meets, coalesce(b2 = l + 1 OR b = l2 + 1, false) AS adjacent,
CASE WHEN b <= l2 AND b2 <= l THEN least(l, l2) - greatest(b, b2) + 1 END AS common, CASE WHEN (b <= l2 AND b2 <= l) OR b2 = l + 1 THEN greatest(l, l2) - least(b, b2) + 1 END AS merged FROM q""")
def period_algebra(spark, sf_dir):
    """Each interval and the next one of its user."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("begin", "event_id")
    d = intervals(spark, sf_dir).withColumn("p", F.struct("begin", "last")).withColumn("q", F.lead("p").over(w))
    p, q = F.col("p"), F.col("q")
    size = lambda x: x["last"] - x["begin"] + 1
    return d.select("event_id", period.duration(p).alias("duration"), F.coalesce(period.intersects(p, q), F.lit(False)).alias("meets"), F.coalesce(period.is_adjacent(p, q), F.lit(False)).alias("adjacent"), size(period.intersection(p, q)).alias("common"), size(period.merge(p, q)).alias("merged"))


@register("WITH " + _P + """, a AS (SELECT user_id, b, l FROM p WHERE event_id % 2 = 0 UNION ALL SELECT user_id, b + 300000000, l + 300000000 FROM p WHERE event_id % 2 = 1),
m AS (SELECT *, max(l) OVER (PARTITION BY user_id ORDER BY b, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM a),
k AS (SELECT *, sum(CASE WHEN far IS NULL OR b > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY b, l) AS isl FROM m)
SELECT user_id, min(b) AS begin, max(l) AS last, count(*) AS n FROM k GROUP BY user_id, isl""")
def period_union(spark, sf_dir):
    p = intervals(spark, sf_dir)
    odd = p.where("event_id % 2 = 1").selectExpr("user_id", "begin + 300000000 as begin", "last + 300000000 as last")
    return period.union(p.where("event_id % 2 = 0"), odd, ["user_id"])


@register("WITH " + _P + """, t AS (SELECT event_id, user_id, b AS t FROM p), e AS (SELECT user_id, max(t) AS tm FROM t GROUP BY 1),
f AS (SELECT p.user_id, max(p.l) - 7200000000 AS far FROM p JOIN e ON e.user_id = p.user_id AND p.b - 7200000000 <= e.tm GROUP BY 1)
SELECT event_id, coalesce(far >= t, false) AS crosses FROM t LEFT JOIN f ON f.user_id = t.user_id""")
def period_crosses(spark, sf_dir):
    """Every event as a point, against all intervals moved two hours back."""
    p = intervals(spark, sf_dir)
    pts = p.select("event_id", "user_id", F.col("begin").alias("t"))
    moved = p.select("user_id", (F.col("begin") - 7_200_000_000).alias("begin"), (F.col("last") - 7_200_000_000).alias("last"))
    return period.crosses(pts, "t", moved, ["user_id"]).select("event_id", "crosses")


@register("WITH " + _P + " SELECT user_id, bool_and(ok) AS ok FROM (SELECT user_id, coalesce(b > lag(l) OVER (PARTITION BY user_id ORDER BY event_id), true) AS ok FROM p) GROUP BY 1")
def period_sorted_disjoint(spark, sf_dir):
    return period.is_sorted_and_disjoint(intervals(spark, sf_dir), "event_id", ["user_id"])
