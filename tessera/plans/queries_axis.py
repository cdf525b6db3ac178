"""Axis lookups, moments, quantiles and binning over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import digest, stats
from tessera.operators.axis import Axis, TemporalAxis
from tessera.session import scratch_path
from tessera.sources import state as saved_state
from tessera.streaming import digests

from .base import register, table

QUANTITY = Axis.linspace(0.0, 4.0, 13)  # 0..48
SIZES = Axis((1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 50.0))
CIRCLE = Axis.linspace(-180.0, 10.0, 36, 360.0)
DISCOUNT = Axis.linspace(0.0, 0.02, 6)
CELLS = Axis.linspace(0.0, 10.0, 6)
DAYS = TemporalAxis.from_range(1_704_067_200_000_000, 86_400_000_000, 31)
LON = "((c_custkey * 37) % 360 - 180)"


def _round(*cols, digits=6):
    return [F.round(F.col(c), digits).alias(c) for c in cols]


@register("""SELECT l_orderkey, l_linenumber, CASE WHEN round(l_quantity / 4.0) BETWEEN 0 AND 12 THEN round(l_quantity / 4.0)::BIGINT ELSE -1 END AS idx,
greatest(least(round(l_quantity / 4.0)::BIGINT, 12), 0) AS idx_bounded FROM lineitem""")
def axis_find_index(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", QUANTITY.find_index(q).alias("idx"), QUANTITY.find_index(q, True).alias("idx_bounded"))


@register("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 48 THEN floor(l_quantity / 4.0)::BIGINT WHEN l_quantity = 48 THEN 11 END AS i0,
CASE WHEN l_quantity < 48 THEN floor(l_quantity / 4.0)::BIGINT + 1 WHEN l_quantity = 48 THEN 12 END AS i1 FROM lineitem""")
def axis_find_indexes(spark, sf_dir):
    p = QUANTITY.find_indexes(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", p["i0"].alias("i0"), p["i1"].alias("i1"))


@register("""WITH a(i, v) AS (VALUES (0, 1.0), (1, 2.0), (2, 4.0), (3, 8.0), (4, 16.0), (5, 32.0), (6, 50.0))
SELECT p_partkey, (SELECT arg_min(i, abs(v - p_size) * 1000 - i) FROM a)::BIGINT AS idx,
CASE WHEN p_size = 50 THEN 5 ELSE (SELECT max(i) FROM a WHERE v <= p_size) END::BIGINT AS i0 FROM part""")
def axis_irregular(spark, sf_dir):
    c = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", SIZES.find_index(c).alias("idx"), SIZES.find_indexes(c)["i0"].alias("i0"))


@register(f"""SELECT c_custkey, (round(({LON} + 180) / 10.0)::BIGINT % 36) AS idx, floor(({LON} + 180) / 10.0)::BIGINT AS i0, ((floor(({LON} + 180) / 10.0)::BIGINT + 1) % 36) AS i1 FROM customer""")
def axis_periodic(spark, sf_dir):
    c = F.expr(LON).cast("double") + 720.0
    p = CIRCLE.find_indexes(c)
    return table(spark, sf_dir, "customer").select("c_custkey", CIRCLE.find_index(c).alias("idx"), p["i0"].alias("i0"), p["i1"].alias("i1"))


@register("""WITH b AS (SELECT p_partkey, CASE WHEN p_size < 48 THEN p_size // 4 WHEN p_size = 48 THEN 11 END AS i FROM part)
SELECT p_partkey, CASE WHEN i - 1 >= 0 AND i + 2 <= 12 THEN concat_ws(',', i - 1, i, i + 1, i + 2) END AS undef_,
CASE WHEN i IS NOT NULL THEN array_to_string(list_filter([i - 1, i, i + 1, i + 2], lambda x: x BETWEEN 0 AND 12), ',') END AS shrink,
CASE WHEN i IS NOT NULL THEN array_to_string(list_transform([i - 1, i, i + 1, i + 2], lambda x: greatest(least(x, 12), 0)), ',') END AS expand FROM b""")
def axis_window(spark, sf_dir):
    c, text = F.col("p_size"), lambda a: F.concat_ws(",", F.transform(a, lambda x: x.cast("string")))
    named = lambda b: F.when(QUANTITY.window(c, 2, b).isNotNull(), text(QUANTITY.window(c, 2, b)))
    return table(spark, sf_dir, "part").select("p_partkey", named("undef").alias("undef_"), named("shrink").alias("shrink"), named("expand").alias("expand"))


@register("""SELECT event_id, round((epoch_us(ts) - 1704067200000000) / 86400000000.0)::BIGINT AS idx, floor((epoch_us(ts) - 1704067200000000) / 86400000000.0)::BIGINT AS i0 FROM events""")
def axis_temporal(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", DAYS.find_time_index(ts).alias("idx"), DAYS.find_time_indexes(ts)["i0"].alias("i0"))


_MOMENTS = """round(sum(w), 4) AS sum_of_weights, round(sum(w * x), 2) AS sum, round(sum(w * x) / sum(w), 6) AS mean, min(x) AS min, max(x) AS max"""


@register(f"""WITH d AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS x, l_quantity AS w FROM lineitem),
m AS (SELECT l_returnflag, l_linestatus, sum(w * x) / sum(w) AS mu FROM d GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, count(*) AS count, {_MOMENTS},
round(sum(w * (x - mu) ** 2) / sum(w) / 1e6, 4) AS variance, round((sum(w * (x - mu) ** 3) / sum(w)) / (sum(w * (x - mu) ** 2) / sum(w)) ** 1.5, 6) AS skewness,
round((sum(w * (x - mu) ** 4) / sum(w)) / (sum(w * (x - mu) ** 2) / sum(w)) ** 2 - 3, 6) AS kurtosis
FROM d JOIN m USING (l_returnflag, l_linestatus) GROUP BY l_returnflag, l_linestatus""")
def stats_weighted(spark, sf_dir):
    out = stats.describe(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"], "l_quantity")
    return out.select("l_returnflag", "l_linestatus", "count", *_round("sum_of_weights", digits=4), *_round("sum", digits=2), *_round("mean"), "min", "max", F.round(F.col("variance") / 1e6, 4).alias("variance"), *_round("skewness", "kurtosis"))


@register("""WITH d AS (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS x FROM events), m AS (SELECT avg(x) AS mu FROM d)
SELECT count(x) AS count, round(sum(x), 4) AS sum, round(avg(x), 6) AS mean, min(x) AS min, max(x) AS max, round(var_samp(x), 4) AS variance,
round((sum((x - mu) ** 3) / count(x)) / var_pop(x) ** 1.5, 6) AS skewness, round(kurtosis_pop(x), 6) AS kurtosis FROM d, m""")
def stats_merged(spark, sf_dir):
    """Partial states by day, merged: missing samples skipped, as NULL and as NaN."""
    x = F.when(F.col("event_id") % 20 == 0, F.lit(float("nan"))).when(F.col("event_id") % 10 == 0, None).otherwise(F.col("value"))
    states = stats.state(table(spark, sf_dir, "events").select(x.alias("x"), F.to_date("ts").alias("day")), "x", ["day"])
    out = stats.merged(states, ddof=1)
    return out.select("count", *_round("sum", digits=4), *_round("mean"), "min", "max", *_round("variance", digits=4), *_round("skewness", "kurtosis"))


@register("""SELECT event_type, count(value) AS count, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(var_samp(value), 4) AS variance FROM events GROUP BY 1""")
def state_saved(spark, sf_dir):
    """States of even and odd events, committed one after the other, read back and merged."""
    d, path = table(spark, sf_dir, "events"), scratch_path(spark, "state")
    for k in (0, 1):
        part = d.where(F.pmod("event_id", F.lit(2)) == k) if k else d.where((F.pmod("event_id", F.lit(2)) == 0) | F.col("event_id").isNull())
        saved_state.save(stats.state(part, "value", ["event_type"]), path, append=k > 0)
    out = stats.merged(saved_state.load(spark, path), ["event_type"], ddof=1)
    return out.select("event_type", "count", *_round("sum", digits=4), *_round("mean"), "min", "max", *_round("variance", digits=4))


@register("""SELECT o_orderpriority, count(*) AS count, round(quantile_cont(o_totalprice, 0.1), 4) AS q10, round(quantile_cont(o_totalprice, 0.5), 4) AS q50,
round(quantile_cont(o_totalprice, 0.99), 4) AS q99, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1""")
def quantiles_exact(spark, sf_dir):
    out = stats.quantiles(table(spark, sf_dir, "orders"), "o_totalprice", [0.1, 0.5, 0.99], ["o_orderpriority"], None)
    return out.select("o_orderpriority", "count", *_round("q10", "q50", "q99", digits=4), "min", "max")


@register("""WITH d AS (SELECT o_orderstatus AS g, 1000000 + (o_totalprice - 150000) / 90000 AS x, o_custkey % 7 AS w FROM orders), m AS (SELECT g, sum(w * x) / sum(w) AS mu FROM d GROUP BY g), c AS (SELECT g, w, x - mu AS e, mu FROM d JOIN m USING (g))
SELECT g, count(*) AS count, round(any_value(mu), 6) AS mean, round(sum(w * e * e) / sum(w), 6) AS variance, round(sqrt(sum(w * e * e) / sum(w)), 6) AS std,
round(sum(w * e ** 3) / sum(w) / (sum(w * e * e) / sum(w)) ** 1.5, 4) AS skewness, round(sum(w * e ** 4) / sum(w) / (sum(w * e * e) / sum(w)) ** 2 - 3, 4) AS kurtosis FROM c GROUP BY g""")
def stats_large_mean(spark, sf_dir):
    """Weighted moments of a small spread about a large mean, from states of parts that are merged."""
    d = table(spark, sf_dir, "orders").selectExpr("o_orderstatus as g", "1000000 + (o_totalprice - 150000) / 90000 as x", "cast(o_custkey % 7 as double) as w", "o_orderpriority as part")
    out = stats.merged(stats.state(d, "x", ["g", "part"], "w"), ["g"])
    return out.select("g", "count", *_round("mean", "variance", "std"), *_round("skewness", "kurtosis", digits=4))


@register("""WITH d AS (SELECT o_orderpriority AS g, 1000000 + (o_totalprice - 150000) / 90000 AS x FROM orders), m AS (SELECT g, avg(x) AS mu FROM d GROUP BY g), c AS (SELECT g, x - mu AS e FROM d JOIN m USING (g))
SELECT g, count(*) AS count, round(avg(e * e), 6) AS variance, round(avg(e ** 3) / avg(e * e) ** 1.5, 4) AS skewness, round(avg(e ** 4) / avg(e * e) ** 2 - 3, 4) AS kurtosis FROM c GROUP BY g""")
def stats_large_mean_unweighted(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr("o_orderpriority as g", "1000000 + (o_totalprice - 150000) / 90000 as x")
    return stats.describe(d, "x", ["g"]).select("g", "count", *_round("variance"), *_round("skewness", "kurtosis", digits=4))


@register("""SELECT l_returnflag, count(*) AS count, round(sum(l_quantity), 4) AS weight, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 2) AS mean,
true AS close10, true AS close50, true AS close99 FROM lineitem GROUP BY 1""")
def digest_quantiles(spark, sf_dir):
    """Weighted digests of parts, merged. An estimate is close if the exact share of weight up to it
    is within a hundredth of the one asked for."""
    d, qs = table(spark, sf_dir, "lineitem"), (0.1, 0.5, 0.99)
    parts = digest.build(d, "l_extendedprice", ["l_returnflag", "l_linestatus"], "l_quantity")
    got = digest.merge(parts, ["l_returnflag"])
    got = got.select("l_returnflag", "count", F.round("weight", 4).alias("weight"), "min", "max", F.round(digest.mean(), 2).alias("mean"), *digest.quantile_columns(qs))
    w, names = F.col("l_quantity"), [f"q{round(100 * q):02d}" for q in qs]
    shares = d.join(F.broadcast(got.select("l_returnflag", *names)), "l_returnflag").groupBy("l_returnflag").agg(*[(F.sum(F.when(F.col("l_extendedprice") <= F.col(n), w).otherwise(0)) / F.sum(w)).alias(n) for n in names])
    close = [(F.abs(F.col(n) - q) <= 0.01).alias(f"close{n[1:]}") for n, q in zip(names, qs, strict=True)]
    return got.drop(*names).join(shares.select("l_returnflag", *close), "l_returnflag")


@register("""SELECT l_returnflag, l_linestatus, count(*) AS count, round(sum(l_quantity), 4) AS weight, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 2) AS mean FROM lineitem GROUP BY 1, 2""")
def digest_stream(spark, sf_dir):
    """The table read as a stream of files; digests are the stream's state."""
    path = f"{sf_dir}/lineitem.parque[t]"  # a pattern may name a file, a plain path of a stream only a folder
    by = ["l_returnflag", "l_linestatus"]
    stream = spark.readStream.schema(table(spark, sf_dir, "lineitem").schema).option("maxFilesPerTrigger", 8).parquet(path)
    got = digests.latest(digests.digests(stream, "l_extendedprice", by, "l_quantity"), by)
    return got.select(*by, "count", F.round("weight", 4).alias("weight"), "min", "max", F.round(digest.mean(), 2).alias("mean"))


@register("""SELECT least(round(l_quantity / 10.0)::BIGINT, 5) AS ix, least(round(l_discount / 0.02)::BIGINT, 5) AS iy, count(*) AS count, min(l_extendedprice) AS min, max(l_extendedprice) AS max, min(l_extendedprice) AS q00, max(l_extendedprice) AS q100 FROM lineitem GROUP BY 1, 2""")
def histogram2d_digest(spark, sf_dir):
    """Digests by cell of the two halves of the table, added."""
    d = table(spark, sf_dir, "lineitem")
    half = lambda k: stats.histogram2d_state(d.where(F.col("l_linenumber") % 2 == k), "l_quantity", "l_discount", "l_extendedprice", CELLS, DISCOUNT)
    out = digest.merge(half(0).union(half(1)), ["ix", "iy"])
    return out.select("ix", "iy", "count", "min", "max", *digest.quantile_columns([0.0, 1.0]))


@register("""WITH p AS (SELECT l_returnflag, l_discount AS x, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY x) AS cw, sum(w) OVER (PARTITION BY l_returnflag) AS tw FROM p)
SELECT l_returnflag, min(x) FILTER (cw >= 0.25 * tw - 1e-9) AS q25, min(x) FILTER (cw >= 0.5 * tw - 1e-9) AS q50 FROM c GROUP BY 1""")
def quantiles_weighted(spark, sf_dir):
    return stats.weighted_quantiles(table(spark, sf_dir, "lineitem"), "l_discount", "l_quantity", [0.25, 0.5], ["l_returnflag"])


@register("""WITH a AS (SELECT i::BIGINT AS ix FROM range(6) t(i)), d AS (SELECT least(round(l_quantity / 10.0)::BIGINT, 5) AS ix, l_extendedprice AS x, l_tax AS w FROM lineitem WHERE l_quantity BETWEEN 5 AND 45)
SELECT a.ix, count(x) AS count, round(coalesce(sum(w), 0), 4) AS sum_of_weights, round(coalesce(sum(w * x), 0), 2) AS sum, round(sum(w * x) / sum(w), 4) AS mean FROM a LEFT JOIN d ON a.ix = d.ix GROUP BY a.ix""")
def binning1d(spark, sf_dir):
    out = stats.binning1d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", CELLS, "l_tax", (5.0, 45.0))
    return out.select("ix", "count", *_round("sum_of_weights", digits=4), *_round("sum", digits=2), *_round("mean", digits=4))


@register("""SELECT least(round(l_quantity / 10.0)::BIGINT, 5) AS ix, least(round(l_discount / 0.02)::BIGINT, 5) AS iy, count(*) AS count, round(sum(l_extendedprice), 2) AS sum, round(avg(l_extendedprice), 4) AS mean,
min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(var_pop(l_extendedprice) / 1e6, 4) AS variance FROM lineitem GROUP BY 1, 2""")
def binning2d(spark, sf_dir):
    out = stats.binning2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", CELLS, DISCOUNT)
    return out.select("ix", "iy", "count", *_round("sum", digits=2), *_round("mean", digits=4), "min", "max", F.round(F.col("variance") / 1e6, 4).alias("variance"))


@register("""WITH d AS (SELECT l_quantity / 10.0 AS a, l_tax / 0.02 AS b, l_extendedprice AS z FROM lineitem WHERE l_quantity <= 50),
e AS (SELECT *, least(floor(a), 4) AS i, least(floor(b), 4) AS j FROM d), f AS (SELECT *, a - i AS t, b - j AS u FROM e),
c AS (SELECT (i + p)::BIGINT AS ix, (j + q)::BIGINT AS iy, z, (CASE WHEN p = 1 THEN t ELSE 1 - t END) * (CASE WHEN q = 1 THEN u ELSE 1 - u END) AS w FROM f, (VALUES (0), (1)) x(p), (VALUES (0), (1)) y(q))
SELECT ix, iy, round(sum(w), 4) AS sum_of_weights, round(sum(w * z) / sum(w), 3) AS mean FROM c WHERE w > 1e-12 GROUP BY 1, 2""")
def binning2d_linear(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").where("l_quantity <= 50")
    out = stats.binning2d(d, "l_quantity", "l_tax", "l_extendedprice", CELLS, DISCOUNT, simple=False)
    return out.select("ix", "iy", *_round("sum_of_weights", digits=4), *_round("mean", digits=3))


@register(f"""WITH d AS (SELECT ({LON} + 180) / 10.0 AS a, sin(radians(((c_custkey * 17) % 180 - 90)::DOUBLE)) AS s, ((c_custkey * 17) % 180) AS la, c_acctbal AS z FROM customer),
e AS (SELECT *, floor(a) AS i, least(la // 10, 17) AS j FROM d),
f AS (SELECT *, a - i AS t, (s - sin(radians(j * 10 - 90.0))) / (sin(radians(j * 10 - 80.0)) - sin(radians(j * 10 - 90.0))) AS u FROM e),
c AS (SELECT ((i + p) % 36)::BIGINT AS ix, (j + q)::BIGINT AS iy, z, (CASE WHEN p = 1 THEN t ELSE 1 - t END) * (CASE WHEN q = 1 THEN u ELSE 1 - u END) AS w FROM f, (VALUES (0), (1)) x(p), (VALUES (0), (1)) y(q))
SELECT ix, iy, round(sum(w), 4) AS sum_of_weights, round(sum(w * z), 3) AS sum FROM c WHERE w > 1e-12 GROUP BY 1, 2""")
def binning2d_geodetic(spark, sf_dir):
    d = table(spark, sf_dir, "customer").selectExpr(f"cast({LON} as double) lon", "cast((c_custkey * 17) % 180 - 90 as double) lat", "c_acctbal")
    out = stats.binning2d(d, "lon", "lat", "c_acctbal", CIRCLE, Axis.linspace(-90.0, 10.0, 19), simple=False, geodetic=True)
    return out.select("ix", "iy", *_round("sum_of_weights", digits=4), *_round("sum", digits=3))


@register("""SELECT least(round(l_quantity / 10.0)::BIGINT, 5) AS ix, least(round(l_discount / 0.02)::BIGINT, 5) AS iy, count(*) AS count,
round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50 FROM lineitem GROUP BY 1, 2""")
def histogram2d(spark, sf_dir):
    out = stats.histogram2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", CELLS, DISCOUNT, [0.25, 0.5], None)
    return out.select("ix", "iy", "count", *_round("q25", "q50", digits=4))


@register("""SELECT floor((epoch_us(ts) - 1704067200000000) / 86400000000.0 + 0.5)::BIGINT AS ix, count(*) AS count, round(avg(value), 6) AS mean FROM events GROUP BY 1""")
def binning1d_time(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(DAYS.ticks(F.col("ts")).alias("t"), "value")
    out = stats.binning1d(e, "t", "value", DAYS, limits=(DAYS.front() - 4.3e10, DAYS.back() + 4.3e10), empty=False)
    return out.select("ix", "count", *_round("mean"))
