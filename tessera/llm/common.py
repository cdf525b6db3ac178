"""What the training-data operators share: scratch tables, bounded samples, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir


_roots: list = []


@atexit.register
def _sweep() -> None:
    """Removes the scratch folders of this driver, as results may read them until it ends."""
    for at, conf in _roots:
        try:
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the JVM may be gone  # noqa: BLE001
            return


class Scratch:
    """Intermediate tables in the shared folder. A saved table cuts the lineage and outlives lost
    executors; ``drop`` removes one that no later step reads, the others go when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0
        _roots.append((spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root), spark.sparkContext._jsc.hadoopConfiguration()))

    def save(self, df: DataFrame, *by: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.partitionBy(*by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Slices:
    """A table (with a whole number ``slice``, and of few rows for each) in the shared folder, of
    which tasks read a slice at a time, without the driver. The folder is opened by Arrow's file
    systems: local or mounted, HDFS, S3 or GS. A slice that lacks rows stops the task."""

    def __init__(self, scratch: Scratch, df: DataFrame):
        self.table = scratch.save(df.repartition("slice"), "slice")  # a file for each slice
        self.rows = {r["slice"]: r["count"] for r in self.table.groupBy("slice").count().collect()}
        path = scratch.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.table._scratch)
        uri = path.getFileSystem(scratch.spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
        self.path = uri.getPath() if uri.getScheme() == "file" else uri.toString().replace("s3a://", "s3://", 1)

    def __getstate__(self) -> dict:
        return {"rows": self.rows, "path": self.path}

    def read(self, k: int) -> pa.Table | None:
        """The rows of slice ``k``; None if it has none."""
        if k not in self.rows:
            return None
        fs, at = pa.fs.FileSystem.from_uri(self.path)
        own = [f for f in fs.get_file_info(pa.fs.FileSelector(f"{at}/slice={k}")) if f.base_name.endswith(".parquet")]
        out = pa.concat_tables([pa.parquet.ParquetFile(fs.open_input_file(f.path)).read() for f in own])
        if out.num_rows != self.rows[k]:
            raise OSError(f"{self.path}: {out.num_rows} rows of slice {k} instead of {self.rows[k]}")
        return out


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int = 7) -> DataFrame:
    """From ``rows`` to twice as many rows, those of the least hashes of all columns, so the choice
    depends on the rows alone; all rows if there are no more than ``rows``. Rows with a null key
    are left out."""
    df = df.where(F.col(key).isNotNull())
    mark = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.lit(seed)), F.lit(1 << 40))
    counts = df.groupBy(F.length(F.bin(mark)).alias("bits")).count().collect()  # at most 40 rows
    have = 0
    for bits, n in sorted((r["bits"], r["count"]) for r in counts):
        have += n
        if have >= rows:
            some = df.where(mark < (1 << bits))
            return some if have <= 2 * rows else some.orderBy(mark).limit(2 * rows)
    return df


def with_ids(df: DataFrame, key: str, **others: Column) -> DataFrame:
    """id (0 for a null), none (whether it is null) and ``others``: a worker gets whole numbers with
    nulls as floats, which would round large ids."""
    own = F.col(f"`{key}`").cast("long")
    return df.select(F.coalesce(own, F.lit(0).cast("long")).alias("id"), own.isNull().alias("none"), *[c.alias(n) for n, c in others.items()])


def ids_of(pdf: pd.DataFrame) -> list[int | None]:
    return [None if none else i for i, none in zip(pdf["id"].tolist(), pdf["none"].tolist(), strict=True)]


def frame(rows: list[tuple], columns: list[str], longs: tuple[str, ...]) -> pd.DataFrame:
    """Columns of rows; those of ``longs`` are whole numbers that may be null, kept to the last bit."""
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(columns)
    return pd.DataFrame({n: pd.array(c, "Int64") if n in longs else pd.Series(c, dtype=None if rows else object) for n, c in zip(columns, cols, strict=True)})


def crc_mod(key: str | Column, mod: int) -> Column:
    """crc32 of an id's decimal text, modulo ``mod``; null for a null id."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(col.cast("string").cast("binary")) % mod


def tidy() -> None:
    """Gives memory that a worker has freed back to the machine, at the end of a task: workers stay
    alive for the next stage, and several of them share an executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Most bits of a Bloom filter: 16 MB, whatever it is made from
FILTER_BITS = 1 << 27


class Bloom:
    """A Bloom filter of the ids in a one-column frame, of at most ``most`` bits. It lets rows be
    told apart where they are read, so that only those that need an exact join are shuffled."""

    def __init__(self, ids: DataFrame, most: int = FILTER_BITS):
        n, bits = ids.count(), 1 << 16
        while bits < min(16 * n, most):
            bits *= 2
        self.bits = bits
        at = ids.select(F.explode(self.places(ids.columns[0])).alias("p"))
        words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
        table = np.zeros(bits // 64, np.int64)
        for r in words.toLocalIterator():  # at most most / 64 rows
            table[r.w] = r.b
        self.sent = ids.sparkSession.sparkContext.broadcast(table)

    def places(self, column: str) -> Column:
        """Bit places of a row's id, an array; NULL for a null id."""
        return F.when(F.col(column).isNotNull(), F.array(*[F.pmod(F.xxhash64(F.col(column), F.lit(j)), F.lit(self.bits)) for j in range(4)]))

    def maybe(self, column: str) -> Column:
        """True for every id of the filter and for few others; false for a null."""
        sent = self.sent

        @F.pandas_udf("boolean")
        def passes(places: pd.Series) -> pd.Series:
            return pd.Series(hits(sent.value, places))

        return passes(self.places(column))


def hits(table: np.ndarray, places: pd.Series) -> np.ndarray:
    """Which rows' bits are all set."""
    known = places.notna().to_numpy()
    out = np.zeros(len(places), bool)
    if known.any():
        p = np.stack(places[known].to_list()).astype(np.int64)
        out[known] = ((table[p >> 6] >> (p & 63)) & 1 == 1).all(1)
    return out


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps; every step is two groupings by node with map-side
    minimum, and each result is written, so that nothing is gathered in one task or the driver.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    pairs = scratch.save(pairs)
    while not pairs.isEmpty():
        # large star: every neighbour above u points to the least of u and its neighbours
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: every neighbour below u, and u, points to the least neighbour
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(below, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        new = scratch.save(small)
        scratch.drop(pairs)
        pairs = new
        # done when every node has one root and no root has one
        nodes = pairs.groupBy("u").agg(F.count("*").alias("n"))
        if nodes.where("n > 1").isEmpty() and nodes.join(pairs.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    roots = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
