"""State rows (moments, digests, bins) as a data source with a version and whole commits.

Tasks write their rows as parts; the driver then names them in one manifest, put in place by a
single rename. A reader sees the parts of the newest manifest and nothing else: a write that dies
half way, a part of a lost task or one that was written twice never counts. Appending lists the
parts before and the new ones, to be merged by the operator that made them; overwriting lists the
new ones alone. Parts that no manifest names any more are left to ``tidy``.

The folder is opened by Arrow's file systems: local or mounted, HDFS, S3 or GS. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.session import ship

NAME, VERSION = "tessera_state", 1


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return pa.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def manifest(path: str) -> dict | None:
    """The newest manifest of a folder: version, number, schema, and parts with their rows; None if
    nothing was ever committed there."""
    fs, at = _opened(path)
    found = fs.get_file_info(pa.fs.FileSelector(at, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.base_name.startswith("manifest-") and f.base_name.endswith(".json"))
    if not names:
        return None
    with fs.open_input_stream(f"{at}/{names[-1]}") as f:
        out = json.loads(f.read())
    if out["version"] != VERSION:
        raise ValueError(f"{path} holds state of version {out['version']}, not {VERSION}")
    return out


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: str, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, at = _opened(self.path)
        name, rows, out = f"part-{uuid.uuid4().hex}.parquet", 0, None
        fs.create_dir(f"{at}/parts")
        for batch in iterator:
            if batch.num_rows:
                out = out or pa.parquet.ParquetWriter(f"{at}/parts/{name}", batch.schema, filesystem=fs)
                out.write_batch(batch)
                rows += batch.num_rows
        if out:
            out.close()
        return _Written(name, rows)

    def commit(self, messages: list) -> None:
        fs, at = _opened(self.path)
        old = manifest(self.path)
        if old and not self.overwrite and old["schema"] != self.schema:
            raise ValueError(f"{self.path} holds rows of another schema")
        number = old["number"] + 1 if old else 1
        kept = old["parts"] if old and not self.overwrite else []
        new = {"version": VERSION, "number": number, "schema": self.schema, "parts": kept + [[m.name, m.rows] for m in messages if m and m.rows]}
        fs.create_dir(at)
        draft = f"{at}/draft-{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps(new).encode())
        fs.move(draft, f"{at}/manifest-{number:09d}.json")

    def abort(self, messages: list) -> None:
        fs, at = _opened(self.path)
        for m in messages:
            if m and m.rows:
                fs.delete_file(f"{at}/parts/{m.name}")


@dataclass
class _Part(InputPartition):
    name: str
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, parts: list):
        self.path, self.parts = path, parts

    def partitions(self) -> list:
        return [_Part(n, rows) for n, rows in self.parts] or [_Part("", 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, at = _opened(self.path)
        with fs.open_input_file(f"{at}/parts/{partition.name}") as f:
            file = pa.parquet.ParquetFile(f)
            if file.metadata.num_rows != partition.rows:
                raise OSError(f"{partition.name} holds {file.metadata.num_rows} rows instead of {partition.rows}")
            yield from file.iter_batches()


class StateSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _manifest(self) -> dict:
        found = manifest(self.options["path"])
        if found is None:
            raise FileNotFoundError(f"no state was committed to {self.options['path']}")
        return found

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self._manifest()["schema"]))

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], self._manifest()["parts"])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema.json(), overwrite)


def _registered(spark: SparkSession) -> SparkSession:
    ship(spark)
    spark.dataSource.register(StateSource)
    return spark


def save(states: DataFrame, path: str, append: bool = False) -> None:
    """Commits state rows to a folder, in place of what is there or beside it."""
    _registered(states.sparkSession)
    states.write.format(NAME).option("path", path).mode("append" if append else "overwrite").save()


def load(spark: SparkSession, path: str) -> DataFrame:
    """The state rows committed last, a task for each part."""
    return _registered(spark).read.format(NAME).option("path", path).load()


def tidy(path: str) -> int:
    """Deletes parts and manifests that the newest manifest doesn't need, while nothing reads or
    writes the folder; returns their number."""
    found = manifest(path)
    if found is None:
        return 0
    fs, at = _opened(path)
    keep = {n for n, _ in found["parts"]} | {f"manifest-{found['number']:09d}.json"}
    old = [f.path for d in (at, f"{at}/parts") for f in fs.get_file_info(pa.fs.FileSelector(d, allow_not_found=True)) if f.type == pa.fs.FileType.File and f.base_name not in keep]
    for f in old:
        fs.delete_file(f)
    return len(old)
