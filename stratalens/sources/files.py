"""Sinks and sources of files: export jobs that resume, and archives of files as a Spark data source.

Only paths travel between executors: bytes go from where a file lies to where
it is wanted inside one task. Folders must be reached by every executor; they
are paths or URIs that pyarrow's file systems know.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.order import numbered
from ..session import ship

#: Bytes that are copied at a time.
BLOCK = 1 << 20


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(uri)
    return store, path.rstrip("/")


def _there(store: fs.FileSystem, path: str) -> int | None:
    """The size of a file, nothing if it isn't there."""
    info = store.get_file_info(path)
    return info.size if info.type == fs.FileType.File else None


def _put(store: fs.FileSystem, path: str, blocks: Iterator[bytes]) -> int:
    """A file that is there in whole or not at all: written under another name, then moved."""
    folder, name = path.rsplit("/", 1)
    beside = f"{folder}/.half-{uuid.uuid4().hex}"
    store.create_dir(folder, recursive=True)
    size = 0
    try:
        with store.open_output_stream(beside, compression=None) as out:
            for block in blocks:
                out.write(block)
                size += len(block)
        store.move(beside, f"{folder}/{name}")
    except BaseException:
        if _there(store, beside) is not None:
            store.delete_file(beside)
        raise
    return size


def _blocks(uri: str) -> Iterator[bytes]:
    store, path = _place(uri)
    with store.open_input_stream(path, compression=None) as source:
        while block := source.read(BLOCK):
            yield block


def _sweep(uri: str) -> None:
    """Remove what tasks that were killed have left under other names."""
    store, path = _place(uri)
    for info in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
        if info.base_name.startswith(".half-"):
            store.delete_file(info.path)


def remove(uri: str) -> None:
    """A folder and what it holds; nothing if it isn't there."""
    store, path = _place(uri)
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)


# ---- export jobs ------------------------------------------------------------

LOG = "pos long, id long, name string, bytes long, outcome string, chunk long"


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def export_plan(wanted: DataFrame, images: DataFrame, rendered: bool = False) -> DataFrame:
    """(pos, id, name, path) of a request ``wanted(pos, id)`` over ``images(id, original_filename, path)``.

    Unknown ids are left out; an id that is asked for twice comes twice. A
    render's name ends in .jpg. The n-th use of a name gets _n before its
    ending, in order of the request: places in the whole order of (name, pos)
    less the first of the name, so that one name may be any number of rows.
    """
    name = F.concat(F.regexp_replace("original_filename", r"(?<=.)\.[^.]*$", ""), F.lit(".jpg")) if rendered else F.col("original_filename")
    asked = wanted.select("pos", "id").join(images.select("id", name.alias("__name"), "path"), "id")
    placed = numbered(asked, "__n", F.col("__name"), F.col("pos"))
    first = placed.groupBy("__name").agg(F.min("__n").alias("__first"))
    n = (F.col("__n") - F.col("__first")).cast("string")
    stem, end = F.regexp_replace("__name", r"(?<=.)\.[^.]*$", ""), F.regexp_extract("__name", r"(?<=.)(\.[^.]*)$", 1)
    shown = F.when(F.col("__n") == F.col("__first"), F.col("__name")).otherwise(F.concat(stem, F.lit("_"), n, end))
    return placed.join(first, "__name").select(F.col("pos").cast("long").alias("pos"), F.col("id").cast("long").alias("id"), shown.alias("name"), "path")


def export_job(plan: DataFrame, folder: str, render: Callable[[bytes], bytes] | None = None, chunk: int = 10_000) -> DataFrame:
    """Writes the files of an :func:`export_plan` below ``folder``/files and returns :func:`export_progress`.

    The plan is kept with the job at its first call; later calls go on with that
    plan. Chunks of the request are written in turn and logged one row a file,
    the log of a chunk by Spark's own commit. A file appears under its name only
    when it is whole. A chunk that was stopped before its log is looked at
    again: files that are there stay as they are. A file that can't be read or
    rendered is logged as failed and doesn't stop the others; a missing one is
    logged as missing. ``cancel_export`` is looked for before every file, and
    before every chunk; a cancelled job stays so.
    """
    spark = ship(plan.sparkSession)
    store, home = _place(folder)
    if store.get_file_info(f"{home}/plan/_SUCCESS").type == fs.FileType.NotFound:
        plan.withColumn("chunk", F.floor(F.col("pos") / chunk)).write.mode("overwrite").partitionBy("chunk").parquet(f"{folder}/plan")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, home = _place(folder)
        for pdf in frames:
            rows = []
            for pos, row_id, name, path in pdf[["pos", "id", "name", "path"]].itertuples(index=False, name=None):
                if _there(store, f"{home}/cancelled") is not None:
                    break
                target, size, outcome = f"{home}/files/{name}", _there(store, f"{home}/files/{name}"), "written"
                if size is None:
                    try:
                        blocks = _blocks(path) if render is None else iter([render(b"".join(_blocks(path)))])
                        size = _put(store, target, blocks)
                    except FileNotFoundError:
                        outcome = "missing"
                    except Exception:  # whatever it is, one file doesn't stop the others
                        outcome = "failed"
                rows.append((pos, row_id, name, size, outcome))
            yield pd.DataFrame(rows, columns=["pos", "id", "name", "bytes", "outcome"]).astype({"bytes": "Int64"})

    kept = _read(spark, f"{folder}/plan", "pos long, id long, name string, path string, chunk long")
    logged = {r["chunk"] for r in _read(spark, f"{folder}/log", LOG).select("chunk").distinct().collect()}
    for k in sorted(r["chunk"] for r in kept.select("chunk").distinct().collect() if r["chunk"] not in logged):
        if _there(store, f"{home}/cancelled") is not None:
            break
        mine = kept.where(F.col("chunk") == k).select("pos", "id", "name", "path")
        dealt = mine.repartition(spark.sparkContext.defaultParallelism)  # a chunk's files are dealt over all cores
        done = dealt.mapInPandas(write, "pos long, id long, name string, bytes long, outcome string")
        # its folder tells readers that the chunk is over only when it was not cancelled on the way
        done.write.mode("overwrite").parquet(f"{folder}/open/chunk={k}")
        if _there(store, f"{home}/cancelled") is None:
            spark.read.parquet(f"{folder}/open/chunk={k}").write.mode("overwrite").parquet(f"{folder}/log/chunk={k}")
    _sweep(f"{folder}/files")
    return export_progress(spark, folder)


def cancel_export(folder: str) -> None:
    """The job stops before its next file."""
    store, home = _place(folder)
    _put(store, f"{home}/cancelled", iter([b""]))


def export_progress(spark: SparkSession, folder: str) -> DataFrame:
    """One row (total, done, failed, missing, bytes, state) by the chunks that are logged; state is running, ready or cancelled."""
    store, home = _place(folder)
    log = _read(spark, f"{folder}/log", LOG)
    of = lambda *outcomes: F.count_if(F.col("outcome").isin(*outcomes))
    done = log.agg(F.count("*").alias("done"), of("failed").alias("failed"), of("missing").alias("missing"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    total = _read(spark, f"{folder}/plan", "pos long").agg(F.count("*").alias("total"))
    state = F.lit("cancelled") if _there(store, f"{home}/cancelled") is not None else F.when(F.col("done") == F.col("total"), "ready").otherwise("running")
    return total.crossJoin(done).withColumn("state", state)  # one row each


# ---- archives ---------------------------------------------------------------


@dataclass
class _Part(InputPartition):
    path: str

    def __init__(self, path: str) -> None:
        self.path = path


@dataclass
class _Written(WriterCommitMessage):
    parts: list[dict]


def _manifest(uri: str) -> list[dict]:
    store, home = _place(uri)
    if _there(store, f"{home}/parts.json") is None:
        return []
    with store.open_input_stream(f"{home}/parts.json") as f:
        return json.loads(f.read())["parts"]


class _Writer(DataSourceWriter):
    def __init__(self, uri: str, columns: list[str], most: int, overwrite: bool) -> None:
        self.uri, self.columns, self.most, self.overwrite = uri, columns, most, overwrite

    def write(self, iterator) -> _Written:
        store, home = _place(self.uri)
        store.create_dir(f"{home}/parts", recursive=True)
        parts, out, archive = [], None, None

        def close() -> None:
            nonlocal out, archive
            if archive is not None:
                archive.close()
                out.close()
                out = archive = None

        by_path = "path" in self.columns
        for row in iterator:
            if by_path and _there(*_place(row["path"])) is None:
                continue
            if archive is None:
                parts.append({"name": f"{uuid.uuid4().hex}.zip", "files": 0, "bytes": 0})
                out = store.open_output_stream(f"{home}/parts/{parts[-1]['name']}", compression=None)
                archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
            with archive.open(zipfile.ZipInfo(row["name"]), "w", force_zip64=True) as entry:
                for block in _blocks(row["path"]) if by_path else [bytes(row["content"] or b"")]:
                    entry.write(block)
                    parts[-1]["bytes"] += len(block)
            parts[-1]["files"] += 1
            if parts[-1]["bytes"] >= self.most:
                close()
        close()
        return _Written(parts)

    def _remove(self, names: set[str]) -> None:
        store, home = _place(self.uri)
        for info in store.get_file_info(fs.FileSelector(f"{home}/parts", allow_not_found=True)):
            if info.base_name in names:
                store.delete_file(info.path)

    def commit(self, messages: list[_Written | None]) -> None:
        old = _manifest(self.uri)
        new = [p for m in messages if m is not None for p in m.parts]
        store, home = _place(self.uri)
        _put(store, f"{home}/parts.json", iter([json.dumps({"parts": new if self.overwrite else old + new}).encode()]))
        if self.overwrite:
            self._remove({p["name"] for p in old})

    def abort(self, messages: list[_Written | None]) -> None:
        self._remove({p["name"] for m in messages if m is not None for p in m.parts})


class _Reader(DataSourceReader):
    def __init__(self, uri: str) -> None:
        self.uri = uri

    def partitions(self) -> list[_Part]:
        return [_Part(f"{self.uri.rstrip('/')}/parts/{p['name']}") for p in _manifest(self.uri)] or [_Part("")]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, path = _place(partition.path)
        with store.open_input_file(path) as source, zipfile.ZipFile(source) as archive:
            for info in archive.infolist():
                yield pa.RecordBatch.from_arrays([pa.array([info.filename]), pa.array([archive.read(info)], pa.binary())], ["name", "content"])


class FileArchive(DataSource):
    """Files in uncompressed zip parts, told by a manifest that is written last.

    Rows to be written are (name, path), whose bytes are read where the part is
    written and left out if the file is gone, or (name, content). A part is
    closed at ``partBytes`` (256 MiB), so the manifest has one entry for that
    many bytes. Parts of a task or job that failed are in no manifest, so no
    reader sees them. Reading gives (name, content), one partition a part.
    """

    @classmethod
    def name(cls) -> str:
        return "file_archive"

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema.fieldNames(), int(self.options.get("partbytes", 256 << 20)), overwrite)


def write_archive(files: DataFrame, folder: str, part_bytes: int = 256 << 20) -> None:
    """``files(name, path)`` or ``files(name, content)`` as the archive of a folder, in place of what it held."""
    ship(files.sparkSession).dataSource.register(FileArchive)
    files.write.format("file_archive").mode("overwrite").option("partBytes", part_bytes).save(folder)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of an archive's files."""
    ship(spark).dataSource.register(FileArchive)
    return spark.read.format("file_archive").load(folder)


def unpack(files: DataFrame, folder: str) -> DataFrame:
    """(name, bytes): ``files(name, content)`` as whole files below a folder; one that has the size already stays."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, home = _place(folder)
        for batch in batches:
            names, sizes = batch.column("name").to_pylist(), []
            for name, content in zip(names, batch.column("content"), strict=True):
                data = content.as_py() or b""
                if name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"{name} leaves the folder")
                sizes.append(len(data) if _there(store, f"{home}/{name}") == len(data) else _put(store, f"{home}/{name}", iter([data])))
            yield pa.RecordBatch.from_pydict({"name": names, "bytes": pa.array(sizes, pa.int64())})

    return files.select("name", "content").mapInArrow(write, "name string, bytes long")
