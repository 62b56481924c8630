"""Catalog sources and sinks: listings, scans, indexes, archives of records, snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, strings
from ..operators import collections, entity, order
from . import files

VERSION = 2
#: The fields of the slim index, beside the capture time and the version of the cached render.
INDEX_FIELDS = ("id", "original_filename", "file_type", "width", "height", "rating", "color_label", "remote_sync", "paired_image_id", "source_root_id")


def listing(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """(path, name, size, modified[, content]) of the media files under a folder.

    Dot files, files in dot folders and unknown endings are left out. Contents
    are only read when asked for, so a listing costs no file reads.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    out = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if with_content else []))
    below = F.expr(f"substring(path, locate('{root.rstrip('/')}', path) + {len(root.rstrip('/'))})")
    return out.where(~below.contains("/.") & strings.file_type(F.col("name")).isNotNull())


def folder_summary(listed: DataFrame) -> DataFrame:
    """(files, bytes) of a listing."""
    return listed.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def scan_source(listed: DataFrame, known: DataFrame, managed: DataFrame) -> DataFrame:
    """(path, sha, action, id) of a scan of files with ``content``.

    A known path is skipped; the bytes of a managed row are skipped; the bytes of
    a row of this source whose path is gone relocate it, the k-th file the k-th
    row of a content; the rest is indexed. ``known(id, path, sha)``, ``managed(sha)``.
    """
    fresh = listed.join(known.select("path"), "path", "left_anti").withColumn("sha", F.sha2("content", 256)).drop("content")
    fresh = fresh.join(managed.select("sha").distinct(), "sha", "left_anti")
    gone = known.join(listed.select("path"), "path", "left_anti")
    rank = lambda df, by: df.withColumn("__k", F.row_number().over(Window.partitionBy("sha").orderBy(by)))
    both = rank(fresh.select("path", "sha"), "path").join(rank(gone.select("id", "sha"), "id"), ["sha", "__k"], "left")
    return both.select("path", "sha", F.when(F.col("id").isNull(), "index").otherwise("relocate").alias("action"), "id")


#: Bytes that an import leaves free on the disk.
RESERVE = 10 << 30


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon, name, admin1, cc, key) of a CSV file of cities; ``key`` is the name as it is searched for."""
    rows = spark.read.csv(path, header=True, schema="lat double, lon double, name string, admin1 string, admin2 string, cc string")
    return rows.where("lat is not null and lon is not null").withColumn("key", strings.normalised_name("name")).drop("admin2")


def other_library(spark: SparkSession, path: str, revisions: set[str]) -> dict[str, DataFrame]:
    """The tables of another library's snapshot folder; one of an unknown revision is refused."""
    found = spark.read.parquet(f"{path}/version").first()
    if found is None or found["version_num"] not in revisions:
        raise ValueError(f"the library's revision {found and found['version_num']} is unknown")
    return {t: spark.read.parquet(f"{path}/{t}") for t in ("images", "tags", "image_tags", "albums", "album_images")}


def stage(listed: DataFrame, session: str, taken: DataFrame | None = None) -> DataFrame:
    """(session, path, staged_name, original_filename, file_type, sha, size, modified, processed) of files with ``content``.

    Contents are hashed as they are read; a name that is used already in the
    session gets the first free number. ``taken(name)`` are names of earlier batches.
    """
    day = F.lit(session)
    files = listed.where(strings.file_type(F.col("name")).isNotNull() & ~F.col("name").startswith("."))
    used = taken.select(day.alias("day"), "name") if taken is not None else files.select(day.alias("day"), "name").limit(0)
    named = order.destinations(files.select(F.col("path").alias("id"), F.col("path").alias("seq"), day.alias("day"), "name"), used)
    staged = named.select(F.col("id").alias("path"), F.element_at(F.split("path", "/"), -1).alias("staged_name"))
    hashed = files.select("path", F.col("name").alias("original_filename"), strings.file_type(F.col("name")).alias("file_type"), F.sha2("content", 256).alias("sha"), "size", "modified")
    return hashed.join(staged, "path").select(F.lit(session).alias("session"), "path", "staged_name", "original_filename", "file_type", "sha", "size", "modified", F.lit(False).alias("processed"))


def preflight(total_bytes: int, free_bytes: int, appends: bool = False) -> None:
    """An import that can't fit is refused before its first byte, one under way once the reserve is touched."""
    if free_bytes < RESERVE or (not appends and total_bytes and total_bytes + RESERVE > free_bytes):
        raise ValueError(f"the import needs {total_bytes} bytes; {max(free_bytes - RESERVE, 0)} are usable")


def untracked(listed: DataFrame, tracked: DataFrame) -> DataFrame:
    """Files that no row tracks."""
    return listed.join(tracked.select("path"), "path", "left_anti")


def library_index(images: DataFrame) -> DataFrame:
    """The slim index in the total order, as one JSON text per row; a field that the rows lack is null."""
    version = F.when(F.coalesce("edit_rev", F.lit(0)) == 0, "").otherwise(F.col("edit_rev").cast("string"))
    have = {c: F.col(c) for c in images.columns} | {"remote_sync": F.coalesce("remote_sync", F.lit(False))} if "remote_sync" in images.columns else {c: F.col(c) for c in images.columns}
    fields = [have.get(c, F.lit(None).cast("string")).alias(c) for c in INDEX_FIELDS]
    return images.orderBy(*order.total_order()).select(F.to_json(F.struct(*fields, dates.iso_seconds(F.col("taken_at")).alias("taken_at"), version.alias("thumb_version")), {"ignoreNullFields": "false"}).alias("row"))


def export_names(images: DataFrame, requested: list[int]) -> DataFrame:
    """(pos, id, archive_name) in the order of the request; the n-th use of a name gets _n."""
    wanted = images.sparkSession.createDataFrame([(n, int(i)) for n, i in enumerate(requested)], "pos int, id long")
    return order.numbered_names(F.broadcast(wanted).join(images.select("id", "original_filename"), "id"), "original_filename", [F.col("pos")]).select("pos", "id", "archive_name")


def write_backup(images: DataFrame, albums: DataFrame, album_images: DataFrame, path: str, links: DataFrame | None = None, library: str | None = None) -> None:
    """Three JSON tables, the files and a manifest; images carry their tags. Rows of source roots aren't backed up, and album rules aren't either.

    With ``library``, the folder that ``file_path`` starts from, files go along
    in an archive; those that are gone are left out. The manifest goes first and
    comes last, so what a stopped backup has left is not read as one.
    """
    spark = images.sparkSession
    files.remove(f"{path}/manifest")
    managed = images.where("source_root_id is null")
    if library is not None:
        files.write_archive(managed.select(F.col("file_path").alias("name"), F.concat(F.lit(library.rstrip("/") + "/"), "file_path").alias("path")), f"{path}/files")
    if links is not None:
        managed = managed.join(entity.tags_of(managed, links), "id")
    managed.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/images")
    albums.drop("rule").write.mode("overwrite").json(f"{path}/albums")
    album_images.join(managed.select(F.col("id").alias("image_id")), "image_id", "left_semi").write.mode("overwrite").json(f"{path}/album_images")
    spark.createDataFrame([(VERSION, dt.datetime.now(dt.timezone.utc).isoformat())], "version int, created_at string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_backup(spark: SparkSession, path: str, schema, defaults: dict[str, Column] | None = None) -> DataFrame:
    """The images of a backup. Keys that an old manifest lacks take their defaults; a newer version is refused."""
    version = spark.read.schema("version int").json(f"{path}/manifest").first()["version"]
    if version > VERSION:
        raise ValueError(f"backup version {version} is newer than {VERSION}")
    rows = spark.read.schema(schema).json(f"{path}/images")
    return rows.withColumns({c: F.coalesce(F.col(c), d) for c, d in (defaults or {}).items()})


def save_clusters(clusters: DataFrame, signature: DataFrame, path: str) -> None:
    """A snapshot of derived clusters beside the one-row signature of what they were built from; the signature is written last."""
    clusters.write.mode("overwrite").parquet(f"{path}/clusters")
    signature.write.mode("overwrite").parquet(f"{path}/signature")


def load_clusters(spark: SparkSession, path: str, live: DataFrame, signature: DataFrame) -> tuple[DataFrame, bool]:
    """The clusters without ids that are gone, and whether they are current: built from what ``signature`` says now."""
    was = spark.read.parquet(f"{path}/signature")
    current = not was.exceptAll(signature.select(*was.columns)).union(signature.select(*was.columns).exceptAll(was)).limit(1).count()
    return collections.repaired(spark.read.parquet(f"{path}/clusters"), live), current


def restored(spark: SparkSession, path: str, schema, defaults: dict[str, Column] | None = None) -> dict[str, DataFrame]:
    """The tables of a backup: images, image_tags, albums, album_images.

    Tags come from the images' records, none in old ones. A partner that the
    backup lacks is left out, as rows of source roots are.
    """
    rows = read_backup(spark, path, schema, defaults)
    there = rows.select(F.col("id").alias("__id"))
    images = rows.join(there, F.col("paired_image_id") == F.col("__id"), "left").withColumn("paired_image_id", F.col("__id")).drop("__id")
    tags = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in rows.columns else F.array().cast("array<string>")
    links = rows.select(F.col("id").alias("image_id"), F.explode(tags).alias("name")).distinct()
    other = {t: spark.read.json(f"{path}/{t}") for t in ("albums", "album_images")}
    return {"images": images.drop("tags"), "image_tags": links} | other


def restored_files(spark: SparkSession, path: str, library: str) -> DataFrame:
    """(name, bytes): the files of a backup, written below the folder ``library`` when rows are asked for."""
    return files.unpack(files.read_archive(spark, f"{path}/files"), library)


def record(images: DataFrame) -> DataFrame:
    """(id, record): every column of a row as JSON."""
    return images.select("id", F.to_json(F.struct("*")).alias("record"))


def from_record(records: DataFrame, schema, keep_id: bool = True) -> DataFrame:
    """Rows from :func:`record`; without ``keep_id`` the id is left to be given."""
    rows = records.select(F.from_json("record", schema).alias("r")).select("r.*")
    return rows if keep_id else rows.drop("id")


def retained(archives: DataFrame, days: int = 7, weeks: int = 4, months: int = 6) -> DataFrame:
    """Archives kept: the last of each of the newest days, weeks and months."""
    keep = F.lit(False)
    out = archives
    for n, (unit, count) in enumerate((("day", days), ("week", weeks), ("month", months))):
        period = F.date_trunc(unit, "created_at")
        last = F.row_number().over(Window.partitionBy(period).orderBy(F.desc("created_at"), "name"))
        out = out.withColumn(f"__period{n}", period).withColumn(f"__last{n}", last)
        kept = out.select(f"__period{n}").distinct().orderBy(F.desc(f"__period{n}")).limit(count).withColumn(f"__keep{n}", F.lit(True))
        out = out.join(F.broadcast(kept), f"__period{n}", "left")
        keep = keep | (F.coalesce(f"__keep{n}", F.lit(False)) & (F.col(f"__last{n}") == 1))
    return out.where(keep).select(*archives.columns)


def publish(df: DataFrame, path: str, version: str) -> str:
    """Write a snapshot beside the old ones; readers switch by path, so none sees half of it."""
    target = f"{path}/{version}"
    df.write.mode("errorifexists").parquet(target)
    return target
