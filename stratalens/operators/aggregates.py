"""Counts, facets, statistics and rollups of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import LibraryFilter, predicates

#: Half-open focal length ranges and their names.
FOCAL_RANGES = (
    (0, 16, "Ultra wide (<16mm)"),
    (16, 24, "Wide (16-23mm)"),
    (24, 36, "Semi wide (24-35mm)"),
    (36, 51, "Normal (36-50mm)"),
    (51, 86, "Short tele (51-85mm)"),
    (86, 136, "Tele (86-135mm)"),
    (136, 301, "Long tele (136-300mm)"),
    (301, 100000, "Super tele (>300mm)"),
)


#: Covers of a collection.
COVERS = 4


def facets(images: DataFrame, f: LibraryFilter) -> DataFrame:
    """(facet, value, n) for camera, lens, focal and region, each without its own dimension's filter.

    One scan: every row gets a flag per facet, and one grouped count over the
    exploded (facet, value) pairs serves all four.
    """
    preds = predicates(f)
    own = {"camera": ("camera",), "lens": ("lens",), "focal": ("focal_min", "focal_max"), "region": ("country",)}
    focal = F.round("focal_length", 1)
    shown = F.when(focal == F.floor(focal), F.format_string("%d", focal.cast("long"))).otherwise(F.format_string("%.1f", focal))
    values = {"camera": F.nullif("camera_model", F.lit("")), "lens": F.nullif("lens_model", F.lit("")), "focal": F.when(focal > 0, shown), "region": F.col("gps_country")}

    def passes(facet: str) -> Column:
        out = F.lit(True)
        for name, p in preds.items():
            if name not in own[facet]:
                out = out & p
        return out

    pairs = F.array(*[F.struct(F.lit(k).alias("facet"), F.when(passes(k), v).alias("value")) for k, v in values.items()])
    return images.select(F.explode(pairs).alias("x")).where("x.value is not null").groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def totals(images: DataFrame) -> DataFrame:
    """One row of library totals; pairs are counted by halves, edits by revision (copies with a baked-in look don't count)."""
    return images.agg(
        F.count("*").alias("photos"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("bytes"),
        F.count_if(F.col("file_type") == "raw").alias("raws"), F.count_if(F.col("file_type") == "jpeg").alias("jpegs"),
        F.floor(F.count_if(F.col("paired_image_id").isNotNull()) / 2).cast("long").alias("pairs"), F.count_if(F.col("edit_rev") > 0).alias("edited"),
        F.count_if(F.col("gps_lat").isNotNull()).alias("located"), F.count_if(F.col("rating") > 0).alias("rated"),
        F.countDistinct(F.nullif("camera_model", F.lit(""))).alias("cameras"), F.countDistinct(F.nullif("lens_model", F.lit(""))).alias("lenses"),
        F.min("taken_at").alias("first_taken"), F.max("taken_at").alias("last_taken"),
    )


def top_values(images: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """The most used non-empty values; ties by value."""
    return images.where(F.col(column) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def focal_histogram(images: DataFrame) -> DataFrame:
    """(position, name, n) of the focal ranges that have rows."""
    bucket = F.lit(None).cast("int")
    for i, (low, high, _) in enumerate(FOCAL_RANGES):
        bucket = F.when((F.col("focal_length") >= low) & (F.col("focal_length") < high), i).otherwise(bucket)
    name = F.element_at(F.array(*[F.lit(n) for *_, n in FOCAL_RANGES]), F.col("position") + 1)
    return images.select(bucket.alias("position")).where("position is not null").groupBy("position").agg(F.count("*").alias("n")).withColumn("name", name)


def ratings(images: DataFrame) -> DataFrame:
    """Counts of ratings 1 to 5, zeros included."""
    spark = images.sparkSession
    counted = images.groupBy("rating").agg(F.count("*").alias("n"))
    scale = spark.range(1, 6).select(F.col("id").cast("int").alias("rating"))
    return scale.join(F.broadcast(counted.where("rating between 1 and 5")), "rating", "left").select("rating", F.coalesce("n", F.lit(0)).alias("n"))


def tag_usage(tags: DataFrame, links: DataFrame) -> DataFrame:
    """Every tag with the number of its images, unused ones with 0."""
    used = links.groupBy("name").agg(F.count("image_id").alias("n"))
    return tags.join(used, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def unused_tags(tags: DataFrame, links: DataFrame) -> DataFrame:
    return tags.join(links, "name", "left_anti")


def covers(images: DataFrame, group: list[str], k: int = COVERS) -> DataFrame:
    """(group, covers): the k newest ids of a group, JPEGs if it has any, undated last.

    A ranked filter right above the window keeps k rows of a group per task before
    the shuffle, however large it is; JPEGs rank first, so the first row tells if there are any.
    """
    jpeg = F.col("file_type") == "jpeg"
    w = Window.partitionBy(*group).orderBy(jpeg.desc(), F.col("taken_at").desc_nulls_last(), "id")
    top = images.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k)
    ranked = F.array_sort(F.collect_list(F.struct("__rank", "id", F.coalesce(jpeg, F.lit(False)).alias("jpeg"))))
    kept = F.filter("ranked", lambda x: x["jpeg"] == F.col("ranked")[0]["jpeg"])
    return top.groupBy(*group).agg(ranked.alias("ranked")).select(*group, F.transform(kept, lambda x: x["id"]).alias("covers"))


def sync_progress(images: DataFrame, mode: str = "all") -> DataFrame:
    """(synced, total) of the rows that the mode covers."""
    scope = images if mode == "all" else images.where("remote_sync")
    return scope.where("file_type <> 'raw'").agg(F.count_if(F.col("remote_id").isNotNull()).alias("synced"), F.count("*").alias("total"))


def signature(images: DataFrame, vectors: DataFrame, version: int = 1) -> DataFrame:
    """What a cached derivation depends on: version, vectors, visible rows and the newest import."""
    return images.agg(F.count("*").alias("n_live"), F.max("imported_at").alias("newest")).crossJoin(vectors.agg(F.count("*").alias("n_vectors"))).withColumn("version", F.lit(version))


def example_count(images: DataFrame) -> DataFrame:
    """(n): visible rows that a suggestion can learn from."""
    return images.agg(F.count_if(F.col("edit_adjustments").isNotNull() | F.col("applied_adjustments").isNotNull()).alias("n"))


def shares(counts: DataFrame, n: str = "n") -> DataFrame:
    """``counts`` with percent of the total, halves up, and bar, the share of the largest; both 0 of nothing."""
    whole = counts.agg(F.sum(n).alias("__sum"), F.max(n).alias("__max"))
    part = lambda c: F.coalesce(F.col(n) / F.nullif(c, F.lit(0)), F.lit(0.0))
    return counts.crossJoin(F.broadcast(whole)).withColumns({"percent": F.floor(part("__sum") * 100 + 0.5).cast("int"), "bar": part("__max")}).drop("__sum", "__max")


def source_list(sources: DataFrame, images: DataFrame, scanning: DataFrame, reachable: DataFrame) -> DataFrame:
    """(id, name, path, n, scanning, available) of the source roots; n counts deleted rows too."""
    counted = images.where("source_root_id is not null").groupBy(F.col("source_root_id").alias("id")).agg(F.count("*").alias("n"))
    flag = lambda df, c: df.select("id").distinct().withColumn(c, F.lit(True))
    joined = sources.join(counted, "id", "left").join(flag(scanning, "scanning"), "id", "left").join(flag(reachable, "available"), "id", "left")
    return joined.select("id", "name", "path", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("scanning", "available")])


def shared_value(column: str, default) -> Column:
    """The value that all rows of a group share, else the default."""
    return F.when((F.min(column) == F.max(column)) & (F.count(column) == F.count("*")), F.min(column)).otherwise(F.lit(default))
