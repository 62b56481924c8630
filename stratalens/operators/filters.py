"""The catalog's shared filter set: one description, used by every list, count, facet and search."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import develop
from . import geo, order

#: Fixed value: stands for "has no location" in the country filter.
NO_COUNTRY = "__none__"
FOCAL_TOLERANCE = 0.05


@dataclass(frozen=True)
class LibraryFilter:
    """Active predicates; a field that is None or empty is off."""

    view_mode: str = "combined"
    album: int | None = None
    rating_min: int | None = None
    color: str | None = None
    camera: str | None = None
    lens: str | None = None
    focal_min: float | None = None
    focal_max: float | None = None
    country: str | None = None
    date_from: dt.datetime | None = None
    date_to: dt.datetime | None = None
    tags: tuple[str, ...] = ()
    unavailable_roots: tuple[str, ...] = ()

    def lifted(self, *fields: str) -> LibraryFilter:
        """The filter without these dimensions."""
        return replace(self, **{f: None for f in fields})


def available(roots: tuple[str, ...], column: str = "source_root_id") -> Column:
    """Rows of no source root, or of a reachable one."""
    return F.col(column).isNull() | ~F.col(column).isin(*roots) if roots else F.lit(True)


def predicates(f: LibraryFilter) -> dict[str, Column]:
    """Row-wise predicates of the active fields, by field."""
    out: dict[str, Column] = {}
    if f.unavailable_roots:
        out["unavailable_roots"] = available(f.unavailable_roots)
    if f.view_mode in ("jpeg_only", "raw_only"):
        out["view_mode"] = F.col("file_type") == f.view_mode.removesuffix("_only")
    if f.rating_min is not None:
        out["rating_min"] = F.col("rating") >= f.rating_min
    for field, column in (("color", "color_label"), ("camera", "camera_model"), ("lens", "lens_model")):
        if getattr(f, field):
            out[field] = F.col(column) == getattr(f, field)
    if f.focal_min is not None:
        out["focal_min"] = F.col("focal_length") >= f.focal_min - FOCAL_TOLERANCE
    if f.focal_max is not None:
        out["focal_max"] = F.col("focal_length") <= f.focal_max + FOCAL_TOLERANCE
    if f.country == NO_COUNTRY:
        out["country"] = F.col("gps_lat").isNull()
    elif f.country:
        out["country"] = F.col("gps_country") == f.country
    if f.date_from is not None:
        out["date_from"] = F.col("taken_at") >= F.lit(f.date_from).cast("timestamp_ntz")
    if f.date_to is not None:
        out["date_to"] = F.col("taken_at") <= F.lit(f.date_to).cast("timestamp_ntz")
    return out


def with_all_tags(images: DataFrame, links: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """Images that carry every wanted tag. Blanks are dropped; a repeated name can't be satisfied."""
    names = [w.strip() for w in wanted if w.strip()]
    if not names:
        return images
    full = links.where(F.col("name").isin(*names)).groupBy("image_id").agg(F.countDistinct("name").alias("n")).where(F.col("n") == len(names))
    return images.join(full, images["id"] == full["image_id"], "left_semi")


def with_any_tag(images: DataFrame, links: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Images that carry one of the tags."""
    hits = links.where(F.col("name").isin(*names))
    return images.join(hits, images["id"] == hits["image_id"], "left_semi")


def album_members(album_images: DataFrame, links: DataFrame, album: int, rule: tuple[str, ...] = ()) -> DataFrame:
    """Distinct image ids of an album: added by hand, or carrying a tag of its rule."""
    manual = album_images.where(F.col("album_id") == album).select("image_id")
    return manual.union(links.where(F.col("name").isin(*rule)).select("image_id")).distinct() if rule else manual.distinct()


def first_places(album_images: DataFrame, *by: str) -> DataFrame:
    """``album_images`` with one row per album and image, the first by position or as ``by`` says: one sort, which joins by image go on with."""
    w = Window.partitionBy("image_id", "album_id").orderBy(*by or (F.asc_nulls_last("position"),))
    return album_images.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first")


def tag_sets(links: DataFrame, rules: DataFrame) -> DataFrame:
    """(image_id, names): each image's tags that a rule names, sorted. Such tags are looked up before links are made distinct; their names are few."""
    named = links.select("image_id", "name").join(F.broadcast(rules.select("name").distinct()), "name", "left_semi")
    return named.groupBy("image_id").agg(F.sort_array(F.collect_set("name")).alias("names"))


def album_sizes(rules: DataFrame, album_images: DataFrame, links: DataFrame, images: DataFrame) -> DataFrame:
    """(album_id, n): visible images of each album that has any, added by hand or carrying a tag of its rule.

    ``rules(album_id, name)``. Images are counted once per set of rule tags that
    occurs, and sets once per distinct rule, however many albums share it; rows added by hand count if they carry none of
    their album's tags, so albums and images are never listed in pairs.
    """
    shown = images.select(F.col("id").alias("image_id"))
    own = tag_sets(links, rules).join(shown, "image_id", "left_semi")
    sets = rules.groupBy("album_id").agg(F.array_sort(F.collect_set("name")).alias("rule"))
    by_name = sets.select("rule").distinct().withColumn("name", F.explode("rule"))
    alike = own.groupBy("names").agg(F.count("*").alias("n")).withColumn("name", F.explode("names"))
    counted = alike.join(by_name, "name").select("rule", "names", "n").distinct().groupBy("rule").agg(F.sum("n").alias("n"))
    manual = first_places(album_images, "image_id").select("album_id", "image_id").join(shown, "image_id", "left_semi").join(sets, "album_id", "left")
    more = manual.join(own, "image_id", "left").where(F.coalesce(~F.arrays_overlap("names", "rule"), F.lit(True)))
    both = sets.join(counted, "rule").select("album_id", "n").unionByName(more.groupBy("album_id").agg(F.count("*").alias("n")))
    return both.groupBy("album_id").agg(F.sum("n").alias("n"))


def clean_rule(names: Column) -> Column:
    """A tag rule's names: trimmed, blanks dropped, the first of equal ones kept, in order."""
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def parsed_rule(text: Column) -> Column:
    """A stored tag rule, a JSON list of texts; nothing or anything else is the empty rule."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.filter(F.from_json(text, "array<string>"), lambda x: x.isNotNull()), none)


def apply(images: DataFrame, f: LibraryFilter, links: DataFrame | None = None, album_images: DataFrame | None = None, rule: tuple[str, ...] = ()) -> DataFrame:
    """The visible rows that pass the filter. For a search scope, leave ``rule`` empty: only rows added by hand count there."""
    out = reduce(DataFrame.where, predicates(f).values(), images)
    if f.tags:
        out = with_all_tags(out, links, f.tags)
    if f.album is not None:
        members = album_members(album_images, links, f.album, rule)
        out = out.join(members, out["id"] == members["image_id"], "left_semi")
    return out


def edited(columns: Iterable[str] = ()) -> Column:
    """Edited in place, or with a look baked in; ``columns`` are those of the rows, which may lack ``applied_adjustments``."""
    in_place = F.col("edit_rev") > 0
    return in_place | F.col("applied_adjustments").isNotNull() if "applied_adjustments" in columns else in_place


def has_edit() -> Column:
    """Any edit that can be undone: geometry or a develop document."""
    off = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) != 0
    out = (F.coalesce(F.col("edit_rotation"), F.lit(0)) % 360 != 0) | F.col("edit_crop_width").isNotNull() | F.col("edit_adjustments").isNotNull()
    for c in ("edit_flip_h", "edit_flip_v", "edit_straighten", "edit_persp_h", "edit_persp_v", "edit_distortion"):
        out = out | off(c)
    return out


def untouched() -> Column:
    """Rendering changes nothing: no geometry and a neutral develop document. A full turn counts as geometry here."""
    none = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) == 0
    out = none("edit_rotation") & F.col("edit_crop_x").isNull() & develop.is_neutral(develop.normalised(F.col("edit_adjustments")))
    for c in ("edit_distortion", "edit_flip_h", "edit_flip_v", "edit_straighten", "edit_persp_h", "edit_persp_v"):
        out = out & none(c)
    return out


def mergeable(images: DataFrame) -> DataFrame:
    """What a merge takes from a library: managed rows out of the trash, by capture time."""
    return images.where("source_root_id is null and deleted_at is null").orderBy(F.asc_nulls_first("taken_at"), "id")


def trash_list(images: DataFrame, owner: int) -> DataFrame:
    """The owner's trash, last deleted first; rows of source roots are markers and not shown."""
    return images.where((F.col("owner_id") == owner) & F.col("deleted_at").isNotNull() & F.col("source_root_id").isNull()).orderBy(F.desc("deleted_at"), "id")


def owned(rows: DataFrame, row_id: int, owner: int) -> DataFrame:
    """The owner's row of that id; no such row is an error."""
    found = rows.where((F.col("id") == row_id) & (F.col("owner_id") == owner))
    if found.isEmpty():
        raise LookupError(f"no row {row_id}")
    return found


def review(staged: DataFrame, view_mode: str = "combined", rating_min: int | None = None, color: str | None = None, hide_duplicates: bool = True) -> DataFrame:
    """Staged files to look through: blocked duplicates are hidden, those that restore from the trash are not.

    ``staged(duplicate_of_image_id, duplicate_of_staged_file_id, in_trash, file_type, rating, color_label)``.
    """
    duplicate = F.col("duplicate_of_image_id").isNotNull() | F.col("duplicate_of_staged_file_id").isNotNull()
    out = staged.where(~duplicate | F.coalesce("in_trash", F.lit(False))) if hide_duplicates else staged
    return reduce(DataFrame.where, predicates(LibraryFilter(view_mode=view_mode, rating_min=rating_min, color=color)).values(), out)


def expired(days: int, now: dt.datetime) -> Column:
    """Trash that may be purged; no days, no purge. Rows of source roots are markers and stay."""
    if days <= 0:
        return F.lit(False)
    return F.col("source_root_id").isNull() & (F.col("deleted_at") < F.lit(now - dt.timedelta(days=days)).cast("timestamp_ntz"))


def time_bounds(kind: str, key: str) -> tuple[dt.datetime, dt.datetime]:
    """The half-open range of a year, month or day key."""
    parts = [int(x) for x in key.split("-")]
    if kind == "year":
        return dt.datetime(parts[0], 1, 1), dt.datetime(parts[0] + 1, 1, 1)
    if kind == "month":
        return dt.datetime(parts[0], parts[1], 1), dt.datetime(parts[0] + parts[1] // 12, parts[1] % 12 + 1, 1)
    if kind == "day":
        start = dt.datetime(*parts)
        return start, start + dt.timedelta(days=1)
    raise ValueError(f"unknown kind {kind}")


def in_time(kind: str, key: str) -> Column:
    start, end = time_bounds(kind, key)
    return (F.col("taken_at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("taken_at") < F.lit(end).cast("timestamp_ntz"))


def smart_predicate(smart_id: str, columns: Iterable[str] = ()) -> Column:
    """The predicate of a derived collection's id ``kind:key`` over rows of these columns."""
    kind, _, key = smart_id.partition(":")
    if kind in ("year", "month", "day"):
        return in_time(kind, key)
    if kind == "country":
        return F.col("gps_country") == key
    if kind == "country-year":
        country, _, year = key.rpartition(":")
        return (F.col("gps_country") == country) & in_time("year", year)
    if kind == "edits":
        return edited(columns)
    raise ValueError(f"unknown collection {smart_id}")


def smart_album(images: DataFrame, smart_id: str, links: DataFrame | None = None, clusters: DataFrame | None = None, radius_km: float = 10.0) -> DataFrame:
    """The rows of a derived collection, in the total order.

    ``links(image_id, name)`` serves tags; ``clusters(cluster, name, group, image_id)``
    serves clusters and groups of clusters, which must exist; an unknown id is an error.
    """
    kind, colon, key = smart_id.partition(":")
    if kind == "tag":
        out = with_any_tag(images, links, (key,))
    elif kind in ("cluster", "cluster-group") and colon:
        if kind == "cluster" and not key.isdigit():
            raise ValueError(f"unknown collection {smart_id}")
        members = clusters.where(F.col("cluster") == int(key) if kind == "cluster" else F.coalesce(F.nullif("group", F.lit("")), "name") == key)
        if members.isEmpty():
            raise ValueError(f"no collection {smart_id}")
        out = images.join(members.select(F.col("image_id").alias("id")).distinct(), "id", "left_semi")
    elif kind == "place":
        try:
            lat, lon = map(float, key.split(","))
        except ValueError:
            raise ValueError(f"unknown collection {smart_id}") from None
        out = geo.near_point(images, lat, lon, radius_km).drop("km")
    else:
        out = images.where(smart_predicate(smart_id, images.columns))
    return out.orderBy(*order.total_order())


def name_contains(query: str, column: str = "name") -> Column:
    """Case-insensitive substring with SQL wildcards left active and no escape."""
    pattern = "%" + query.lower().replace("\\", "\\\\") + "%"
    return F.lower(F.col(column)).like(pattern)
