"""Entity resolution: content dedup, merges, renames and pairs of sibling files."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = dt.timedelta(seconds=10)
#: What a merge takes over into a photo that is there already.
CARRIED_OVER = (
    "rating", "color_label", "edit_rotation", "edit_crop_x", "edit_crop_y", "edit_crop_width", "edit_crop_height", "edit_flip_h", "edit_flip_v", "edit_straighten", "edit_persp_h", "edit_persp_v", "edit_distortion",
    "edit_adjustments", "edit_rev", "applied_adjustments",
)


def first_wins(staged: DataFrame, content: str = "sha", seq: str = "seq", id_col: str = "id") -> DataFrame:
    """``staged`` with duplicate_of: the first row of the same content, null for the first itself.

    The originals come from a grouped minimum, which combines before the shuffle,
    so a content that many rows share is no hot window.
    """
    first = staged.where(F.col(content).isNotNull()).groupBy(content).agg(F.min(F.struct(seq, id_col))[id_col].alias("__first"))
    return staged.join(first, content, "left").withColumn("duplicate_of", F.when(F.col("__first") != F.col(id_col), F.col("__first"))).drop("__first")


def match_library(staged: DataFrame, library: DataFrame, content: str = "sha") -> DataFrame:
    """``staged`` with library_id: the smallest library id of the same content, else null."""
    known = library.groupBy(content).agg(F.min("id").alias("library_id"))
    return staged.join(known, content, "left")


def _first_of(rows: DataFrame, content: str) -> DataFrame:
    """Of several rows of one content that with the smallest id, by a grouped minimum."""
    return rows.groupBy(content).agg(F.min_by(F.struct(*rows.columns), "id").alias("__row")).select("__row.*")


def merge(home: DataFrame, source: DataFrame, content: str, fields: list[str] | tuple[str, ...] = CARRIED_OVER) -> DataFrame:
    """The next snapshot of ``home``: matched rows take ``fields`` from the source, unmatched source rows are added.

    Several source rows of one content count as the one with the smallest id.
    """
    one = _first_of(source, content)
    taken = one.select(F.col(content), *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__hit"))
    updated = home.join(taken, content, "left").select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in home.columns])
    return updated.unionByName(one.join(home.select(content), content, "left_anti").select(*home.columns))


def merge_summary(home: DataFrame, source: DataFrame, content: str, albums: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """(photos, known, new, bytes[, albums, tags]) of a merge before it runs."""
    known = home.select(content).distinct().withColumn("__hit", F.lit(True))
    out = source.join(known, content, "left").agg(
        F.count("*").alias("photos"), F.count_if(F.col("__hit")).alias("known"), F.count_if(F.col("__hit").isNull()).alias("new"), F.coalesce(F.sum(F.when(F.col("__hit").isNull(), F.col("size"))), F.lit(0)).cast("long").alias("bytes")
    )
    for name, rows in (("albums", albums), ("tags", tags)):
        if rows is not None:
            out = out.crossJoin(F.broadcast(rows.agg(F.count("*").alias(name))))
    return out


def id_map(home: DataFrame, source: DataFrame, content: str) -> DataFrame:
    """(source_id, id): the row of ``home``, after a merge, that stands for each source row: that of the same content with the smallest id."""
    known = home.groupBy(content).agg(F.min("id").alias("__home"))
    return source.join(known, content).select(F.col("id").alias("source_id"), F.col("__home").alias("id"))


def remap_pairs(home: DataFrame, source: DataFrame, ids: DataFrame) -> DataFrame:
    """``home`` with partners taken over from the source, through ``ids(source_id, id)``, where none is known yet."""
    own, other = ids.toDF("__source", "__here"), ids.toDF("__pair", "__partner")
    pairs = source.where("paired_image_id is not null").select(F.col("id").alias("__source"), F.col("paired_image_id").alias("__pair"))
    found = pairs.join(own, "__source").join(other, "__pair").groupBy("__here").agg(F.min("__partner").alias("__partner"))
    both = home.join(found, F.col("id") == F.col("__here"), "left")
    return both.select(*[F.coalesce("paired_image_id", "__partner").alias(c) if c == "paired_image_id" else F.col(c) for c in home.columns])


def tags_of(images: DataFrame, links: DataFrame) -> DataFrame:
    """(id, tags): every row's tag names in order; none is an empty list."""
    named = links.groupBy(F.col("image_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("tags"))
    return images.select("id").join(named, "id", "left").select("id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def follow_renames(missing: DataFrame, untracked: DataFrame) -> DataFrame:
    """(id, path): the k-th file of a content claims the k-th missing row of that content.

    Sizes are compared first, so only files that may match are hashed:
    ``missing(id, size, sha)``, ``untracked(path, size, content)``.
    """
    maybe = untracked.join(missing.select("size").distinct(), "size", "left_semi").withColumn("sha", F.sha2("content", 256))
    rank = lambda df, by: df.withColumn("__k", F.row_number().over(Window.partitionBy("sha").orderBy(by)))
    return rank(missing, "id").join(rank(maybe.drop("size"), "path"), ["sha", "__k"]).select("id", "path")


def stem(name: Column) -> Column:
    """The pairing key: the name in lower case without its extension."""
    return F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))


def camera_key(camera: Column) -> Column:
    return F.lower(F.trim(F.coalesce(camera, F.lit(""))))


def conflict(time_a: Column, time_b: Column, camera_a: Column, camera_b: Column, tolerance: dt.timedelta = TOLERANCE) -> Column:
    """Whether two files can't be one shot: known times too far apart, or different known cameras."""
    apart = F.abs(F.unix_micros(time_a.cast("timestamp")) - F.unix_micros(time_b.cast("timestamp"))) > int(tolerance.total_seconds() * 1_000_000)
    a, b = camera_key(camera_a), camera_key(camera_b)
    return F.coalesce(apart, F.lit(False)) | ((a != "") & (b != "") & (a != b))


def pairs_one_to_one(shots: DataFrame, tolerance: dt.timedelta = TOLERANCE) -> DataFrame:
    """(stem, raw_id, other_id) of stems with exactly one raw and one JPEG that don't conflict."""
    raw, jpeg = F.col("kind") == "raw", F.col("kind") == "jpeg"
    pick = lambda c, w: F.max(F.when(w, F.col(c)))
    both = shots.groupBy("stem").agg(
        F.count_if(raw).alias("raws"), F.count_if(jpeg).alias("others"), pick("id", raw).alias("raw_id"), pick("id", jpeg).alias("other_id"),
        pick("taken_at", raw).alias("raw_at"), pick("taken_at", jpeg).alias("other_at"), pick("camera", raw).alias("raw_camera"), pick("camera", jpeg).alias("other_camera"),
    ).where("raws = 1 and others = 1")
    return both.where(~conflict(F.col("raw_at"), F.col("other_at"), F.col("raw_camera"), F.col("other_camera"), tolerance)).select("stem", "raw_id", "other_id")


def pair_groups(shots: DataFrame, tolerance: dt.timedelta = TOLERANCE) -> DataFrame:
    """(stem, raw_id, other_id) of any stem group.

    One raw and one JPEG pair unless they conflict. In a larger group each raw,
    in order of id, takes the only free JPEG that confirms it: both times known
    and within the tolerance, the cameras not at odds; whatever stays ambiguous
    stays alone. Files of other kinds take no part. A JPEG that is taken takes
    all rows of its id along.
    """
    limit = tolerance.total_seconds()

    def clash(a: dict, b: dict) -> bool:
        known = a["taken_at"] is not None and b["taken_at"] is not None
        return (known and abs((a["taken_at"] - b["taken_at"]).total_seconds()) > limit) or bool(a["camera"] and b["camera"] and a["camera"] != b["camera"])

    def pair(group: list[dict]) -> list[tuple]:
        raws, others, out = [x for x in group if x["kind"] == "raw"], [x for x in group if x["kind"] == "jpeg"], []
        alone = len(raws) == len(others) == 1
        for raw in raws:
            hits = [o for o in others if (alone or raw["taken_at"] is not None and o["taken_at"] is not None) and not clash(raw, o)]
            if len(hits) == 1:
                out.append((raw["stem"], raw["id"], hits[0]["id"]))
                others = [o for o in others if o["id"] != hits[0]["id"]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by stem and id; a stem's files are few
        group: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if group and group[0]["stem"] != row["stem"]:
                    out += pair(group)
                    group = []
                group.append(row)
            yield table(out)
        if group:
            yield table(pair(group))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["stem", "raw_id", "other_id"])

    kinds = dict(shots.dtypes)
    types = [{"bigint": pa.int64(), "int": pa.int32()}.get(kinds[c], pa.string()) for c in ("stem", "id", "id")]
    own = shots.where(F.col("kind").isin("raw", "jpeg"))
    some = own.groupBy("stem").agg(F.count_if(F.col("kind") == "raw").alias("r"), F.count("*").alias("n")).where("r > 0 and n > r").select("stem")
    chosen = own.join(some, "stem", "left_semi").select("stem", "id", "kind", "taken_at", camera_key(F.col("camera")).alias("camera"))
    return chosen.repartition("stem").sortWithinPartitions("stem", "id", "taken_at", "camera").mapInArrow(run, f"stem {kinds['stem']}, raw_id {kinds['id']}, other_id {kinds['id']}")


def conflicting_pairs(images: DataFrame, tolerance: dt.timedelta = TOLERANCE) -> DataFrame:
    """(id, paired_image_id) of pairs, judged once from the smaller id, whose halves conflict; an absent partner is left."""
    other = images.select(F.col("id").alias("paired_image_id"), F.col("taken_at").alias("__at"), F.col("camera_model").alias("__camera"))
    both = images.where(F.col("id") < F.col("paired_image_id")).join(other, "paired_image_id")
    return both.where(conflict(F.col("taken_at"), F.col("__at"), F.col("camera_model"), F.col("__camera"), tolerance)).select("id", "paired_image_id")


def incomplete_pairs(files: DataFrame) -> DataFrame:
    """The unselected halves of pairs of which one half is selected."""
    other = files.select(F.col("id").alias("paired_image_id"), F.col("selected").alias("__other"))
    return files.join(other, "paired_image_id").where(~F.col("selected") & F.col("__other")).select("id")


def _one_of_each(shots: DataFrame, by: list[str]) -> DataFrame:
    """(raw_id, jpeg_id) of groups that hold exactly one raw and one JPEG."""
    raw, jpeg = F.col("file_type") == "raw", F.col("file_type") == "jpeg"
    counted = shots.groupBy(*by).agg(F.count_if(raw).alias("r"), F.count_if(jpeg).alias("j"), F.max(F.when(raw, F.col("id"))).alias("raw_id"), F.max(F.when(jpeg, F.col("id"))).alias("jpeg_id"))
    return counted.where("r = 1 and j = 1").select("raw_id", "jpeg_id")


def pair_scanned(images: DataFrame, root: str) -> DataFrame:
    """(raw_id, jpeg_id) of a source root after a scan: first within a folder by stem, then anywhere by stem and equal capture time.

    Only visible rows without a partner take part; the second pass needs a known
    time and what the first has left, of the whole library.
    """
    free = images.where("paired_image_id is null and deleted_at is null").withColumn("__stem", stem(F.col("original_filename")))
    own = free.where(F.col("source_root_id") == root)
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    first = _one_of_each(own.withColumn("__folder", folder).withColumn("__stem", stem(F.element_at(F.split("file_path", "/"), -1))), ["__folder", "__stem"])
    taken = first.select(F.explode(F.array("raw_id", "jpeg_id")).alias("id"))
    left = free.where("taken_at is not null").join(taken, "id", "left_anti")
    return first.unionByName(_one_of_each(left, ["__stem", "taken_at"]))


def with_pairs(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """``images`` with both halves of ``pairs(raw_id, jpeg_id)`` pointing at each other."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("raw_id").alias("a"), F.col("jpeg_id").alias("b")), F.struct(F.col("jpeg_id").alias("a"), F.col("raw_id").alias("b")))).alias("x")).select("x.*")
    joined = images.join(both, F.col("id") == F.col("a"), "left")
    return joined.select(*[F.coalesce("b", "paired_image_id").alias(c) if c == "paired_image_id" else F.col(c) for c in images.columns])


def trashed_duplicates(staged: DataFrame, images: DataFrame) -> DataFrame:
    """(id): trashed rows that staged files are copies of."""
    gone = images.where("deleted_at is not null").select("id")
    return gone.join(staged.select(F.col("duplicate_of_image_id").alias("id")), "id", "left_semi")


def selectable(staged: DataFrame, images: DataFrame) -> DataFrame:
    """``staged`` with ``selectable``: no duplicate, or a copy of a row of a source root or of the trash."""
    back = images.where("source_root_id is not null or deleted_at is not null").select(F.col("id").alias("__id"), F.lit(True).alias("__back"))
    # most files are no copies: their nulls, which match nothing, would all be dealt to one task
    copies = staged.where("duplicate_of_image_id is not null").join(back, F.col("duplicate_of_image_id") == F.col("__id"), "left")
    joined = copies.unionByName(staged.where("duplicate_of_image_id is null").withColumns({"__id": F.lit(None).cast(dict(images.dtypes)["id"]), "__back": F.lit(None).cast("boolean")}))
    fresh = F.col("duplicate_of_image_id").isNull() & F.col("duplicate_of_staged_file_id").isNull()
    return joined.withColumn("selectable", fresh | F.coalesce("__back", F.lit(False))).drop("__id", "__back")


def update_staged(staged: DataFrame, images: DataFrame, ids: DataFrame, selected: bool | None = None, rating: int | None = None, color: str | None = None, strict: bool = False) -> DataFrame:
    """``staged`` with these values set for ``ids(id)``; selecting a blocked duplicate is skipped, or an error if ``strict``."""
    marked = selectable(staged, images).join(ids.select(F.col("id").alias("__hit")).distinct(), F.col("id") == F.col("__hit"), "left")
    hit = F.col("__hit").isNotNull()
    if strict and selected and not marked.where(hit & ~F.col("selectable")).isEmpty():
        raise ValueError("a duplicate can't be imported again")
    values = {k: v for k, v in (("selected", selected), ("rating", rating), ("color_label", color)) if v is not None}
    may = lambda k: hit & F.col("selectable") if k == "selected" and selected else hit
    return marked.select(*[F.when(may(c), F.lit(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in staged.columns])


def commit_plan(staged: DataFrame, images: DataFrame) -> DataFrame:
    """(id, action, image_id) of the selected and processed files of an import.

    A file without a twin is an ``insert``; a copy of a row of a source root
    ``promote``s it and a copy of a trashed row ``restore``s it, of several
    copies of one row the first by ``seq``; everything else isn't imported.
    """
    ready = staged.where("selected and processed")
    fresh = ready.where("duplicate_of_image_id is null and duplicate_of_staged_file_id is null").select("id", F.lit("insert").alias("action"), F.lit(None).cast(dict(images.dtypes)["id"]).alias("image_id"))
    one = ready.where("duplicate_of_image_id is not null").groupBy(F.col("duplicate_of_image_id").alias("image_id")).agg(F.min_by("id", "seq").alias("id"))
    known = images.where("source_root_id is not null or deleted_at is not null").select(F.col("id").alias("image_id"), F.when(F.col("source_root_id").isNotNull(), "promote").otherwise("restore").alias("action"))
    return fresh.unionByName(one.join(known, "image_id").select("id", "action", "image_id"))


def promote(staged: DataFrame) -> DataFrame:
    """Per content, the first selected and processed row that isn't in the library: what a commit imports."""
    ready = staged.where("selected and processed and library_id is null")
    return ready.groupBy("sha").agg(F.min_by(F.struct(*staged.columns), "seq").alias("__row")).select("__row.*")


def unprocessed(staged: DataFrame, sessions: DataFrame) -> DataFrame:
    """Files of open sessions that were not analysed: what a restart takes up again. ``sessions(session_id, status)``."""
    return staged.where("not processed").join(sessions.where("status = 'staging'").select("session_id"), "session_id", "left_semi")


def scan_status(actions: DataFrame, listed: DataFrame) -> DataFrame:
    """(scanned, added, relocated) of a scan from its ``actions(path, action)`` and the files it listed."""
    counted = actions.agg(F.count_if(F.col("action") == "index").alias("added"), F.count_if(F.col("action") == "relocate").alias("relocated"))
    return listed.agg(F.count("*").alias("scanned")).crossJoin(F.broadcast(counted))
