"""Changes: each takes the current snapshot and returns the next one, to be written to a new path."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import develop, strings
from . import entity
from .filters import clean_rule, has_edit

CONFIRMATION = "DELETE"
#: The tag that edited rows carry, and geometry without an edit.
EDIT_TAG = "edit"
NO_GEOMETRY = {
    "edit_rotation": 0, "edit_crop_x": None, "edit_crop_y": None, "edit_crop_width": None, "edit_crop_height": None, "edit_flip_h": False, "edit_flip_v": False, "edit_straighten": 0.0, "edit_persp_h": 0, "edit_persp_v": 0, "edit_distortion": 0,
}
CROP = ("edit_crop_x", "edit_crop_y", "edit_crop_width", "edit_crop_height")


def _ids(images: DataFrame, ids: list[int]) -> Column:
    return F.col("id").isin([int(i) for i in ids])


def with_partners(images: DataFrame, ids: list[int]) -> DataFrame:
    """The ids and their hidden halves."""
    chosen = images.where(_ids(images, ids))
    return chosen.select("id").union(chosen.where("paired_image_id is not null").select("paired_image_id")).distinct()


def _where_in(images: DataFrame, ids: DataFrame) -> DataFrame:
    return images.join(ids.select(F.col("id").alias("__id")).distinct().withColumn("__hit", F.lit(True)), F.col("id") == F.col("__id"), "left")


def update(images: DataFrame, ids: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Set columns of the rows with these ids."""
    marked = _where_in(images, ids)
    return marked.select(*[F.when(F.col("__hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in images.columns])


def rate(images: DataFrame, ids: list[int], rating: int | None = None, color: str | None = None) -> DataFrame:
    """Rating or colour of the rows and of their partners."""
    values = {k: F.lit(v) for k, v in (("rating", rating), ("color_label", color)) if v is not None}
    return update(images, with_partners(images, ids), values)


def describe(images: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """A trimmed description; blank means none."""
    return update(images, ids, {"description": F.nullif(F.trim(F.lit(text)), F.lit(""))})


def trash(images: DataFrame, ids: list[int], now: dt.datetime) -> DataFrame:
    return update(images, with_partners(images, ids), {"deleted_at": F.coalesce("deleted_at", F.lit(now).cast("timestamp_ntz"))})


def restore(images: DataFrame, ids: list[int]) -> DataFrame:
    """Trashed rows come back; markers of source roots don't."""
    back = images.where("deleted_at is not null and source_root_id is null").join(with_partners(images, ids), "id", "left_semi").select("id")
    return update(images, back, {"deleted_at": F.lit(None).cast("timestamp_ntz")})


def hard_delete(images: DataFrame, links: dict[str, DataFrame], gone: DataFrame) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Rows, their links in every child table, and the remote removals to queue: (images, links, queue)."""
    ids = gone.select("id").distinct()
    left = images.join(ids, "id", "left_anti")
    orphan = ids.select(F.col("id").alias("paired_image_id"), F.lit(True).alias("__gone"))
    left = left.join(orphan, "paired_image_id", "left").withColumn("paired_image_id", F.when(F.col("__gone").isNull(), F.col("paired_image_id"))).select(*images.columns)
    children = {k: v.join(ids.withColumnRenamed("id", "image_id"), "image_id", "left_anti").select(*v.columns) for k, v in links.items()}
    queue = images.join(ids, "id", "left_semi").where("remote_id is not null").select("id", "remote_id", "original_filename")
    return left, children, queue


def add_tags(links: DataFrame, ids: DataFrame, names: list[str]) -> DataFrame:
    """Links with these tags added; blanks are ignored, what is there stays once."""
    clean = [n.strip() for n in names if n.strip()]
    more = ids.select(F.col("id").alias("image_id")).withColumn("name", F.explode(F.array(*[F.lit(n) for n in clean]))) if clean else links.limit(0)
    return links.unionByName(more.select(*links.columns)).distinct()


def remove_tag(links: DataFrame, name: str, ids: DataFrame | None = None) -> DataFrame:
    """Links without a tag, of some images or of all."""
    if ids is None:
        return links.where(F.col("name") != name)
    gone = ids.select(F.col("id").alias("image_id"), F.lit(name).alias("name"))
    return links.join(gone, ["image_id", "name"], "left_anti").select(*links.columns)


def reset(images: DataFrame, ids: DataFrame, rating: bool = False, color: bool = False, develop: bool = False, geometry: bool = False) -> DataFrame:
    """Chosen fields back to their defaults; a row whose edits were reset has the revision of what is left."""
    values = {}
    if rating:
        values["rating"] = F.lit(0)
    if color:
        values["color_label"] = F.lit("none")
    if develop:
        values["edit_adjustments"] = F.lit(None).cast("string")
    if geometry:
        kinds = dict(images.dtypes)
        values |= {c: F.lit(v).cast(kinds[c]) for c, v in NO_GEOMETRY.items() if c in kinds}
    out = update(images, ids, {k: v for k, v in values.items() if k in images.columns})
    return sync_edit_state(out, ids) if develop or geometry else out


def reset_links(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Tags or album rows without those of the images."""
    return links.join(ids.select(F.col("id").alias("image_id")), "image_id", "left_anti").select(*links.columns)


def sync_edit_state(images: DataFrame, ids: DataFrame) -> DataFrame:
    """The revision of these rows counts up if they carry an edit and is 0 if not."""
    marked = _where_in(images, ids)
    rev = F.when(F.col("__hit") & has_edit(), F.coalesce("edit_rev", F.lit(0)) + 1).when(F.col("__hit"), 0).otherwise(F.col("edit_rev"))
    return marked.select(*[rev.alias(c) if c == "edit_rev" else F.col(c) for c in images.columns])


def sync_edit_tag(links: DataFrame, images: DataFrame, ids: DataFrame) -> DataFrame:
    """Tag links after :func:`sync_edit_state`: these rows carry the edit tag if they carry an edit."""
    own = images.join(ids.select("id").distinct(), "id", "left_semi")
    return add_tags(remove_tag(links, EDIT_TAG, own.where(~has_edit()).select("id")), own.where(has_edit()).select("id"), [EDIT_TAG])


def crop_fits(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Whether a crop box lies within the image and is not empty."""
    return x.between(0, 1) & (x < 1) & y.between(0, 1) & (y < 1) & (width > 0) & (width <= 1 - x) & (height > 0) & (height <= 1 - y)


def rotate(images: DataFrame, ids: DataFrame, degrees: int) -> DataFrame:
    """A turn by a multiple of 90 degrees; the crop no longer fits and goes, the revision counts up."""
    if degrees % 90:
        raise ValueError("degrees must be a multiple of 90")
    values = {"edit_rotation": F.pmod(F.coalesce("edit_rotation", F.lit(0)) + degrees, F.lit(360)), "edit_rev": F.coalesce("edit_rev", F.lit(0)) + 1}
    return update(images, ids, values | {c: F.lit(None).cast("double") for c in CROP})


def save_edits(images: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows with the geometry and the document of ``edits(id, rotation, crop_x, .., straighten, .., adjustments)``.

    Rotations are multiples of 90 and crops lie within the image, else it is an
    error; straightening is held within 45, perspective and distortion within
    100; documents are normalised and a neutral one is null.
    """
    crops = [F.col(f"crop_{c}") for c in ("x", "y", "width", "height")]
    if not edits.where((F.col("rotation") % 90 != 0) | (crops[0].isNotNull() & ~F.coalesce(crop_fits(*crops), F.lit(False)))).isEmpty():
        raise ValueError("a rotation isn't a multiple of 90, or a crop leaves the image")
    within = lambda c, most: F.greatest(F.lit(-most), F.least(F.lit(most), F.coalesce(F.col(c), F.lit(0 * most))))
    new = edits.select(
        F.col("id").alias("__id"), F.pmod("rotation", F.lit(360)).alias("n_rotation"), *[c.alias(f"n_crop_{k}") for c, k in zip(crops, ("x", "y", "width", "height"), strict=True)], *[F.coalesce(c, F.lit(False)).alias(f"n_{c}") for c in ("flip_h", "flip_v")],
        within("straighten", 45.0).alias("n_straighten"), *[within(c, 100).alias(f"n_{c}") for c in ("persp_h", "persp_v", "distortion")], develop.dumped(develop.normalised(F.col("adjustments"))).alias("n_adjustments"),
    )
    both = images.join(new, F.col("id") == F.col("__id"), "left")
    kinds, fields = dict(images.dtypes), {f"edit_{c.removeprefix('n_')}": c for c in new.columns if c != "__id"}
    saved = both.select(*[F.when(F.col("__id").isNotNull(), F.col(fields[c]).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in images.columns])
    return sync_edit_state(saved, edits)


def apply_develop(images: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows with the normalised ``documents(id, adjustments)``; geometry stays, the revision follows."""
    new = documents.select(F.col("id").alias("__id"), develop.dumped(develop.normalised(F.col("adjustments"))).alias("__doc"))
    both = images.join(new, F.col("id") == F.col("__id"), "left")
    saved = both.select(*[F.when(F.col("__id").isNotNull(), F.col("__doc")).otherwise(F.col(c)).alias(c) if c == "edit_adjustments" else F.col(c) for c in images.columns])
    return sync_edit_state(saved, documents)


def merge_suggestions(images: DataFrame, suggestions: DataFrame, groups: list[str]) -> DataFrame:
    """(id, adjustments): each row's own document with the enabled groups of its suggestion laid over it; ``suggestions(id, adj)`` are normalised."""
    if not groups:
        raise ValueError("no group is enabled")
    own = images.select("id", F.to_json(develop.normalised(F.col("edit_adjustments"))).alias("__own"))
    maps = lambda c: F.from_json(c, "map<string,string>")
    laid = own.join(suggestions.select("id", F.to_json("adj").alias("__new")), "id").select("id", develop.merged(maps("__own"), develop.only_groups(F.col("__new"), groups)).alias("m"))
    # values that are objects or lists come back as JSON text, which a plain map would quote
    quoted = F.transform(F.map_entries("m"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.when(e["key"].isin(*develop.ENUMS), F.concat(F.lit('"'), e["value"], F.lit('"'))).otherwise(e["value"])))
    return laid.select("id", F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}")).alias("adjustments"))


def append_to_album(links: DataFrame, album: int, ids: list[int]) -> DataFrame:
    """Ids that aren't in the album yet, at the positions after its last, in the order given.

    The list is a user's selection; it is numbered on the driver, so no window runs over it.
    """
    spark = links.sparkSession
    wanted = spark.createDataFrame([(int(i), n) for n, i in enumerate(dict.fromkeys(ids))], "image_id long, __n int")
    mine = links.where(F.col("album_id") == album)
    new = wanted.join(mine.select("image_id"), "image_id", "left_anti")
    start = mine.agg(F.count("*").alias("__start"))
    placed = new.crossJoin(F.broadcast(start)).withColumn("position", F.col("__start") + F.row_number().over(Window.orderBy("__n")) - 1)
    return links.unionByName(placed.select(F.lit(album).cast(dict(links.dtypes)["album_id"]).alias("album_id"), "image_id", F.col("position").cast(dict(links.dtypes)["position"]).alias("position")))


def remove_from_album(links: DataFrame, images: DataFrame, album: int, ids: DataFrame, mirrored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(links, queue): the album without these rows, and the remote removals that mirror it."""
    gone = ids.select(F.col("id").alias("image_id")).distinct().withColumn("album_id", F.lit(album).cast(dict(links.dtypes)["album_id"]))
    queue = images.where(F.lit(mirrored) & F.col("remote_id").isNotNull()).join(ids, "id", "left_semi").select("id", "remote_id")
    return links.join(gone, ["album_id", "image_id"], "left_anti").select(*links.columns), queue


def set_flag(rows: DataFrame, ids: DataFrame, enabled: bool, column: str = "remote_sync") -> DataFrame:
    """The sync flag of images or albums."""
    return update(rows, ids, {column: F.lit(enabled)})


def delete_from_trash(images: DataFrame, links: dict[str, DataFrame], ids: DataFrame | None = None, mounted: bool = True) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """:func:`hard_delete` of trashed rows, of all if no ids are given.

    Rows of source roots stay as markers; an id that isn't in the trash is an
    error, and so is a library that can't be reached.
    """
    if not mounted:
        raise ValueError("the library can't be reached")
    gone = images.where("deleted_at is not null and source_root_id is null")
    if ids is not None:
        if not images.where("deleted_at is null").join(ids, "id", "left_semi").isEmpty():
            raise ValueError("only rows in the trash can be deleted")
        gone = gone.join(ids.select("id"), "id", "left_semi")
    return hard_delete(images, links, gone)


def add_source(sources: DataFrame, source_id: str, owner: int, path: str, name: str = "") -> DataFrame:
    """``sources`` with a root; a blank path and one that is registered are errors; without a name the path is the name."""
    path = path.strip()
    if not path or not sources.where((F.col("owner_id") == owner) & (F.col("path") == path)).isEmpty():
        raise ValueError("the folder is blank or registered already")
    kinds = dict(sources.dtypes)
    row = {"id": source_id, "owner_id": owner, "path": path, "name": name.strip() or path}
    return sources.unionByName(sources.sparkSession.range(1).select(*[F.lit(row.get(c)).cast(kinds[c]).alias(c) for c in sources.columns]))


def remove_source(sources: DataFrame, images: DataFrame, staged: DataFrame, links: dict[str, DataFrame], source_id: str) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, DataFrame]]:
    """(sources, images, staged, links) without a root: its rows go, references to them become null, files stay."""
    gone = images.where(F.col("source_root_id") == source_id).select("id")
    left, children, _ = hard_delete(images.withColumn("remote_id", F.lit(None).cast("string")) if "remote_id" not in images.columns else images, links, gone)
    marked = staged.join(gone.distinct().withColumn("__gone", F.lit(True)).withColumnRenamed("id", "duplicate_of_image_id"), "duplicate_of_image_id", "left")
    cleared = marked.select(*[F.when(F.col("__gone").isNull(), F.col(c)).alias(c) if c == "duplicate_of_image_id" else F.col(c) for c in staged.columns])
    return sources.where(F.col("id") != source_id), left.select(*images.columns), cleared, children


def sync_with_library(images: DataFrame, links: dict[str, DataFrame], files: DataFrame, derived: DataFrame, root: str, mounted: bool = True) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(images, links, report) after the files of the library: ``files(path, size, content)``, ``derived(id)`` of cached renders.

    A managed row whose file is gone follows an untracked file of the same
    content, else it is deleted with its links; rows of source roots are left
    alone. The report counts rows removed, followed, files untracked, renders of
    no row and rows without renders. An absent library is an error, since every
    file would be missing.
    """
    if not mounted:
        raise ValueError("the library can't be reached")
    managed = images.where("source_root_id is null").withColumn("__path", F.concat_ws("/", F.lit(root), "file_path"))
    missing = managed.join(files.select(F.col("path").alias("__path")), "__path", "left_anti").select("id", F.col("file_size").alias("size"), F.col("file_hash").alias("sha"))
    free = files.join(managed.select(F.col("__path").alias("path")), "path", "left_anti")
    moved = entity.follow_renames(missing, free)
    lost = missing.join(moved, "id", "left_anti").select("id")
    left, children, _ = hard_delete(images, links, lost)
    new = moved.select(F.col("id").alias("__id"), F.expr(f"substring(path, {len(root.rstrip('/')) + 2})").alias("__new"))
    both = left.join(new, F.col("id") == F.col("__id"), "left")
    now = both.select(*[F.coalesce("__new", "file_path").alias(c) if c == "file_path" else F.col(c) for c in images.columns])
    count = lambda df, name: df.agg(F.count("*").alias(name))
    report = count(lost, "removed_missing_files").crossJoin(count(moved, "renamed_files_followed")).crossJoin(count(free.join(moved, "path", "left_anti"), "untracked_files_found"))
    report = report.crossJoin(count(derived.join(now, "id", "left_anti"), "orphan_renders_removed")).crossJoin(count(now.join(derived, "id", "left_anti"), "renders_queued"))
    return now, children, report


#: What a baked copy takes from its source; the lens and the country are not among them.
INHERITED = ("owner_id", "taken_at", "camera_make", "camera_model", "iso", "aperture", "shutter_speed", "focal_length", "gps_lat", "gps_lon")


def save_copy(images: DataFrame, source_id: int, new_id: int, file: dict, adjustments: str | None = None) -> DataFrame:
    """``images`` with a baked copy of a row: a managed JPEG with the fields of ``file`` and the look that was baked in.

    ``file`` names columns and their values, such as the path, name, hash and size; other columns are null.
    """
    kinds = dict(images.dtypes)
    look = develop.dumped(develop.normalised(F.lit(adjustments).cast("string")))
    values = {"id": F.lit(new_id), "file_type": F.lit("jpeg"), "applied_adjustments": look, "rating": F.lit(0), "color_label": F.lit("none"), "edit_rev": F.lit(0)} | {k: F.lit(v) for k, v in file.items()}
    copy = images.where(F.col("id") == source_id).select(*[values.get(c, F.col(c) if c in INHERITED else F.lit(None)).cast(kinds[c]).alias(c) for c in images.columns])
    return images.unionByName(copy)


def create_album(albums: DataFrame, album_id: int, name: str, rule: list[str] | None = None) -> DataFrame:
    """``albums(id, name, tag_filter)`` with a new one; its rule is cleaned, an empty one is null."""
    kinds = dict(albums.dtypes)
    row = {"id": F.lit(album_id), "name": F.lit(name), "tag_filter": _rule_text(rule or [])}
    return albums.unionByName(albums.sparkSession.range(1).select(*[row.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in albums.columns]))


def _rule_text(names: list[str]) -> Column:
    clean = clean_rule(F.array(*map(F.lit, names)).cast("array<string>"))
    return F.when(F.size(clean) > 0, F.to_json(clean))


def update_album(albums: DataFrame, album_id: int, name: str | None = None, rule: list[str] | None = None) -> DataFrame:
    """Name or rule of an album; what is None stays, an empty rule becomes null."""
    values = {k: v for k, v in (("name", F.lit(name)), ("tag_filter", _rule_text(rule or []))) if (name if k == "name" else rule) is not None}
    mine = F.col("id") == album_id
    return albums.select(*[F.when(mine, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in albums.columns])


def delete_album(albums: DataFrame, links: DataFrame, album_id: int) -> tuple[DataFrame, DataFrame]:
    """(albums, links) without an album; its images stay."""
    return albums.where(F.col("id") != album_id), links.where(F.col("album_id") != album_id)


def rename(images: DataFrame, row_id: int, name: str) -> DataFrame:
    """A row and its partner take a new stem and keep their extensions; a taken name is refused."""
    stem = F.lit(name)
    ext = F.regexp_extract("original_filename", r"(\.[^.]*)$", 1)
    ids = with_partners(images, [row_id])
    renamed = images.join(ids, "id", "left_semi").select(F.concat(stem, ext).alias("original_filename"))
    if not images.join(ids, "id", "left_anti").where("deleted_at is null").join(renamed, "original_filename", "left_semi").isEmpty():
        raise ValueError(f"{name} is taken")
    return update(images, ids, {"original_filename": F.concat(stem, ext)})


def rename_plan(images: DataFrame, wanted: DataFrame, pairs: bool = True) -> DataFrame:
    """(id, filename, path, error, asked) of renames ``wanted(id, name)`` and of their partners, all settled before anything changes.

    A typed name loses its row's own ending if it carries it; the ending stays.
    Of a row named twice the smaller name counts; a name that doesn't change
    anything gives no row. ``error`` is ``name`` for one that can't be a file's,
    ``taken`` where another row has the path, also one about to leave it, or
    where a row of smaller id goes there in the same plan. A partner follows its
    row's stem unless it is asked for itself or its row can't be renamed; what
    is in its own way doesn't stop the row. ``images(id, original_filename,
    file_path, paired_image_id, ..)``; unknown ids are left out.
    """
    ext = lambda c: F.regexp_extract(c, r"(?<=.)(\.[^.]*)$", 1)
    rows = images.select("id", "original_filename", "file_path", "paired_image_id", ext("original_filename").alias("ext"))
    one = wanted.groupBy("id").agg(F.min("name").alias("name"))
    typed = F.trim("name")
    bare = F.when((F.col("ext") != "") & F.lower(typed).endswith(F.lower("ext")), F.trim(F.expr("left(trim(name), length(trim(name)) - length(ext))"))).otherwise(typed)
    asked = rows.join(one, "id").withColumn("stem", bare).withColumn("filename", strings.renamed(F.col("stem"), F.col("ext"))).withColumn("asked", F.lit(True))
    named = _rename_targets(asked, images)
    if not pairs:
        return named.drop("stem", "partner")
    going = named.where("error is null and partner is not null").select(F.col("partner").alias("id"), "stem").groupBy("id").agg(F.min("stem").alias("stem"))
    follow = rows.join(going, "id").join(one.select("id"), "id", "left_anti").withColumn("filename", strings.renamed(F.col("stem"), F.col("ext"))).withColumn("asked", F.lit(False))
    # rows that were asked for have their places already; partners take what is left
    gone = named.where("error is null").select("path")
    partners = _rename_targets(follow, images)
    met = partners.join(gone.withColumn("__met", F.lit(True)), "path", "left").withColumn("error", F.when(F.col("error").isNull() & F.col("__met"), "taken").otherwise(F.col("error")))
    return named.unionByName(met.drop("__met")).drop("stem", "partner")


def _rename_targets(asked: DataFrame, images: DataFrame) -> DataFrame:
    folder = F.regexp_extract("file_path", r"^(.*/)?[^/]*$", 1)
    to = asked.withColumn("path", F.concat(folder, "filename")).where("path is null or path <> file_path")
    held = images.groupBy(F.col("file_path").alias("path")).agg(F.lit(True).alias("__held"))
    first = to.where("path is not null").groupBy("path").agg(F.min("id").alias("__first"))
    met = to.join(first, "path", "left").join(held, "path", "left")
    error = F.when(F.col("filename").isNull(), "name").when(F.col("__held") | (F.col("id") != F.col("__first")), "taken")
    return met.select("id", "filename", "path", error.alias("error"), "asked", "stem", F.col("paired_image_id").alias("partner"))


def apply_renames(images: DataFrame, plan: DataFrame) -> DataFrame:
    """The next rows: names and paths of a plan's rows without error; ids and all else stay."""
    new = plan.where("error is null").select("id", F.col("filename").alias("__filename"), F.col("path").alias("__path"))
    both = images.join(new, "id", "left")
    given = {"original_filename": "__filename", "file_path": "__path"}
    return both.select(*[F.coalesce(given[c], c).alias(c) if c in given else F.col(c) for c in images.columns])


def wipe(images: DataFrame, owner: int, confirmation: str) -> DataFrame:
    """All rows but the owner's; the exact confirmation is required."""
    if confirmation != CONFIRMATION:
        raise ValueError("not confirmed")
    return images.where(F.col("owner_id") != owner)


def repair(rows: DataFrame, fresh: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(next rows, ids that changed): re-read metadata takes the place of what differs; nulls in it change nothing."""
    new = fresh.select("id", *[F.col(c).alias(f"__{c}") for c in columns])
    both = rows.join(new, "id", "left")
    differs = F.lit(False)
    for c in columns:
        differs = differs | (F.col(f"__{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"__{c}")))
    changed = both.where(differs).select("id")
    return both.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns]), changed


def next_copy_name(images: DataFrame, name: str) -> DataFrame:
    """(name): the stem without an edit suffix, with the next free ``_edit-n``."""
    stem = F.regexp_replace(F.regexp_replace(F.lit(name), r"\.[^.]*$", ""), r"_edit-\d+$", "")
    taken = images.select(stem.alias("stem"), F.regexp_extract("original_filename", r"^(.*)_edit-(\d+)\.[^.]*$", 1).alias("s"), F.try_to_number(F.nullif(F.regexp_extract("original_filename", r"^(.*)_edit-(\d+)\.[^.]*$", 2), F.lit("")), F.lit("9999999999")).cast("long").alias("n"))
    return taken.groupBy("stem").agg(F.max(F.when(F.col("s") == F.col("stem"), F.col("n"))).alias("n")).select(F.concat("stem", F.lit("_edit-"), (F.coalesce("n", F.lit(0)) + 1).cast("string"), F.lit(".jpg")).alias("name"))
