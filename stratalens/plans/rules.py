"""Registered queries of the catalog's rules: edits, imports, merges, mirroring, names and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, develop, strings
from ..operators import aggregates, changes, collections, entity, filters, geo, mirror, order, places, search, vectors
from ..session import partitions, table
from ..sources import catalog
from . import views
from .roster import KM, ORDER, query

_GEOMETRY = "edit_flip_h OR edit_flip_v OR edit_straighten <> 0 OR edit_persp_h <> 0 OR edit_persp_v <> 0 OR edit_distortion <> 0"
_HAS_EDIT = f"(edit_rotation % 360 <> 0 OR edit_crop_width IS NOT NULL OR {_GEOMETRY} OR edit_adjustments IS NOT NULL)"
_NEUTRAL = "coalesce(try_cast(json_extract_string(edit_adjustments, '$.contrast') AS double), 0) = 0"


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows of a small file that need much work each, as many tasks as the session has partitions."""
    return df.repartition(partitions(df.sparkSession), key)


def _positions(df: DataFrame, column: str) -> DataFrame:
    """A list column as rows (rank, id)."""
    return df.select(*[c for c in df.columns if c != column], F.posexplode(column).alias("pos", "id")).withColumn("rank", (F.col("pos") + 1).cast("long")).drop("pos")


# ---- predicates -------------------------------------------------------------


@query(f"SELECT id FROM v_live WHERE {_HAS_EDIT}")
def has_any_edit(spark, sf_dir):
    return views.live(spark, sf_dir).where(filters.has_edit()).select("id")


@query(f"SELECT id FROM v_live WHERE edit_rotation = 0 AND edit_crop_x IS NULL AND NOT ({_GEOMETRY}) AND {_NEUTRAL}")
def untouched(spark, sf_dir):
    return views.live(spark, sf_dir).where(filters.untouched()).select("id")


@query("SELECT id FROM v_image WHERE source_root_id IS NULL AND deleted_at IS NULL")
def mergeable(spark, sf_dir):
    return filters.mergeable(views.images(spark, sf_dir)).select("id")


@query("SELECT id FROM v_live WHERE file_type = 'raw' AND rating >= 3")
def view_raw_only(spark, sf_dir):
    return filters.apply(views.live(spark, sf_dir), filters.LibraryFilter(view_mode="raw_only", rating_min=3)).select("id")


@query("SELECT id FROM v_live WHERE id IN (SELECT image_id FROM v_album_image WHERE album_id = 7) OR id IN (SELECT image_id FROM v_image_tag WHERE name IN (SELECT name FROM v_rule WHERE album_id = 7))")
def album_grid(spark, sf_dir):
    rule = tuple(r["name"] for r in views.album_rules(spark, sf_dir).where("album_id = 7").select("name").distinct().collect())
    f = filters.LibraryFilter(album=7)
    return filters.apply(views.live(spark, sf_dir), f, views.image_tags(spark, sf_dir), views.album_images(spark, sf_dir), rule).select("id")


@query("SELECT id FROM v_live WHERE rating >= 2 AND id IN (SELECT image_id FROM v_album_image WHERE album_id = 7)")
def album_search_scope(spark, sf_dir):
    f = filters.LibraryFilter(album=7, rating_min=2)
    return filters.apply(views.live(spark, sf_dir), f, None, views.album_images(spark, sf_dir)).select("id")


@query("SELECT id FROM v_live WHERE id IN (SELECT image_id FROM v_image_tag WHERE name = 'PROMO')")
def smart_tag(spark, sf_dir):
    return filters.smart_album(views.live(spark, sf_dir), "tag:PROMO", views.image_tags(spark, sf_dir)).select("id")


@query(f"SELECT id FROM v_live WHERE {KM.format(lat1='10.5', lon1='20.25', lat2='gps_lat', lon2='gps_lon')} <= 1500")
def smart_place(spark, sf_dir):
    return filters.smart_album(views.live(spark, sf_dir), "place:10.5,20.25", radius_km=1500.0).select("id")


def _clusters(spark, sf_dir) -> DataFrame:
    """Vectors of one label are a cluster, three labels a group."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("label").alias("cluster"), F.concat(F.lit("moment "), F.col("label").cast("string")).alias("name"), F.when(F.col("label") % 3 != 0, F.concat(F.lit("group "), (F.col("label") % 3).cast("string"))).alias("group"), F.col("vec_id").alias("image_id"))


@query("SELECT id FROM v_live WHERE id IN (SELECT vec_id FROM embeddings WHERE label = 1)")
def smart_cluster(spark, sf_dir):
    return filters.smart_album(views.live(spark, sf_dir), "cluster:1", clusters=_clusters(spark, sf_dir)).select("id")


@query("SELECT id FROM v_live WHERE id IN (SELECT vec_id FROM embeddings WHERE label % 3 = 1)")
def smart_cluster_group(spark, sf_dir):
    return filters.smart_album(views.live(spark, sf_dir), "cluster-group:group 1", clusters=_clusters(spark, sf_dir)).select("id")


@query("SELECT t.id, t.name FROM v_tag t WHERE lower(t.name) LIKE '%ar%'")
def tag_contains(spark, sf_dir):
    return views.tags(spark, sf_dir).where(filters.name_contains("AR")).select("id", "name")


@query("SELECT s_suppkey AS id, list_distinct(['a', 'b' || cast(s_suppkey % 3 AS varchar)]) IS NOT NULL AS ok, CASE WHEN s_suppkey % 3 = 0 THEN 'a,b0' ELSE 'b' || cast(s_suppkey % 3 AS varchar) || ',a' END AS rule FROM supplier")
def tag_rule_cleaned(spark, sf_dir):
    b = F.concat(F.lit("b"), (F.col("s_suppkey") % 3).cast("string"))
    names = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit(" a"), F.lit(""), b, F.lit("a "))).otherwise(F.array(b, F.lit("a"), F.concat(b, F.lit(" ")), F.lit("  ")))
    parsed = filters.clean_rule(filters.parsed_rule(F.to_json(names)))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), parsed.isNotNull().alias("ok"), F.array_join(parsed, ",").alias("rule"))


# ---- collections ------------------------------------------------------------

_COVERS = "row_number() OVER (PARTITION BY {by} ORDER BY CASE WHEN file_type = 'jpeg' THEN 0 ELSE 1 END, taken_at DESC NULLS LAST, id) AS rank, count(*) OVER (PARTITION BY {by}) AS n, bool_or(file_type = 'jpeg') OVER (PARTITION BY {by}) AS any_jpeg"
_TOP = "rank <= 4 AND (file_type = 'jpeg' OR NOT any_jpeg)"


@query(
    f"WITH y AS (SELECT id, file_type, cast(year(taken_at) AS varchar) AS key, {_COVERS.format(by='year(taken_at)')} FROM v_live WHERE taken_at IS NOT NULL), m AS (SELECT id, file_type, strftime(taken_at, '%Y-%m') AS key, strftime(taken_at, '%B %Y') AS name, {_COVERS.format(by=chr(39).join(('strftime(taken_at, ', '%Y-%m', ')')))} FROM v_live WHERE taken_at IS NOT NULL), "
    f"d AS (SELECT id, file_type, cast(taken_at AS date) AS day, {_COVERS.format(by='cast(taken_at AS date)')} FROM v_live WHERE taken_at IS NOT NULL), big AS (SELECT day FROM d, (SELECT median(n) AS middle FROM (SELECT day, max(n) AS n FROM d GROUP BY 1)) WHERE rank = 1 AND n >= greatest(10.0, middle * 1.5) ORDER BY day DESC LIMIT 30) "
    f"SELECT 'year' AS kind, key, key AS name, n, rank, id FROM y WHERE {_TOP} UNION ALL SELECT 'month', key, name, n, rank, id FROM m WHERE n >= 5 AND {_TOP} UNION ALL SELECT 'day', cast(day AS varchar), strftime(day, '%-d %B %Y'), n, rank, id FROM d WHERE day IN (SELECT day FROM big) AND {_TOP}"
)
def time_albums(spark, sf_dir):
    return _positions(collections.time_albums(views.live(spark, sf_dir), factor=1.5), "covers")


@query(
    "WITH m AS (SELECT album_id, image_id, min(position) AS position FROM v_album_image GROUP BY 1, 2), r AS (SELECT DISTINCT album_id, image_id FROM v_rule r JOIN v_image_tag t ON t.name = r.name), b AS (SELECT coalesce(m.album_id, r.album_id) AS album_id, coalesce(m.image_id, r.image_id) AS image_id, position FROM m FULL JOIN r ON r.album_id = m.album_id AND r.image_id = m.image_id), "
    "k AS (SELECT album_id, image_id, file_type, row_number() OVER (PARTITION BY album_id ORDER BY CASE WHEN file_type = 'jpeg' THEN 0 ELSE 1 END, position IS NULL, position, taken_at DESC NULLS LAST, image_id) AS rank, bool_or(file_type = 'jpeg') OVER (PARTITION BY album_id) AS any_jpeg FROM b JOIN v_live i ON i.id = image_id) "
    "SELECT album_id, rank, image_id AS id FROM k WHERE rank <= 4 AND (file_type = 'jpeg' OR NOT any_jpeg)"
)
def album_covers(spark, sf_dir):
    albums = views.albums(spark, sf_dir).select(F.col("id").alias("album_id"))
    return _positions(collections.album_covers(albums, views.album_rules(spark, sf_dir), views.album_images(spark, sf_dir), views.image_tags(spark, sf_dir), views.live(spark, sf_dir)), "covers")


@query("SELECT gps_country, arg_max(camera_model, (n, -first)) AS camera_model FROM (SELECT gps_country, camera_model, count(*) AS n, min(id) AS first FROM v_live WHERE camera_model IS NOT NULL AND gps_country IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def majority_camera(spark, sf_dir):
    return collections.majority(views.live(spark, sf_dir).where("gps_country is not null"), ["gps_country"], "camera_model", "id")


@query("SELECT count(*) AS n FROM v_live WHERE edit_adjustments IS NOT NULL OR applied_adjustments IS NOT NULL")
def example_count(spark, sf_dir):
    return aggregates.example_count(views.live(spark, sf_dir))


@query("SELECT i.id, coalesce(string_agg(t.name, ',' ORDER BY t.name), '') AS tags FROM v_live i LEFT JOIN v_image_tag t ON t.image_id = i.id GROUP BY 1")
def tags_of_images(spark, sf_dir):
    return entity.tags_of(views.live(spark, sf_dir), views.image_tags(spark, sf_dir)).select("id", F.array_join("tags", ",").alias("tags"))


@query("SELECT value, n, cast(floor(n / sum(n) OVER () * 100 + 0.5) AS int) AS percent, round(n / max(n) OVER (), 9) AS bar FROM (SELECT lens_model AS value, count(*) AS n FROM v_live WHERE lens_model <> '' GROUP BY 1)")
def stats_shares(spark, sf_dir):
    counts = aggregates.top_values(views.live(spark, sf_dir), "lens_model", 1000)
    return aggregates.shares(counts).withColumn("bar", F.round("bar", 9))


@query("SELECT CASE WHEN label % 3 <> 0 THEN 'group ' || cast(label % 3 AS varchar) ELSE 'moment ' || cast(label AS varchar) END AS \"group\", count(DISTINCT label) AS clusters, count(*) AS n FROM embeddings GROUP BY 1")
def cluster_group_totals(spark, sf_dir):
    sizes = _clusters(spark, sf_dir).groupBy("cluster", "name", "group").agg(F.count("*").alias("size"))
    return collections.group_totals(sizes)


@query("SELECT 'root-' || cast(r AS varchar) AS id, n, r = 1 AS scanning, r <> 2 AS available FROM (VALUES (0), (1), (2), (9)) AS v(r) LEFT JOIN (SELECT source_root_id, count(*) AS c FROM v_image GROUP BY 1) ON source_root_id = 'root-' || cast(r AS varchar), LATERAL (SELECT coalesce(c, 0) AS n)")
def source_list(spark, sf_dir):
    roots = spark.createDataFrame([(f"root-{r}", f"Root {r}", f"/mnt/{r}") for r in (0, 1, 2, 9)], "id string, name string, path string")
    out = aggregates.source_list(roots, views.images(spark, sf_dir), roots.where("id = 'root-1'"), roots.where("id <> 'root-2'"))
    return out.select("id", "n", "scanning", "available")


@query(
    "SELECT cluster, rank, id FROM (SELECT label AS cluster, vec_id AS id, file_type, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN file_type = 'jpeg' THEN 0 ELSE 1 END, CASE WHEN file_type = 'jpeg' THEN NULL WHEN vec_id = c THEN 0 ELSE vec_id + 1 END, taken_at DESC NULLS LAST, vec_id) AS rank, bool_or(coalesce(file_type = 'jpeg', false)) OVER (PARTITION BY label) AS any_jpeg "
    "FROM (SELECT *, max(vec_id) OVER (PARTITION BY label) AS c FROM embeddings) LEFT JOIN v_image i ON i.id = vec_id) WHERE rank <= 4 AND (coalesce(file_type = 'jpeg', false) OR NOT any_jpeg)"
)
def cluster_covers(spark, sf_dir):
    m = _clusters(spark, sf_dir).select("cluster", F.col("image_id").alias("id"), F.col("image_id").alias("pos"))
    last = m.groupBy("cluster").agg(F.max("id").alias("cover"))
    return _positions(collections.cluster_covers(m.join(last, "cluster"), views.images(spark, sf_dir)), "covers")


@query("SELECT vec_id AS id, cast(year(taken_at) AS int) AS year, gps_country AS country FROM embeddings JOIN v_live i ON i.id = vec_id WHERE NOT (file_type = 'raw' AND paired_image_id IS NOT NULL)")
def clusterable(spark, sf_dir):
    return collections.clusterable(views.live(spark, sf_dir), _vectors(spark, sf_dir)).select("id", "year", "country")


# ---- imports ----------------------------------------------------------------

_REVIEW = "SELECT s.* FROM v_staged s LEFT JOIN (SELECT id FROM v_image WHERE deleted_at IS NOT NULL) t ON t.id = s.duplicate_of_image_id WHERE (s.duplicate_of_image_id IS NULL AND s.duplicate_of_staged_file_id IS NULL) OR t.id IS NOT NULL"


@query(f"SELECT id FROM ({_REVIEW}) WHERE file_type = 'jpeg' AND rating >= 2 AND color_label = 'red'")
def import_review(spark, sf_dir):
    staged, images = views.staged(spark, sf_dir), views.images(spark, sf_dir)
    trashed = entity.trashed_duplicates(staged, images).select(F.col("id").alias("duplicate_of_image_id"), F.lit(True).alias("in_trash"))
    return filters.review(staged.join(trashed, "duplicate_of_image_id", "left"), "jpeg_only", 2, "red").select("id")


@query("SELECT DISTINCT i.id FROM v_image i JOIN v_staged s ON s.duplicate_of_image_id = i.id WHERE i.deleted_at IS NOT NULL")
def trashed_duplicates(spark, sf_dir):
    return entity.trashed_duplicates(views.staged(spark, sf_dir), views.images(spark, sf_dir))


@query(
    "SELECT s.id, CASE WHEN (s.duplicate_of_image_id IS NULL AND s.duplicate_of_staged_file_id IS NULL) OR i.id IS NOT NULL THEN true ELSE s.selected END AS selected, 4 AS rating FROM v_staged s LEFT JOIN v_image i ON i.id = s.duplicate_of_image_id AND (i.source_root_id IS NOT NULL OR i.deleted_at IS NOT NULL)"
)
def staged_bulk_update(spark, sf_dir):
    staged = views.staged(spark, sf_dir)
    return entity.update_staged(staged, views.images(spark, sf_dir), staged.select("id"), selected=True, rating=4).select("id", "selected", "rating")


@query(
    "WITH r AS (SELECT * FROM v_staged WHERE selected AND processed) SELECT id, 'insert' AS action, NULL::bigint AS image_id FROM r WHERE duplicate_of_image_id IS NULL AND duplicate_of_staged_file_id IS NULL UNION ALL "
    "SELECT s.id, CASE WHEN i.source_root_id IS NOT NULL THEN 'promote' ELSE 'restore' END, i.id FROM (SELECT duplicate_of_image_id AS d, arg_min(id, seq) AS id FROM r WHERE duplicate_of_image_id IS NOT NULL GROUP BY 1) s JOIN v_image i ON i.id = s.d WHERE i.source_root_id IS NOT NULL OR i.deleted_at IS NOT NULL"
)
def commit_plan(spark, sf_dir):
    return entity.commit_plan(views.staged(spark, sf_dir), views.images(spark, sf_dir))


@query("SELECT s.id, coalesce(s.taken_at, p.taken_at) AS effective FROM v_staged s LEFT JOIN v_staged p ON p.id = s.paired_with")
def effective_dates(spark, sf_dir):
    return order.review_order(views.staged(spark, sf_dir)).select("id", F.col("effective").cast("timestamp_ntz").alias("effective"))


@query("SELECT cast(coalesce(s.taken_at, p.taken_at) AS date) AS day, count(*) AS n, min(s.seq) AS first FROM v_staged s LEFT JOIN v_staged p ON p.id = s.paired_with GROUP BY 1")
def import_day_sections(spark, sf_dir):
    return order.day_sections(views.staged(spark, sf_dir))


@query("SELECT id, strftime(taken_at, '%Y/%Y-%m-%d/') || CASE WHEN n = 1 THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') || '_' || cast(n - 1 AS varchar) || regexp_extract(name, '(\\.[^.]*)$', 1) END AS path FROM (SELECT id, taken_at, name, row_number() OVER (PARTITION BY cast(taken_at AS date), name ORDER BY id) + CASE WHEN cast(taken_at AS date) IN (SELECT cast(taken_at AS date) FROM v_image WHERE deleted_at IS NOT NULL) AND name = 'S1.jpg' THEN 1 ELSE 0 END AS n FROM (SELECT id, taken_at, 'S' || cast(id % 3 AS varchar) || '.jpg' AS name FROM v_live WHERE taken_at IS NOT NULL))")
def destinations(spark, sf_dir):
    day, name = F.to_date("taken_at").alias("day"), F.concat(F.lit("S"), (F.col("id") % 3).cast("string"), F.lit(".jpg")).alias("name")
    files = views.live(spark, sf_dir).where("taken_at is not null").select("id", F.col("id").alias("seq"), day, name)
    taken = views.images(spark, sf_dir).where("deleted_at is not null").select(day, F.lit("S1.jpg").alias("name")).distinct()
    return order.destinations(files, taken)


# ---- pairs and merges -------------------------------------------------------


def _free_pairs(spark, sf_dir) -> DataFrame:
    """Two rows a shot, a raw and a JPEG of one time; those of every third shot lie in folders of their own."""
    shot, raw = F.floor(F.col("id") / 2), F.col("id") % 2 == 0
    name = F.concat(F.lit("S"), shot.cast("string"), F.when(raw, ".raf").otherwise(".JPG"))
    folder = F.concat(F.lit("f"), (shot % 7).cast("string"), F.when((shot % 3 == 0) & raw, "/raw/").otherwise("/"))
    return views.images(spark, sf_dir).withColumns(
        {"source_root_id": F.concat(F.lit("root-"), (shot % 2).cast("string")), "paired_image_id": F.when(F.col("id") % 13 == 0, F.col("id")), "file_type": F.when(raw, "raw").otherwise("jpeg"), "original_filename": name, "file_path": F.concat(folder, name), "taken_at": F.expr("timestamp_ntz'2000-01-01' + make_dt_interval(cast(floor(id / 2) % 100 as int))")}
    )


_FREE = "(SELECT id, CASE WHEN id % 2 = 0 THEN 'raw' ELSE 'jpeg' END AS file_type, id // 2 AS stem, id // 2 % 2 AS root, CASE WHEN id // 2 % 3 = 0 AND id % 2 = 0 THEN 'raw' ELSE '' END || cast(id // 2 % 7 AS varchar) AS folder FROM v_image WHERE id % 13 <> 0 AND deleted_at IS NULL)"
_TWO = "count(*) FILTER (WHERE file_type = 'raw') = 1 AND count(*) FILTER (WHERE file_type = 'jpeg') = 1"
_HALVES = "max(id) FILTER (WHERE file_type = 'raw') AS raw_id, max(id) FILTER (WHERE file_type = 'jpeg') AS jpeg_id"


@query(f"WITH f AS {_FREE}, a AS (SELECT {_HALVES} FROM f WHERE root = 0 GROUP BY folder, stem HAVING {_TWO}), b AS (SELECT {_HALVES} FROM f WHERE id NOT IN (SELECT raw_id FROM a UNION ALL SELECT jpeg_id FROM a) GROUP BY stem HAVING {_TWO}) SELECT *, 1 AS n FROM a UNION ALL SELECT *, 1 FROM b")
def pair_scanned(spark, sf_dir):
    images = _free_pairs(spark, sf_dir)
    pairs = entity.pair_scanned(images, "root-0")
    linked = entity.with_pairs(images, pairs).select("id", "paired_image_id")
    n = linked.groupBy(F.col("paired_image_id").alias("raw_id")).agg(F.count("*").cast("int").alias("n"))
    return pairs.join(n, "raw_id").select("raw_id", "jpeg_id", "n")


_HOME = "(SELECT * FROM v_live WHERE id % 2 = 0)"
_AWAY = "(SELECT * FROM v_live)"


@query(f"SELECT a.id AS source_id, h.id FROM {_AWAY} a JOIN (SELECT sha1, min(id) AS id FROM {_HOME} GROUP BY 1) h ON h.sha1 = a.sha1")
def merge_id_map(spark, sf_dir):
    live = views.live(spark, sf_dir)
    return entity.id_map(live.where("id % 2 = 0"), live, "sha1")


@query(
    f"WITH m AS (SELECT a.id AS source_id, h.id FROM {_AWAY} a JOIN (SELECT sha1, min(id) AS id FROM {_HOME} GROUP BY 1) h ON h.sha1 = a.sha1), p AS (SELECT x.id, min(y.id) AS partner FROM {_AWAY} a JOIN m x ON x.source_id = a.id JOIN m y ON y.source_id = a.paired_image_id GROUP BY 1) "
    f"SELECT h.id, coalesce(CASE WHEN h.id % 4 = 0 THEN h.paired_image_id END, p.partner) AS paired_image_id FROM {_HOME} h LEFT JOIN p ON p.id = h.id"
)
def merge_remap_pairs(spark, sf_dir):
    live = views.live(spark, sf_dir)
    home = live.where("id % 2 = 0")
    blank = home.withColumn("paired_image_id", F.when(F.col("id") % 4 == 0, F.col("paired_image_id")))
    return entity.remap_pairs(blank, live, entity.id_map(home, live, "sha1")).select("id", "paired_image_id")


@query(f"WITH o AS (SELECT sha1, arg_min(rating, id) AS rating, arg_min(coalesce(edit_adjustments, ''), id) AS doc, arg_min(edit_rev, id) AS rev, min(id) AS id FROM (SELECT * FROM v_live WHERE id % 2 = 1) GROUP BY 1) SELECT h.id, CASE WHEN o.sha1 IS NOT NULL THEN o.rating ELSE h.rating END AS rating, CASE WHEN o.sha1 IS NOT NULL THEN o.doc ELSE coalesce(h.edit_adjustments, '') END AS doc, CASE WHEN o.sha1 IS NOT NULL THEN o.rev ELSE h.edit_rev END AS rev FROM {_HOME} h LEFT JOIN o ON o.sha1 = h.sha1 UNION ALL SELECT id, rating, doc, rev FROM o WHERE sha1 NOT IN (SELECT sha1 FROM {_HOME})")
def merge_carried_over(spark, sf_dir):
    live = views.live(spark, sf_dir)
    out = entity.merge(live.where("id % 2 = 0"), live.where("id % 2 = 1"), "sha1")
    return out.select("id", "rating", F.coalesce("edit_adjustments", F.lit("")).alias("doc"), F.col("edit_rev").alias("rev"))


_FAR = "sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (cast(x[1] AS double) - cast(x[2] AS double)) * (cast(x[1] AS double) - cast(x[2] AS double)))))"


# ---- the remote copy --------------------------------------------------------


def _albums(spark, sf_dir) -> DataFrame:
    ruled = views.album_rules(spark, sf_dir).groupBy("album_id").agg(F.collect_set("name").alias("rule"))
    named = views.albums(spark, sf_dir).select(F.col("id").alias("album_id"), F.col("name").alias("album"), (F.col("id") % 3 == 0).alias("album_sync"))
    return named.join(ruled, "album_id", "left").withColumn("rule", F.coalesce("rule", F.array().cast("array<string>")))


@query("SELECT id FROM v_image WHERE deleted_at IS NULL AND file_type = 'jpeg' AND remote_id IS NULL AND (remote_sync OR id IN (SELECT image_id FROM v_image_tag WHERE name IN (SELECT name FROM v_rule WHERE album_sync)))")
def mirror_upload_candidates(spark, sf_dir):
    return mirror.upload_candidates(views.images(spark, sf_dir), _albums(spark, sf_dir), views.image_tags(spark, sf_dir), "selective")


_PAIRS = "(SELECT m.album_id, 'x' AS x, image_id FROM v_album_image m WHERE album_id % 3 = 0 UNION SELECT album_id, 'x', image_id FROM v_rule r JOIN v_image_tag t ON t.name = r.name WHERE album_sync)"


@query(f"SELECT DISTINCT s_name AS album, remote_id FROM {_PAIRS} p JOIN supplier ON s_suppkey = p.album_id JOIN v_image i ON i.id = p.image_id WHERE i.deleted_at IS NULL AND remote_id IS NOT NULL EXCEPT SELECT s_name, remote_id FROM v_album_image m JOIN supplier ON s_suppkey = m.album_id JOIN v_image i ON i.id = m.image_id WHERE position < 5")
def mirror_album_pushes(spark, sf_dir):
    """The remote copy has what lies at the front of an album."""
    images, albums, members = views.images(spark, sf_dir), _albums(spark, sf_dir), views.album_images(spark, sf_dir)
    there = members.where("position < 5").join(albums.select("album_id", "album"), "album_id").join(images.select(F.col("id").alias("image_id"), "remote_id"), "image_id")
    return mirror.album_pushes(images, albums, members, views.image_tags(spark, sf_dir), there.where("remote_id is not null").select("remote_id", "album"), "selective")


@query(f"SELECT i.id, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS albums FROM {_PAIRS} p JOIN supplier ON s_suppkey = p.album_id JOIN v_live i ON i.id = p.image_id GROUP BY 1")
def mirror_album_names(spark, sf_dir):
    return mirror.album_names(views.live(spark, sf_dir), _albums(spark, sf_dir), views.album_images(spark, sf_dir), views.image_tags(spark, sf_dir), "selective", sep=",")


_KNOWN = "(SELECT 'sum' || cast(k AS varchar) AS sha1, 'r' || cast(k AS varchar) AS remote_id FROM range(0, 700, 3) t(k))"


def _known(spark) -> DataFrame:
    k = F.col("id").cast("string")
    return spark.range(0, 700, 3).select(F.concat(F.lit("sum"), k).alias("sha1"), F.concat(F.lit("r"), k).alias("remote_id"))


@query(f"SELECT i.id, k.remote_id FROM v_image i LEFT JOIN {_KNOWN} k ON k.sha1 = i.sha1")
def mirror_remote_ids(spark, sf_dir):
    return mirror.remote_ids(views.images(spark, sf_dir), _known(spark)).select("id", "remote_id")


@query(f"SELECT id, remote_id FROM v_image WHERE deleted_at IS NOT NULL AND remote_sync AND remote_id IS NOT NULL UNION ALL SELECT i.id, k.remote_id FROM v_image i JOIN {_KNOWN} k ON k.sha1 = i.sha1 WHERE deleted_at IS NOT NULL AND remote_sync AND i.remote_id IS NULL AND file_type = 'jpeg' AND i.id % 5 <> 0")
def mirror_trashed_removals(spark, sf_dir):
    images = views.images(spark, sf_dir)
    return mirror.trashed_removals(images, _known(spark), images.where("id % 5 = 0"), "selective")


@query("SELECT remote_id, CASE WHEN remote_id IS NULL THEN sha1 END AS sha1, original_filename FROM v_image WHERE deleted_at IS NOT NULL AND remote_sync AND (remote_id IS NOT NULL OR (file_type = 'jpeg' AND source_root_id IS NULL))")
def mirror_deletion_queue(spark, sf_dir):
    return mirror.deletion_queue(views.images(spark, sf_dir).where("deleted_at is not null"), "selective")


@query("SELECT event_id FROM events WHERE epoch_us(ts) > epoch_us((SELECT max(ts) FROM events)) - 1800 * 1000000")
def jobs_unexpired(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    now = e.agg(F.max("ts")).first()[0]
    return mirror.unexpired(e, F.lit(now), 1800, "ts").select("event_id")


# ---- vectors and suggestions ------------------------------------------------


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (SELECT id FROM v_live WHERE rating = 5)")
def vectors_multi_get(spark, sf_dir):
    return vectors.multi_get(_vectors(spark, sf_dir), views.live(spark, sf_dir).where("rating = 5")).select("id", "label")


@query("SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 10 = 0")
def vectors_upsert(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    old = [v.where("id % 4 = 0").withColumn("label", F.col("label") + add).withColumn("seq", F.lit(seq)) for seq, add in ((1, 50), (2, 100))]
    new = v.where("id % 10 = 0").withColumn("id", F.col("id") + 1_000_000).withColumn("seq", F.lit(1))
    return vectors.upsert(v, old[0].unionByName(old[1]).unionByName(new)).select("id", "label")


@query("SELECT vec_id AS id, round(list_sum(list_transform(list_transform(embedding, lambda x: cast(x AS double) / s), lambda y: y * y)), 6) AS square, round(cast(embedding[1] AS double) / s, 6) AS first FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: cast(x AS double) * cast(x AS double)))) AS s FROM embeddings)")
def vectors_normalised(spark, sf_dir):
    unit = _vectors(spark, sf_dir).select("id", vectors.normalised(F.col("vector")).alias("u"))
    return unit.select("id", F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("square"), F.round(F.col("u")[0], 6).alias("first"))


@query("SELECT event_type, round(CASE WHEN abs(x) < 1e-9 AND abs(y) < 1e-9 THEN 0 ELSE (degrees(atan2(y, x)) + 360) % 360 END, 4) AS hue FROM (SELECT event_type, sum(value * cos(radians(event_id % 90))) AS x, sum(value * sin(radians(event_id % 90))) AS y FROM events GROUP BY 1)")
def circular_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value", (F.col("event_id") % 90).alias("angle"))
    return e.groupBy("event_type").agg(F.round(vectors.circular_mean("angle", "value"), 4).alias("hue"))


@query("SELECT user_id, arg_max(event_type, (cast(w AS bigint), -s)) AS event_type FROM (SELECT user_id, event_type, sum(event_id % 5) AS w, min(event_id) AS s FROM events GROUP BY 1, 2) GROUP BY 1")
def weighted_vote(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", (F.col("event_id") % 5).alias("w"), "event_id")
    return vectors.vote(e, "user_id", "event_type", "w", "event_id")


@query("SELECT id, coalesce(applied_adjustments, edit_adjustments) AS doc, file_type = 'raw' AS is_raw, paired_image_id AS pair FROM v_live WHERE applied_adjustments IS NOT NULL OR edit_adjustments IS NOT NULL")
def example_pool(spark, sf_dir):
    return vectors.example_pool(views.live(spark, sf_dir))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: cast(x[1] AS double) * cast(x[2] AS double)))"


@query(
    f"WITH e AS (SELECT i.id, coalesce(applied_adjustments, edit_adjustments) AS doc, file_type = 'raw' AS is_raw, paired_image_id AS pair, coalesce(o.embedding, p.embedding) AS v FROM v_live i LEFT JOIN embeddings o ON o.vec_id = i.id LEFT JOIN embeddings p ON p.vec_id = i.paired_image_id WHERE applied_adjustments IS NOT NULL OR edit_adjustments IS NOT NULL), "
    f"t AS (SELECT vec_id AS query, embedding AS q, file_type = 'raw' AS raw_query, paired_image_id AS pair_query FROM embeddings JOIN v_live i ON i.id = vec_id WHERE vec_id % 50 = 0), s AS (SELECT query, id, doc, is_raw = raw_query AS same, least(id, coalesce(pair, id)) AS shot, {_DOT.format(a='q', b='v')} AS score FROM e, t WHERE v IS NOT NULL AND id <> query AND id IS DISTINCT FROM pair_query), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY query, same, shot ORDER BY score DESC, id) AS k FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY query, same ORDER BY score DESC, id) AS n, bool_or(same) OVER (PARTITION BY query) AS any_same FROM o WHERE k = 1) SELECT query, id, doc, round(score, 6) AS score FROM r WHERE n <= 5 AND same = any_same"
)
def example_neighbours(spark, sf_dir):
    live, v = views.live(spark, sf_dir), _vectors(spark, sf_dir).select("id", "vector")
    targets = v.where("id % 50 = 0").join(live.select("id", (F.col("file_type") == "raw").alias("is_raw"), F.col("paired_image_id").alias("pair")), "id")
    return vectors.example_neighbours(targets, vectors.example_pool(live), v).withColumn("score", F.round("score", 6))


@query(f"SELECT query, id, round(distance, 6) AS distance, cast(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), id) AS n FROM (SELECT q.vec_id AS query, e.vec_id AS id, {_FAR} AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)) WHERE n <= 10")
def knn_join_top10(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("id", "vector")
    return vectors.nearest_join(v.where("id % 50 = 0"), v, 10).withColumn("distance", F.round("distance", 6))


@query("SELECT i.id, coalesce(o.vec_id, p.vec_id) AS of FROM v_live i LEFT JOIN embeddings o ON o.vec_id = i.id LEFT JOIN embeddings p ON p.vec_id = i.paired_image_id")
def own_or_partner_vector(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("id", F.array(F.col("id").cast("double")).alias("vector"))
    return vectors.own_or_partner(views.live(spark, sf_dir), v).select("id", F.col("vector")[0].cast("long").alias("of"))


# ---- places -----------------------------------------------------------------

_NAMES = "(SELECT n_name AS name, 'C' || cast(n_nationkey AS varchar) AS cc FROM nation WHERE n_nationkey % 4 <> 3)"


def _names(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 3")
    return n.select(F.col("n_name").alias("name"), F.lit(None).cast("string").alias("lang"), F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("cc"))


@query(f"SELECT n_nationkey AS id, coalesce(name, 'C' || cast(n_nationkey AS varchar)) AS country FROM nation LEFT JOIN {_NAMES} k ON k.cc = 'C' || cast(n_nationkey AS varchar)")
def country_names(spark, sf_dir):
    codes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("cc"))
    return places.country_name(codes, _names(spark, sf_dir)).select("id", "country")


@query(f"SELECT c_custkey AS id, coalesce(g.cc, CASE WHEN c_custkey % 2 = 0 THEN 'D' || cast(n_nationkey AS varchar) END) AS cc FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN {_NAMES} g ON g.name = n_name")
def country_from_query(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    asked = c.select(F.concat(F.lit(" "), F.lower(F.regexp_replace("n_name", "_", "-"))).alias("query"), F.when(F.col("c_custkey") % 2 == 0, "DE-at").otherwise("fr").alias("lang"), "c_custkey")
    # every name also has a German reading, which counts only where there is no general one
    german = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("de").alias("lang"), F.concat(F.lit("D"), F.col("n_nationkey").cast("string")).alias("cc"))
    found = places.country_of(asked.select("query", "lang").distinct(), _names(spark, sf_dir).unionByName(german))
    return asked.join(found, ["query", "lang"]).select(F.col("c_custkey").alias("id"), "cc")


_CENTRES = "SELECT n_nationkey AS centre, cast(n_nationkey * 7 - 80 AS double) AS lat, cast(n_nationkey * 14 - 175 AS double) AS lon FROM nation"


@query(f"SELECT i.id, coalesce(CASE WHEN id % 3 = 0 THEN gps_country END, CASE WHEN gps_lat IS NOT NULL THEN coalesce(k.name, 'C' || cast(c.centre AS varchar)) END) AS gps_country FROM v_live i LEFT JOIN (SELECT id AS i, centre, row_number() OVER (PARTITION BY id ORDER BY {KM.format(lat1='gps_lat', lon1='gps_lon', lat2='lat', lon2='lon')}, 'C' || cast(centre AS varchar)) AS r FROM v_live, ({_CENTRES}) WHERE gps_lat IS NOT NULL) c ON c.i = i.id AND r = 1 LEFT JOIN {_NAMES} k ON k.cc = 'C' || cast(c.centre AS varchar)")
def annotate_countries(spark, sf_dir):
    images = views.live(spark, sf_dir).withColumn("gps_country", F.when(F.col("id") % 3 == 0, F.col("gps_country")))
    cities = table(spark, sf_dir, "nation").selectExpr("concat('C', cast(n_nationkey as string)) as city", "cast(n_nationkey * 7 - 80 as double) as lat", "cast(n_nationkey * 14 - 175 as double) as lon")
    return places.annotate_countries(images, cities, _names(spark, sf_dir)).select("id", "gps_country")


@query("SELECT gps_country, greatest(max(x) - min(x), max(y) - min(y)) >= 58 AS splittable FROM (SELECT gps_country, (gps_lon + 180.0) / 360.0 * 67108864 AS x, (1.0 - ln(tan(radians(gps_lat)) + 1.0 / cos(radians(gps_lat))) / pi()) / 2.0 * 67108864 AS y FROM v_live WHERE gps_lat IS NOT NULL) GROUP BY 1")
def splittable(spark, sf_dir):
    return geo.splittable(views.live(spark, sf_dir), ["gps_country"])


@query("SELECT min(id) AS id FROM v_live WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL GROUP BY least(id, coalesce(paired_image_id, id))")
def map_pins(spark, sf_dir):
    return order.map_pins(views.live(spark, sf_dir)).select("id")


@query(f"SELECT c.centre AS place, count(*) AS n FROM v_live i JOIN ({_CENTRES}) c ON {KM.format(lat1='gps_lat', lon1='gps_lon', lat2='c.lat', lon2='c.lon')} <= 900 WHERE gps_lat IS NOT NULL GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, place LIMIT 30")
def place_albums(spark, sf_dir):
    centres = table(spark, sf_dir, "nation").selectExpr("n_nationkey as place", "cast(n_nationkey * 7 - 80 as double) as lat", "cast(n_nationkey * 14 - 175 as double) as lon", "cast(null as string) as label")
    return geo.place_albums(views.live(spark, sf_dir).select("id", "gps_lat", "gps_lon"), centres, 900.0).select("place", "n")


# ---- names, dates and numbers -----------------------------------------------


@query("SELECT p_partkey AS id, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', ' ', 'g')) AS key FROM part")
def normalised_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), strings.normalised_name(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("key"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name || '.jpg' END AS renamed, regexp_replace(p_name, ' ', '_') AS stem FROM part")
def renamed_files(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    typed = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit("/x"))).otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")))
    copy = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_edit-"), (F.col("p_partkey") % 12).cast("string"), F.lit(".jpg"))
    return p.select(F.col("p_partkey").alias("id"), strings.renamed(typed, F.lit(".jpg")).alias("renamed"), strings.edit_stem(copy).alias("stem"))


_LENS = "CASE p_partkey % 9 WHEN 0 THEN 'undef' WHEN 1 THEN cast(p_size AS varchar) || ' ' || cast(p_size + 20 AS varchar) || ' 1.8 2.8' WHEN 2 THEN ' ' || p_name || ' ' WHEN 3 THEN cast(p_size AS varchar) WHEN 4 THEN '0 ' || cast(p_size AS varchar) || ' ' || cast(p_size AS varchar) || ' 2 2 0' WHEN 5 THEN 'Unknown (0 0)' WHEN 6 THEN 'None' WHEN 7 THEN '0.0 mm f/0.0' ELSE cast(p_size AS varchar) || ' ' || cast(p_size AS varchar) || ' 0 0' END"


@query("SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 1 THEN cast(p_size AS varchar) || '-' || cast(p_size + 20 AS varchar) || 'mm f/1.8-2.8' WHEN 2 THEN p_name WHEN 4 THEN cast(p_size AS varchar) || 'mm f/2' WHEN 8 THEN cast(p_size AS varchar) || 'mm' END AS lens FROM part")
def lens_names(spark, sf_dir):
    p = _dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey").withColumn("lens", F.expr(_LENS.replace("AS varchar", "AS string")))
    return p.select(F.col("p_partkey").alias("id"), strings.clean_lens(F.col("lens")).alias("lens"))


@query("SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN '—' WHEN event_id % 4 = 1 THEN '1/' || cast(event_id % 500 + 1 AS varchar) WHEN event_id % 4 = 2 THEN cast(event_id % 30 + 1 AS varchar) || 's' ELSE '1/280' END AS shown, CASE WHEN event_id % 4 = 2 THEN cast(event_id % 30 + 1 AS bigint) END AS whole FROM events")
def shutter_speeds(spark, sf_dir):
    n = F.col("event_id")
    text = F.when(n % 4 == 0, F.lit("")).when(n % 4 == 1, (1 / (n % 500 + 1)).cast("string")).when(n % 4 == 2, (n % 30 + 1).cast("string")).otherwise("1/280")
    e = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return e.select(F.col("event_id").alias("id"), strings.shutter(F.col("text")).alias("shown"), F.when(n % 4 == 2, strings.whole_number(F.concat("text", F.lit(".9")))).when(n % 4 == 3, strings.whole_number(F.lit("undef"))).alias("whole"))


@query("SELECT id, regexp_replace(original_filename, '\\.[^.]*$', '') AS stem, regexp_extract(original_filename, '(\\.[^.]*)$', 1) AS ext FROM v_image")
def split_names(spark, sf_dir):
    return views.images(spark, sf_dir).select("id", strings.split_name(F.col("original_filename")).alias("x")).select("id", "x.stem", "x.ext")


@query("SELECT id, CASE id % 3 WHEN 0 THEN taken_at WHEN 1 THEN cast(taken_at AS date) + INTERVAL 12 HOUR ELSE imported_at END AS captured FROM v_image")
def capture_dates(spark, sf_dir):
    i, k = views.images(spark, sf_dir), F.col("id") % 3
    text = F.when(k == 0, F.date_format("taken_at", "yyyy:MM:dd HH:mm:ss"))
    name = F.when(k == 1, F.concat(F.lit("trip_"), F.date_format("taken_at", "yyyyMMdd"), F.lit(".jpg"))).otherwise(F.lit("trip.jpg"))
    none = F.lit(None).cast("string")
    return i.select("id", dates.capture_date([none, none, text, none, none], name, F.col("imported_at")).cast("timestamp_ntz").alias("captured"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN taken_at + INTERVAL 7 SECOND ELSE cast(taken_at AS date) + INTERVAL 12 HOUR END AS named FROM v_image")
def name_dates(spark, sf_dir):
    later = F.expr("taken_at + interval 7 second")
    name = F.when(F.col("id") % 2 == 0, F.date_format(later, "'IMG_'yyyyMMdd'_'HHmmss'.jpg'")).otherwise(F.date_format("taken_at", "yyyy-MM-dd' x.jpg'"))
    return views.images(spark, sf_dir).select("id", dates.name_date(name).alias("named"))


@query("SELECT a.event_id AS id, coalesce(abs(epoch_us(a.ts) - epoch_us(b.ts)) < 1000000, a.ts IS NULL AND b.ts IS NULL) AS same, least(120 * pow(2, a.event_id % 8), 3600) AS wait, CASE WHEN a.event_id % 20000 >= 3600 THEN cast(a.event_id % 20000 // 3600 AS varchar) || 'h ' || cast(a.event_id % 20000 % 3600 // 60 AS varchar) || 'm' WHEN a.event_id % 20000 >= 60 THEN cast(a.event_id % 20000 // 60 AS varchar) || 'm ' || cast(a.event_id % 20000 % 60 AS varchar) || 's' ELSE cast(a.event_id % 20000 AS varchar) || 's' END AS took FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN ts END AS ts FROM events) a JOIN (SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN ts + INTERVAL 1 SECOND * (event_id % 2) END AS ts FROM events) b ON b.event_id = a.event_id")
def moments_and_durations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    a, b = F.when(n % 3 != 0, F.col("ts")), F.when(n % 6 != 0, F.when(n % 2 == 0, F.col("ts")).otherwise(F.expr("ts + interval 1 second")))
    return e.select(n.alias("id"), dates.same_moment(a, b).alias("same"), dates.backoff_seconds(n % 8 + 1).alias("wait"), dates.duration(n % 20000).alias("took"))


# ---- develop documents ------------------------------------------------------

_K = "cast(json_extract_string(props, '$.k') AS int)"


@query(f"SELECT event_id AS id, round(greatest(-8.0, least(8.0, k * 0.25 - 10)), 4) AS exposure, greatest(-250, least(250, k * 7 - 300)) AS temperature, greatest(0, least(80, k + 10)) AS sharpness_threshold, 100 AS lut_intensity, CASE WHEN k % 3 = 0 THEN 'velvia' ELSE 'none' END AS film_sim, least(100, k) AS red_hue, greatest(-100, -k * 3) AS red_saturation, greatest(0, least(360, k * 9 - 50)) AS wheel, 50 AS blending, least(255, k * 5) AS last_y FROM (SELECT event_id, {_K} AS k FROM events)")
def develop_normalised(spark, sf_dir):
    e = _dealt(table(spark, sf_dir, "events").select("event_id", "props"), "event_id").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    doc = F.to_json(
        F.struct(
            (k * 0.25 - 10).alias("exposure"), (k * 7 - 300).cast("string").alias("temperature"), (k + 10).alias("sharpness_threshold"), F.lit("none of it").alias("lut_intensity"), F.when(k % 3 == 0, "velvia").otherwise("sepia").alias("film_sim"), F.create_map(F.lit("red"), F.array(k, -k * 3)).alias("hsl"),
            F.struct(F.create_map(F.lit("hue"), k * 9 - 50).alias("shadows")).alias("color_grading"), F.create_map(F.lit("luma"), F.array(F.array(F.lit(0), F.lit(3)), F.array(F.lit(255), k * 5))).alias("point_curves"), F.lit(1).alias("unknown"),
        )
    )
    n = develop.normalised(doc, ("exposure", "temperature", "sharpness_threshold", "lut_intensity", "film_sim", "hsl", "color_grading", "point_curves"))
    return e.select(F.col("event_id").alias("id"), n.alias("n")).select(
        "id", F.round("n.exposure", 4).alias("exposure"), "n.temperature", "n.sharpness_threshold", "n.lut_intensity", "n.film_sim", F.col("n.hsl.red")[0].alias("red_hue"), F.col("n.hsl.red")[1].alias("red_saturation"), F.col("n.color_grading.shadows.hue").alias("wheel"),
        F.col("n.color_grading.blending").alias("blending"), F.col("n.point_curves.luma")[1][1].alias("last_y"),
    )


#: JSON values by number, whether each holds as a flag, and the number that it counts as, null for none.
_VALUES = (("null", False, None), ("true", True, 1), ("false", False, 0), ('"false"', True, None), ('""', False, None), ("0", False, 0), ("7", True, 7), ("[]", False, None), ("[0]", True, None), ("{}", False, None), ('{"a":1}', True, None), ('" 12 "', True, 12), ("-0.0", False, 0))
_VALUE = "(VALUES " + ", ".join(f"({n}, '{v}', {holds}, {'NULL' if x is None else x})" for n, (v, holds, x) in enumerate(_VALUES)) + ") AS v(n, js, holds, number)"


@query(f"SELECT event_id AS id, a.holds AS visible, NOT b.holds AND FALSE OR b.holds AS invert, CASE WHEN a.number IS NULL THEN 100 ELSE a.number END AS opacity, coalesce(b.number, 0) AS contrast, coalesce(a.number, 0) <> 0 AS adjusted, a.holds AND b.holds AS part_shown, a.holds AND coalesce(a.number, 0) <> 0 OR coalesce(b.number, 0) <> 0 AS edited FROM events JOIN {_VALUE} ON v.n = event_id % {len(_VALUES)} JOIN (SELECT n AS m, js AS js2, holds, number FROM {_VALUE}) b ON b.m = event_id // 7 % {len(_VALUES)}, LATERAL (SELECT v.holds AS holds, v.number AS number) a".replace("NOT b.holds AND FALSE OR ", ""))
def develop_masks(spark, sf_dir):
    """Flags and numbers of every kind of JSON value, in masks and beside them."""
    values = F.array(*[F.lit(v) for v, _, _ in _VALUES])
    e = _dealt(table(spark, sf_dir, "events").select("event_id"), "event_id").select(F.col("event_id").alias("id"), F.get(values, F.col("event_id") % len(_VALUES)).alias("a"), F.get(values, F.floor(F.col("event_id") / 7) % len(_VALUES)).alias("b"))
    part = F.format_string('[{"type": "radial", "visible": %s}, {"type": "other"}, 5]', "b")
    doc = F.format_string('{"contrast": %s, "masks": [{"visible": %s, "invert": %s, "opacity": %s, "sub_masks": %s, "adjustments": {"hue": %s, "none": 3}}, null, "x"]}', "b", "a", "b", "a", part, "a")
    n = e.select("id", develop.normalised(doc).alias("n"))
    mask = F.col("n.masks")[0]
    return n.select(
        "id", mask["visible"].alias("visible"), mask["invert"].alias("invert"), mask["opacity"].alias("opacity"), F.col("n.contrast").alias("contrast"), (F.size(F.map_keys(mask["adjustments"])) > 0).alias("adjusted"),
        (mask["visible"] & mask["sub_masks"][0]["visible"]).alias("part_shown"), (~develop.is_neutral(F.col("n"))).alias("edited"),
    )


@query("SELECT id, edit_adjustments IS NULL OR edit_adjustments = '{}' OR id % 150 = 0 AS neutral FROM v_image")
def develop_neutral(spark, sf_dir):
    return views.images(spark, sf_dir).select("id", develop.is_neutral(develop.normalised(F.col("edit_adjustments"))).alias("neutral"))


@query(f"SELECT user_id AS id, cast(round_even(least(100, sum(w * contrast) / sum(w)), 0) AS int) AS contrast, cast(round_even(least(200, sum(w * 2 * contrast) / sum(w)), 0) AS int) AS shadows FROM (SELECT user_id, event_id % 3 + 1 AS w, greatest(-100, least(100, {_K})) AS contrast FROM events) GROUP BY 1")
def develop_blended(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    doc = F.to_json(F.struct(k.alias("contrast"), (2 * F.greatest(F.lit(-100), F.least(F.lit(100), k))).alias("shadows")))
    e = _dealt(table(spark, sf_dir, "events").select("event_id", "user_id", "props"), "event_id").select(F.col("user_id").alias("query"), (F.col("event_id") % 3 + 1).cast("double").alias("weight"), develop.normalised(doc).alias("adj"))
    return develop.blended(e).select(F.col("query").alias("id"), "contrast", "shadows")


# ---- changes ----------------------------------------------------------------


@query("SELECT id, CASE WHEN rating = 1 THEN edit_rev + 1 ELSE edit_rev END AS edit_rev, CASE WHEN rating = 1 THEN (edit_rotation + 270) % 360 ELSE edit_rotation END AS edit_rotation, CASE WHEN rating = 1 THEN NULL ELSE edit_crop_x END AS edit_crop_x FROM v_image")
def edits_rotate(spark, sf_dir):
    i = views.images(spark, sf_dir)
    return changes.rotate(i, i.where("rating = 1").select("id"), -90).select("id", "edit_rev", "edit_rotation", "edit_crop_x")


@query(f"SELECT id, CASE WHEN rating <> 1 THEN edit_rev WHEN {_HAS_EDIT.replace('edit_adjustments IS NOT NULL', 'false')} THEN edit_rev + 1 ELSE 0 END AS edit_rev, CASE WHEN rating = 1 THEN 'none' ELSE color_label END AS color_label, CASE WHEN rating <> 1 THEN edit_adjustments END AS edit_adjustments FROM v_image")
def edits_reset(spark, sf_dir):
    i = views.images(spark, sf_dir)
    return changes.reset(i, i.where("rating = 1").select("id"), color=True, develop=True).select("id", "edit_rev", "color_label", "edit_adjustments")


@query("SELECT id, CASE WHEN rating = 5 THEN id % 4 * 90 % 360 ELSE edit_rotation END AS edit_rotation, CASE WHEN rating = 5 THEN least(45.0, cast(id % 100 AS double)) ELSE edit_straighten END AS edit_straighten, CASE WHEN rating <> 5 THEN edit_rev WHEN id % 4 <> 0 OR id % 100 <> 0 OR id % 3 <> 0 THEN edit_rev + 1 ELSE 0 END AS edit_rev FROM v_image")
def edits_saved(spark, sf_dir):
    i = views.images(spark, sf_dir)
    n = F.col("id")
    none = [F.lit(None).cast("double").alias(f"crop_{c}") for c in ("x", "y", "width", "height")]
    doc = F.when(n % 3 != 0, F.lit('{"contrast": 5}'))
    edits = i.where("rating = 5").select("id", (n % 4 * 90).cast("int").alias("rotation"), *none, *[F.lit(False).alias(c) for c in ("flip_h", "flip_v")], (n % 100).cast("double").alias("straighten"), *[F.lit(0).alias(c) for c in ("persp_h", "persp_v", "distortion")], doc.alias("adjustments"))
    return changes.save_edits(i, edits).select("id", F.col("edit_rotation").cast("long").alias("edit_rotation"), "edit_straighten", "edit_rev")


@query("SELECT image_id, name FROM v_image_tag UNION SELECT id, 'edit' FROM v_live WHERE rating = 1 AND " + _HAS_EDIT)
def edit_tags(spark, sf_dir):
    live = views.live(spark, sf_dir)
    return changes.sync_edit_tag(views.image_tags(spark, sf_dir), live, live.where("rating = 1").select("id"))


@query("SELECT id, CASE WHEN id % 10 = 3 AND deleted_at IS NULL THEN TIMESTAMP '2000-01-01' WHEN id % 10 = 7 AND source_root_id IS NULL THEN NULL ELSE deleted_at END AS deleted_at FROM (SELECT id, source_root_id, deleted_at FROM (SELECT *, NULL AS paired_image_id FROM (SELECT * EXCLUDE (paired_image_id) FROM v_image)))")
def trash_and_restore(spark, sf_dir):
    from .roster import NOW

    i = views.images(spark, sf_dir).withColumn("paired_image_id", F.lit(None).cast("long"))
    chosen = i.where("id % 10 = 3").select("id")
    down = changes.update(i, chosen, {"deleted_at": F.coalesce("deleted_at", F.lit(NOW).cast("timestamp_ntz"))})
    back = down.where("id % 10 = 7 and deleted_at is not null and source_root_id is null").select("id")
    return changes.update(down, back, {"deleted_at": F.lit(None).cast("timestamp_ntz")}).select("id", "deleted_at")


@query("SELECT id, CASE WHEN paired_image_id IN (SELECT id FROM v_image WHERE source_root_id = 'root-1') THEN NULL ELSE paired_image_id END AS paired_image_id FROM v_image WHERE source_root_id IS NULL OR source_root_id <> 'root-1'")
def source_removed(spark, sf_dir):
    roots = spark.createDataFrame([("root-1", 1, "/mnt/1", "one")], "id string, owner_id int, path string, name string")
    _, left, _, _ = changes.remove_source(roots, views.images(spark, sf_dir), views.staged(spark, sf_dir), {}, "root-1")
    return left.select("id", "paired_image_id")


@query("SELECT id, CASE WHEN paired_image_id IN (SELECT id FROM v_image WHERE deleted_at IS NOT NULL AND source_root_id IS NULL) THEN NULL ELSE paired_image_id END AS paired_image_id FROM v_image WHERE NOT (deleted_at IS NOT NULL AND source_root_id IS NULL)")
def trash_emptied(spark, sf_dir):
    left, _, _ = changes.delete_from_trash(views.images(spark, sf_dir), {"tags": views.image_tags(spark, sf_dir)})
    return left.select("id", "paired_image_id")


@query("SELECT album_id, image_id, position FROM v_album_image WHERE NOT (album_id = 5 AND image_id IN (SELECT id FROM v_live WHERE rating >= 3))")
def album_rows_removed(spark, sf_dir):
    live = views.live(spark, sf_dir)
    return changes.remove_from_album(views.album_images(spark, sf_dir), live, 5, live.where("rating >= 3").select("id"))[0]


@query("SELECT id, CASE WHEN rating = 5 THEN true ELSE remote_sync END AS remote_sync FROM v_image")
def sync_flags(spark, sf_dir):
    i = views.images(spark, sf_dir)
    return changes.set_flag(i, i.where("rating = 5").select("id"), True).select("id", "remote_sync")


@query("SELECT count(*) FILTER (WHERE managed AND id % 6 = 2) AS removed_missing_files, count(*) FILTER (WHERE managed AND id % 6 = 3) AS renamed_files_followed, count(*) FILTER (WHERE id % 100 = 1) AS untracked_files_found, count(*) FILTER (WHERE managed AND id % 6 = 2 AND id % 2 = 0) AS orphan_renders_removed, count(*) FILTER (WHERE NOT (managed AND id % 6 = 2) AND id % 2 = 1) AS renders_queued FROM (SELECT id, source_root_id IS NULL AS managed FROM v_image)")
def library_synced(spark, sf_dir):
    # files stand where the rows say, but those of every sixth row are gone and those of the next are elsewhere
    i = views.images(spark, sf_dir).withColumn("file_path", F.concat(F.lit("p"), F.col("id").cast("string"))).withColumn("file_size", F.col("id")).withColumn("content", F.encode(F.concat(F.lit("bytes "), F.col("id").cast("string")), "UTF-8"))
    i = i.withColumn("file_hash", F.sha2("content", 256))
    path = F.concat(F.when(F.col("id") % 6 == 3, "/lib/moved-").otherwise("/lib/"), F.col("file_path"))
    files = i.where("source_root_id is null and id % 6 <> 2").select(path.alias("path"), F.col("file_size").alias("size"), "content")
    more = i.where("id % 100 = 1").select(F.concat(F.lit("/lib/more-"), "file_path").alias("path"), F.lit(-1).cast("long").alias("size"), F.encode(F.lit("more"), "UTF-8").alias("content"))
    derived = i.where("id % 2 = 0").select("id")
    return changes.sync_with_library(i.drop("content"), {}, files.unionByName(more), derived, "/lib")[2]


# ---- search and order -------------------------------------------------------


@query(f"SELECT id, row_number() OVER (ORDER BY {ORDER}) AS place FROM (SELECT DISTINCT id, taken_at, original_filename FROM (SELECT i.*, t.name FROM v_live i JOIN v_image_tag t ON t.image_id = i.id WHERE lower(t.name) LIKE '%m%' ORDER BY {ORDER}, t.name LIMIT 60))")
def search_tag_stage(spark, sf_dir):
    return search.tag_stage(views.live(spark, sf_dir), views.image_tags(spark, sf_dir), "M", 60).select("id", F.col("pos").cast("long").alias("place"))


@query(
    f"WITH a AS (SELECT id, 0 AS stage, row_number() OVER (ORDER BY {ORDER}) AS pos FROM (SELECT * FROM v_live WHERE gps_country = 'NATION_7' ORDER BY {ORDER} LIMIT 40)), b AS (SELECT id, 1 AS stage, row_number() OVER (ORDER BY km, id) AS pos FROM (SELECT id, {KM.format(lat1='20.0', lon1='30.0', lat2='gps_lat', lon2='gps_lon')} AS km FROM v_live WHERE gps_lat IS NOT NULL) WHERE km <= 75), "
    "u AS (SELECT id, arg_min(stage, (stage, pos)) AS stage, arg_min(pos, (stage, pos)) AS pos FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1), h AS (SELECT u.id, paired_image_id, row_number() OVER (ORDER BY stage, pos) AS place FROM u JOIN v_live i ON i.id = u.id), beside AS (SELECT id, place FROM h UNION ALL SELECT p.id, h.place FROM h JOIN v_live p ON p.id = h.paired_image_id), "
    "f AS (SELECT id, min(place) AS place FROM beside GROUP BY 1), r AS (SELECT f.id, row_number() OVER (ORDER BY place, CASE WHEN file_type = 'raw' THEN 1 ELSE 0 END, f.id) AS rank, least(f.id, coalesce(paired_image_id, f.id)) AS p FROM f JOIN v_live i ON i.id = f.id) SELECT rank, id FROM r WHERE rank <= 50 OR (rank = 51 AND p = (SELECT p FROM r WHERE rank = 50))"
)
def search_with_partners(spark, sf_dir):
    scope = views.live(spark, sf_dir)
    stages = [search.country_stage(scope, "NATION_7", 40), search.place_stage(scope, 20.0, 30.0, 100_000)]
    return search.search(scope, scope, stages, 50).select(F.col("rank").cast("long").alias("rank"), "id")


@query("SELECT id, min(taken_at) OVER (PARTITION BY least(id, coalesce(paired_image_id, id))) AS place, CASE WHEN file_type = 'raw' THEN 1 ELSE 0 END AS half FROM v_live")
def pairs_side_by_side(spark, sf_dir):
    return order.pairs_adjacent(views.live(spark, sf_dir), "taken_at").select("id", "place", "half")


@query(
    "SELECT row FROM (SELECT '{\"id\":' || cast(id AS varchar) || ',\"original_filename\":\"' || original_filename || '\",\"file_type\":\"' || file_type || '\",\"width\":null,\"height\":null,\"rating\":' || cast(rating AS varchar) || ',\"color_label\":\"' || color_label || '\",\"remote_sync\":' || cast(remote_sync AS varchar) || ',\"paired_image_id\":' || coalesce(cast(paired_image_id AS varchar), 'null') "
    "|| ',\"source_root_id\":' || coalesce('\"' || source_root_id || '\"', 'null') || ',\"taken_at\":\"' || strftime(taken_at, '%Y-%m-%dT%H:%M:%S') || '\",\"thumb_version\":\"' || CASE WHEN edit_rev = 0 THEN '' ELSE cast(edit_rev AS varchar) END || '\"}' AS row FROM v_live)"
)
def index_rows(spark, sf_dir):
    return catalog.library_index(views.live(spark, sf_dir))
