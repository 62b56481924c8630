"""Registered queries of the catalog engine and their SQL.

Each query builds its plan from the operators; the SQL beside it states the
same result for DuckDB over the same tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, develop, strings
from ..operators import aggregates, changes, collections, entity, filters, geo, order, search, vectors
from ..operators.filters import LibraryFilter
from ..session import table
from ..streaming import events as stream_events
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

FILTER = LibraryFilter(rating_min=4, unavailable_roots=views.UNAVAILABLE)
SHOWN = "(source_root_id IS NULL OR source_root_id NOT IN ('root-2'))"
ORDER = "taken_at DESC NULLS LAST, original_filename, id"
KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
NOW = dt.datetime(2000, 1, 1)


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = views.with_views(sql)
        return f

    return register


def _ids(df: DataFrame) -> DataFrame:
    return df.select("id")


# ---- scans, filters, counts -------------------------------------------------


@query(
    f"SELECT id, original_filename, file_type, rating, color_label, strftime(taken_at, '%Y-%m-%dT%H:%M:%S') AS taken, file_size, CASE WHEN edit_rev = 0 THEN '' ELSE cast(edit_rev AS varchar) END AS thumb_version FROM v_live "
    f"WHERE {SHOWN} AND rating >= 4 AND gps_country IS NOT NULL AND id IN (SELECT image_id FROM v_image_tag WHERE name IN (SELECT name FROM v_tag ORDER BY name LIMIT 2) GROUP BY image_id HAVING count(DISTINCT name) = 2) ORDER BY {ORDER} LIMIT 100"
)
def library_index(spark, sf_dir):
    names = views.tags(spark, sf_dir).orderBy("name").limit(2)
    wanted = replace(FILTER, tags=tuple(r["name"] for r in names.collect()))
    found = filters.apply(views.live(spark, sf_dir), wanted, views.image_tags(spark, sf_dir)).where("gps_country is not null")
    return order.page(found).select(
        "id", "original_filename", "file_type", "rating", "color_label", dates.iso_seconds(F.col("taken_at")).alias("taken"), "file_size", F.when(F.col("edit_rev") == 0, "").otherwise(F.col("edit_rev").cast("string")).alias("thumb_version")
    )


@query(f"SELECT count(*) AS n FROM v_live WHERE {SHOWN} AND rating >= 4")
def library_count(spark, sf_dir):
    return filters.apply(views.live(spark, sf_dir), FILTER).agg(F.count("*").alias("n"))


@query("SELECT id FROM v_live WHERE rating >= 3 AND color_label = 'red' AND camera_model = 'BUILDING'")
def filter_equalities(spark, sf_dir):
    return _ids(filters.apply(views.live(spark, sf_dir), LibraryFilter(rating_min=3, color="red", camera="BUILDING")))


@query("SELECT id FROM v_live WHERE focal_length >= cast(35.8 AS double) - cast(0.05 AS double) AND focal_length <= cast(85.8 AS double) + cast(0.05 AS double)")
def filter_focal_tolerance(spark, sf_dir):
    return _ids(filters.apply(views.live(spark, sf_dir), LibraryFilter(focal_min=35.8, focal_max=85.8)))


@query("SELECT id FROM v_live WHERE gps_lat IS NULL")
def filter_country_none(spark, sf_dir):
    return _ids(filters.apply(views.live(spark, sf_dir), LibraryFilter(country=filters.NO_COUNTRY)))


@query("SELECT id FROM v_live WHERE taken_at >= TIMESTAMP '1995-03-01 00:00:00' AND taken_at <= TIMESTAMP '1995-05-31 23:59:59'")
def filter_date_range(spark, sf_dir):
    return _ids(filters.apply(views.live(spark, sf_dir), LibraryFilter(date_from=dt.datetime(1995, 3, 1), date_to=dt.datetime(1995, 5, 31, 23, 59, 59))))


@query("SELECT id FROM v_live WHERE file_type = 'jpeg'")
def view_jpeg_only(spark, sf_dir):
    return _ids(filters.apply(views.live(spark, sf_dir), LibraryFilter(view_mode="jpeg_only")))


@query(f"SELECT id FROM v_live WHERE {SHOWN}")
def exclude_unavailable(spark, sf_dir):
    return _ids(views.live(spark, sf_dir).where(filters.available(views.UNAVAILABLE)))


@query("SELECT id FROM v_live WHERE id IN (SELECT image_id FROM v_image_tag WHERE name IN (SELECT name FROM v_tag ORDER BY name LIMIT 3))")
def tags_any_rule(spark, sf_dir):
    names = tuple(r["name"] for r in views.tags(spark, sf_dir).orderBy("name").limit(3).collect())
    return _ids(filters.with_any_tag(views.live(spark, sf_dir), views.image_tags(spark, sf_dir), names))


@query(
    "SELECT a.id AS album_id, count(*) AS n FROM v_album a JOIN (SELECT album_id, image_id FROM v_album_image UNION SELECT r.album_id, t.image_id FROM v_rule r JOIN v_image_tag t ON t.name = r.name) m ON m.album_id = a.id "
    "JOIN v_live i ON i.id = m.image_id GROUP BY a.id"
)
def album_members(spark, sf_dir):
    return filters.album_sizes(views.album_rules(spark, sf_dir), views.album_images(spark, sf_dir), views.image_tags(spark, sf_dir), views.live(spark, sf_dir))


@query("SELECT id FROM v_image WHERE owner_id = 1 AND deleted_at IS NOT NULL AND source_root_id IS NULL ")
def trash_list(spark, sf_dir):
    return _ids(filters.trash_list(views.images(spark, sf_dir), 1))


@query("SELECT id FROM v_image WHERE source_root_id IS NULL AND deleted_at < TIMESTAMP '1999-12-02 00:00:00'")
def purge_expired(spark, sf_dir):
    return _ids(views.images(spark, sf_dir).where(filters.expired(30, NOW)))


@query("SELECT id FROM v_live WHERE taken_at >= TIMESTAMP '1996-02-01' AND taken_at < TIMESTAMP '1996-03-01'")
def time_bounds_month(spark, sf_dir):
    return _ids(views.live(spark, sf_dir).where(filters.smart_predicate("month:1996-02")))


@query("SELECT id FROM v_live WHERE gps_country = 'NATION_7' AND taken_at >= TIMESTAMP '1996-01-01' AND taken_at < TIMESTAMP '1997-01-01'")
def smart_country_year(spark, sf_dir):
    return _ids(views.live(spark, sf_dir).where(filters.smart_predicate("country-year:NATION_7:1996")))


@query("SELECT id, gps_lat, gps_lon, paired_image_id, original_filename FROM v_live WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL")
def geo_points(spark, sf_dir):
    return views.live(spark, sf_dir).where("gps_lat is not null and gps_lon is not null").select("id", "gps_lat", "gps_lon", "paired_image_id", "original_filename")


# ---- facets and statistics --------------------------------------------------

_FACET = "SELECT '{facet}' AS facet, {value} AS value, count(*) AS n FROM v_live WHERE {where} GROUP BY 1, 2"
_FOCAL = "CASE WHEN round(focal_length, 1) = floor(round(focal_length, 1)) THEN cast(cast(round(focal_length, 1) AS bigint) AS varchar) ELSE printf('%.1f', round(focal_length, 1)) END"


@query(
    " UNION ALL ".join(
        (
            _FACET.format(facet="camera", value="camera_model", where="camera_model <> '' AND rating >= 3 AND gps_country = 'NATION_7'"),
            _FACET.format(facet="lens", value="lens_model", where="lens_model <> '' AND rating >= 3 AND gps_country = 'NATION_7' AND camera_model = 'BUILDING'"),
            _FACET.format(facet="focal", value=_FOCAL, where="round(focal_length, 1) > 0 AND rating >= 3 AND gps_country = 'NATION_7' AND camera_model = 'BUILDING'"),
            _FACET.format(facet="region", value="gps_country", where="gps_country IS NOT NULL AND rating >= 3 AND camera_model = 'BUILDING'"),
        )
    )
)
def facets_cross_filtered(spark, sf_dir):
    return aggregates.facets(views.live(spark, sf_dir), LibraryFilter(rating_min=3, camera="BUILDING", country="NATION_7"))


@query("SELECT count(*) AS n FROM v_live WHERE gps_lat IS NULL")
def no_location(spark, sf_dir):
    return views.live(spark, sf_dir).agg(F.count_if(F.col("gps_lat").isNull()).alias("n"))


@query(
    "SELECT count(*) AS photos, cast(coalesce(sum(file_size), 0) AS bigint) AS bytes, count(*) FILTER (WHERE file_type = 'raw') AS raws, count(*) FILTER (WHERE file_type = 'jpeg') AS jpegs, cast(floor(count(paired_image_id) / 2) AS bigint) AS pairs, "
    "count(*) FILTER (WHERE edit_rev > 0) AS edited, count(gps_lat) AS located, count(*) FILTER (WHERE rating > 0) AS rated, count(DISTINCT nullif(camera_model, '')) AS cameras, count(DISTINCT nullif(lens_model, '')) AS lenses, min(taken_at) AS first_taken, max(taken_at) AS last_taken FROM v_live"
)
def stats_totals(spark, sf_dir):
    return aggregates.totals(views.live(spark, sf_dir))


@query("SELECT lens_model AS value, count(*) AS n FROM v_live WHERE lens_model <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def stats_top_lenses(spark, sf_dir):
    return aggregates.top_values(views.live(spark, sf_dir), "lens_model")


@query(
    "SELECT p AS position, name, count(*) AS n FROM v_live JOIN (VALUES (0, 0, 16, 'Ultra wide (<16mm)'), (1, 16, 24, 'Wide (16-23mm)'), (2, 24, 36, 'Semi wide (24-35mm)'), (3, 36, 51, 'Normal (36-50mm)'), (4, 51, 86, 'Short tele (51-85mm)'), (5, 86, 136, 'Tele (86-135mm)'), "
    "(6, 136, 301, 'Long tele (136-300mm)'), (7, 301, 100000, 'Super tele (>300mm)')) AS r(p, low, high, name) ON focal_length >= low AND focal_length < high GROUP BY p, name"
)
def stats_focal_buckets(spark, sf_dir):
    return aggregates.focal_histogram(views.live(spark, sf_dir))


@query("SELECT cast(year(taken_at) AS int) AS year, count(*) AS n FROM v_live WHERE taken_at IS NOT NULL GROUP BY 1")
def stats_years(spark, sf_dir):
    return collections.years(views.live(spark, sf_dir))


@query("SELECT r.rating, count(i.id) AS n FROM (VALUES (1), (2), (3), (4), (5)) AS r(rating) LEFT JOIN v_live i ON i.rating = r.rating GROUP BY r.rating")
def stats_ratings_zero_filled(spark, sf_dir):
    return aggregates.ratings(views.live(spark, sf_dir))


@query("SELECT t.name, count(l.image_id) AS n FROM v_tag t LEFT JOIN v_image_tag l ON l.name = t.name GROUP BY t.name")
def tag_usage_left(spark, sf_dir):
    return aggregates.tag_usage(views.tags(spark, sf_dir), views.image_tags(spark, sf_dir))


@query("SELECT t.name, t.id FROM v_word t WHERE NOT EXISTS (SELECT 1 FROM v_image_tag l WHERE l.name = t.name)")
def tags_unused_anti(spark, sf_dir):
    return aggregates.unused_tags(views.tag_words(spark, sf_dir), views.image_tags(spark, sf_dir))


@query("SELECT count(*) FILTER (WHERE remote_id IS NOT NULL) AS synced, count(*) AS total FROM v_live WHERE remote_sync AND file_type <> 'raw'")
def sync_progress(spark, sf_dir):
    return aggregates.sync_progress(views.live(spark, sf_dir), "selective")


@query("SELECT source_root_id, count(*) AS n FROM v_image WHERE source_root_id IS NOT NULL GROUP BY 1")
def sources_with_counts(spark, sf_dir):
    return views.images(spark, sf_dir).where("source_root_id is not null").groupBy("source_root_id").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM v_live) AS n_live, (SELECT max(imported_at) FROM v_live) AS newest, (SELECT count(*) FROM embeddings) AS n_vectors, 1 AS version")
def library_signature(spark, sf_dir):
    return aggregates.signature(views.live(spark, sf_dir), table(spark, sf_dir, "embeddings"))


@query("SELECT cast(taken_at AS date) AS day, CASE WHEN min(rating) = max(rating) AND count(rating) = count(*) THEN min(rating) ELSE 0 END AS rating FROM v_live GROUP BY 1")
def shared_selection_value(spark, sf_dir):
    return views.live(spark, sf_dir).groupBy(F.to_date("taken_at").alias("day")).agg(aggregates.shared_value("rating", 0).alias("rating"))


# ---- derived collections ----------------------------------------------------


@query("SELECT strftime(taken_at, '%Y-%m') AS key, strftime(taken_at, '%B %Y') AS name, count(*) AS n FROM v_live GROUP BY 1, 2 HAVING count(*) >= 5")
def time_months_min5(spark, sf_dir):
    return collections.months(views.live(spark, sf_dir))


@query(
    "SELECT day, n FROM (SELECT cast(taken_at AS date) AS day, count(*) AS n FROM v_live GROUP BY 1), (SELECT median(n) AS middle FROM (SELECT count(*) AS n FROM v_live GROUP BY cast(taken_at AS date))) WHERE n >= greatest(10.0, middle * 1.5) ORDER BY day DESC LIMIT 30"
)
def big_days_median(spark, sf_dir):
    return collections.big_days(views.live(spark, sf_dir), factor=1.5)


@query("SELECT gps_country, count(*) AS n FROM v_live WHERE gps_country IS NOT NULL GROUP BY 1")
def countries(spark, sf_dir):
    return collections.countries(views.live(spark, sf_dir))


@query("SELECT gps_country, cast(year(taken_at) AS int) AS year, count(*) AS n FROM v_live WHERE gps_country IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY year DESC, n DESC, gps_country LIMIT 60")
def country_years_min3(spark, sf_dir):
    return collections.country_years(views.live(spark, sf_dir))


@query("SELECT name, n, row_number() OVER (ORDER BY n DESC, lower(name), name) AS place FROM (SELECT l.name, count(*) AS n FROM v_image_tag l JOIN v_live i ON i.id = l.image_id GROUP BY 1)")
def tag_albums(spark, sf_dir):
    listed = collections.tag_albums(views.live(spark, sf_dir), views.image_tags(spark, sf_dir)).select("name", "n", F.monotonically_increasing_id().alias("seq"))
    rows = listed.agg(F.sort_array(F.collect_list(F.struct("seq", "name", "n"))).alias("rows"))  # tag names are few; their order is the result
    return rows.select(F.posexplode("rows").alias("pos", "x")).select("x.name", "x.n", (F.col("pos") + 1).cast("long").alias("place"))


@query("SELECT n, rank, id FROM (SELECT count(*) OVER () AS n, row_number() OVER (ORDER BY CASE WHEN file_type = 'jpeg' THEN 0 ELSE 1 END, taken_at DESC NULLS LAST, id) AS rank, id, file_type, bool_or(file_type = 'jpeg') OVER () AS any_jpeg FROM v_live WHERE edit_rev > 0 OR applied_adjustments IS NOT NULL) WHERE rank <= 4 AND (file_type = 'jpeg' OR NOT any_jpeg)")
def edited_album(spark, sf_dir):
    out = collections.edited_album(views.live(spark, sf_dir))
    return out.select("n", F.posexplode("covers").alias("pos", "id")).select("n", (F.col("pos") + 1).cast("long").alias("rank"), "id")


@query("SELECT gps_country, rank, id FROM (SELECT gps_country, id, row_number() OVER (PARTITION BY gps_country ORDER BY taken_at DESC NULLS LAST, id) AS rank FROM v_live WHERE gps_country IS NOT NULL AND file_type = 'jpeg') WHERE rank <= 4")
def covers_top4(spark, sf_dir):
    out = aggregates.covers(views.live(spark, sf_dir).where("gps_country is not null"), ["gps_country"])
    return out.select("gps_country", F.posexplode("covers").alias("pos", "id")).select("gps_country", (F.col("pos") + 1).cast("long").alias("rank"), "id")


@query("SELECT s.subject, s.cluster, s.size, s.rank FROM (SELECT gps_country AS subject, cast(year(taken_at) AS int) AS cluster, count(*) AS size, row_number() OVER (PARTITION BY gps_country ORDER BY count(*) DESC, cast(year(taken_at) AS int)) AS rank FROM v_live WHERE gps_country IS NOT NULL GROUP BY 1, 2) s JOIN (SELECT gps_country AS subject, min(cast(year(taken_at) AS int)) AS seen FROM v_live WHERE gps_country IS NOT NULL GROUP BY 1) m ON m.subject = s.subject ORDER BY s.rank, m.seen, s.subject LIMIT 40")
def round_robin_subjects(spark, sf_dir):
    sizes = views.live(spark, sf_dir).where("gps_country is not null").groupBy(F.col("gps_country").alias("subject"), F.year("taken_at").alias("cluster")).agg(F.count("*").alias("size"))
    return collections.round_robin(sizes).withColumn("rank", F.col("rank").cast("long"))


# ---- geography --------------------------------------------------------------


@query(f"SELECT id, round({KM.format(lat1='48.0', lon1='11.0', lat2='gps_lat', lon2='gps_lon')}, 6) AS km FROM v_live WHERE {KM.format(lat1='48.0', lon1='11.0', lat2='gps_lat', lon2='gps_lon')} <= 2000")
def haversine_to_point(spark, sf_dir):
    return geo.near_point(views.live(spark, sf_dir), 48.0, 11.0, 2000.0).select("id", F.round("km", 6).alias("km"))


_CENTRES = "SELECT n_nationkey AS centre, cast(n_nationkey * 7 - 80 AS double) AS lat, cast(n_nationkey * 14 - 175 AS double) AS lon FROM nation"


@query(f"SELECT c.centre, count(*) AS n FROM v_live i JOIN ({_CENTRES}) c ON {KM.format(lat1='gps_lat', lon1='gps_lon', lat2='c.lat', lon2='c.lon')} <= 900 WHERE gps_lat IS NOT NULL GROUP BY 1")
def range_join_places(spark, sf_dir):
    centres = table(spark, sf_dir, "nation").selectExpr("n_nationkey as centre", "cast(n_nationkey * 7 - 80 as double) as lat", "cast(n_nationkey * 14 - 175 as double) as lon")
    return geo.within(views.live(spark, sf_dir).select("id", "gps_lat", "gps_lon"), centres, 900.0).groupBy("centre").agg(F.count("*").alias("n"))


@query(f"SELECT id, centre AS city FROM (SELECT i.id, c.centre, row_number() OVER (PARTITION BY i.id ORDER BY {KM.format(lat1='gps_lat', lon1='gps_lon', lat2='c.lat', lon2='c.lon')}, c.centre) AS r FROM v_live i, ({_CENTRES}) c WHERE gps_lat IS NOT NULL) WHERE r = 1")
def nearest_city(spark, sf_dir):
    cities = table(spark, sf_dir, "nation").selectExpr("n_nationkey as city", "cast(n_nationkey * 7 - 80 as double) as lat", "cast(n_nationkey * 14 - 175 as double) as lon")
    return geo.nearest(views.live(spark, sf_dir), cities).select("id", "city")


@query("SELECT cast(floor((gps_lon + 180.0) / 360.0 * 2048 / 58) AS bigint) AS cell_x, cast(floor((1.0 - ln(tan(radians(gps_lat)) + 1.0 / cos(radians(gps_lat))) / pi()) / 2.0 * 2048 / 58) AS bigint) AS cell_y, count(*) AS n FROM v_live WHERE gps_lat IS NOT NULL GROUP BY 1, 2")
def grid_cells(spark, sf_dir):
    return geo.grid_cells(views.live(spark, sf_dir), zoom=3).select("cell_x", "cell_y", "n")


@query("SELECT round(avg(gps_lat), 6) AS lat, round(avg(gps_lon), 6) AS lon FROM v_live WHERE gps_lat IS NOT NULL")
def located_centroid(spark, sf_dir):
    return geo.centroid(views.live(spark, sf_dir)).select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def _km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"12742.0 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


@query(f"""
WITH RECURSIVE p AS (SELECT gps_country AS grp, gps_lat AS lat, gps_lon AS lon, min(epoch_us(cast(taken_at AS TIMESTAMP))) AS seq, count(*) AS n FROM v_live WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL GROUP BY 1, 2, 3),
r(grp, lat, lon, seq, step) AS (
  SELECT grp, lat, lon, seq, 0 FROM p UNION ALL
  SELECT grp, lat, lon, seq, step + 1 FROM (SELECT *, first_value(lat) OVER w AS la, first_value(lon) OVER w AS lo FROM r WINDOW w AS (PARTITION BY grp ORDER BY seq NULLS LAST, lat, lon)) WHERE round({_km("la", "lo", "lat", "lon")}, 9) > 500
), founders AS (SELECT grp, step, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY grp, step ORDER BY seq NULLS LAST, lat, lon) AS k FROM r) WHERE k = 1),
joined AS (SELECT p.*, f.step, row_number() OVER (PARTITION BY p.grp, p.lat, p.lon ORDER BY round({_km("p.lat", "p.lon", "f.lat", "f.lon")}, 9), f.step) AS k FROM p JOIN founders f ON f.grp IS NOT DISTINCT FROM p.grp),
centres AS (SELECT grp, step, sum(lat * n) / sum(n) AS lat, sum(lon * n) / sum(n) AS lon FROM joined WHERE k = 1 GROUP BY 1, 2),
counted AS (SELECT c.grp, c.step, c.lat, c.lon, cast(coalesce(sum(p.n) FILTER (WHERE round({_km("p.lat", "p.lon", "c.lat", "c.lon")}, 9) <= 500), 0) AS BIGINT) AS members FROM centres c JOIN p ON p.grp IS NOT DISTINCT FROM c.grp GROUP BY 1, 2, 3, 4)
SELECT cast(grp AS VARCHAR) AS "group", cast(row_number() OVER (PARTITION BY grp ORDER BY members DESC, step) - 1 AS INT) AS place, round(lat, 9) AS lat, round(lon, 9) AS lon, members FROM counted
""")
def leader_places(spark, sf_dir):
    points = views.live(spark, sf_dir).withColumn("seq", F.unix_micros(F.col("taken_at").cast("timestamp")))
    places = geo.leader_places(points.select("id", "seq", "gps_lat", "gps_lon", "gps_country"), 500.0, group="gps_country")
    return places.select("group", "place", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "members")


# ---- vectors ----------------------------------------------------------------


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_L2 = "sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (cast(x[1] AS double) - cast(x[2] AS double)) * (cast(x[1] AS double) - cast(x[2] AS double)))))"


@query(f"SELECT e.vec_id AS id, round({_L2}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q WHERE e.vec_id <> (SELECT min(vec_id) FROM embeddings) ORDER BY {_L2}, e.vec_id LIMIT 10")
def knn_l2_top10(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return vectors.nearest_to_row(v, v.agg(F.min("id")).first()[0], 10).select("id", F.round("distance", 6).alias("distance"))


@query(
    f"SELECT id, round(distance, 6) AS distance FROM (SELECT e.vec_id AS id, e.label, {_L2} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q WHERE e.vec_id <> (SELECT min(vec_id) FROM embeddings) ORDER BY distance, id LIMIT 200) WHERE label IN (1, 2) ORDER BY distance, id LIMIT 20"
)
def knn_scope_postfilter(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    ranked = vectors.nearest_to_row(v, v.agg(F.min("id")).first()[0], vectors.pool_size(20))
    return vectors.scoped(ranked, v.where(F.col("label").isin(1, 2)), 20).select("id", F.round("distance", 6).alias("distance"))


_DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: cast(x[1] AS double) * cast(x[2] AS double)))"


@query(f"SELECT id, label FROM (SELECT e.vec_id AS id, q.label, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_DOT} DESC, q.label DESC) AS r FROM embeddings e, (SELECT label, embedding FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) WHERE k = 1) q) WHERE r = 1")
def cosine_label_argmax(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    labels = v.groupBy("label").agg(F.min_by("vector", "id").alias("label_vector"))
    return collections.name_clusters(v.select(F.col("id").alias("cluster"), "vector"), labels, least=-2.0).select(F.col("cluster").alias("id"), F.col("name").cast("int").alias("label"))


@query("SELECT user_id, event_id, round(exp((value - max(value) OVER (PARTITION BY user_id)) / 50.0) / sum(exp((value - m) / 50.0)) OVER (PARTITION BY user_id), 9) AS weight FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM events)")
def softmax_weights(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return vectors.softmax_weights(e, "user_id", "value", 50.0).select("user_id", "event_id", F.round("weight", 9).alias("weight"))


@query("SELECT id FROM v_live WHERE id NOT IN (SELECT vec_id FROM embeddings) AND id % 5 <> 0 ORDER BY imported_at DESC NULLS LAST, id LIMIT 100")
def missing_embeddings_anti(spark, sf_dir):
    images = views.live(spark, sf_dir)
    return _ids(vectors.missing_vectors(images, _vectors(spark, sf_dir), images.where("id % 5 = 0"), 100))


_COS = "round(list_cosine_similarity(v.e, f.e), 12)"


def _most_like(centres: str) -> str:
    return f"SELECT * FROM (SELECT v.*, f.centre, row_number() OVER (PARTITION BY v.id ORDER BY {_COS} DESC, f.centre) AS k, {_COS} AS cos FROM v JOIN {centres} f ON f.grp IS NOT DISTINCT FROM v.grp) WHERE k = 1 AND cos >= 0.3"


@query(f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, label AS grp, cast(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), r(grp, id, e, step) AS (
  SELECT grp, id, e, 0 FROM v UNION ALL
  SELECT grp, id, e, step + 1 FROM (SELECT *, first_value(id) OVER w AS first_id, first_value(e) OVER w AS first_e FROM r WINDOW w AS (PARTITION BY grp ORDER BY id)) WHERE id <> first_id AND round(list_cosine_similarity(e, first_e), 12) < 0.3
), founders AS (SELECT grp, step AS centre, arg_min(e, id) AS e FROM r GROUP BY 1, 2), joined AS ({_most_like("founders")}),
parts AS (SELECT grp, centre, unnest(e) / sqrt(list_dot_product(e, e)) AS x, generate_subscripts(e, 1) AS pos FROM joined), means AS (SELECT grp, centre, pos, avg(x) AS x FROM parts GROUP BY 1, 2, 3), centroids AS (SELECT grp, centre, list(x ORDER BY pos) AS e FROM means GROUP BY 1, 2),
moved AS ({_most_like("centroids")}), kept AS (SELECT grp, centre, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, centre) - 1 AS cluster FROM moved GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT cast(m.grp AS VARCHAR) AS "group", m.id, cast(k.cluster AS INT) AS cluster FROM moved m JOIN kept k ON k.grp IS NOT DISTINCT FROM m.grp AND k.centre = m.centre
""")
def greedy_clusters(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("seq", F.col("id"))
    return collections.greedy_clusters(v, group="label", threshold=0.3, least=2)


# ---- entity resolution ------------------------------------------------------


def _staged(spark, sf_dir):
    """Two libraries, as two sides are the feature: sources of a one-digit number are home, the others come in."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"), F.col("n_chars").alias("size"), "source")
    return d.where("length(source) > 4").drop("source").withColumn("seq", F.col("id")), d.where("length(source) <= 4").drop("source")


_STAGED = "(SELECT doc_id AS id, sha256(text) AS sha, n_chars AS size FROM documents WHERE length(source) > 4)"
_LIBRARY = "(SELECT doc_id AS id, sha256(text) AS sha, n_chars AS size FROM documents WHERE length(source) <= 4)"


@query("SELECT doc_id AS id, CASE WHEN text IS NOT NULL THEN nullif(first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id), doc_id) END AS duplicate_of FROM documents")
def dedup_first_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"), F.col("doc_id").alias("seq"))
    return entity.first_wins(d).select("id", "duplicate_of")


@query(f"SELECT s.id, l.library_id FROM {_STAGED} s LEFT JOIN (SELECT sha, min(id) AS library_id FROM {_LIBRARY} GROUP BY sha) l ON l.sha = s.sha")
def dedup_library_match(spark, sf_dir):
    return entity.match_library(*_staged(spark, sf_dir)).select("id", "library_id")


@query(f"SELECT count(*) AS photos, count(l.sha) AS known, count(*) - count(l.sha) AS new, cast(coalesce(sum(CASE WHEN l.sha IS NULL THEN s.size END), 0) AS bigint) AS bytes FROM {_STAGED} s LEFT JOIN (SELECT DISTINCT sha FROM {_LIBRARY}) l ON l.sha = s.sha")
def merge_summary(spark, sf_dir):
    staged, library = _staged(spark, sf_dir)
    return entity.merge_summary(library, staged, "sha")


@query(
    f"WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY id) AS n FROM {_STAGED}) WHERE n = 1), l AS (SELECT * FROM {_LIBRARY}) SELECT l.id, l.sha, CASE WHEN s.sha IS NOT NULL THEN s.size ELSE l.size END AS size FROM l LEFT JOIN s ON s.sha = l.sha UNION ALL SELECT id, sha, size FROM s WHERE sha NOT IN (SELECT sha FROM l)"
)
def merge_upsert(spark, sf_dir):
    staged, library = _staged(spark, sf_dir)
    return entity.merge(library, staged.drop("seq"), "sha", ["size"])


@query(
    "SELECT m.id, u.path FROM (SELECT doc_id AS id, sha256(text) AS sha, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents WHERE length(source) <= 4) m JOIN (SELECT 'new/' || cast(doc_id AS varchar) AS path, sha256(text) AS sha, row_number() OVER (PARTITION BY sha256(text) ORDER BY 'new/' || cast(doc_id AS varchar)) AS k FROM documents WHERE length(source) > 4) u ON u.sha = m.sha AND u.k = m.k"
)
def rename_follow_ranked(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    missing = d.where("length(source) <= 4").select(F.col("doc_id").alias("id"), F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha"))
    files = d.where("length(source) > 4").select(F.concat(F.lit("new/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").alias("size"), F.encode("text", "UTF-8").alias("content"))
    return entity.follow_renames(missing, files)


def _shots(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linestatus") == "O", "raw").otherwise("jpeg")
    return lines.select(F.col("l_orderkey").alias("stem"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), kind.alias("kind"), F.col("l_returnflag").alias("camera"), F.col("l_shipdate").alias("taken_at"))


@query(
    "SELECT stem, raw_id, other_id FROM (SELECT l_orderkey AS stem, count(*) FILTER (WHERE l_linestatus = 'O') AS raws, count(*) FILTER (WHERE l_linestatus <> 'O') AS others, max(CASE WHEN l_linestatus = 'O' THEN l_orderkey * 100 + l_linenumber END) AS raw_id, max(CASE WHEN l_linestatus <> 'O' THEN l_orderkey * 100 + l_linenumber END) AS other_id, "
    "max(CASE WHEN l_linestatus = 'O' THEN l_shipdate END) AS a, max(CASE WHEN l_linestatus <> 'O' THEN l_shipdate END) AS b, max(CASE WHEN l_linestatus = 'O' THEN l_returnflag END) AS c, max(CASE WHEN l_linestatus <> 'O' THEN l_returnflag END) AS d FROM lineitem GROUP BY 1) WHERE raws = 1 AND others = 1 AND c = d AND abs(epoch(a) - epoch(b)) <= 864000 * 3"
)
def pair_stem_1to1(spark, sf_dir):
    return entity.pairs_one_to_one(_shots(spark, sf_dir), dt.timedelta(days=30))


@query("""
WITH RECURSIVE s AS (SELECT l_orderkey AS stem, l_linestatus = 'O' AS raw, {'id': l_orderkey * 100 + l_linenumber, 'at': epoch(l_shipdate), 'camera': lower(trim(coalesce(l_returnflag, '')))} AS x FROM lineitem),
g AS (SELECT stem, list(x ORDER BY x.id) FILTER (WHERE raw) AS raws, list(x ORDER BY x.id) FILTER (WHERE NOT raw) AS others FROM s GROUP BY 1 HAVING bool_or(raw) AND NOT bool_and(raw)),
r(stem, raws, others, k, raw_id, other_id) AS (
  SELECT stem, raws, others, 0, cast(NULL AS BIGINT), cast(NULL AS BIGINT) FROM g UNION ALL
  SELECT stem, raws, CASE WHEN len(hits) = 1 THEN list_filter(others, lambda o: o.id <> hits[1].id) ELSE others END, k + 1, raws[k + 1].id, CASE WHEN len(hits) = 1 THEN hits[1].id END FROM (
    SELECT *, list_filter(others, lambda o: (len(raws) = 1 AND len(others) = 1 OR raws[k + 1].at IS NOT NULL AND o.at IS NOT NULL) AND coalesce(abs(raws[k + 1].at - o.at) <= 2592000, true) AND (raws[k + 1].camera = '' OR o.camera = '' OR raws[k + 1].camera = o.camera)) AS hits FROM r WHERE k < len(raws)))
SELECT stem, raw_id, other_id FROM r WHERE other_id IS NOT NULL
""")
def pair_groups(spark, sf_dir):
    return entity.pair_groups(_shots(spark, sf_dir), dt.timedelta(days=30))


@query("SELECT a.id, a.paired_image_id FROM v_live a JOIN v_live b ON b.id = a.paired_image_id WHERE a.id < b.id AND (abs(epoch(a.taken_at) - epoch(b.taken_at)) > 10 OR a.camera_model <> b.camera_model)")
def unpair_conflicts(spark, sf_dir):
    return entity.conflicting_pairs(views.live(spark, sf_dir))


@query("SELECT a.id FROM v_live a JOIN v_live b ON b.id = a.paired_image_id WHERE a.id % 5 <> 0 AND b.id % 5 = 0")
def incomplete_pairs(spark, sf_dir):
    return entity.incomplete_pairs(views.live(spark, sf_dir).withColumn("selected", F.col("id") % 5 == 0))


# ---- order, pairs, sections -------------------------------------------------


@query(f"SELECT min(id) FILTER (WHERE half = 1) AS id, min(id) FILTER (WHERE first = 1) AS at FROM (SELECT id, least(id, coalesce(paired_image_id, id)) AS p, row_number() OVER (PARTITION BY least(id, coalesce(paired_image_id, id)) ORDER BY CASE WHEN file_type = 'raw' THEN 1 ELSE 0 END, {ORDER}) AS half, row_number() OVER (PARTITION BY least(id, coalesce(paired_image_id, id)) ORDER BY {ORDER}) AS first FROM v_live) GROUP BY p")
def pairs_collapsed(spark, sf_dir):
    return order.collapse_in_order(views.live(spark, sf_dir)).select("id", F.col("place.id").alias("at"))


@query(
    "SELECT conv_id, turn, role, cast(section AS bigint) AS section, CASE WHEN nth = 1 THEN role ELSE role || '#' || cast(nth AS varchar) END AS section_key FROM (SELECT *, dense_rank() OVER (PARTITION BY conv_id, role ORDER BY section) AS nth FROM (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM (SELECT conv_id, turn, role, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS fresh FROM conversations)))"
)
def sections_islands(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return order.sections(rows, "role", [F.col("turn")], within=["conv_id"]).select("conv_id", "turn", "role", "section", "section_key")


@query("SELECT id, CASE WHEN n = 0 THEN original_filename ELSE regexp_replace(original_filename, '\\.[^.]*$', '') || '_' || cast(n AS varchar) || regexp_extract(original_filename, '(\\.[^.]*)$', 1) END AS archive_name FROM (SELECT id, original_filename, row_number() OVER (PARTITION BY original_filename ORDER BY id) - 1 AS n FROM v_live)")
def name_collision_suffix(spark, sf_dir):
    return order.numbered_names(views.live(spark, sf_dir), "original_filename", [F.col("id")]).select("id", "archive_name")


@query("SELECT user_id, event_id, n, CASE WHEN seconds > 0 THEN round(n / seconds, 9) END AS rate FROM (SELECT user_id, event_id, count(*) OVER w AS n, (epoch_us(ts) - min(epoch_us(ts)) OVER w) / 1000000.0 AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))")
def rolling_eta_20(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_id").alias("seq"))
    return order.rolling_rate(e, "user_id", "ts").select("user_id", "event_id", "n", F.round("rate", 9).alias("rate"))


@query("SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda acc, x: acc * 0.6 + x * (1 - 0.6)), 6) AS ema FROM events GROUP BY user_id")
def ema_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("values"))
    return e.select("user_id", F.round(order.ema(F.col("values")), 6).alias("ema"))


@query(f"SELECT id, min(stage) AS stage FROM (SELECT id, 0 AS stage FROM (SELECT id FROM v_live WHERE color_label = 'red' ORDER BY {ORDER} LIMIT 50) UNION ALL SELECT id, 1 FROM (SELECT id FROM v_live WHERE rating >= 4 ORDER BY {ORDER} LIMIT 50)) GROUP BY id")
def ordered_union_stages(spark, sf_dir):
    stage = lambda p: search._placed(views.live(spark, sf_dir).where(p).orderBy(*order.total_order()).limit(50), order.total_order()).select("id", "pos")
    return order.ordered_union([stage("color_label = 'red'"), stage("rating >= 4")]).select("id", "stage")


@query(f"""
WITH tagged AS (SELECT DISTINCT i.* FROM (SELECT i.*, t.name FROM v_live i JOIN v_image_tag t ON t.image_id = i.id WHERE lower(t.name) LIKE '%econ%' ORDER BY {ORDER}, t.name LIMIT 40) h JOIN v_live i ON i.id = h.id),
here AS (SELECT * FROM v_live WHERE gps_country = 'NATION_7' ORDER BY {ORDER} LIMIT 40), near AS (SELECT e.vec_id, {_L2} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q ORDER BY distance, vec_id LIMIT 200),
stages AS (SELECT 0 AS stage, row_number() OVER (ORDER BY {ORDER}) AS pos, id, file_type, paired_image_id FROM tagged UNION ALL SELECT 1, row_number() OVER (ORDER BY {ORDER}), id, file_type, paired_image_id FROM here UNION ALL SELECT 2, row_number() OVER (ORDER BY n.distance, i.id), i.id, i.file_type, i.paired_image_id FROM near n JOIN v_live i ON i.id = n.vec_id),
hits AS (SELECT *, row_number() OVER (ORDER BY stage, pos) AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stage, pos) AS n FROM stages) WHERE n = 1),
pairs AS (SELECT place, id, file_type, paired_image_id FROM hits UNION ALL SELECT h.place, p.id, p.file_type, p.paired_image_id FROM hits h JOIN v_live p ON p.id = h.paired_image_id),
ranked AS (SELECT *, row_number() OVER (ORDER BY place, file_type = 'raw', id) AS rank FROM (SELECT id, file_type, paired_image_id, min(place) AS place FROM pairs GROUP BY 1, 2, 3))
SELECT cast(rank AS INT) AS rank, id, file_type, paired_image_id FROM ranked r WHERE rank <= 100 OR rank = 101 AND least(id, coalesce(paired_image_id, id)) = (SELECT least(id, coalesce(paired_image_id, id)) FROM ranked WHERE rank = 100)
""")
def search_three_stages(spark, sf_dir):
    scope = views.live(spark, sf_dir)
    v = _vectors(spark, sf_dir)
    probe = [float(x) for x in v.where(F.col("id") == v.agg(F.min("id")).first()[0]).first()["vector"]]
    stages = [search.tag_stage(scope, views.image_tags(spark, sf_dir), "econ", 40), search.country_stage(scope, "NATION_7", 40), search.vector_stage(scope, v.drop("label"), probe, 40)]
    return search.search(scope, scope, stages, 100)


@query(
    f"SELECT id, cast(row_number() OVER (ORDER BY {ORDER}) AS bigint) AS place FROM (SELECT * FROM v_live WHERE gps_country = 'NATION_7' ORDER BY {ORDER} LIMIT 40)"
)
def search_country_stage(spark, sf_dir):
    return search.country_stage(views.live(spark, sf_dir), "NATION_7", 40).select("id", F.col("pos").cast("long").alias("place"))


# ---- documents, names, dates ------------------------------------------------


@query("SELECT event_id, cast(greatest(-100, least(100, coalesce(try_cast(json_extract_string(props, '$.k') AS double), 0))) AS int) AS contrast FROM events")
def json_normalise(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    doc = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("contrast")))
    return e.select("event_id", develop.scalar(doc, "contrast").alias("contrast"))


@query("SELECT id, CASE WHEN lower(original_filename) LIKE '%.raf' THEN 'raw' WHEN lower(original_filename) LIKE '%.jpg' THEN 'jpeg' ELSE 'png' END AS kind, lower(regexp_replace(original_filename, '\\.[^.]*$', '')) AS stem, strftime(taken_at, '%Y/%Y-%m-%d/') || original_filename AS path FROM v_image")
def file_names(spark, sf_dir):
    i = views.images(spark, sf_dir)
    return i.select("id", strings.file_type(F.col("original_filename")).alias("kind"), entity.stem(F.col("original_filename")).alias("stem"), strings.library_path(F.col("taken_at"), F.col("original_filename")).alias("path"))


@query("SELECT id, taken_at AS parsed FROM v_image")
def metadata_dates(spark, sf_dir):
    i = views.images(spark, sf_dir)
    return i.select("id", dates.metadata_date(F.date_format("taken_at", "yyyy:MM:dd HH:mm:ss")).alias("parsed"))


# ---- changes ----------------------------------------------------------------


@query("SELECT id, CASE WHEN id IN (6, 7, 12, 13, 30, 31) THEN 5 ELSE rating END AS rating FROM v_image")
def bulk_rate_with_pairs(spark, sf_dir):
    return changes.rate(views.images(spark, sf_dir), [6, 13, 30], rating=5).select("id", "rating")


@query("SELECT image_id, name FROM v_image_tag UNION SELECT id, 'kept' FROM v_live WHERE rating = 5")
def bulk_add_tags(spark, sf_dir):
    five = views.live(spark, sf_dir).where("rating = 5").select("id")
    return changes.add_tags(views.image_tags(spark, sf_dir), five, [" kept ", ""])


@query("SELECT id, CASE WHEN paired_image_id IN (SELECT id FROM v_image WHERE deleted_at IS NOT NULL AND source_root_id IS NULL) THEN NULL ELSE paired_image_id END AS paired_image_id FROM v_image WHERE deleted_at IS NULL OR source_root_id IS NOT NULL")
def hard_delete_cascade(spark, sf_dir):
    i = views.images(spark, sf_dir)
    left, _, _ = changes.hard_delete(i, {}, i.where("deleted_at is not null and source_root_id is null"))
    return left.select("id", "paired_image_id")


@query("SELECT image_id, name FROM v_image_tag WHERE NOT (name = (SELECT min(name) FROM v_tag) AND image_id IN (SELECT id FROM v_live WHERE rating = 1))")
def remove_tag_from_some(spark, sf_dir):
    name = views.tags(spark, sf_dir).agg(F.min("name")).first()[0]
    return changes.remove_tag(views.image_tags(spark, sf_dir), name, views.live(spark, sf_dir).where("rating = 1").select("id"))


@query("SELECT id, CASE WHEN id % 3 = 0 AND taken_at <> taken_at + INTERVAL 1 HOUR THEN taken_at + INTERVAL 1 HOUR ELSE taken_at END AS taken_at FROM v_image")
def repair_dates(spark, sf_dir):
    i = views.images(spark, sf_dir)
    fresh = i.where("id % 3 = 0").select("id", F.expr("taken_at + interval 1 hour").alias("taken_at"))
    return changes.repair(i, fresh, ["taken_at"])[0].select("id", "taken_at")


# ---- event-time windows (an addition of this engine) ------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    return stream_events.tumbling(table(spark, sf_dir, "events"), "1 hour")


@query("SELECT start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - s * INTERVAL 30 MINUTE AS start, event_type FROM events, (VALUES (0), (1)) AS v(s)) GROUP BY 1, 2")
def events_sliding(spark, sf_dir):
    return stream_events.sliding(table(spark, sf_dir, "events"), "1 hour", "30 minutes")


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def events_session(spark, sf_dir):
    return stream_events.sessions(table(spark, sf_dir, "events"), "2 hours")
