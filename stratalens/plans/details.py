"""Registered queries of small parts: pixels, lists, scans, names and jobs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import develop, pixels, strings
from ..operators import changes, collections, entity, geo, order, places
from ..session import table
from ..sources import catalog
from ..streaming import ingest
from . import views
from .roster import KM, query

_RGB = "(SELECT event_id AS id, (event_id % 101) / 100.0 AS r, (user_id % 53) / 52.0 AS g, (event_id * 7 % 101) / 100.0 AS b FROM events)"
_LUMA = "(r * 0.2126 + g * 0.7152 + b * 0.0722)"


def _rgb(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id as id", "cast(event_id % 101 as double) / 100 as r", "cast(user_id % 53 as double) / 52 as g", "cast(event_id * 7 % 101 as double) / 100 as b")


# ---- pixels -----------------------------------------------------------------


@query(f"SELECT id, round(CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END, 6) AS linear, round(CASE WHEN g <= 0.0031308 THEN g * 12.92 ELSE 1.055 * pow(g, 1 / 2.4) - 0.055 END, 6) AS srgb, round({_LUMA}, 6) AS luma, round(least(8.0, greatest(1.0, 0.1 / (b + 0.001))), 6) AS gain, round((1 + b / 16.0) / (1 + b), 6) AS shoulder FROM {_RGB}")
def pixel_light(spark, sf_dir):
    r, g, b = (F.col(c) for c in "rgb")
    shown = {"linear": pixels.to_linear(r), "srgb": pixels.to_srgb(g), "luma": pixels.luma(r, g, b), "gain": pixels.base_gain(b + 0.001), "shoulder": pixels.reinhard_ratio(b)}
    return _rgb(spark, sf_dir).select("id", *[F.round(c, 6).alias(n) for n, c in shown.items()])


@query(
    f"WITH x AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM {_RGB}), y AS (SELECT *, hi - lo AS span, (hi + lo) / 2 AS l FROM x) "
    "SELECT id, round(CASE WHEN span = 0 THEN 0 WHEN hi = r THEN ((g - b) / span + CASE WHEN g < b THEN 6 ELSE 0 END) * 60 WHEN hi = g THEN ((b - r) / span + 2) * 60 ELSE ((r - g) / span + 4) * 60 END, 5) AS h, round(CASE WHEN span = 0 THEN 0 ELSE span / (1 - abs(2 * l - 1)) END, 5) AS s, round(l, 5) AS l, round(r, 5) AS r, round(g, 5) AS g, round(b, 5) AS b FROM y"
)
def pixel_hsl(spark, sf_dir):
    x = _rgb(spark, sf_dir).select("id", pixels.hsl(F.col("r"), F.col("g"), F.col("b")).alias("x")).withColumn("y", pixels.from_hsl(F.col("x")))
    return x.select("id", *[F.round(f"x.{c}", 5).alias(c) for c in "hsl"], *[F.round(f"y.{c}", 5).alias(c) for c in "rgb"])


@query(f"SELECT id, round(y + (r - y) * 0.4, 6) AS dull, round(y + (r - y) * greatest(0.0, 1 + 80 * (1 - least(1.0, greatest(r, g, b) - least(r, g, b))) / 100.0), 6) AS vivid FROM (SELECT *, {_LUMA} AS y FROM {_RGB})")
def pixel_saturation(spark, sf_dir):
    r, g, b = (F.col(c) for c in "rgb")
    return _rgb(spark, sf_dir).select("id", F.round(pixels.saturated(r, g, b, F.lit(-60.0))["r"], 6).alias("dull"), F.round(pixels.vibrant(r, g, b, F.lit(80.0))["r"], 6).alias("vivid"))


@query(
    f"WITH m AS (SELECT id, greatest(0.0, least(1.0, (1 - sqrt(pow((r - 0.5) / 0.3, 2) + pow((g - 0.5) / 0.4, 2))) / 0.5 + 0.5)) AS radial, greatest(0.0, least(1.0, r * 0.5 / 0.5 + (g - 0.0) * 0.5 / 0.5)) AS linear, greatest(0.0, least(1.0, ({_LUMA} - 0.3) / 0.2 + 1, (0.7 - {_LUMA}) / 0.2 + 1)) AS light FROM {_RGB}) "
    "SELECT id, round(radial, 6) AS radial, round(linear, 6) AS linear, round(light, 6) AS light, round(least(greatest(0.0, radial - linear), light), 6) AS composed FROM m"
)
def pixel_masks(spark, sf_dir):
    r, g, b = (F.col(c) for c in "rgb")
    m = {"radial": pixels.radial_mask(r, g, 0.5, 0.5, 0.3, 0.4, 0.5), "linear": pixels.linear_mask(r, g, 0.0, 0.0, 0.5, 0.5), "light": pixels.luminance_mask(pixels.luma(r, g, b), 0.3, 0.7, 0.2)}
    out = _rgb(spark, sf_dir).select("id", *[c.alias(n) for n, c in m.items()])
    both = pixels.composed([("additive", F.col("radial")), ("subtractive", F.col("linear")), ("intersect", F.col("light"))])
    return out.withColumn("composed", both).select("id", *[F.round(c, 6).alias(c) for c in (*m, "composed")])


_TONED = (
    "(SELECT event_id AS id, (event_id % 997 + 1) / 500.0 AS y, CAST((user_id % 7 - 3) * 50 AS DOUBLE) AS highlights, CAST((user_id % 5 - 2) * 75 AS DOUBLE) AS shadows, CAST((user_id % 3 - 1) * 150 AS DOUBLE) AS whites, "
    "CAST(CASE WHEN user_id % 4 = 0 THEN 150 ELSE 0 END AS DOUBLE) AS blacks, CAST((user_id % 3 - 1) * 60 AS DOUBLE) AS contrast, CAST(CASE WHEN user_id % 2 = 0 THEN -120 ELSE 80 END AS DOUBLE) AS brightness FROM events)"
)


def _step_sql(at: str, start: float, full: float, side: int) -> str:
    t = f"greatest(0.0, least(1.0, ({side} * {at} - ({start})) / {full - start}))"
    return f"({t} * {t} * (3 - 2 * {t}))"


def _curve_sql(at: str) -> str:
    """The tone curve over stops, written out slider by slider."""
    shifted = (
        f"({at} + greatest(-1.0, least(1.0, shadows / 100)) * 2.2 * {_step_sql(at, -1.5, 4.5, -1)} + greatest(0.0, shadows / 100 - 1) * 3.0 * {_step_sql(at, -0.5, 2.5, -1)} + least(0.0, shadows / 100 + 1) * 3.0 * {_step_sql(at, -1.5, 3.0, -1)} "
        f"+ highlights / 100 * 2.2 * {_step_sql(at, -1.5, 4.5, 1)} + greatest(0.0, blacks / 100) * 1.5 * {_step_sql(at, 2.5, 6.0, -1)} + greatest(0.0, whites / 100) * 1.3 * {_step_sql(at, 2.0, 5.0, 1)} + least(0.0, whites / 100) * 1.6 * {_step_sql(at, 2.75, 6.0, 1)})"
    )
    return f"{shifted} * (1 + CASE WHEN contrast > 0 THEN 1.2 ELSE 0.85 END * contrast / 100)"


_BELL = "v + 0.5 * brightness / 100 * exp(-pow(greatest(v, log2(1e-6 / 0.18)), 2) / (2 * 2.2 * 2.2))"
_KEYS = "highlights, shadows, whites, blacks, contrast, brightness"


@query(
    f"WITH p AS (SELECT *, log2(y / 0.18) AS l FROM {_TONED}), g0 AS (SELECT *, -20 + step * 30.0 / 4095 AS l FROM (SELECT DISTINCT {_KEYS} FROM p WHERE greatest(abs(highlights), abs(shadows), abs(whites), abs(blacks)) > 100), (SELECT range AS step FROM range(4096))), "
    f"g1 AS (SELECT *, {_curve_sql('l')} AS v FROM g0), g2 AS (SELECT {_KEYS}, step, greatest({_BELL}, log2(1e-9 / 0.18)) AS v FROM g1), g3 AS (SELECT *, max(v) OVER w AS low, v < lag(v) OVER w AS back FROM g2 WINDOW w AS (PARTITION BY {_KEYS} ORDER BY step)), "
    f"g4 AS (SELECT *, coalesce(lead(low) OVER (PARTITION BY {_KEYS} ORDER BY step), low) AS high, bool_or(back) OVER (PARTITION BY {_KEYS}) AS turns FROM g3), q AS (SELECT *, (l + 20) / (30.0 / 4095) AS place, {_curve_sql('l')} AS v FROM p), r AS (SELECT * EXCLUDE (v), {_BELL} AS v FROM q) "
    f"SELECT r.id, turns IS NOT NULL AS guarded, round(pow(2.0, coalesce(low + (high - low) * (place - step), r.v) - l), 5) AS ratio FROM r LEFT JOIN (SELECT * FROM g4 WHERE turns) g ON {' AND '.join(f'g.{k} = r.{k}' for k in _KEYS.split(', '))} AND g.step = floor(place)"
)
def pixel_tone_guarded(spark, sf_dir):
    part = lambda c: f"cast({c} as double)"
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id as id", "cast(event_id % 997 + 1 as double) / 500 as y", f"{part('(user_id % 7 - 3) * 50')} as highlights", f"{part('(user_id % 5 - 2) * 75')} as shadows", f"{part('(user_id % 3 - 1) * 150')} as whites",
        f"{part('case when user_id % 4 = 0 then 150 else 0 end')} as blacks", f"{part('(user_id % 3 - 1) * 60')} as contrast", f"{part('case when user_id % 2 = 0 then -120 else 80 end')} as brightness",
    )
    turning = pixels.tone_guards(rows).select(*pixels.TONE_SLIDERS).distinct().withColumn("guarded", F.lit(True))
    out = pixels.tone_ratio(rows).join(turning, list(pixels.TONE_SLIDERS), "left")
    return out.select("id", F.coalesce("guarded", F.lit(False)).alias("guarded"), F.round("ratio", 5).alias("ratio"))


_HUE = "(CASE WHEN hi = lo THEN 0 WHEN hi = r THEN ((g - b) / (hi - lo) + CASE WHEN g < b THEN 6 ELSE 0 END) * 60 WHEN hi = g THEN ((b - r) / (hi - lo) + 2) * 60 ELSE ((r - g) / (hi - lo) + 4) * 60 END)"


def _near_sql(centre: int) -> str:
    d = f"least(abs(h - {centre}), 360 - abs(h - {centre}))"
    return f"CASE WHEN {d} < 90 THEN 0.5 + 0.5 * cos({d} * pi() / 90) ELSE 0 END"


@query(
    f"WITH x AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM {_RGB}), y AS (SELECT *, {_HUE} AS h, least(1.0, (hi - lo) * 1.4) AS w FROM x), z AS (SELECT *, (1 - 0.32 * 0.7 * pow(w, 1.5)) * (1 - 0.35 * 0.9 * w * ({_near_sql(250)})) AS f FROM y) "
    "SELECT id, round(least(1.0, r * f), 6) AS r, round(least(1.0, g * f), 6) AS g, round(least(1.0, b * f), 6) AS b FROM z"
)
def pixel_chrome(spark, sf_dir):
    x = pixels.chrome(F.col("r"), F.col("g"), F.col("b"), F.lit(70.0), F.lit(90.0))
    return _rgb(spark, sf_dir).select("id", x.alias("x")).select("id", *[F.round(f"x.{c}", 6).alias(c) for c in "rgb"])


def _channel_sql(n: int) -> str:
    k = f"(({n} + h2 / 30) - 12 * floor(({n} + h2 / 30) / 12))"
    return f"greatest(0.0, least(1.0, l - (1 - abs(2 * l - 1)) * s2 / 2 * greatest(-1.0, least({k} - 3, 9 - {k}, 1.0))))"


@query(
    f"WITH x AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM {_RGB}), y AS (SELECT *, {_HUE} AS h, (hi + lo) / 2 AS l, CASE WHEN hi = lo THEN 0 ELSE (hi - lo) / (1 - abs(hi + lo - 1)) END AS s FROM x), "
    f"z AS (SELECT id, l, (h + ({_near_sql(0)}) * 12 - ({_near_sql(120)}) * 18) - 360 * floor((h + ({_near_sql(0)}) * 12 - ({_near_sql(120)}) * 18) / 360) AS h2, greatest(0.0, least(1.0, s * (1 + ({_near_sql(240)}) * 0.4))) AS s2, greatest(0.0, least(1.0, 1 - 2 * l)) * 0.03 AS t FROM y) "
    f"SELECT id, round(greatest(0.0, least(1.0, {_channel_sql(0)} + t)), 9) AS r, round(greatest(0.0, least(1.0, {_channel_sql(8)} - t)), 9) AS g, round(greatest(0.0, least(1.0, {_channel_sql(4)} + t)), 9) AS b FROM z"
)
def pixel_calibrated(spark, sf_dir):
    out = pixels.calibrated(_rgb(spark, sf_dir), {"red_hue": 40, "green_hue": -60, "blue_saturation": 80, "shadows_tint": 50})
    return out.select("id", *[F.round(c, 9).alias(c) for c in "rgb"])


# ---- lists ------------------------------------------------------------------


def _placed(df, *columns: str):
    """A short ordered list with places, in the order in which it comes."""
    rows = df.withColumn("seq", F.monotonically_increasing_id()).agg(F.sort_array(F.collect_list(F.struct("seq", *columns))).alias("rows"))
    return rows.select(F.posexplode("rows").alias("pos", "x")).select(*[f"x.{c}" for c in columns], F.col("pos").cast("long").alias("place"))


@query("SELECT name, row_number() OVER (ORDER BY name) - 1 AS place FROM v_word")
def tag_list(spark, sf_dir):
    return _placed(collections.tag_list(views.tag_words(spark, sf_dir)), "name")


@query("SELECT label AS cluster, row_number() OVER (ORDER BY lower(CASE WHEN label % 3 <> 0 THEN 'G' || cast(label % 3 AS varchar) ELSE n END), lower(n)) - 1 AS place FROM (SELECT DISTINCT label, CASE WHEN label % 2 = 0 THEN 'M' ELSE 'm' END || cast(label AS varchar) AS n FROM embeddings)")
def cluster_list(spark, sf_dir):
    label = F.col("label")
    name = F.concat(F.when(label % 2 == 0, "M").otherwise("m"), label.cast("string"))
    c = table(spark, sf_dir, "embeddings").select(label.alias("cluster"), name.alias("name"), F.when(label % 3 != 0, F.concat(F.lit("G"), (label % 3).cast("string"))).otherwise("").alias("group")).distinct()
    return _placed(collections.cluster_list(c), "cluster")


@query("SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey % 7 DESC, s_suppkey) - 1 AS place FROM supplier")
def album_list(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 7).alias("created_at"))
    return _placed(collections.album_list(a), "id")


# ---- imports and jobs -------------------------------------------------------


@query("SELECT id FROM (SELECT *, id % 3 AS session_id FROM v_staged) WHERE NOT processed AND session_id <> 1")
def unprocessed_files(spark, sf_dir):
    sessions = spark.createDataFrame([(0, "staging"), (1, "committed"), (2, "staging")], "session_id long, status string")
    return entity.unprocessed(views.staged(spark, sf_dir).withColumn("session_id", F.col("id") % 3), sessions).select("id")


@query("SELECT count(*) AS scanned, count(*) FILTER (WHERE id % 4 = 1) AS added, count(*) FILTER (WHERE id % 4 = 2) AS relocated FROM v_image")
def source_scanned(spark, sf_dir):
    # of four files one is known, one is new, one was known elsewhere and one is a copy of a managed row
    i = views.images(spark, sf_dir).select("id", F.col("id").cast("string").alias("path"), F.encode(F.concat(F.lit("b"), F.col("id").cast("string")), "UTF-8").alias("content"))
    sha = F.sha2("content", 256).alias("sha")
    known = i.where("id % 4 = 0").select("id", "path", sha).unionByName(i.where("id % 4 = 2").select("id", F.concat(F.lit("old/"), "path").alias("path"), sha))
    return entity.scan_status(catalog.scan_source(i.select("path", "content"), known, i.where("id % 4 = 3").select(sha)), i)


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def newest_requests(spark, sf_dir):
    return ingest.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id").select("user_id", "event_id")


@query("SELECT event_id FROM events, (SELECT max(ts) AS now FROM events) WHERE epoch(now) // 1 - epoch(ts) // 1 >= 24 * 3600 OR (event_id % 2 = 0 AND epoch(now) // 1 - epoch(ts) // 1 >= 15 * 60)")
def jobs_due(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    changed = F.when(F.col("event_id") % 2 == 0, F.col("ts")).otherwise(F.lit(now))
    return ingest.due(e.select("event_id", F.col("ts").alias("dirty_since"), changed.alias("last_change"), F.lit(now).alias("now"))).select("event_id")


@query("SELECT 'upload' AS what, id FROM v_image WHERE deleted_at IS NULL AND file_type <> 'raw' AND (remote_id IS NULL OR id % 2 = 0) UNION ALL SELECT 'remove', id FROM v_image WHERE deleted_at IS NOT NULL AND remote_id IS NOT NULL AND id % 2 = 1")
def remote_reconciled(spark, sf_dir):
    i = views.images(spark, sf_dir)
    todo = ingest.reconcile(i, i.where("remote_id is not null and id % 2 = 1").select("remote_id"))
    return todo["upload"].select(F.lit("upload").alias("what"), "id").unionByName(todo["remove"].select(F.lit("remove").alias("what"), "id"))


# ---- names, exports, changes ------------------------------------------------


@query("SELECT pos, id, CASE WHEN n = 0 THEN original_filename ELSE regexp_replace(original_filename, '\\.[^.]*$', '') || '_' || cast(n AS varchar) || regexp_extract(original_filename, '(\\.[^.]*)$', 1) END AS archive_name FROM (SELECT pos, id, original_filename, row_number() OVER (PARTITION BY original_filename ORDER BY pos) - 1 AS n FROM (SELECT unnest([5005, 5, 10005, 8, 3]) AS want, unnest([0, 1, 2, 3, 4]) AS pos) JOIN v_image ON id = want)")
def export_names(spark, sf_dir):
    return catalog.export_names(views.images(spark, sf_dir), [5005, 5, 10005, 8, 3])


@query("SELECT DISTINCT unnest([id, coalesce(paired_image_id, id)]) AS id FROM v_image WHERE id IN (6, 13, 20, 30)")
def selection_with_partners(spark, sf_dir):
    return changes.with_partners(views.images(spark, sf_dir), [6, 13, 20, 30])


@query("SELECT p_partkey AS id, bit_count(xor(p_partkey * 7919, p_partkey * 104729)) AS bits FROM part")
def hash_distances(spark, sf_dir):
    k = F.col("p_partkey")
    text = lambda x: F.lpad(F.hex(x), 16, "0")
    return table(spark, sf_dir, "part").select(k.alias("id"), strings.hamming(text(k * 7919), text(k * 104729)).cast("int").alias("bits"))


@query("SELECT id, CASE WHEN source_root_id IS NULL THEN '/lib/' || file_path ELSE file_path END AS path FROM v_image")
def image_paths(spark, sf_dir):
    return views.images(spark, sf_dir).select("id", strings.image_path("/lib", F.col("source_root_id"), F.col("file_path")).alias("path"))


@query(f"SELECT n_nationkey AS id FROM nation ORDER BY {KM.format(lat1='10.0', lon1='20.0', lat2='(n_nationkey * 7 - 80)', lon2='(n_nationkey * 14 - 175)')}, n_name LIMIT 1")
def place_resolved(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    c = n.selectExpr("n_nationkey as id", "n_name as key", "cast(n_nationkey * 7 - 80 as double) as lat", "cast(n_nationkey * 14 - 175 as double) as lon")
    return geo.resolve_place(c, 10.0, 20.0).select("id")


def _norm_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


_CITY = "p_name || CASE WHEN p_partkey % 3 = 0 THEN ' ' || CAST(p_partkey % 9 AS {text}) ELSE '' END AS name, p_brand AS admin1, 'N' || CAST(p_partkey % 25 AS {text}) AS cc, CAST(p_partkey % 180 - 90 AS DOUBLE) AS lat, CAST(p_partkey * 7 % 360 - 180 AS DOUBLE) AS lon"
_ASKED = (
    "CASE c_custkey % 8 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN p_name || ', nation_' || CAST(c_custkey % 25 AS {text}) WHEN 3 THEN p_name || ' nation_' || CAST(c_custkey % 25 AS {text}) WHEN 4 THEN p_name || ', ' || p_brand "
    "WHEN 5 THEN upper(p_name) || ' n' || CAST(c_custkey % 25 AS {text}) WHEN 6 THEN 'exo ' || split_part(p_name, ' ', 2) || ', land ' || CAST(c_custkey % 25 AS {text}) ELSE p_name || ' nowhere ' || CAST(c_custkey % 25 AS {text}) END AS query"
)
_LANG = "CASE WHEN c_custkey % 3 > 0 THEN 'de-DE' END AS lang"
# exonyms stand for the small ones of each kind; countries have a general name and one in German


@query(
    f"WITH g AS (SELECT *, {_norm_sql('name')} AS key FROM (SELECT name, lat, lon, min(struct_pack(cc := cc, admin1 := admin1)) AS x FROM (SELECT {_CITY.format(text='VARCHAR')} FROM part) GROUP BY ALL)), a AS (SELECT DISTINCT query, lang, coalesce(split_part(lang, '-', 1), '') AS own FROM (SELECT {_ASKED.format(text='VARCHAR')}, {_LANG} FROM customer JOIN part ON p_partkey = c_custkey)), "
    "b AS (SELECT *, trim(split_part(lower(query), ',', 1)) AS name, nullif(trim(split_part(lower(query), ',', 2)), '') AS q FROM a), c AS (SELECT query, lang, own, 0 AS turn, name, q FROM b UNION ALL SELECT query, lang, own, t, array_to_string(w[1:len(w) - t], ' '), array_to_string(w[len(w) - t + 1:], ' ') FROM (SELECT *, string_split(name, ' ') AS w, unnest(generate_series(1, len(string_split(name, ' ')) - 1)) AS t FROM b WHERE q IS NULL)), "
    f"d AS (SELECT query, lang, own, turn, {_norm_sql('q')} AS wanted, {_norm_sql('name')} AS key, name FROM c), e AS (SELECT DISTINCT 'exo ' || split_part(p_name, ' ', 2) AS key, 'small ' || split_part(p_name, ' ', 2) AS known FROM part), u AS (SELECT * FROM d UNION SELECT * REPLACE ({_norm_sql("regexp_replace(name, '([aou])e', '\\1', 'g')")} AS key) FROM d WHERE own = 'de'), "
    "k AS (SELECT query, lang, own, turn, wanted, key FROM u UNION SELECT query, lang, own, turn, wanted, known FROM u JOIN e USING (key) WHERE own = 'de'), p AS (SELECT k.key, g.name, g.lat, g.lon, g.x FROM (SELECT DISTINCT key FROM k WHERE len(key) >= 4) k JOIN g ON starts_with(g.key, k.key || ' ') QUALIFY row_number() OVER (PARTITION BY k.key ORDER BY g.key, g.name, g.lat, g.lon) <= 20), "
    f"f AS (SELECT DISTINCT query, lang, turn, s.name, s.lat, s.lon FROM k JOIN (SELECT key, name, lat, lon, x FROM g UNION ALL FROM p) s USING (key) WHERE wanted IS NULL OR lower(s.x.cc) = wanted OR {_norm_sql('s.x.admin1')} = wanted OR wanted = 'nation ' || s.x.cc[2:] OR (own = 'de' AND wanted = 'land ' || s.x.cc[2:])) "
    "SELECT query, lang, count(*) AS cities, count(DISTINCT name) AS names, sum(lat * 1000 + lon) AS places FROM (SELECT *, min(turn) OVER (PARTITION BY query, lang) AS least FROM f) WHERE turn = least GROUP BY ALL"
)
def places_located(spark, sf_dir):
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    cities = part.selectExpr(*views._split(_CITY.format(text="STRING")))
    asked = table(spark, sf_dir, "customer").join(part, F.col("p_partkey") == F.col("c_custkey")).selectExpr(_ASKED.format(text="STRING"), _LANG)
    code = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    names = nation.select(F.col("n_name").alias("name"), F.lit(None).cast("string").alias("lang"), code.alias("cc"))
    names = names.unionByName(nation.select(F.concat(F.lit("Land "), F.col("n_nationkey").cast("string")).alias("name"), F.lit("de").alias("lang"), code.alias("cc")))
    kind = F.split("p_name", " ")[1]
    exonyms = part.select(F.concat(F.lit("Exo "), kind).alias("exonym"), F.concat(F.lit("small "), kind).alias("name")).distinct()
    found = places.located(asked, cities, names, exonyms)
    return found.groupBy("query", "lang").agg(F.count("*").alias("cities"), F.countDistinct("name").alias("names"), F.sum(F.col("lat") * 1000 + F.col("lon")).alias("places"))


_TYPED = "CASE id % 9 WHEN 0 THEN 'a/b' WHEN 1 THEN '  ' WHEN 2 THEN concat('DSCF', cast((id + 40) % 5000 AS {text})) WHEN 3 THEN concat(' same', cast(id % 50 AS {text}), '.JPG') ELSE concat('shot-', cast(id AS {text}), '.v2') END"
_EXT, _DIR = "regexp_extract(original_filename, '(\\.[^.]*)$', 1)", "regexp_extract(file_path, '^(.*/)?[^/]*$', 1)"


@query(
    f"WITH t AS (SELECT id, file_path, paired_image_id, {_EXT} AS ext, {_DIR} AS dir, trim({_TYPED.format(text='VARCHAR')}) AS typed, rating >= 4 AS asked FROM v_image), s AS (SELECT *, CASE WHEN lower(typed) LIKE '%' || ext THEN trim(left(typed, length(typed) - length(ext))) ELSE typed END AS stem FROM t WHERE asked), "
    "n AS (SELECT *, CASE WHEN stem <> '' AND NOT contains(stem, '/') THEN stem || ext END AS filename FROM s), p AS (SELECT *, dir || filename AS path FROM n), c AS (SELECT * FROM p WHERE path IS NULL OR path <> file_path), "
    "a AS (SELECT id, filename, path, CASE WHEN filename IS NULL THEN 'name' WHEN path IN (SELECT file_path FROM t) OR id <> min(id) OVER (PARTITION BY path) THEN 'taken' END AS error, true AS asked, stem, paired_image_id FROM c), "
    "f AS (SELECT t.id, x.stem || t.ext AS filename, t.dir || x.stem || t.ext AS path FROM (SELECT paired_image_id AS id, min(stem) AS stem FROM a WHERE error IS NULL AND paired_image_id IS NOT NULL GROUP BY 1) x JOIN t ON t.id = x.id WHERE NOT t.asked AND t.dir || x.stem || t.ext <> t.file_path) "
    "SELECT id, filename, path, error, asked FROM a UNION ALL SELECT id, filename, path, CASE WHEN path IN (SELECT file_path FROM t) OR id <> min(id) OVER (PARTITION BY path) OR path IN (SELECT path FROM a WHERE error IS NULL) THEN 'taken' END, false FROM f"
)
def renames_planned(spark, sf_dir):
    i = views.images(spark, sf_dir)
    return changes.rename_plan(i, i.where("rating >= 4").select("id", F.expr(_TYPED.format(text="STRING")).alias("name")))


@query("SELECT id FROM v_image WHERE id % 5 = 0")
def library_wiped(spark, sf_dir):
    i = views.images(spark, sf_dir).withColumn("owner_id", F.when(F.col("id") % 5 == 0, 2).otherwise(1))
    return changes.wipe(i, 1, "DELETE").select("id")


@query("SELECT event_id AS id, round(k / 50.0, 6) AS exposure, cast(round_even(k * 1.8, 0) AS int) AS hue, greatest(k - 50, 0) AS vibrance, least(k - 50, 0) AS saturation FROM (SELECT event_id, cast(json_extract_string(props, '$.k') AS int) AS k FROM events)")
def develop_from_legacy(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    x = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), develop.from_legacy(k, k, k - 50).alias("x"))
    return x.select("id", F.round("x.exposure", 6).alias("exposure"), "x.hue", "x.vibrance", "x.saturation")


@query("SELECT id, CASE WHEN id % 4 = 1 THEN CASE WHEN id % 2 = 1 THEN '7' END END AS contrast, CASE WHEN id % 4 = 1 THEN '3' END AS exposure FROM v_image")
def develop_merged(spark, sf_dir):
    i = views.images(spark, sf_dir)
    own = F.from_json(F.when(F.col("id") % 4 == 1, '{"exposure": 3, "contrast": 1}'), "map<string,string>")
    partial = develop.only_groups(F.lit('{"contrast": 7, "tint": 9}'), ["tone"])
    out = i.select("id", develop.merged(own, partial).alias("m"))
    return out.select("id", F.try_element_at("m", F.lit("contrast")).alias("contrast"), F.try_element_at("m", F.lit("exposure")).alias("exposure"))


@query("SELECT section, pos, r AS row FROM (SELECT user_id AS section, event_id AS pos, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS r FROM events)")
def justified_rows(spark, sf_dir):
    # four squares of 100 and their gaps fill 412 exactly
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("section"), F.col("event_id").alias("pos"), F.lit(1.0).alias("aspect"))
    return order.justified_rows(e, 412.0, 100.0).select("section", "pos", F.col("row").cast("long").alias("row"))


# ---- clusters, copies, albums -----------------------------------------------


@query("WITH m AS (SELECT label AS cluster, vec_id AS id, max(vec_id) OVER (PARTITION BY label) AS cover FROM embeddings), k AS (SELECT m.* FROM m JOIN v_live i ON i.id = m.id) SELECT cluster, count(*) AS n, min(id) AS first, CASE WHEN bool_or(id = cover) THEN max(cover) ELSE min(id) END AS cover FROM k GROUP BY 1 HAVING count(*) >= 5")
def clusters_repaired(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("id"))
    c = v.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("image_ids"), F.max("id").alias("cover")).select("cluster", F.col("cluster").cast("string").alias("name"), F.lit("").alias("group"), "image_ids", "cover")
    out = collections.repaired(c, views.live(spark, sf_dir))
    return out.select("cluster", F.size("image_ids").cast("long").alias("n"), F.col("image_ids")[0].alias("first"), "cover")


@query("SELECT id, taken_at, camera_model, lens_model, gps_lat, gps_country, file_type, original_filename, source_root_id FROM v_image UNION ALL SELECT -1, taken_at, camera_model, NULL, gps_lat, NULL, 'jpeg', 'copy_edit-1.jpg', NULL FROM v_image WHERE id = 22")
def copy_saved(spark, sf_dir):
    out = changes.save_copy(views.images(spark, sf_dir), 22, -1, {"original_filename": "copy_edit-1.jpg"}, '{"contrast": 3}')
    return out.select("id", "taken_at", "camera_model", "lens_model", "gps_lat", "gps_country", "file_type", "original_filename", "source_root_id")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey = 3 THEN 'Trips' ELSE s_name END AS name, CASE WHEN s_suppkey = 3 THEN '[\"a\",\"b\"]' WHEN s_suppkey <> 4 THEN '[\"x\"]' END AS tag_filter FROM supplier WHERE s_suppkey <> 5 UNION ALL SELECT -1, 'New', NULL")
def albums_changed(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit('["x"]').alias("tag_filter"))
    a = changes.update_album(changes.create_album(a, -1, "New", [" "]), 3, "Trips", ["a ", "b", "a"])
    return changes.delete_album(changes.update_album(a, 4, rule=[]), views.album_images(spark, sf_dir), 5)[0]
