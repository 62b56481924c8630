"""Catalog views over the driver's star-schema tables, in DataFrame form and as DuckDB SQL.

Every column is plain arithmetic on keys, so both engines compute the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters
from ..session import partitions, table

#: The colour labels of the catalog, in their order.
COLORS = ("none", "red", "orange", "yellow", "green", "blue", "magenta", "gray")
UNAVAILABLE = ("root-2",)

IMAGE_SELECT = """
  o_orderkey AS id, 1 AS owner_id,
  concat('DSCF', cast(o_orderkey % 5000 AS string), CASE WHEN o_orderkey % 3 = 0 THEN '.raf' WHEN o_orderkey % 10 = 1 THEN '.png' ELSE '.jpg' END) AS original_filename,
  CASE WHEN o_orderkey % 3 = 0 THEN 'raw' WHEN o_orderkey % 10 = 1 THEN 'png' ELSE 'jpeg' END AS file_type,
  cast(round(o_totalprice) AS bigint) AS file_size, o_orderdate AS taken_at,
  o_orderdate + make_interval_days AS imported_at,
  CASE WHEN o_orderkey % 17 = 0 THEN o_orderdate + INTERVAL 40 DAY END AS deleted_at,
  CASE WHEN o_orderkey % 11 = 0 THEN concat('root-', cast(o_orderkey % 3 AS string)) END AS source_root_id,
  c_mktsegment AS camera_model,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END AS lens_model,
  cast(cast(o_orderkey % 400 AS double) + cast(0.83 AS double) AS double) AS focal_length,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE n_name END AS gps_country,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE cast(o_custkey * 7919 % 16000 AS double) / cast(100 AS double) - cast(80 AS double) END AS gps_lat,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE cast(o_custkey * 104729 % 36000 AS double) / cast(100 AS double) - cast(180 AS double) END AS gps_lon,
  CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 6 - cast(substring(o_orderpriority, 1, 1) AS int) END AS rating,
  CASE o_custkey % 8 WHEN 0 THEN 'none' WHEN 1 THEN 'red' WHEN 2 THEN 'orange' WHEN 3 THEN 'yellow' WHEN 4 THEN 'green' WHEN 5 THEN 'blue' WHEN 6 THEN 'magenta' ELSE 'gray' END AS color_label,
  CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey + 1 WHEN o_orderkey % 6 = 1 AND o_orderkey > 1 THEN o_orderkey - 1 END AS paired_image_id,
  cast(o_orderkey % 4 AS int) AS edit_rev,
  CASE WHEN o_orderkey % 29 = 0 THEN 'a' || cast(o_orderkey AS string) END AS remote_id,
  o_orderkey % 7 = 0 AS remote_sync,
  concat('dir', cast(o_orderkey % 40 AS string), '/DSCF', cast(o_orderkey % 5000 AS string), CASE WHEN o_orderkey % 3 = 0 THEN '.raf' WHEN o_orderkey % 10 = 1 THEN '.png' ELSE '.jpg' END) AS file_path,
  concat('sum', cast(o_orderkey % 700 AS string)) AS sha1,
  cast(o_orderkey % 5 * 90 AS int) AS edit_rotation,
  CASE WHEN o_orderkey % 23 = 0 THEN cast(0.25 AS double) END AS edit_crop_x, CASE WHEN o_orderkey % 23 = 0 THEN cast(0.25 AS double) END AS edit_crop_y,
  CASE WHEN o_orderkey % 23 = 0 THEN cast(0.5 AS double) END AS edit_crop_width, CASE WHEN o_orderkey % 23 = 0 THEN cast(0.5 AS double) END AS edit_crop_height,
  o_orderkey % 19 = 0 AS edit_flip_h, o_orderkey % 37 = 0 AS edit_flip_v,
  CASE WHEN o_orderkey % 41 = 0 THEN cast(2.5 AS double) ELSE cast(0 AS double) END AS edit_straighten,
  cast(CASE WHEN o_orderkey % 43 = 0 THEN 10 ELSE 0 END AS int) AS edit_persp_h, cast(CASE WHEN o_orderkey % 47 = 0 THEN 10 ELSE 0 END AS int) AS edit_persp_v, cast(CASE WHEN o_orderkey % 53 = 0 THEN 10 ELSE 0 END AS int) AS edit_distortion,
  CASE o_orderkey % 4 WHEN 1 THEN concat('{"contrast": ', cast(o_orderkey % 150 AS string), '}') WHEN 2 THEN '{}' END AS edit_adjustments,
  CASE WHEN o_orderkey % 31 = 0 THEN '{"exposure": 1}' END AS applied_adjustments
"""
_FROM = " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def _sql(dialect: str) -> str:
    days = "INTERVAL 3 DAY"
    text = "SELECT " + IMAGE_SELECT.replace("make_interval_days", days)
    return text if dialect == "spark" else text.replace("AS string)", "AS varchar)")


#: DuckDB's form of the views.
IMAGE = _sql("duckdb") + _FROM
TAG = "SELECT p_type AS name, min(p_partkey) AS id FROM part GROUP BY p_type"
IMAGE_TAG = "SELECT DISTINCT l_orderkey AS image_id, p_type AS name FROM lineitem JOIN part ON l_partkey = p_partkey"
ALBUM = "SELECT s_suppkey AS id, s_name AS name, CASE s_suppkey % 6 WHEN 0 THEN NULL ELSE s_suppkey % 6 END AS rule FROM supplier"
WORD = "SELECT upper(split_part(p_name, ' ', 1)) AS name, min(p_partkey) AS id FROM part GROUP BY 1"
RULE = f"SELECT a.id AS album_id, a.name AS album, k.name, a.id % 3 = 0 AS album_sync FROM ({ALBUM}) a JOIN (SELECT name, row_number() OVER (ORDER BY name) AS r FROM ({TAG})) k ON k.r IN (a.rule, a.rule + 2)"
STAGED = """SELECT event_id AS id, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN event_id END AS duplicate_of_image_id, CASE WHEN event_id % 11 = 3 THEN event_id - 1 END AS duplicate_of_staged_file_id,
  CASE event_id % 3 WHEN 0 THEN 'raw' ELSE 'jpeg' END AS file_type, cast(event_id % 6 AS int) AS rating, CASE event_id % 4 WHEN 0 THEN 'red' ELSE 'none' END AS color_label, event_id % 2 = 0 AS selected, event_id % 5 <> 0 AS processed,
  CASE WHEN event_id % 4 <> 1 THEN ts END AS taken_at, CASE event_id % 6 WHEN 0 THEN event_id + 1 WHEN 1 THEN event_id - 1 END AS paired_with FROM events"""
ALBUM_IMAGE = "SELECT l_suppkey AS album_id, l_orderkey AS image_id, min(l_linenumber) AS position FROM lineitem GROUP BY l_suppkey, l_orderkey"
LIVE = "owner_id = 1 AND deleted_at IS NULL"


def with_views(select: str) -> str:
    """DuckDB SQL with the views that it names in front."""
    views = {"v_image": IMAGE, "v_live": f"SELECT * FROM v_image WHERE {LIVE}", "v_tag": TAG, "v_image_tag": IMAGE_TAG, "v_album": ALBUM, "v_album_image": ALBUM_IMAGE, "v_word": WORD, "v_rule": RULE, "v_staged": STAGED}
    need = [v for v in views if re.search(rf"\b{v}\b", select) or (v == "v_image" and "v_live" in select)]
    if not need:
        return select
    select = select.strip()
    own = select.removeprefix("WITH ").removeprefix("RECURSIVE ")
    return ("WITH RECURSIVE " if select.startswith("WITH RECURSIVE ") else "WITH ") + ", ".join(f"{v} AS ({views[v]})" for v in need) + (", " if own != select else " ") + own


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer.select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = _sql("spark").removeprefix("SELECT ")
    return joined.selectExpr(*_split(text))


def _split(text: str) -> list[str]:
    """The select list's items; commas inside brackets don't count."""
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible rows: of the owner and not deleted."""
    return images(spark, sf_dir).where(LIVE)


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("id"))


def tag_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags named by the first words of parts: few of them are in use."""
    return table(spark, sf_dir, "part").groupBy(F.upper(F.split("p_name", " ")[0]).alias("name")).agg(F.min("p_partkey").alias("id"))


def album_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(album_id, album, name, album_sync): an album's rule names the tag of its number and the one two places on."""
    numbered = tags(spark, sf_dir).agg(F.array_sort(F.collect_list("name")).alias("names")).select(F.posexplode("names").alias("at", "name"))  # tag names are few
    ruled = albums(spark, sf_dir).where("rule is not null").withColumn("at", F.explode(F.array(F.col("rule") - 1, F.col("rule") + 1)))
    return ruled.withColumnRenamed("name", "album").join(F.broadcast(numbered), "at").select(F.col("id").alias("album_id"), "album", "name", (F.col("id") % 3 == 0).alias("album_sync"))


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an import, some of them copies of others or of library rows."""
    select = STAGED.removeprefix("SELECT ").rsplit(" FROM ", 1)[0]
    return table(spark, sf_dir, "events").selectExpr(*_split(select))


def image_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tags of images, dealt by image before they are made distinct: few repeat, and joins by image go on with them."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    named = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("image_id"), F.col("p_type").alias("name"))
    return named.repartition(4 * partitions(spark), "image_id").distinct()


def albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 6 != 0, F.col("s_suppkey") % 6).alias("rule"))


def album_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of albums at their first position, dealt by image and sorted: hardly any pair repeats, so tables of them would only fill memory."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("album_id"), F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("position"))
    return filters.first_places(lines.repartition(4 * partitions(spark), "image_id"))
