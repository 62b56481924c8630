"""Places: distances, range joins with cells, nearest cities, grids and names."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.195


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the square root is held at 1 against rounding."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def near_point(points: DataFrame, lat: float, lon: float, radius_km: float) -> DataFrame:
    """Points within the radius with ``km``; the latitude bound reaches the scan."""
    band = radius_km / KM_PER_DEGREE + 0.01
    out = points.where(F.col("gps_lat").between(lat - band, lat + band))
    return out.withColumn("km", haversine_km(F.lit(lat), F.lit(lon), F.col("gps_lat"), F.col("gps_lon"))).where(F.col("km") <= radius_km)


def _cells(lat: Column, lon: Column, height: float) -> tuple[Column, Column, Column]:
    """Latitude band, longitude cell and number of cells of the band, in bands of ``height`` degrees.

    A band's cells are so wide that a circle of that radius, centred in the band
    or the next one, reaches no farther than into a neighbouring cell.
    """
    band = F.floor(lat / height).cast("int")
    return band, *_ring(band, lon, height)


def _ring(band: Column, lon: Column, height: float) -> tuple[Column, Column]:
    edge = F.radians(F.greatest(F.abs(band * height), F.abs((band + 1) * height)) + height)
    reach = math.sin(math.radians(height)) / F.cos(edge)
    around = (edge >= math.pi / 2) | (reach >= 1)
    count = F.when(around, 1).otherwise(F.greatest(F.lit(1), F.floor(F.lit(2 * math.pi) / F.asin(F.least(reach, F.lit(1.0)))).cast("int")))
    return F.pmod(F.floor((lon + 180.0) / 360.0 * count).cast("int"), count), count


def within(points: DataFrame, centres: DataFrame, radius_km: float) -> DataFrame:
    """``points(id, gps_lat, gps_lon)`` x ``centres(centre, lat, lon)`` no farther apart than the radius.

    An equi-join on cells of the radius' size, each centre standing in its own
    cell and those around it, across the date line too, then the exact distance.
    Towards the poles cells widen to the whole circle of latitude.
    """
    height = radius_km / KM_PER_DEGREE + 0.01
    band, cell, _ = _cells(F.col("gps_lat"), F.col("gps_lon"), height)
    p = points.where("gps_lat is not null and gps_lon is not null").withColumn("__band", band).withColumn("__cell", cell)
    c = centres.withColumn("__band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("lat") / height).cast("int") + d)))
    own, count = _ring(F.col("__band"), F.col("lon"), height)
    c = c.withColumn("__cell", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(own + d, count)))))
    near = p.join(c, ["__band", "__cell"]).withColumn("km", haversine_km(F.col("gps_lat"), F.col("gps_lon"), F.col("lat"), F.col("lon")))
    return near.where(F.col("km") <= radius_km).drop("__band", "__cell")


#: Degrees of the cells in which a nearest city is looked for, one size after another.
NEAR_DEGREES = (1.0, 8.0)
#: Cities at most that positions are compared with one by one: all positions, or the few that are far from everything.
FEW_CITIES, CITIES = 256, 500_000


def nearest(points: DataFrame, cities: DataFrame) -> DataFrame:
    """Each point with its nearest city: (id, city, km), ties by city. ``cities(city, lat, lon)``.

    Distinct positions meet the cities of the cells around them. A city found
    nearer than a cell's height is the nearest there is; positions without one go
    on to larger cells, and the few that are far from everything to the whole
    list, whose size is checked. A short list is compared as a whole at once.
    """
    few = cities.limit(CITIES + 1)
    count = few.count()
    if count > CITIES:
        raise ValueError(f"more than {CITIES} cities")
    best = F.min(F.struct("km", "city")).alias("best")
    left = points.where("gps_lat is not null and gps_lon is not null").select("gps_lat", "gps_lon").distinct().withColumn("id", F.xxhash64("gps_lat", "gps_lon"))
    found = None
    for degrees in NEAR_DEGREES if count > FEW_CITIES else ():
        radius = (degrees - 0.01) * KM_PER_DEGREE
        hits = within(left, cities.withColumnRenamed("city", "centre"), radius).withColumnRenamed("centre", "city").groupBy("gps_lat", "gps_lon").agg(best)
        found = hits if found is None else found.unionByName(hits)
        left = left.join(hits, ["gps_lat", "gps_lon"], "left_anti")
    km = haversine_km(F.col("gps_lat"), F.col("gps_lon"), F.col("lat"), F.col("lon"))
    far = left.crossJoin(F.broadcast(few)).select("gps_lat", "gps_lon", km.alias("km"), "city").groupBy("gps_lat", "gps_lon").agg(best)
    return points.join(far if found is None else found.unionByName(far), ["gps_lat", "gps_lon"]).select("id", "best.city", "best.km")


def _around(rows: DataFrame, height: float, band: str, cell: str) -> DataFrame:
    """A copy of each row for its own cell and each of those that a circle of ``height`` degrees around it can reach."""
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    out = rows.withColumn(band, F.explode(F.transform(near, lambda d: F.floor(F.col("lat") / height).cast("int") + d)))
    own, count = _ring(F.col(band), F.col("lon"), height)
    return out.withColumn(cell, F.explode(F.array_distinct(F.transform(near, lambda d: F.pmod(own + d, count)))))


def _km9(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.round(haversine_km(lat1, lon1, lat2, lon2), 9)


def _last_founders(spots: pd.DataFrame, radius_km: float) -> list[int]:
    """The places in ``spots`` of its founders, in one pass in order; leaders are looked up by cells of the radius' height."""
    height = radius_km / KM_PER_DEGREE + 0.01
    bands: dict[tuple, list[tuple[float, float]]] = {}
    out = []
    for k, (group, lat, lon) in enumerate(zip(spots["group"], spots["lat"], spots["lon"], strict=True)):
        band = math.floor(lat / height)
        have = [x for d in (-1, 0, 1) for x in bands.get((group, band + d), ())]
        if have:
            near = np.array(have)
            if (np.round(distance_km(near[:, 0], near[:, 1], lat, lon), 9) <= radius_km).any():
                continue
        bands.setdefault((group, band), []).append((lat, lon))
        out.append(k)
    return out


#: Spots not yet settled at most that are settled in one task; it changes how they are settled, not what comes out.
FEW_SPOTS = 100_000


def founders(spots: DataFrame, radius_km: float, few: int | None = None) -> DataFrame:
    """(group, lat, lon, seq) of the spots that have no earlier founder of their group within the radius; earlier by seq, lat, lon.

    In each round a cell's spots wait for the first unsettled one among all that
    can be within reach of the cell; where that one lies in the cell itself, no
    earlier spot is left that could take it, so it is a founder, and what is
    within its radius is settled too. Counts by cell are grouped minima, so no
    task holds a group or a crowded cell. When few spots are left, one task
    looks through them in order, which gives the same.
    """
    height, few = radius_km / KM_PER_DEGREE + 0.01, FEW_SPOTS if few is None else few
    band, cell, _ = _cells(F.col("lat"), F.col("lon"), height)
    order = F.struct(F.col("seq").isNull().alias("late"), "seq", "lat", "lon", F.col("own_band").alias("b"), F.col("own_cell").alias("c"))
    rest, found = materialise(spots.select("group", "lat", "lon", "seq").withColumn("own_band", band).withColumn("own_cell", cell)), []
    while (left := rest.limit(few + 1).count()) > few:
        first = _around(rest, height, "band", "cell").groupBy("group", "band", "cell").agg(F.min(order).alias("first"))
        chosen = materialise(first.where((F.col("first.b") == F.col("band")) & (F.col("first.c") == F.col("cell"))).select("group", "first.lat", "first.lon", "first.seq"))
        found.append(chosen)
        near = _around(chosen, height, "own_band", "own_cell").groupBy("group", "own_band", "own_cell").agg(F.collect_list(F.struct("lat", "lon")).alias("near"))  # a few of each cell
        taken = F.exists("near", lambda x: _km9(x["lat"], x["lon"], F.col("lat"), F.col("lon")) <= radius_km)
        rest = materialise(rest.join(near, ["group", "own_band", "own_cell"], "left").where(~F.coalesce(taken, F.lit(False))).select("group", "lat", "lon", "seq", "own_band", "own_cell"))
    if left:

        def settle(batches):
            own = [b.to_pandas() for b in batches]
            if own:
                spots = pd.concat(own).sort_values(["group", "seq", "lat", "lon"], ignore_index=True, na_position="last")
                yield pa.RecordBatch.from_pandas(spots.iloc[_last_founders(spots, radius_km)], preserve_index=False)

        found.append(rest.select("group", "lat", "lon", "seq").repartition(1).mapInArrow(settle, "group string, lat double, lon double, seq double"))
    return reduce(DataFrame.unionByName, found) if found else rest.select("group", "lat", "lon", "seq")


def leader_places(points: DataFrame, radius_km: float, group: str | None = None) -> DataFrame:
    """(group, place, lat, lon, members): places in order of the number ``seq``.

    A spot is a position of any number of points, at the seq of its first. A
    spot with no earlier founder of its group within the radius founds a place;
    each spot joins the nearest founder, of equal ones the earliest; a place's
    centre is the mean of its points; members are all points of the group
    within the radius of the centre, so a point may count at several places or
    at none. Places are numbered by members, largest first, equal ones by their
    founders. Kilometres count to nine decimals. Points without a position are
    left out; a null seq comes last, and a null group is one.

    Founders stay where they are until all are known, so the result is the same
    for any partitioning and order of rows.
    """
    height = radius_km / KM_PER_DEGREE + 0.01
    band, cell, _ = _cells(F.col("lat"), F.col("lon"), height)
    name = F.col(group).cast("string") if group else F.lit("")
    keyed = points.where("gps_lat is not null and gps_lon is not null").select(F.coalesce(F.concat(F.lit("="), name), F.lit("-")).alias("group"), F.col("gps_lat").cast("double").alias("lat"), F.col("gps_lon").cast("double").alias("lon"), F.col("seq").cast("double").alias("seq"))
    spots = materialise(keyed.groupBy("group", "lat", "lon").agg(F.min("seq").alias("seq"), F.count("*").alias("n")).withColumn("band", band).withColumn("cell", cell))
    heads = materialise(founders(spots, radius_km))
    far = _around(heads, height, "band", "cell").select("group", "band", "cell", F.col("lat").alias("at"), F.col("lon").alias("along"), F.col("seq").alias("since"))
    nearness = F.struct(_km9(F.col("lat"), F.col("lon"), F.col("at"), F.col("along")).alias("km"), F.col("since").isNull().alias("late"), "since", "at", "along")
    joined = spots.join(far, ["group", "band", "cell"]).groupBy("group", "lat", "lon").agg(F.first("n").alias("n"), F.min(nearness).alias("best"))
    centres = joined.groupBy("group", "best.late", "best.since", "best.at", "best.along").agg((F.sum(F.col("lat") * F.col("n")) / F.sum("n")).alias("lat"), (F.sum(F.col("lon") * F.col("n")) / F.sum("n")).alias("lon"))
    centres = materialise(centres)
    around = _around(centres, height, "band", "cell").select("group", "band", "cell", "late", "since", "at", "along", F.col("lat").alias("mid"), F.col("lon").alias("mean"))
    inside = spots.join(around, ["group", "band", "cell"]).where(_km9(F.col("lat"), F.col("lon"), F.col("mid"), F.col("mean")) <= radius_km)
    keys = ["group", "late", "since", "at", "along"]
    counted = inside.groupBy(*keys).agg(F.sum("n").alias("members"))
    known = centres.withColumns({f"__{c}": F.col(c) for c in keys}).drop(*keys)
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys])
    places = known.join(counted, same, "left").select(F.col("__group").alias("group"), "lat", "lon", F.coalesce("members", F.lit(0)).alias("members"), *[F.col(f"__{c}").alias(c) for c in keys[1:]])
    numbers = Window.partitionBy("group").orderBy(F.desc("members"), "late", "since", "at", "along")  # a group's places, bounded by the earth over the radius squared
    back = F.when(F.col("group") != "-", F.substring("group", 2, 1 << 30))
    return places.withColumn("place", (F.row_number().over(numbers) - 1).cast("int")).select(back.alias("group"), "place", "lat", "lon", "members")


def place_albums(points: DataFrame, centres: DataFrame, radius_km: float, least: int = 5, limit: int = 30) -> DataFrame:
    """(place, lat, lon, n, name, smart_id): the biggest centres by the points within the radius, named by ``label``.

    ``centres(place, lat, lon, label)``. A point may count at several centres. A
    label's second use gets a roman numeral, and so on; without one the position is the name.
    """
    counted = within(points, centres.withColumnRenamed("place", "centre"), radius_km).groupBy(F.col("centre").alias("place"), "lat", "lon", "label").agg(F.count("*").alias("n"))
    top = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "place").limit(limit)
    name = F.coalesce("label", F.format_string("%.3f, %.3f", "lat", "lon"))
    use = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "place"))
    named = top.withColumn("name", name).withColumn("__use", use)
    shown = F.when(F.col("__use") == 1, F.col("name")).otherwise(F.concat("name", F.lit(" "), roman(F.col("__use"))))
    return named.select("place", "lat", "lon", "n", shown.alias("name"), F.format_string("place:%.4f,%.4f", "lat", "lon").alias("smart_id"))


#: Fixed values.
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")


def roman(n: Column) -> Column:
    """A small number in roman numerals, a larger one in digits."""
    return F.coalesce(F.get(F.array(*map(F.lit, ROMAN)), n - 1), n.cast("string"))


def distance_km(lat1, lon1, lat2, lon2):
    """:func:`haversine_km` of numbers or arrays."""
    p, q = np.radians(lat1), np.radians(lat2)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2 * RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def grid_cells(points: DataFrame, zoom: int, cell: int = 58) -> DataFrame:
    """(cell_x, cell_y, n, front): points by Web-Mercator pixel cell, the newest in front."""
    size = float(256 << zoom)
    x = (F.col("gps_lon") + 180.0) / 360.0 * size
    y = (F.lit(1.0) - F.log(F.tan(F.radians("gps_lat")) + F.lit(1.0) / F.cos(F.radians("gps_lat"))) / math.pi) / 2.0 * size
    placed = points.where("gps_lat is not null and gps_lon is not null").withColumn("cell_x", F.floor(x / cell)).withColumn("cell_y", F.floor(y / cell))
    return placed.groupBy("cell_x", "cell_y").agg(F.count("*").alias("n"), F.max(F.struct("taken_at", (-F.col("id")).alias("o"), "id"))["id"].alias("front"))


def splittable(points: DataFrame, by: list[str], cell: int = 58, zoom: int = 18) -> DataFrame:
    """(by, splittable): whether a group's points are a cell apart at the largest zoom, so that zooming in parts them."""
    size = float(256 << zoom)
    x = (F.col("gps_lon") + 180.0) / 360.0 * size
    y = (F.lit(1.0) - F.log(F.tan(F.radians("gps_lat")) + F.lit(1.0) / F.cos(F.radians("gps_lat"))) / math.pi) / 2.0 * size
    spread = lambda c: F.max(c) - F.min(c)
    return points.where("gps_lat is not null and gps_lon is not null").groupBy(*by).agg((F.greatest(spread(x), spread(y)) >= cell).alias("splittable"))


def place_rows(gazetteer: DataFrame, key: Column, prefixes: int = 20) -> DataFrame:
    """Gazetteer rows whose ``key`` is the name, or begins with it as a whole word if it has four letters or more."""
    exact = gazetteer.where(F.col("key") == key)
    longer = gazetteer.where((F.length(key) >= 4) & F.col("key").startswith(F.concat(key, F.lit(" "))))
    longer = longer.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy("lat", "lon"))).where(F.col("__n") <= prefixes).drop("__n")
    return exact.unionByName(longer).distinct()


def resolve_place(candidates: DataFrame, lat: float, lon: float) -> DataFrame:
    """The candidate nearest to a point, the library's centroid as a rule."""
    return candidates.withColumn("km", haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).orderBy("km", "key").limit(1)


def centroid(points: DataFrame) -> DataFrame:
    """Plain means of the located rows."""
    return points.where("gps_lat is not null").agg(F.avg("gps_lat").alias("lat"), F.avg("gps_lon").alias("lon"))
