"""Promises of the catalog's rules that the registered queries don't show: errors, modes, odd input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratalens.functions import strings
from stratalens.operators import aggregates, changes, collections, entity, filters, mirror, order, places, vectors
from stratalens.sources import catalog

T0 = dt.datetime(2026, 7, 1, 12)
IMAGE = (
    "id long, owner_id int, original_filename string, file_path string, file_type string, taken_at timestamp_ntz, deleted_at timestamp_ntz, source_root_id string, paired_image_id long, rating int, color_label string, remote_id string, remote_sync boolean, sha1 string, "
    "file_size long, file_hash string, gps_lat double, gps_lon double, gps_country string, edit_rotation int, edit_crop_x double, edit_crop_y double, edit_crop_width double, edit_crop_height double, edit_flip_h boolean, edit_flip_v boolean, edit_straighten double, edit_persp_h int, "
    "edit_persp_v int, edit_distortion int, edit_adjustments string, edit_rev int, applied_adjustments string"
)


def images(spark, rows):
    base = {c: None for c in (x.split()[0] for x in IMAGE.split(", "))} | dict(owner_id=1, file_type="jpeg", taken_at=T0, rating=0, color_label="none", remote_sync=False, edit_rev=0, edit_rotation=0)
    full = [base | {"original_filename": f"{r['id']}.jpg", "file_path": f"{r['id']}.jpg"} | r for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in base) for r in full], IMAGE)


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_edits_are_checked(spark):
    rows = images(spark, [dict(id=1, edit_rotation=360), dict(id=2, edit_flip_h=True), dict(id=3, edit_adjustments="{}"), dict(id=4)])
    assert ids(rows.where(filters.has_edit())) == [2, 3] and ids(rows.where(filters.untouched())) == [3, 4]
    with pytest.raises(ValueError):
        changes.rotate(rows, rows.select("id"), 45)
    turned = changes.rotate(rows, rows.where("id = 4").select("id"), -90).where("id = 4").first()
    assert (turned.edit_rotation, turned.edit_rev) == (270, 1)
    schema = "id long, rotation int, crop_x double, crop_y double, crop_width double, crop_height double, flip_h boolean, flip_v boolean, straighten double, persp_h int, persp_v int, distortion int, adjustments string"
    edit = lambda *r: spark.createDataFrame([r], schema)
    for bad in ((4, 45, None, None, None, None, False, False, 0.0, 0, 0, 0, None), (4, 0, 0.5, 0.5, 0.6, 0.5, False, False, 0.0, 0, 0, 0, None), (4, 0, 0.5, None, 0.1, 0.5, False, False, 0.0, 0, 0, 0, None)):
        with pytest.raises(ValueError):
            changes.save_edits(rows, edit(*bad))
    saved = changes.save_edits(rows, edit(4, 450, 0.1, 0.2, 0.5, 0.5, None, True, -80.0, 300, None, 0, '{"contrast": 500}')).where("id = 4").first()
    assert (saved.edit_rotation, saved.edit_crop_width, saved.edit_flip_h, saved.edit_flip_v, saved.edit_straighten, saved.edit_persp_h, saved.edit_persp_v, saved.edit_rev) == (90, 0.5, False, True, -45.0, 100, 0, 1)
    assert '"contrast":100' in saved.edit_adjustments
    clean = changes.save_edits(rows, edit(2, 0, None, None, None, None, False, False, 0.0, 0, 0, 0, '{"contrast": 0}')).where("id = 2").first()
    assert (clean.edit_rev, clean.edit_adjustments, clean.edit_flip_h) == (0, None, False)
    developed = changes.apply_develop(rows, spark.createDataFrame([(1, '{"hue": 500}'), (3, "nonsense")], "id long, adjustments string"))
    got = {r.id: (r.edit_rev, r.edit_adjustments) for r in developed.collect()}
    assert got[1][0] == 1 and '"hue":180' in got[1][1] and got[3] == (0, None) and got[4] == (0, None)
    suggested = changes.merge_suggestions(rows, spark.createDataFrame([(1, '{"contrast": 9, "tint": 7, "film_sim": "astia"}')], "id long, doc string").select("id", changes.develop.normalised(F.col("doc")).alias("adj")), ["tone", "color"])
    merged = changes.apply_develop(rows, suggested).where("id = 1").first().edit_adjustments
    assert '"contrast":9' in merged and '"tint":0' in merged and '"film_sim":"astia"' in merged
    with pytest.raises(ValueError):
        changes.merge_suggestions(rows, suggested, [])
    links = spark.createDataFrame([(4, "edit"), (2, "sky")], "image_id long, name string")
    assert sorted(map(tuple, changes.sync_edit_tag(links, rows, rows.select("id")).collect())) == [(2, "edit"), (2, "sky"), (3, "edit")]


def test_trash_and_sources(spark):
    rows = images(spark, [dict(id=1, deleted_at=T0), dict(id=2, paired_image_id=1), dict(id=3, deleted_at=T0, source_root_id="r"), dict(id=4, source_root_id="r", paired_image_id=2)])
    with pytest.raises(ValueError):
        changes.delete_from_trash(rows, {}, rows.where("id = 2").select("id"))
    with pytest.raises(ValueError):
        changes.delete_from_trash(rows, {}, mounted=False)
    with pytest.raises(ValueError):
        changes.sync_with_library(rows, {}, None, None, "/lib", mounted=False)
    left, children, _ = changes.delete_from_trash(rows, {"tags": spark.createDataFrame([(1, "a"), (2, "a")], "image_id long, name string")}, rows.where("id in (1, 3)").select("id"))
    assert ids(left) == [2, 3, 4] and {r.id: r.paired_image_id for r in left.collect()}[2] is None and children["tags"].count() == 1
    roots = spark.createDataFrame([("r", 1, "one", "/mnt/one")], "id string, owner_id int, name string, path string")
    for path in (" ", "/mnt/one "):
        with pytest.raises(ValueError):
            changes.add_source(roots, "s", 1, path)
    assert {r.name for r in changes.add_source(roots, "s", 1, "/mnt/two").collect()} == {"one", "/mnt/two"}
    staged = spark.createDataFrame([(1, 4), (2, 2)], "id long, duplicate_of_image_id long")
    kept, left, cleared, _ = changes.remove_source(roots, rows, staged, {}, "r")
    assert kept.count() == 0 and ids(left) == [1, 2] and {r.id: r.duplicate_of_image_id for r in cleared.collect()} == {1: None, 2: 2}
    with pytest.raises(LookupError):
        filters.owned(rows, 1, 2)
    assert filters.owned(rows, 1, 1).count() == 1


def test_imports(spark):
    schema = "id long, seq long, duplicate_of_image_id long, duplicate_of_staged_file_id long, selected boolean, processed boolean, file_type string, rating int, color_label string"
    rows = images(spark, [dict(id=1, deleted_at=T0), dict(id=2, source_root_id="r"), dict(id=3)])
    staged = spark.createDataFrame([(10, 1, None, None, True, True, "jpeg", 0, "none"), (11, 2, 1, None, True, True, "jpeg", 0, "none"), (12, 3, 1, None, True, True, "raw", 0, "none"), (13, 4, 2, None, True, True, "raw", 0, "none"), (14, 5, 3, None, True, True, "jpeg", 0, "none"), (15, 6, None, 10, True, True, "jpeg", 0, "none"), (16, 7, None, None, True, False, "jpeg", 0, "none")], schema)
    assert sorted(map(tuple, entity.commit_plan(staged, rows).collect()), key=str) == [(10, "insert", None), (11, "restore", 1), (13, "promote", 2)]
    off = staged.withColumn("selected", F.lit(False))
    on = entity.update_staged(off, rows, staged.select("id"), selected=True).where("selected")
    assert ids(on) == [10, 11, 12, 13, 16]
    with pytest.raises(ValueError):
        entity.update_staged(off, rows, staged.where("id = 15").select("id"), selected=True, strict=True)
    assert entity.update_staged(off, rows, staged.select("id"), selected=False, rating=2, strict=True).where("rating = 2").count() == 7
    taken = spark.createDataFrame([(dt.date(2026, 7, 1), "a.jpg"), (dt.date(2026, 7, 1), "a_2.jpg")], "day date, name string")
    files = spark.createDataFrame([(1, 1, dt.date(2026, 7, 1), "a.jpg"), (2, 2, dt.date(2026, 7, 1), "a_1.jpg"), (3, 3, dt.date(2026, 7, 1), "a.jpg"), (4, 4, dt.date(2026, 7, 2), "a.jpg"), (5, 5, dt.date(2026, 7, 1), ".hidden"), (6, 6, dt.date(2026, 7, 1), ".hidden")], "id long, seq long, day date, name string")
    got = {r.id: r.path.split("/")[-1] for r in order.destinations(files, taken).collect()}
    assert got == {1: "a_1.jpg", 2: "a_1_1.jpg", 3: "a_3.jpg", 4: "a.jpg", 5: ".hidden", 6: ".hidden_1"}
    for call in ((20 << 30, 15 << 30, False), (0, 1 << 30, True)):
        with pytest.raises(ValueError):
            catalog.preflight(*call)
    catalog.preflight(1 << 30, 15 << 30)


def test_mirror_modes(spark):
    rows = images(spark, [dict(id=1), dict(id=2, remote_sync=True), dict(id=3, remote_id="a", deleted_at=T0), dict(id=4, sha1="s4", deleted_at=T0, remote_sync=True), dict(id=5, file_type="raw")])
    albums = spark.createDataFrame([(7, "A", ["sky"], True), (8, "B", [], False)], "album_id long, album string, rule array<string>, album_sync boolean")
    links, members = spark.createDataFrame([(1, "sky")], "image_id long, name string"), spark.createDataFrame([(8, 2)], "album_id long, image_id long")
    assert ids(mirror.upload_candidates(rows, albums, links, "full")) == [1, 2] and ids(mirror.upload_candidates(rows, albums, links, "selective")) == [1, 2]
    assert ids(mirror.upload_candidates(rows, albums.where("album_id = 8"), links, "selective")) == [2]
    names = lambda mode, on=True: {r.id: r.albums for r in mirror.album_names(rows, albums, members, links, mode, on).collect()}
    assert names("full") == {1: ["A"], 2: ["B"]} and names("selective") == {1: ["A"]} and names("full", False) == {}
    assert mirror.deletion_queue(rows, "manual").count() == 0 and mirror.deletion_queue(rows.where("id in (3, 4)"), "full").count() == 2 and mirror.deletion_queue(rows.where("id in (3, 4)"), "selective").first().sha1 == "s4"
    known = spark.createDataFrame([("s4", "b")], "sha1 string, remote_id string")
    assert {(r.id, r.remote_id) for r in mirror.trashed_removals(rows, known, rows.limit(0), "full").collect()} == {(3, "a"), (4, "b")}
    assert mirror.trashed_removals(rows, known, rows.where("id = 4"), "selective").count() == 0
    with pytest.raises(ValueError):
        mirror.deletion_queue(rows, "some")


def test_mirror_lists_no_pairs_of_rules(spark, capsys):
    rows = images(spark, [dict(id=i, remote_id=f"r{i}") for i in range(1, 5)])
    albums = spark.createDataFrame([(k, f"A{k % 20:02}", ["sky", "sea"][: 1 + k % 2], True) for k in range(200)] + [(900, "Z", [], True), (901, "A03", [], True)], "album_id long, album string, rule array<string>, album_sync boolean")
    links, members = spark.createDataFrame([(1, "sky"), (1, "sea"), (2, "sea"), (3, "land")], "image_id long, name string"), spark.createDataFrame([(900, 1), (901, 2), (900, 3)], "album_id long, image_id long")
    every, odd = [f"A{k:02}" for k in range(20)], [f"A{k:02}" for k in range(1, 20, 2)]
    out = mirror.album_names(rows, albums, members, links, "full")
    assert {r.id: r.albums for r in out.collect()} == {1: [*every, "Z"], 2: odd, 3: ["Z"]}
    known = spark.createDataFrame([("r1", a) for a in every] + [("r2", "A01")], "remote_id string, album string")
    assert sorted((r.remote_id, r.album) for r in mirror.album_pushes(rows, albums, members, links, known, "full").collect()) == [("r1", "Z")] + [("r2", a) for a in odd[1:]] + [("r3", "Z")]
    # albums meet the tags of rules by name only, once each, before any image comes to them
    out.explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert "Join LeftSemi, (name" in plan and "Join Inner, (name" in plan


def test_collections_and_rules(spark):
    rows = images(spark, [dict(id=1, gps_lat=48.0, gps_lon=11.0, gps_country="Germany"), dict(id=2, file_type="raw"), dict(id=3, deleted_at=T0)])
    clusters = spark.createDataFrame([(0, "sky", "", 1), (1, "sea", "water", 2)], "cluster int, name string, `group` string, image_id long")
    for wrong in ("cluster:x", "cluster:9", "cluster-group:none", "place:1", "nothing:1", "month"):
        with pytest.raises(ValueError):
            filters.smart_album(rows, wrong, clusters=clusters)
    assert ids(filters.smart_album(rows, "cluster-group:sky", clusters=clusters)) == [1] and ids(filters.smart_album(rows, "place:48.0,11.0")) == [1]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(filters.parsed_rule(F.lit(None).cast("string"))) == [] and one(filters.parsed_rule(F.lit("oops"))) == [] and one(filters.clean_rule(filters.parsed_rule(F.lit('[" b", "a", "b ", ""]')))) == ["b", "a"]
    albums, members = spark.createDataFrame([(9,), (8,)], "album_id long"), spark.createDataFrame([(9, 2, 0), (9, 3, 1), (8, 2, 0)], "album_id long, image_id long, position int")
    rules, links = spark.createDataFrame([(9, "t")], "album_id long, name string"), spark.createDataFrame([(1, "t"), (2, "t")], "image_id long, name string")
    live = rows.where("deleted_at is null")
    assert {r.album_id: r.covers for r in collections.album_covers(albums, rules, members, links, live).collect()} == {9: [1], 8: [2]}
    assert {r.album_id: r.n for r in filters.album_sizes(rules, members, links, live).collect()} == {9: 2, 8: 1}
    votes = spark.createDataFrame([(1, None, 1), (1, None, 2), (1, "b", 3), (1, "a", 4), (2, None, 5)], "g int, v string, seq int")
    assert {r.g: r.v for r in collections.majority(votes, ["g"], "v", "seq").collect()} == {1: "b", 2: None}
    assert aggregates.shares(spark.createDataFrame([("a", 1), ("b", 7)], "v string, n int")).orderBy("v").first().percent == 13
    assert aggregates.shares(spark.createDataFrame([("a", 0)], "v string, n int")).first().percent == 0
    lens = {"": "—", None: "—", "0.5": "1/2", "2.54": "2.5s", "30": "30s", "1/280": "1/280", "0": "0"}
    assert {k: one(strings.shutter(F.lit(k).cast("string"))) for k in lens} == lens
    assert [one(strings.whole_number(F.lit(x).cast("string"))) for x in ("undef", "7.9", "-1.5", None)] == [None, 7, -1, None]
    names = spark.createDataFrame([("Germany", "DE")], "name string, cc string")
    assert {r.cc: r.country for r in places.country_name(spark.createDataFrame([("DE",), ("XK",), ("",), (None,)], "cc string"), names).collect()} == {"DE": "Germany", "XK": "XK", "": None, None: None}


def test_backup_and_cluster_cache(spark, tmp_path):
    rows = images(spark, [dict(id=i) for i in range(1, 9)] + [dict(id=20, source_root_id="r"), dict(id=21, paired_image_id=20), dict(id=22, paired_image_id=1)])
    albums, members = spark.createDataFrame([(9, "A")], "id long, name string"), spark.createDataFrame([(9, 1, 0), (9, 20, 1)], "album_id long, image_id long, position int")
    links = spark.createDataFrame([(1, "b"), (1, "a"), (20, "a")], "image_id long, name string")
    catalog.write_backup(rows, albums, members, f"{tmp_path}/b", links)
    back = catalog.restored(spark, f"{tmp_path}/b", IMAGE + ", tags array<string>", {"rating": F.lit(0)})
    assert {r.id: r.paired_image_id for r in back["images"].where("id > 8").collect()} == {21: None, 22: 1} and back["images"].columns == rows.columns
    assert sorted(map(tuple, back["image_tags"].collect())) == [(1, "a"), (1, "b")] and back["album_images"].count() == 1 and back["albums"].count() == 1
    clusters = spark.createDataFrame([(0, "sky", "", [8, 1, 2, 3, 4, 5], 8), (1, "sea", "g", [1, 2, 3, 4], 1)], "cluster int, name string, `group` string, image_ids array<long>, cover long")
    signature = aggregates.signature(rows.withColumn("imported_at", F.lit(T0)), rows)
    catalog.save_clusters(clusters, signature, f"{tmp_path}/c")
    kept, current = catalog.load_clusters(spark, f"{tmp_path}/c", rows.where("id <> 8"), signature)
    assert current and [(r.cluster, r.image_ids, r.cover, r["group"]) for r in kept.collect()] == [(0, [1, 2, 3, 4, 5], 1, "sky")]
    assert not catalog.load_clusters(spark, f"{tmp_path}/c", rows, aggregates.signature(rows.where("id <> 8").withColumn("imported_at", F.lit(T0)), rows))[1]
    (tmp_path / "cities.csv").write_text("lat,lon,name,admin1,admin2,cc\n48.1,11.5,München,Bavaria,,DE\nx,1,Nowhere,,,\n")
    assert [(r.key, r.cc) for r in catalog.gazetteer(spark, f"{tmp_path}/cities.csv").collect()] == [("munchen", "DE")]
    for t, df in {"images": rows, "tags": links.select("name"), "image_tags": links, "albums": albums, "album_images": members, "version": spark.createDataFrame([("v3",)], "version_num string")}.items():
        df.write.parquet(f"{tmp_path}/lib/{t}")
    assert catalog.other_library(spark, f"{tmp_path}/lib", {"v3"})["images"].count() == 11
    with pytest.raises(ValueError):
        catalog.other_library(spark, f"{tmp_path}/lib", {"v4"})
    (tmp_path / "in").mkdir()
    for name in ("a.jpg", "b.txt", ".x.jpg"):
        (tmp_path / "in" / name).write_bytes(name.encode())
    (tmp_path / "in" / "sub").mkdir()
    (tmp_path / "in" / "sub" / "a.jpg").write_bytes(b"other")
    staged = catalog.stage(catalog.listing(spark, f"file:{tmp_path}/in", with_content=True), "s1", spark.createDataFrame([("a_1.jpg",)], "name string")).collect()
    assert sorted((r.staged_name, r.original_filename, r.processed) for r in staged) == [("a.jpg", "a.jpg", False), ("a_2.jpg", "a.jpg", False)] and len({r.sha for r in staged}) == 2


def test_examples(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (4, [0.0, 1.0]), (9, [1.0, 0.0])], "id long, vector array<double>")
    pool = spark.createDataFrame([(1, "own", False, 2), (2, "partner", True, 1), (3, "raw by its partner", True, 4), (4, "jpeg", False, 3), (5, "no vector", False, None)], "id long, doc string, is_raw boolean, pair long")
    target = spark.createDataFrame([(9, [1.0, 0.0], False, None), (1, [1.0, 0.0], True, 2)], "id long, vector array<double>, is_raw boolean, pair long")
    got = {}
    for r in vectors.example_neighbours(target, pool, v).orderBy("query", F.desc("score")).collect():
        got.setdefault(r.query, []).append(r.doc)
    assert got == {9: ["own", "jpeg"], 1: ["raw by its partner"]}
