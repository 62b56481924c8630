"""Place names and settings."""

import pytest

from stratalens.operators import changes, places, settings


NAMES = [("Germany", None, "DE"), ("Deutschland", "de", "DE"), ("Italy", None, "IT"), ("United States", None, "US")]
CITIES = [("Rome", "Lazio", "IT", 41.9, 12.5), ("Rome", "New York", "US", 43.2, -75.5), ("New York City", "New York", "US", 40.7, -74.0), ("Lübeck", "Schleswig-Holstein", "DE", 53.9, 10.7), ("Florence", "Tuscany", "IT", 43.8, 11.3)]


def test_places(spark):
    names = spark.createDataFrame(NAMES, "name string, lang string, cc string")
    asked = spark.createDataFrame([("deutschland", "de"), ("deutschland", None), ("ITALY ", "fr"), ("nowhere", None)], "query string, lang string")
    assert {(r.query, r.lang): r.cc for r in places.country_of(asked, names).collect()} == {("deutschland", "de"): "DE", ("deutschland", None): None, ("ITALY ", "fr"): "IT", ("nowhere", None): None}
    cities = spark.createDataFrame(CITIES, "name string, admin1 string, cc string, lat double, lon double")
    queries = spark.createDataFrame([("Rome",), ("rome, it",), ("Rome Italy",), ("new york city",), ("lubeck germany",), ("Rome, Mars",)], "query string")
    got = {}
    for r in places.candidates(queries, cities, names).collect():
        got.setdefault(r.query, []).append((r.name, r.cc))
    assert {k: sorted(v) for k, v in got.items()} == {"Rome": [("Rome", "IT"), ("Rome", "US")], "rome, it": [("Rome", "IT")], "Rome Italy": [("Rome", "IT")], "new york city": [("New York City", "US")], "lubeck germany": [("Lübeck", "DE")]}
    exonyms = spark.createDataFrame([("Florenz", "Florence")], "exonym string, name string")
    keys = {(r.query, r.key) for r in places.spellings(spark.createDataFrame([("Florenz",), ("Luebeck",)], "query string"), exonyms).collect()}
    assert {("Florenz", "florence"), ("Luebeck", "lubeck")} <= keys


def test_located_places(spark):
    rows = [*CITIES, ("Halle", "Flanders", "BE", 50.7, 4.2), ("Halle (Saale)", "Saxony-Anhalt", "DE", 51.5, 12.0), ("Halle Neustadt", "Saxony-Anhalt", "DE", 51.4, 11.9), ("Bad", "x", "DE", 1.0, 1.0), ("Bad Ems", "x", "DE", 50.3, 7.7), ("Rome", "Lazio", "IT", 41.9, 12.5), ("Nil", None, None, None, 1.0)]
    rows += [(f"Saint {i:02}", "x", "FR", float(i), 0.0) for i in range(30)]
    cities = spark.createDataFrame(rows, "name string, admin1 string, cc string, lat double, lon double")
    names = spark.createDataFrame([*NAMES, ("Italien", "de", "IT")], "name string, lang string, cc string")
    exonyms = spark.createDataFrame([("Florenz", "Florence")], "exonym string, name string")
    cases = {
        ("Rome", None): ["Rome/IT", "Rome/US"], ("rome, it", None): ["Rome/IT"], ("Rome Lazio", None): ["Rome/IT"], ("rome italien", "de-AT"): ["Rome/IT"], ("rome italien", None): [], ("new york", None): ["New York City/US"], ("halle", None): ["Halle (Saale)/DE", "Halle Neustadt/DE", "Halle/BE"],
        ("halle, germany", None): ["Halle (Saale)/DE", "Halle Neustadt/DE"], ("bad", None): ["Bad/DE"], ("florenc", None): [], ("Florenz", "de"): ["Florence/IT"], ("Florenz", "en"): [], ("luebeck", "de"): ["Lübeck/DE"], ("luebeck", None): [], ("new york city united states", None): ["New York City/US"],
        ("Rome, Mars", None): [], ("rome,", None): ["Rome/IT", "Rome/US"], ("saint", None): [f"Saint {i:02}/FR" for i in range(20)], ("", None): [], (" , italy", None): [], (None, "de"): [], ("--", None): [], ("nil", None): [],
    }
    asked = spark.createDataFrame([*cases, ("Rome", None)], "query string, lang string")
    got = {}
    for r in places.located(asked, cities, names, exonyms).collect():
        got.setdefault((r.query, r.lang), []).append(f"{r.name}/{r.cc}")
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in cases.items() if v}
    assert places.located(asked, cities.limit(0), names.limit(0), exonyms.limit(0)).count() == 0


def test_renames_in_two_phases(spark):
    rows = [(1, "a.jpg", "d/a.jpg", 2), (2, "a.raf", "d/a.raf", 1), (3, "b.jpg", "d/b.jpg", 4), (4, "b.raf", "d/b.raf", 3), (5, "x.raf", "d/x.raf", None), (6, "c.jpg", "d/c.jpg", None), (7, "c.jpg", "e/c.jpg", None), (8, "n", "n", None), (9, "k.jpg", "d/k.jpg", 10), (10, "k.raf", "d/k.raf", 9)]
    images = spark.createDataFrame(rows, "id long, original_filename string, file_path string, paired_image_id long")
    wanted = spark.createDataFrame([(1, " new.JPG "), (3, "x"), (5, "x"), (6, "new"), (7, "new"), (8, "Sunset 2026.07.14"), (9, "q"), (10, "r.raf"), (99, "z"), (1, "zz")], "id long, name string")
    plan = changes.rename_plan(images, wanted)
    got = {r.id: (r.path, r.error, r.asked) for r in plan.collect()}
    assert got == {
        1: ("d/new.jpg", None, True), 2: ("d/new.raf", None, False), 3: ("d/x.jpg", None, True), 4: ("d/x.raf", "taken", False), 6: ("d/new.jpg", "taken", True), 7: ("e/new.jpg", None, True),
        8: ("Sunset 2026.07.14", None, True), 9: ("d/q.jpg", None, True), 10: ("d/r.raf", None, True),
    }
    after = {r.id: (r.original_filename, r.file_path) for r in changes.apply_renames(images, plan).collect()}
    assert after[1] == ("new.jpg", "d/new.jpg") and after[2] == ("new.raf", "d/new.raf") and after[4] == ("b.raf", "d/b.raf") and after[6] == ("c.jpg", "d/c.jpg") and len(after) == 10
    alone = changes.rename_plan(images, wanted, pairs=False)
    assert sorted(r.id for r in alone.collect()) == [1, 3, 6, 7, 8, 9, 10]
    odd = spark.createDataFrame([(1, ".."), (2, "a:b"), (3, None), (6, "c.jpg"), (7, "x" * 300)], "id long, name string")
    assert {r.id: (r.path, r.error) for r in changes.rename_plan(images, odd).collect()} == {1: (None, "name"), 2: (None, "name"), 3: (None, "name"), 7: (None, "name")}
    assert changes.rename_plan(images, odd.limit(0)).count() == 0


def test_settings(spark):
    empty = spark.createDataFrame([], "key string, value string")
    assert settings.read(empty) == settings.DEFAULTS
    now = settings.write(settings.write(empty, {"trash_days": 99999, "sync_paused": True}), {"sections": "tags,unknown,years"})
    assert settings.read(now)["trash_days"] == 3650 and settings.read(now)["sync_paused"] is True and settings.sections(now) == ["years", "tags"]
    assert settings.sections(settings.write(now, {"sections": ""})) == []
    with pytest.raises(ValueError):
        settings.write(empty, {"nothing": 1})
