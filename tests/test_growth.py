"""Work that grows no faster than the input."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import develop, strings
from stratalens.operators import collections, entity, filters, mirror, order, vectors
from stratalens.plans import views

DAY = dt.date(2026, 7, 1)


def test_labels_are_all_used(spark, monkeypatch):
    quality = pytest.importorskip("stratalens.llm.quality")
    monkeypatch.setattr(quality, "LABELLED", 10, raising=False)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    assert quality.targets(labels).count() == 200
    rng = np.random.default_rng(1)
    for xs in (rng.normal(size=333).tolist(), [2.0] * 7, [1.0, 5.0]):
        got = quality.quantile(spark.createDataFrame([(x,) for x in xs], "x double"), "x", 0.01)
        assert got == pytest.approx(float(np.quantile(xs, 0.01)), rel=1e-12)


def test_labels_meet_features_in_one_way_at_any_size(spark, monkeypatch, capsys):
    quality = pytest.importorskip("stratalens.llm.quality")
    docs = spark.createDataFrame([(i, f"good w{i % 7} w{i % 5}" if i % 2 else f"BAD x{i % 3}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    joined, join = [], type(docs).join
    monkeypatch.setattr(type(docs), "join", lambda self, *a, **k: joined.append((self.columns, join(self, *a, **k))) or joined[-1][1])
    assert quality.weights(docs, labels).count() == 60 and len(joined) == 2
    for columns, out in joined:
        assert "text" not in columns
        out.explain()
        assert "Broadcast" not in capsys.readouterr().out  # labels are few here, and would be sent to all tasks


def test_packed_features_come_back():
    quality = pytest.importorskip("stratalens.llm.quality")
    texts = ["", "a b c a b c", "", "Some 12 WORDS, some more", *(" ".join(f"w{k * j}" for j in range(90)) for k in range(40)), ""]
    row, key = quality.features(texts)
    column = quality.packed(row, key, len(texts))
    for start, length in ((0, len(texts)), (3, 20), (len(texts) - 1, 1)):
        inside = (row >= start) & (row < start + length)
        got = quality.unpacked(column.slice(start, length))
        assert got[0].tolist() == (row[inside] - start).tolist() and got[1].tolist() == key[inside].tolist()
    top = quality.BUCKETS - 1
    assert quality.unpacked(quality.packed(np.array([0, 2]), np.array([0, top]), 3))[1].tolist() == [0, top]


def test_destinations_of_one_crowded_name(spark):
    n = 20_000
    files = spark.range(n).select("id", F.col("id").alias("seq"), F.lit(DAY).alias("day"), F.lit("a.jpg").alias("name"))
    taken = spark.createDataFrame([(DAY, "a_7.jpg")], "day date, name string")
    began = time.time()
    got = {r.id: r.path.split("/")[-1] for r in order.destinations(files, taken).collect()}
    assert time.time() - began < 40
    assert got == {i: "a.jpg" if i == 0 else f"a_{i + (i > 6)}.jpg" for i in range(n)}


def test_destinations_of_one_name_are_row_numbers(spark, capsys):
    files = spark.createDataFrame([(3, 1, DAY, "a_1.jpg"), (2, 1, DAY, "a_1.jpg"), (1, 2, DAY, "a_1.jpg"), (4, 1, DAY, "b"), (5, 1, DAY, "c.x.jpg")], "id long, seq long, day date, name string")
    taken = spark.createDataFrame([(DAY, "a_1.jpg"), (DAY, "z.jpg")], "day date, name string")
    out = order.destinations(files, taken)
    assert {r.id: r.path.split("/")[-1] for r in out.collect()} == {2: "a_1_1.jpg", 3: "a_1_2.jpg", 1: "a_1_3.jpg", 4: "b", 5: "c.x.jpg"}
    out.explain()
    assert "row_number" in capsys.readouterr().out


def test_lens_text_is_taken_apart_once(spark, capsys):
    values = ("0 0 8 8 2 2 0", "0 0 0 0 0", "1 2 3 4 5", "8.8 25.7 1.8 2.8", "x 1 2", " 5 5 0 0 ", "NaN 1 2 3", "1d 2 0 0", "", None, "7")
    out = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", strings.clean_lens(F.col("v")).alias("lens"))
    assert [r.lens for r in out.orderBy("k").collect()] == ["8mm f/2", None, None, "8.8-25.7mm f/1.8-2.8", "x 1 2", "5mm", "NaN-1mm f/2-3", "1-2mm", None, None, None]
    out.explain()
    assert capsys.readouterr().out.count("split(") == 1


def test_documents_of_some_keys_only(spark, capsys):
    rows = spark.createDataFrame([('{"contrast": 3, "hsl": {"red": [1]}, "hue": 4}',)], "doc string")
    n = rows.select(develop.normalised(F.col("doc"), ("hsl", "contrast")).alias("n")).first().n
    assert list(n.asDict()) == ["contrast", "hsl"] and (n.contrast, n.hsl.red) == (3, [1, 0, 0])


def test_neutrality_writes_no_text(spark, capsys):
    rows = spark.createDataFrame([("{}",)], "doc string").select(develop.is_neutral(develop.normalised(F.col("doc"))).alias("neutral"))
    rows.explain()
    assert "to_json" not in capsys.readouterr().out and rows.first().neutral


def test_files_that_are_no_copies_are_not_dealt_to_one_task(spark):
    staged = spark.range(4000).select("id", F.when(F.col("id") % 1000 == 0, F.col("id")).alias("duplicate_of_image_id"), F.lit(None).cast("long").alias("duplicate_of_staged_file_id"), F.lit(False).alias("selected")).repartition(4)
    images = spark.range(4000).select("id", F.lit("r").alias("source_root_id"), F.lit(None).cast("timestamp").alias("deleted_at"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = entity.selectable(staged, images)
        assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 2000
        assert out.count() == 4000 and out.where("selectable").count() == 4000
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_examples_meet_targets_in_blocks(spark, monkeypatch, capsys):
    rng = np.random.default_rng(7)
    v = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(40)], "id long, vector array<double>")
    examples = spark.createDataFrame([(i, f"d{i}", i % 3 == 0, i ^ 1) for i in range(40)], "id long, doc string, is_raw boolean, pair long")
    targets = v.where("id % 3 = 0").selectExpr("id", "vector", "id % 2 = 0 as is_raw", "cast(null as long) as pair")
    whole = sorted(map(tuple, vectors.example_neighbours(targets, examples, v, 3).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "TARGETS", 5)
    out = vectors.example_neighbours(targets, examples, v, 3)
    assert sorted(map(tuple, out.collect())) == whole and whole
    out.explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_tags_and_rows_of_albums_are_dealt_before_they_are_made_distinct(spark, sf, capsys):
    views.image_tags(spark, sf).explain()
    above, below = capsys.readouterr().out.split("Exchange hashpartitioning(image_id", 1)
    assert "HashAggregate" in above and "HashAggregate" not in below
    views.album_images(spark, sf).explain()
    assert "Aggregate" not in capsys.readouterr().out  # pairs hardly repeat: one sort, no tables of them


def test_album_sizes_count_sets_of_tags_once(spark, capsys):
    rules = spark.createDataFrame([(a, n) for a in range(6) for n in ("abc", "bcd")[a % 2]] + [(9, "none")], "album_id long, name string")
    links = spark.createDataFrame([(i, n) for i in range(40) for k, n in enumerate("abcdxy") if (i >> k) & 1], "image_id long, name string")
    members = spark.createDataFrame([(a, i) for a in (0, 7) for i in (0, 3, 16, 16, 38, 39)], "album_id long, image_id long")
    shown = spark.range(39)
    tagged = lambda names: {r.image_id for r in links.where(links["name"].isin(*names)).collect()} & set(range(39))
    hand = {0, 3, 16, 38}
    want = {a: len(tagged(("abc", "bcd")[a % 2]) | (hand if a == 0 else set())) for a in range(6)} | {7: len(hand)}
    out = filters.album_sizes(rules, members, links, shown)
    assert {r.album_id: r.n for r in out.collect()} == want
    out.explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert "Generate explode(names" in plan  # rules meet sets of tags, which are few, not images


def test_album_covers_of_equal_positions_are_the_newest(spark):
    images = spark.createDataFrame([(i, dt.datetime(2026, 1, 1) + dt.timedelta(i), "jpeg") for i in range(9)], "id long, taken_at timestamp_ntz, file_type string")
    members = spark.createDataFrame([(1, i, 5) for i in range(9)] + [(1, 0, 2), (1, 1, None)], "album_id long, image_id long, position int")
    albums, none = spark.createDataFrame([(1,), (2,)], "album_id long"), spark.createDataFrame([], "album_id long, name string")
    rules, links = spark.createDataFrame([(2, "a"), (2, "b")], "album_id long, name string"), spark.createDataFrame([(i, "ab"[i % 2]) for i in range(8)] + [(7, "a"), (8, "c")], "image_id long, name string")
    got = lambda r: {x.album_id: x.covers for x in collections.album_covers(albums, r, members, links, images).collect()}
    assert got(none) == {1: [0, 8, 7, 6]} and got(rules) == {1: [0, 8, 7, 6], 2: [7, 6, 5, 4]}


def _library(spark, images, names):
    """Images 0.., each with one of three sets of tags and every fifth in an album by hand; albums of two rules, some of whose names occur twice."""
    rows = spark.range(images).select("id", F.concat(F.lit("r"), F.col("id") % (images - 3)).alias("remote_id"), F.lit(None).cast("timestamp").alias("deleted_at"))
    albums = [(k, f"A{k % (names - 5):04}", ["sky"] if k % 2 else ["sea", "sky"], True) for k in range(names)] + [(9000, "M", [], True), (9001, "A0003", [], True), (9002, None, ["sea"], True)]
    sets = (["sky"], ["sea", "sky"], ["land"])
    tags = [(i, t) for i in range(images) for t in sets[i % 3]]
    members = [(9000 + i % 2, i) for i in range(0, images, 5)]
    held = {}
    for i in range(images):
        got = {name for _, name, rule, _ in albums if name and set(sets[i % 3]) & set(rule)} | ({["M", "A0003"][i % 2]} if i % 5 == 0 else set())
        if got:
            held[i] = got
    return rows, spark.createDataFrame(albums, "album_id long, album string, rule array<string>, album_sync boolean"), spark.createDataFrame(members, "album_id long, image_id long"), spark.createDataFrame(tags, "image_id long, name string"), held


def _runs(batches):
    """Places where a value is not the one before it, in all files."""
    return sum(1 + sum(a != b for a, b in zip(x, x[1:])) for x in batches if x)


def test_album_names_of_equal_images_lie_side_by_side(spark, monkeypatch):
    rows, albums, members, links, held = _library(spark, 600, 30)
    for size in (2048, 7):
        monkeypatch.setattr(mirror, "SAME", size, raising=False)
        out = mirror.album_names(rows, albums, members, links, "full")
        parts = out.rdd.glom().collect()
        assert {r.id: r.albums for p in parts for r in p} == {i: sorted(x) for i, x in held.items()} and sum(map(len, parts)) == len(held)
        # six lists occur; each comes in pieces of at most so many images (twice as many pieces, as they are dealt by their ids)
        assert _runs([[tuple(r.albums) for r in p] for p in parts]) <= 6 * (1 + 2 * 600 // size) + 6
    assert {r.id: r.albums for r in mirror.album_names(rows, albums, members, links, "full", sep="|").collect()} == {i: "|".join(sorted(x)) for i, x in held.items()}


def test_album_pushes_repeat_what_was_just_written(spark, monkeypatch):
    rows, albums, members, links, held = _library(spark, 600, 60)
    known = [(f"r{i}", name) for i in range(0, 600, 4) for name in ("A0001", "A0002", "M", "other")] + [("r7", None)]
    want = {(name, f"r{i % 597}") for i, x in held.items() for name in x} - {(name, r) for r, name in known}
    pushed = spark.createDataFrame(known, "remote_id string, album string")
    for images, names in ((256, 8192), (16, 5)):
        monkeypatch.setattr(mirror, "ROWS", images, raising=False)
        monkeypatch.setattr(mirror, "NAMES", names, raising=False)
        parts = mirror.album_pushes(rows, albums, members, links, pushed, "full").rdd.glom().collect()
        got = [(r.album, r.remote_id) for p in parts for r in p]
        assert len(got) == len(set(got)) and set(got) == want
        assert _runs([[r.album for r in p] for p in parts]) < len(got) / 4
