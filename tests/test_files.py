"""Export jobs and archives of files: whole files only, resume, cancel, round trips."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from stratalens.sources import catalog, files


@pytest.fixture
def library(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    rows = []
    for i in range(40):
        name = f"{'a' if i % 3 else 'b'}.{'jpg' if i % 2 else 'raf'}"
        path = tmp_path / "lib" / f"{i}"
        if i != 7:
            path.write_bytes(bytes([i]) * (i * 1000))
        rows.append((i, name, str(path)))
    return spark.createDataFrame(rows, "id long, original_filename string, path string"), rows


def numbered_by_hand(names):
    used, out = {}, []
    for name in names:
        n = used[name] = used.get(name, -1) + 1
        stem, _, end = name.rpartition(".")
        out.append(f"{stem}_{n}.{end}" if n else name)
    return out


def test_export_plan_keeps_the_request(spark, library):
    images, rows = library
    order = [5, 1, 3, 5, 99, 0, 2, 4, 6]
    wanted = spark.createDataFrame(list(enumerate(order)), "pos long, id long")
    for rendered in (False, True):
        got = [r.name for r in files.export_plan(wanted, images, rendered).orderBy("pos").collect()]
        names = [rows[i][1] for i in order if i < 40]
        assert got == numbered_by_hand([n.rpartition(".")[0] + ".jpg" for n in names] if rendered else names)


def test_export_resumes_and_leaves_no_half_files(spark, library, tmp_path):
    images, rows = library
    folder = str(tmp_path / "job")
    plan = files.export_plan(images.select(images.id.alias("pos"), "id"), images)
    broken, lib = tmp_path / "broken", tmp_path / "lib"
    broken.touch()

    def render(data):
        if broken.exists() and len(data) >= 25_000:
            os._exit(1)  # the worker dies, as if its machine were lost
        if data[:1] == b"\x04":
            raise ValueError("not an image")
        return data[::-1] + b"!"

    with pytest.raises(Exception):  # noqa: B017
        files.export_job(plan, folder, render, chunk=10)
    assert files.export_progress(spark, folder).first().asDict() == {"total": 40, "done": 20, "failed": 1, "missing": 1, "bytes": sum(i * 1000 + 1 for i in range(20) if i not in (4, 7)), "state": "running"}
    whole = {r.name for r in plan.collect()}
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "job" / "files").iterdir() if p.name in whole}
    broken.unlink()
    last = files.export_job(plan.limit(0), folder, render, chunk=10).first()  # the plan of the first call counts
    assert (last.total, last.done, last.failed, last.missing, last.state) == (40, 40, 1, 1, "ready")
    after = {p.name: p for p in (tmp_path / "job" / "files").iterdir() if not p.name.startswith(".") or ".half" in p.name}
    after = {n: p for n, p in after.items() if not n.endswith(".crc")}
    assert set(after) == {r.name for r in plan.collect() if r.id not in (4, 7)}
    assert all(after[n].stat().st_mtime_ns == t for n, t in before.items())
    for r in plan.collect():
        if r.id not in (4, 7):
            assert after[r.name].read_bytes() == (lib / str(r.id)).read_bytes()[::-1] + b"!"


def test_export_cancelled_and_empty(spark, library, tmp_path):
    images, _ = library
    plan = files.export_plan(images.select(images.id.alias("pos"), "id"), images)
    files.cancel_export(str(tmp_path / "job"))
    assert files.export_job(plan, str(tmp_path / "job")).first().asDict() == {"total": 40, "done": 0, "failed": 0, "missing": 0, "bytes": 0, "state": "cancelled"}
    assert files.export_job(plan.limit(0), str(tmp_path / "none")).first().state == "ready"


def test_archive_round_trip(spark, library, tmp_path):
    images, rows = library
    folder = str(tmp_path / "archive")
    listed = images.selectExpr("concat('library/', id, '/', original_filename) as name", "path")
    files.write_archive(listed, folder, part_bytes=50_000)
    want = {f"library/{i}/{n}": bytes([i]) * (i * 1000) for i, n, _ in rows if i != 7}
    assert {r.name: bytes(r.content) for r in files.read_archive(spark, folder).collect()} == want
    parts = list((tmp_path / "archive" / "parts").glob("*.zip"))
    assert len(parts) > 4 and sum(len(zipfile.ZipFile(io.BytesIO(p.read_bytes())).namelist()) for p in parts) == 39
    (tmp_path / "archive" / "parts" / "left-over.zip").write_bytes(b"half")  # of a job that died: in no manifest
    assert files.read_archive(spark, folder).count() == 39
    out = files.unpack(files.read_archive(spark, folder), str(tmp_path / "back"))
    assert {r.name: r.bytes for r in out.collect()} == {n: len(c) for n, c in want.items()}
    assert all((tmp_path / "back" / n).read_bytes() == c for n, c in want.items())
    files.write_archive(spark.createDataFrame([("x", None), ("y", b"1")], "name string, content binary"), folder)
    assert {r.name: bytes(r.content) for r in files.read_archive(spark, folder).collect()} == {"x": b"", "y": b"1"}
    files.write_archive(listed.limit(0), folder)
    assert files.read_archive(spark, folder).count() == 0
    with pytest.raises(Exception, match="leaves the folder"):
        files.unpack(spark.createDataFrame([("../x", b"1")], "name string, content binary"), str(tmp_path / "back")).collect()


def test_backup_with_files(spark, tmp_path):
    lib = tmp_path / "lib"
    lib.mkdir()
    (lib / "1.jpg").write_bytes(b"one")
    (lib / "2.jpg").write_bytes(b"two")
    images = spark.createDataFrame([(1, "1.jpg", None, 3), (2, "2.jpg", "root", None), (3, "gone.jpg", None, 1)], "id long, file_path string, source_root_id string, paired_image_id long")
    albums = spark.createDataFrame([(5, "A", "x")], "id long, name string, rule string")
    members = spark.createDataFrame([(5, 1, 0), (5, 2, 1)], "album_id long, image_id long, position int")
    path = str(tmp_path / "backup")
    for _ in range(2):  # a second backup takes the place of the first
        catalog.write_backup(images, albums, members, path, library=str(lib))
    tables = catalog.restored(spark, path, images.schema)
    assert sorted((r.id, r.paired_image_id) for r in tables["images"].collect()) == [(1, 3), (3, 1)]
    assert [tuple(r) for r in catalog.restored_files(spark, path, str(tmp_path / "new")).collect()] == [("1.jpg", 3)]
    assert (tmp_path / "new" / "1.jpg").read_bytes() == b"one" and not (tmp_path / "new" / "2.jpg").exists()
    with pytest.raises(Exception):  # noqa: B017
        catalog.write_backup(images.limit(1), albums.withColumn("name", F.raise_error(F.lit("stop"))), members, path, library=str(lib))
    with pytest.raises(Exception):  # noqa: B017  (half a backup is none)
        catalog.restored(spark, path, images.schema)
