"""Files on disk: result files of different ages, registries, imports of the package's modules."""

import subprocess
import sys
from pathlib import Path

import pytest

from overfly.sources import readers

REPO = Path(__file__).resolve().parent.parent


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("filename,inliers,offset_m,skipped\na1,5,1.5,False\na2,nan,,True\n")
    (tmp_path / "b.csv").write_text("filename,skipped,raw_err_m,inliers\nb1,True,77.0,22\n")
    (tmp_path / "c d.csv").write_text("﻿filename, inliers\r\nc1,9\r\n")
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "f.csv").write_text("filename,skipped,raw_err_m,inliers\n")
    d = readers.result_csv(spark, str(tmp_path), ["inliers", "offset_m", "raw_err_m"])
    got = {r["filename"]: (r["inliers"], r["offset_m"], r["raw_err_m"], r["skipped"]) for r in d.collect()}
    assert got == {"a1": (5.0, 1.5, None, False), "a2": (None, None, None, True), "b1": (22.0, None, 77.0, True), "c1": (9.0, None, None, False)}


def test_headers_of_files_in_many_blocks(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        (tmp_path / "a.csv").write_text("x,y\n" + "".join(f"{i},{-i}\n" for i in range(500)))
        (tmp_path / "b.csv").write_text("y,x\n" + "".join(f"{-i},{i}\n" for i in range(500, 900)))
        rows = readers.result_csv(spark, str(tmp_path), ["x", "y"]).collect()
        assert sorted((r["x"], r["y"]) for r in rows) == [(float(i), float(-i)) for i in range(900)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_registry_reports_what_is_missing(spark, tmp_path):
    (tmp_path / "one.csv").write_text("filename,offset_m\na,1\n")
    (tmp_path / "two.csv").write_text("offset_m,filename\n2,b\n")
    files = {m: str(tmp_path / f"{m}.csv") for m in ("one", "two", "three")}
    d, missing = readers.registry_csv(spark, files, ["offset_m"])
    assert missing == ["three"] and sorted((r["method"], r["filename"], r["offset_m"]) for r in d.collect()) == [("one", "a", 1.0), ("two", "b", 2.0)]
    with pytest.raises(FileNotFoundError):
        readers.registry_csv(spark, {"three": files["three"]}, [])


def test_every_module_is_imported_on_its_own():
    """One interpreter per module of the plans, and one for all others: no order of imports is needed."""
    mods = [".".join(p.relative_to(REPO).with_suffix("").parts) for p in sorted((REPO / "overfly").rglob("*.py")) if p.name != "__init__.py" and "llm" not in p.parts]
    plans = [m for m in mods if ".plans." in m]
    for each in [*[[m] for m in plans], [m for m in mods if m not in plans]]:
        subprocess.run([sys.executable, "-c", "; ".join(f"import {m}" for m in each)], cwd=REPO, check=True, timeout=120)


def test_array_archives_round_trip_in_slices(spark, tmp_path, monkeypatch):
    import numpy as np

    from overfly.sources import archives

    archives.register(spark)
    d = spark.range(1000).selectExpr("id", "cast(id as string) as name", "array(cast(id as float), cast(-id as float)) as v")
    archives.write_arrays(d, str(tmp_path / "a"), per_file=300)
    assert len(list((tmp_path / "a").glob("*.npz"))) == 4 and not list((tmp_path / "a").glob("_*"))
    back = spark.read.format("array_archive").load(str(tmp_path / "a"))
    assert sorted(map(tuple, back.select("id", "name", "v").collect())) == sorted(map(tuple, d.collect()))
    archives.write_arrays(d.filter("id < 10"), str(tmp_path / "a"))
    assert spark.read.format("array_archive").schema("id long").load(str(tmp_path / "a")).count() == 10
    # Compressed and other files; a small piece makes several partitions of one archive.
    (tmp_path / "b").mkdir()
    np.savez(tmp_path / "b" / "x.npz", id=np.arange(500), v=np.arange(1000.0).reshape(500, 2), unread=np.array([{"a": 1}], object))
    monkeypatch.setattr(archives, "PIECE", 2400)
    r = archives.ArrayReader(str(tmp_path / "b"), spark.createDataFrame([], "id long, v array<double>").schema)
    parts = r.partitions()
    assert len(parts) == 5
    rows = [x for p in parts for b in r.read(p) for x in b.to_pylist()]
    assert [x["id"] for x in rows] == list(range(500)) and rows[7]["v"] == [14.0, 15.0]
    np.savez_compressed(tmp_path / "b" / "x.npz", id=np.arange(500), v=np.arange(1000.0).reshape(500, 2))
    assert len(r.partitions()) == 1 and [x["v"][0] for b in r.read(r.partitions()[0]) for x in b.to_pylist()] == [2.0 * i for i in range(500)]
    with pytest.raises(ValueError, match="no array"):
        archives.ArrayReader(str(tmp_path / "b"), spark.createDataFrame([], "other long").schema).partitions()
    with pytest.raises(Exception, match="nulls"):
        archives.write_arrays(spark.createDataFrame([(1, None)], "id long, v array<float>"), str(tmp_path / "c"))
    assert not list(tmp_path.glob("c/*"))


def test_tar_members_in_pieces(spark, tmp_path, monkeypatch):
    from overfly.sources import archives

    rows = [("a.tar", "x/1.csv", b"q" * 2500), ("a.tar", "2.txt", b""), ("b.tar", "3.txt", b"three")]
    assert archives.write_tars(spark.createDataFrame(rows, "archive string, member string, content binary"), str(tmp_path)).count() == 2
    monkeypatch.setattr(archives, "PIECE", 1000)
    r = archives.TarReader(str(tmp_path), True)
    got = [x for p in r.partitions() for x in r.read(p)]
    assert [(m, size, part, len(c)) for _, m, size, part, c in got] == [("2.txt", 0, 0, 0), ("x/1.csv", 2500, 0, 1000), ("x/1.csv", 2500, 1, 1000), ("x/1.csv", 2500, 2, 500), ("3.txt", 5, 0, 5)]
    archives.register(spark)
    assert spark.read.format("tar_archive").load(str(tmp_path)).filter("content IS NOT NULL").count() == 0


def test_raster_headers_need_no_pixels(spark, tmp_path):
    from overfly.sources import archives

    pixels = bytes(range(200)) * 15
    (tmp_path / "m.tif").write_bytes(archives.raster(100, 30, pixels, (31.0, 115.0, 30.0, 116.0), strip_rows=7))
    archives.register(spark)
    h = spark.read.format("raster_header").load(str(tmp_path / "m.tif")).first()
    assert (h["width"], h["height"], h["bits"], h["compression"]) == (100, 30, 8, 1) and [round(h[c], 9) for c in ("top", "left", "bottom", "right")] == [31.0, 115.0, 30.0, 116.0]
    strips = sorted(spark.read.format("raster_strips").load(str(tmp_path)).collect(), key=lambda r: r["first_row"])
    assert [(r["first_row"], r["rows"]) for r in strips] == [(0, 7), (7, 7), (14, 7), (21, 7), (28, 2)] and b"".join(bytes(r["pixels"]) for r in strips) == pixels
    # The header is found although the pixels are cut out of the file's middle.
    raw = (tmp_path / "m.tif").read_bytes()

    class Only:
        def __init__(self):
            self.at, self.read_bytes = 0, 0

        def seek(self, i):
            self.at = i

        def read(self, n):
            self.read_bytes += n
            self.at += n
            return raw[self.at - n : self.at]

    f = Only()
    assert archives.raster_tags(f)["width"] == (100,) and f.read_bytes < 400
