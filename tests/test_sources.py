import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.sources import documents, images

rng = np.random.default_rng(4)


@pytest.mark.parametrize("channels", [1, 3])
@pytest.mark.parametrize("bits", [8, 16])
def test_formats_round_trip(channels, bits):
    a = rng.integers(0, 1 << bits, (7, 5, channels))
    for write, read in ((images.write_pnm, images.read_pnm), (images.write_png, images.read_png), (images.write_tiff, images.read_tiff), (lambda a, b: images.write_tiff(a, b, compressed=True), images.read_tiff)):
        got, b = read(write(a, bits))
        assert b == bits and (got == a).all()


def test_float_tiff_and_24_bits():
    a = rng.normal(0, 1, (4, 6, 3)).astype(np.float32)
    got, bits = images.read_tiff(images.write_tiff(a, 32, is_float=True))
    assert bits == 32 and (got == a).all()
    one = np.array([[0, 0, 63]], dtype="u1")  # exponent 63, no mantissa: 1
    assert images._float24(one, True)[0] == 1.0
    assert images._float24(one[:, ::-1], False)[0] == 1.0


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    a = rng.integers(0, 256, (6, 4, 3)).astype(np.int64)
    flat, rows = a.reshape(6, 12), []
    above = np.zeros(12, dtype=np.int64)
    for y in range(6):
        line = []
        for i in range(12):
            left, up, corner = flat[y, i - 3] if i >= 3 else 0, above[i], above[i - 3] if i >= 3 else 0
            p = left + up - corner
            paeth = sorted(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))[0][2]
            line.append((flat[y, i] - (0, left, up, (left + up) // 2, paeth)[kind]) & 255)
        rows.append(bytes([kind, *line]))
        above = flat[y]
    chunk = lambda k, x: struct.pack(">I", len(x)) + k + x + struct.pack(">I", zlib.crc32(k + x))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (images.read_png(data)[0] == a).all()


def test_read_images_by_extension(spark, tmp_path):
    a = rng.integers(0, 256, (3, 4, 3))
    (tmp_path / "in").mkdir()
    for name, data in (("a.png", images.write_png(a, 8)), ("in/b.PPM", images.write_pnm(a, 8)), ("c.tif", images.write_tiff(a, 8)), ("d.raw", b"x"), ("e.png", b"broken")):
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert len(rows) == 5
    for name in ("a.png", "b.PPM", "c.tif"):
        assert rows[name].error is None and rows[name].samples == a.ravel().tolist() and rows[name].height == 3
    assert rows["d.raw"].error == "unknown file type" and rows["e.png"].error
    written = images.encode_images(images.read_images(spark, str(tmp_path)).where("error IS NULL"), "png").collect()
    assert all((images.read_png(bytes(r.content))[0] == a).all() for r in written)


def test_scan_files(spark, tmp_path):
    for name in ("a.NEF", "x/b.nef", "x/y/c.nef", ".h/d.nef", "x/e.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1")
    names = lambda **k: {r.base for r in documents.scan_files(spark, str(tmp_path), ["nef"], **k).collect()}
    assert names() == {"a", "b", "c"} and names(max_depth=1) == {"a", "b"}


def test_parameters_rules_and_migration(spark, tmp_path):
    (tmp_path / "p.pp3").write_text("[Version]\nVersion=326\n\n[Exposure]\n# no\nAuto=false\nCompensation=1.5\nCompensation=2\nCurve=1;0;0.5;1;\n\n[rule 2]\niso_min=100\niso_max=50\nprofilepath=a.pp3\n[rule 1]\niso_min=100\niso_max=800\nprofilepath=b.pp3\n[rule 3]\niso_min=1\n")
    p = documents.read_parameters(spark, str(tmp_path / "p.pp3"))
    got = {(r.section, r.key): r.value for r in p.collect()}
    assert got["Exposure", "Compensation"] == "2" and got["Exposure", "Auto"] == "false" and len(got) == 11
    curve = p.where("key = 'Curve'").select(documents.values_list(F.col("value")).alias("v")).first().v
    assert curve == [1.0, 0.0, 0.5, 1.0]
    rules = [(r.serial, r.iso_min, r.iso_max, r.profilepath) for r in documents.read_rules(p).collect()]
    assert rules == [(1, 100.0, 800.0, "b.pp3"), (2, 0.0, 819200.0, "a.pp3")]
    m = documents.migrate(p, F.lit(300), [(310, "Exposure", "Compensation", "Comp"), (320, "Exposure", "Auto", None)], {"Comp": 2.0})
    now = {(r.section, r.key): r.value for r in m.collect()}
    assert now["Exposure", "Comp"] == "4.0" and ("Exposure", "Auto") not in now
    documents.write_parameters(p.select("section", "key", "value"), str(tmp_path / "out"))
    again = documents.read_parameters(spark, str(tmp_path / "out"))
    assert {(r.section, r.key): r.value for r in again.collect()} == got


def test_bad_pixels_queue_and_constants(spark, tmp_path):
    (tmp_path / "a.badpixels").write_text("2\n5 6\nwrong\n 7  8 \n")
    (tmp_path / "b.badpixels").write_text("1 2\n")
    rows = {(r.path.rsplit("/", 1)[1], r.y, r.x) for r in documents.read_bad_pixels(spark, f"{tmp_path}/*.badpixels").collect()}
    assert rows == {("a.badpixels", 8, 7), ("a.badpixels", 10, 9), ("b.badpixels", 2, 1)}
    jobs = spark.createDataFrame([("a.nef", "a.pp3", "o", "jpg", 92, 2, 8, 8, 0, 1, 1, 0, 0, 0)], documents.QUEUE)
    documents.write_queue(jobs, str(tmp_path / "queue"))
    assert documents.read_queue(spark, str(tmp_path / "queue")).collect() == jobs.collect()
    (tmp_path / "1.json").write_text('[{"make_model": "Maker X", "white": 100, "raw_crop": [1, 2]}, {"make_model": "B", "white": 5}]')
    (tmp_path / "2.json").write_text('[{"make_model": "MAKER x", "white": 200}]')
    got = {r.key: r for r in documents.read_constants(spark, [str(tmp_path / "1.json"), str(tmp_path / "2.json")]).collect()}
    assert got["MAKER X"].white == 200 and got["MAKER X"].raw_crop == [1, 2] and got["B"].white == 5


def test_lens_profiles(spark, tmp_path):
    (tmp_path / "l.xml").write_text("<db><lens><maker>A</maker><model>50</model><mount>M</mount><cropfactor>1.5</cropfactor></lens></db>")
    assert documents.read_lens_profiles(spark, str(tmp_path / "l.xml")).first().cropfactor == 1.5


def test_save_images_writes_whole_files(spark, tmp_path):
    a = rng.integers(0, 256, (3, 4, 1))
    df = spark.createDataFrame([(f"in/{k}.ppm", 4, 3, 1, [float(x) for x in a.ravel()]) for k in range(5)], "path string, width int, height int, channels int, samples array<float>").repartition(2)
    rows = images.save_images(df, str(tmp_path / "out"), "png").collect()
    assert len(rows) == 5 and sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"{k}.png" for k in range(5)]
    assert all((images.read_png(p.read_bytes())[0] == a).all() for p in (tmp_path / "out").iterdir())
    assert {r.bytes for r in rows} == {(tmp_path / "out/0.png").stat().st_size}


def test_sidecars_and_cache(spark):
    files = spark.createDataFrame([("d/a.nef", "d", "a", 5), ("d/b.nef", "d", "b", 9), ("e/a.nef", "e", "a", 1)], "path string, dir string, base string, modified long")
    side = spark.createDataFrame([("d/A.xmp", "d", "A")], "path string, dir string, base string")
    assert {r.path: r.sidecar for r in documents.with_sidecars(files, side).collect()} == {"d/a.nef": "d/A.xmp", "d/b.nef": None, "e/a.nef": None}
    cache = spark.createDataFrame([("d/a.nef", 5, 100), ("d/b.nef", 8, 200)], "path string, modified long, iso int")
    got = {r.path: (r.fresh, r.iso) for r in documents.reuse_cached(files, cache, ["iso"]).collect()}
    assert got == {"d/a.nef": (True, 100), "d/b.nef": (False, None), "e/a.nef": (False, None)}
