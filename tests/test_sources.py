import random
import struct
import zlib

import pytest

from tessera.functions import text as tx
from tessera.sources import files, images
from pyspark.sql import functions as F


def png(path, width, height, pixels, channels):
    kind = {1: 0, 3: 2, 4: 6}[channels]
    raw = b"".join(b"\0" + bytes(v for x in range(width) for v in pixels[y * width + x]) for y in range(height))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_to_pixels_and_back(spark, tmp_path):
    png(tmp_path / "rgb.png", 2, 2, [(255, 0, 0), (0, 255, 0), (0, 0, 255), (1, 2, 3)], 3)
    png(tmp_path / "grey.png", 1, 1, [(77,)], 1)
    (tmp_path / "bad.png").write_bytes(b"no image")
    table = images.explode_pixels(images.read_images(spark, str(tmp_path)))
    got = {(r.image_id, r.x, r.y): (r.r, r.g, r.b) for r in table.collect()}
    assert got == {("rgb.png", 0, 0): (255, 0, 0), ("rgb.png", 1, 0): (0, 255, 0), ("rgb.png", 0, 1): (0, 0, 255), ("rgb.png", 1, 1): (1, 2, 3), ("grey.png", 0, 0): (77, 77, 77)}
    images.write_pixels(table, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_alpha_is_laid_on_white(spark):
    raw = spark.createDataFrame([("a", 2, 1, 4, bytearray([10, 20, 30, 255, 10, 20, 30, 0]))], "image_id string, width int, height int, channels int, data binary")
    assert [(r.r, r.g, r.b) for r in images.explode_pixels(raw).orderBy("x").collect()] == [(30, 20, 10), (255, 255, 255)]


def test_decimation(spark):
    grid = spark.range(100).selectExpr("'i' AS image_id", "CAST(id % 10 AS INT) AS x", "CAST(id / 10 AS INT) AS y")
    assert images.decimated(grid, 5).count() == 25 and images.quality_limit(1) == 100 and images.quality_limit(10) == 1000


@pytest.fixture
def tree(tmp_path):
    for name in ("file1.txt", "file2.ts", "sub_dir/sub_file.txt", "sub_dir/nested_dir/deep_file.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("hello")
    return tmp_path


def test_listing(spark, tree):
    got = files.list_files(spark, str(tree)).orderBy("path").collect()
    assert [(r.path, r.parent, r.depth) for r in got] == [("file1.txt", "", 1), ("file2.ts", "", 1), ("sub_dir/nested_dir/deep_file.md", "sub_dir/nested_dir", 3), ("sub_dir/sub_file.txt", "sub_dir", 2)]
    read = files.read_files(spark, str(tree), max_size=3).collect()
    assert {r.error for r in read} == {"FILE_TOO_LARGE"}


def test_classification(spark):
    cases = [
        ("test.exe", b"x", tx.BINARY), ("image.jpg", b"x", tx.BINARY), ("compiled.wasm", b"x", tx.BINARY), ("test.txt", b"Hello\xff", tx.BINARY), ("control.dat", b"\x01" * 100, tx.BINARY),
        ("binary.dat", b"\x01\x02\x03\xff", tx.BINARY), ("text_with_nul.txt", b"some text\x00 and more", tx.CAVEATS), ("clean.txt", b"plain", tx.TEXT), ("app.log", b"plain\n", tx.TEXT), ("empty.txt", b"", tx.TEXT),
    ]
    df = spark.createDataFrame([(n, bytearray(c)) for n, c, _ in cases], "name string, content binary")
    got = {r.name: r.kind for r in df.select("name", tx.classify(F.col("content"), F.col("name")).alias("kind")).collect()}
    assert got == {n: k for n, _, k in cases}


def test_logs_and_benchmarks(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"timestamp": "2024-01-01T00:00:00", "level": "INFO", "message": "m", "duration_ms": 2.5}\nno json\n')
    rows = files.read_logs(spark, str(tmp_path / "log.json")).collect()
    assert rows[0].duration_ms == 2.5 and rows[1]._corrupt_record == "no json"
    bench = spark.createDataFrame([("2024-01-01 00:00:00", "cpu", 1, 2.5, 3, 4)], "timestamp string, device string, radius int, elapsed_ms double, width int, height int").withColumn("timestamp", F.to_timestamp("timestamp"))
    for _ in range(2):
        files.append_benchmarks(bench, str(tmp_path / "bench"))
    assert [r.radius for r in files.read_benchmarks(spark, str(tmp_path / "bench")).collect()] == [1, 1]
    files.append_logs(files.read_logs(spark, str(tmp_path / "log.json")).drop("_corrupt_record").filter("level is not null"), str(tmp_path / "logs"))
    assert spark.read.json(str(tmp_path / "logs")).count() == 1


def test_pixels_written_as_images_and_read_back(spark, tmp_path):
    rng = random.Random(4)
    sides = {"a.png": (5, 3), "b": (1, 1), "c.jpg": (16, 9)}
    rows = [(n, x, y, *(rng.randrange(256) for _ in range(3))) for n, (w, h) in sides.items() for x in range(w) for y in range(h)]
    gone = [r for r in rows if (r[0], r[1], r[2]) in {("a.png", 1, 1), ("a.png", 4, 1), ("c.jpg", 0, 0)} or (r[0] == "c.jpg" and r[2] == 4)]
    kept = [r for r in rows if r not in gone]
    df = spark.createDataFrame(kept, "image_id string, x int, y int, r int, g int, b int").repartition(3)
    for _ in range(2):  # writing again replaces the same files
        images.write_images(df, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith((".", "_"))) == ["a.bmp", "b.bmp", "c.bmp"]
    back = images.explode_pixels(images.read_images(spark, str(tmp_path / "out"))).collect()
    want = {(n.split(".")[0] + ".bmp", *rest) for n, *rest in kept} | {(n.split(".")[0] + ".bmp", x, y, 0, 0, 0) for n, x, y, *_ in gone}
    assert {tuple(r) for r in back} == want and len(back) == len(rows)
