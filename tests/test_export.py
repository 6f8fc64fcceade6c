"""The export sink: files by their manifest's names, searchable PDFs, and nothing left behind by a failure."""

import re
import struct
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leafmill.sources import archive, export


def png(width, height, planes=3, value=7):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = (b"\0" + bytes([value]) * (width * planes)) * height
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if planes == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def jpeg(width, height):
    """A JPEG file's headers: enough for its size."""
    return b"\xff\xd8\xff\xe0" + struct.pack(">H5sHBHHBB", 16, b"JFIF\0", 0x0102, 0, 1, 1, 0, 0) + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, height, width, 3) + bytes(9) + b"\xff\xd9"


def pages(spark, rows):
    return spark.createDataFrame(rows, export.PAGES)


def listed(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file())


def test_images_by_the_manifests_names(spark, tmp_path):
    rows = [(f"b{i % 2}", f"B_Page_{i:06}.png", i, bytearray(png(3, 2, value=i)), 300, None) for i in range(6)]
    export.write_export(pages(spark, rows).repartition(3), str(tmp_path / "out"), "png")
    assert listed(tmp_path / "out") == sorted(f"{r[0]}/{r[1]}" for r in rows)
    data = (tmp_path / "out" / "b1" / "B_Page_000003.png").read_bytes()
    chunks = list(export.png_chunks(data))
    assert dict(chunks)[b"pHYs"] == struct.pack(">IIB", 11811, 11811, 1) and [k for k, _ in chunks] == [b"IHDR", b"pHYs", b"IDAT", b"IEND"]
    listing = archive.list_files(spark, str(tmp_path / "out")).select(F.element_at(F.split("path", "/"), -1).alias("path"), "length")
    assert archive.verify_export(pages(spark, rows).select("target"), listing).count() == 0
    export.write_export(pages(spark, [("b0", "B_Page_000000.png", 0, bytearray(png(9, 9)), None, None)]), str(tmp_path / "out"), "PNG")
    assert (tmp_path / "out" / "b0" / "B_Page_000000.png").read_bytes() == png(9, 9) and len(listed(tmp_path / "out")) == 6


def test_density_of_jpeg_files():
    data = export.with_density(jpeg(30, 20), 285)
    assert struct.unpack(">BHH", data[13:18]) == (1, 285, 285) and export.jpeg_size(data) == (30, 20, 3) and len(data) == len(jpeg(30, 20))
    bare = jpeg(30, 20)[:2] + jpeg(30, 20)[20:]
    assert export.jpeg_size(export.with_density(bare, 200)) == (30, 20, 3) and export.with_density(bare, None) == bare


def test_a_pdf_for_each_batch(spark, tmp_path):
    words = [("Hello (x)", 5.0, 15.0, 9.0), ("naïve 日", 1.0, 18.0, 3.0)]
    rows = [("one", "t", 2, bytearray(png(40, 20, 1)), None, None), ("one", "t", 1, bytearray(jpeg(30, 20)), None, words), ("two", "t", 1, bytearray(png(4, 4)), None, None)]
    export.write_export(pages(spark, rows).repartition(3), str(tmp_path), "PDF")
    assert listed(tmp_path) == ["one.pdf", "two.pdf"]
    data = (tmp_path / "one.pdf").read_bytes()
    start = int(re.search(rb"startxref\n(\d+)\n%%EOF", data)[1])
    size = int(re.match(rb"xref\n0 (\d+)\n", data[start:])[1])
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n ", data[start:])]
    assert len(places) == size - 1 and all(data[at:].startswith(b"%d 0 obj" % (i + 1)) for i, at in enumerate(places))
    assert re.findall(rb"/MediaBox \[0 0 (\d+) (\d+)\]", data) == [(b"30", b"20"), (b"40", b"20")] and b"/Count 2" in data  # by place
    drawn = [zlib.decompress(m[1]) for m in re.finditer(rb"/Filter /FlateDecode /Length \d+ >>\nstream\n(.*?)\nendstream", data, re.S) if m[1][:1] == b"x" and b"cm /Im Do" in zlib.decompress(m[1])]
    assert b"BT 3 Tr /F 9.00 Tf 5.00 5.00 Td (Hello \\(x\\)) Tj ET" in drawn[0] and "naïve ?".encode("cp1252") in drawn[0] and b"BT" not in drawn[1]


@pytest.mark.parametrize("bad", [b"", b"%PDF no image", jpeg(3, 3)])
def test_a_failing_task_leaves_nothing_behind(spark, tmp_path, bad):
    rows = [("b", f"{i}.png", i, bytearray(png(3, 2)), None, None) for i in range(8)] + [("b", "bad.png", 9, bytearray(bad), None, None)]
    (tmp_path / "out" / "b").mkdir(parents=True)
    (tmp_path / "out" / "b" / "0.png").write_bytes(b"old")
    with pytest.raises(Exception, match="no content|content isn't PNG"):
        export.write_export(pages(spark, rows).repartition(4), str(tmp_path / "out"), "PNG")
    assert listed(tmp_path / "out") == ["b/0.png"] and (tmp_path / "out" / "b" / "0.png").read_bytes() == b"old"
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["b"]


def test_formats_and_missing_files(spark, tmp_path):
    with pytest.raises(ValueError, match="GIF"):
        export.write_export(pages(spark, []), str(tmp_path / "out"), "GIF")
    manifest = spark.createDataFrame([(1, 1, "a.png", "B_Page_000001.png", 150), (1, 2, "gone.png", "B_Page_000002.png", 150)], "batch_id long, idx int, path string, target string, dpi int")
    contents = spark.createDataFrame([("a.png", bytearray(png(2, 2)))], "path string, content binary")
    words = spark.createDataFrame([("a.png", "w", 1.0, 2.0, 3.0), ("a.png", "flat", 1.0, 2.0, 0.0)], "path string, text string, x double, baseline double, size double")
    made = {r["place"]: r for r in export.export_pages(manifest, contents, words).collect()}
    assert [w["text"] for w in made[1]["words"]] == ["w"] and made[2]["content"] is None and made[1]["dpi"] == 150
    with pytest.raises(Exception, match="no content"):
        export.write_export(export.export_pages(manifest, contents), str(tmp_path / "out"), "PNG")
    export.write_export(export.export_pages(manifest.where("idx = 1"), contents), str(tmp_path / "out"), "PNG")
    assert listed(tmp_path / "out") == ["1/B_Page_000001.png"]
