"""Writing finished batches: page images by the names of a manifest, or one searchable PDF for each batch, moved to their places when all are written."""

from __future__ import annotations

import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMATS = ("PDF", "TIFF", "JPG", "PNG")
#: First bytes of the formats that a page may come in.
MAGIC = {"JPG": (b"\xff\xd8\xff",), "PNG": (b"\x89PNG\r\n\x1a\n",), "TIFF": (b"II*\x00", b"MM\x00*")}
PAGES = "folder string, target string, place int, content binary, dpi int, words array<struct<text: string, x: double, baseline: double, size: double>>"


def kind_of(content: bytes) -> str | None:
    return next((k for k, heads in MAGIC.items() if content.startswith(heads)), None)


def png_chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        yield kind, content[at + 8 : at + 8 + size]
        at += size + 12


def with_density(content: bytes, dpi: int | None) -> bytes:
    """A JPEG or PNG file with its resolution stamped into it; others, and without a resolution, as they are."""
    if not dpi or dpi <= 0:
        return content
    if kind_of(content) == "JPG":
        if content[2:4] == b"\xff\xe0" and content[6:11] == b"JFIF\0":
            return content[:13] + struct.pack(">BHH", 1, dpi, dpi) + content[18:]
        return content[:2] + b"\xff\xe0" + struct.pack(">H5sHBHHBB", 16, b"JFIF\0", 0x0102, 1, dpi, dpi, 0, 0) + content[2:]
    if kind_of(content) == "PNG":
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        metre = round(dpi / 0.0254)
        parts = [chunk(k, d) for k, d in png_chunks(content) if k != b"pHYs"]
        return content[:8] + parts[0] + chunk(b"pHYs", struct.pack(">IIB", metre, metre, 1)) + b"".join(parts[1:])
    return content


def jpeg_size(content: bytes) -> tuple[int, int, int]:
    """Width, height and planes of a JPEG file, from its frame header."""
    at = 2
    while at + 9 < len(content):
        marker, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            _, height, width, planes = struct.unpack(">BHHB", content[at + 4 : at + 10])
            return width, height, planes
        at += 2 + size
    raise ValueError("no frame header in a JPEG file")


def pdf_image(content: bytes) -> tuple[int, int, bytes, bytes]:
    """Width, height, the entries of a PDF image and its data: JPEG data as they are, and the packed rows of a PNG file (grey or colour, 8 bits, not interlaced)."""
    space = lambda planes: {1: b"/DeviceGray", 3: b"/DeviceRGB", 4: b"/DeviceCMYK"}[planes]
    kind = kind_of(content)
    if kind == "JPG":
        width, height, planes = jpeg_size(content)
        return width, height, b"/ColorSpace %s /BitsPerComponent 8 /Filter /DCTDecode" % space(planes), content
    if kind == "PNG":
        chunks = list(png_chunks(content))
        width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[0][1])
        if depth == 8 and colour in (0, 2) and not interlaced:
            planes = 1 if colour == 0 else 3
            entries = b"/ColorSpace %s /BitsPerComponent 8 /Filter /FlateDecode /DecodeParms << /Predictor 15 /Colors %d /Columns %d >>" % (space(planes), planes, width)
            return width, height, entries, b"".join(d for k, d in chunks if k == b"IDAT")
    raise ValueError("a page of a PDF must be a JPEG file, or a PNG file of 8 bits that isn't interlaced and has no palette or alpha plane")


def page_content(width: int, height: int, words: list[Any]) -> bytes:
    """Drawing of a page: the image over the whole of it, and its words, unseen, where they stand; places are in pixels from the top."""
    out = [b"q %d 0 0 %d 0 0 cm /Im Do Q" % (width, height)]
    for w in words:
        text = w["text"].encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
        out.append(b"BT 3 Tr /F %.2f Tf %.2f %.2f Td (%s) Tj ET" % (w["size"], w["x"], height - w["baseline"], text))
    return b"\n".join(out)


class Pdf:
    """A PDF file written page by page: it holds the places of its objects, not the pages."""

    def __init__(self, out: BinaryIO):
        self.out, self.at, self.places, self.pages = out, 0, {}, []
        self.next = 4
        self._write(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n")
        self._object(3, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _object(self, number: int, body: bytes, data: bytes | None = None) -> None:
        self.places[number] = self.at
        self._write(b"%d 0 obj\n%s\n" % (number, body) + (b"stream\n%s\nendstream\n" % data if data is not None else b"") + b"endobj\n")

    def add(self, content: bytes, words: list[Any]) -> None:
        width, height, entries, data = pdf_image(content)
        drawing = zlib.compress(page_content(width, height, words))
        page, image, drawn = self.next, self.next + 1, self.next + 2
        self.next += 3
        self._object(image, b"<< /Type /XObject /Subtype /Image /Width %d /Height %d %s /Length %d >>" % (width, height, entries, len(data)), data)
        self._object(drawn, b"<< /Filter /FlateDecode /Length %d >>" % len(drawing), drawing)
        self._object(page, b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Contents %d 0 R /Resources << /XObject << /Im %d 0 R >> /Font << /F 3 0 R >> >> >>" % (width, height, drawn, image))
        self.pages.append(page)

    def close(self) -> None:
        self._object(1, b"<< /Type /Catalog /Pages 2 0 R >>")
        self._object(2, b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(self.pages), b" ".join(b"%d 0 R" % p for p in self.pages)))
        start = self.at
        self._write(b"xref\n0 %d\n0000000000 65535 f \n" % self.next + b"".join(b"%010d 00000 n \n" % self.places[i] for i in range(1, self.next)))
        self._write(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (self.next, start))


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (temporary, final)."""

    moves: list[tuple[str, str]] = field(default_factory=list)


class ExportWriter(DataSourceWriter):
    """Tasks write under a temporary folder of the job; the commit moves all files to their names, an abort removes them."""

    def __init__(self, path: str, file_format: str):
        self.path, self.format, self.job = path, file_format, uuid.uuid4().hex
        files, _, temporary = self._place()
        files.create_dir(temporary, recursive=True)  # here and not by tasks: one that still runs after an abort can't make it again

    def _place(self) -> tuple[fs.FileSystem, str, str]:
        files, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return files, base.rstrip("/"), f"{base.rstrip('/')}/_temporary-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, base, temporary = self._place()
        done = Written()

        def start(target: str) -> BinaryIO:
            done.moves.append((f"{temporary}/{uuid.uuid4().hex}", f"{base}/{target}"))
            return files.open_output_stream(done.moves[-1][0])

        pdf = stream = None
        try:
            for row in iterator:
                content = bytes(row["content"]) if row["content"] is not None else b""
                if not content:
                    raise ValueError(f"{row['target']}: no content")
                target = f"{row['folder']}/{row['target']}"
                if self.format == "PDF":
                    if pdf is None or done.moves[-1][1] != f"{base}/{row['folder']}.pdf":
                        if pdf is not None:
                            pdf.close()
                            stream.close()
                        stream = start(f"{row['folder']}.pdf")
                        pdf = Pdf(stream)
                    pdf.add(content, row["words"] or [])
                    continue
                if kind_of(content) != self.format:
                    raise ValueError(f"{target}: its content isn't {self.format}")
                with start(target) as out:
                    out.write(with_density(content, row["dpi"]))
            if pdf is not None:
                pdf.close()
                stream.close()
        except BaseException:
            if stream is not None:
                stream.close()
            self._remove(files, done)
            raise
        return done

    @staticmethod
    def _remove(files: fs.FileSystem, done: Written) -> None:
        for temporary, _ in done.moves:
            if files.get_file_info(temporary).type != fs.FileType.NotFound:
                files.delete_file(temporary)

    def commit(self, messages: list[Written | None]) -> None:
        files, _, temporary = self._place()
        for temporary_file, final in (m for w in messages if w for m in w.moves):
            files.create_dir(final.rsplit("/", 1)[0], recursive=True)
            files.move(temporary_file, final)
        if files.get_file_info(temporary).type != fs.FileType.NotFound:
            files.delete_dir(temporary)

    def abort(self, messages: list[Written | None]) -> None:
        files, _, temporary = self._place()
        for _ in range(20):  # tasks may be writing their last file
            try:
                if files.get_file_info(temporary).type != fs.FileType.NotFound:
                    files.delete_dir(temporary)
                return
            except OSError:
                time.sleep(0.1)


class ExportSource(DataSource):
    """df.write.format("leafmill_export").option("format", "PDF").save(folder), over PAGES."""

    @classmethod
    def name(cls) -> str:
        return "leafmill_export"

    def writer(self, schema: StructType, overwrite: bool) -> ExportWriter:
        wanted = self.options.get("format", "").strip().upper()
        if wanted not in FORMATS:
            raise ValueError(f"format {wanted}: not one of {', '.join(FORMATS)}")
        if missing := [c for c in ("folder", "target", "place", "content", "dpi", "words") if c not in schema.fieldNames()]:
            raise ValueError(f"columns missing: {', '.join(missing)}")
        return ExportWriter(self.options["path"], wanted)


def write_export(pages: DataFrame, path: str, file_format: str) -> None:
    """Writes `pages` (PAGES): TIFF, JPG and PNG as `folder`/`target` each, a PDF as `folder`.pdf with its pages by `place` and their words as unseen text. Other formats are refused.

    Content has to be of the format already (of a PDF: JPEG, or PNG without palette and alpha); JPG and PNG files get the resolution `dpi` stamped in, if there is one. Nothing stands under a final name until every task
    has written; a task that fails leaves nothing behind, and the others' files are removed. Existing files of these names are replaced. `path` is a folder that driver and executors share (a path, or a URI that pyarrow opens).
    A batch's pages go to one task as they must follow each other in a file; it holds one page at a time.
    """
    if file_format.strip().upper() not in FORMATS:
        raise ValueError(f"format {file_format}: not one of {', '.join(FORMATS)}")
    pages.sparkSession.dataSource.register(ExportSource)
    rows = pages.select("folder", "target", "place", "content", "dpi", "words")
    if file_format.strip().upper() == "PDF":
        rows = rows.repartition("folder").sortWithinPartitions("folder", "place", "target")
    rows.write.format("leafmill_export").option("format", file_format).mode("append").save(path)


def export_pages(manifest: DataFrame, contents: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """PAGES from a manifest (batch_id, idx, path, target, and dpi if known), the files' contents (path, content; as Spark's binaryFile reads them) and text placements (path, text, x, baseline, size; see T01).

    Files that can't be found have no content, which the sink refuses. Placements without size or text draw nothing.
    """
    out = manifest.join(contents.select("path", "content"), "path", "left")
    if words is None:
        out = out.withColumn("words", F.lit(None).cast("array<struct<text: string, x: double, baseline: double, size: double>>"))
    else:
        seen = words.where("size > 0 AND trim(text) <> ''").groupBy("path").agg(F.collect_list(F.struct("text", F.col("x").cast("double"), F.col("baseline").cast("double"), F.col("size").cast("double"))).alias("words"))  # a page's words
        out = out.join(seen, "path", "left")
    dpi = F.col("dpi").cast("int") if "dpi" in manifest.columns else F.lit(None).cast("int")
    return out.select(F.col("batch_id").cast("string").alias("folder"), "target", F.col("idx").cast("int").alias("place"), "content", dpi.alias("dpi"), "words")
