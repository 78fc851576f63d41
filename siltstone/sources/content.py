"""Content extraction: text, office documents, image headers and recognized text become chunks with exact provenance.

Files come by Spark's ``binaryFile`` reader (or any frame with path and content); each is routed by extension and decoded
on executors in Arrow batches. Text is cut into overlapping byte windows that never split a character.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.paths import filename, media_kind

BOM = b"\xef\xbb\xbf"


class ExtractionError(ValueError):
    """A file cannot be extracted; ``code`` says why."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Limits:
    chunk_bytes: int = 4096
    overlap_bytes: int = 256
    chunks: int = 2048
    output_bytes: int = 8 * 1024 * 1024
    source_bytes: int = 4 * 1024 * 1024
    unpacked_bytes: int = 8 * 1024 * 1024


def chunk_bounds(data: bytes, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """[start, end) byte windows. Ends and starts move back to a character's first byte; a start that would not advance
    becomes the previous end."""
    back = lambda i: next(k for k in range(i, -1, -1) if k == len(data) or data[k] & 0xC0 != 0x80)
    start = 0
    while start < len(data):
        end = min(start + size, len(data))
        if end < len(data):
            end = back(end) if back(end) > start else end
        yield start, end
        if end == len(data):
            return
        following = back(max(end - overlap, 0))
        start = following if following > start else end


def split_text(text: str, limits: Limits) -> list[tuple[str, int, int]]:
    """(text, start, end) chunks; raises when the chunks or their bytes, overlaps included, exceed the limits."""
    data, out, total = text.encode(), [], 0
    for a, b in chunk_bounds(data, limits.chunk_bytes, limits.overlap_bytes):
        total += b - a
        if len(out) >= limits.chunks:
            raise ExtractionError("extraction_chunk_limit_exceeded")
        if total > limits.output_bytes:
            raise ExtractionError("extraction_output_limit_exceeded")
        out.append((data[a:b].decode(), a, b))
    return out


def utf8_chunks(content: bytes, limits: Limits) -> list[tuple[str, int, int]]:
    """Chunks of strict UTF-8, offsets counted in the source, which may start with a byte-order mark."""
    if len(content) > limits.source_bytes:
        raise ExtractionError("extraction_source_too_large")
    shift = len(BOM) if content.startswith(BOM) else 0
    try:
        text = content[shift:].decode()
    except UnicodeDecodeError:
        raise ExtractionError("extraction_invalid_utf8") from None
    return [(t, a + shift, b + shift) for t, a, b in split_text(text, limits)]


CHUNKS = "doc_id long, ordinal long, text string, byte_start long, byte_end long, error_code string"


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits(chunks=65_536, output_bytes=64 * 1024 * 1024)) -> DataFrame:
    """(key, ordinal, text, byte_start, byte_end, error_code) of a table of texts; nulls and empty texts give no chunk, a
    text beyond the limits one row with the error's code and nothing else."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def chunks(key: int | None, text: str) -> list[tuple]:
        try:
            return [(key, i, *c, None) for i, c in enumerate(split_text(text, limits))]
        except ExtractionError as e:
            return [(key, None, None, None, None, e.code)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for k, t in zip(batch.column(0), batch.column(1), strict=True) for row in chunks(k.as_py(), t.as_py() or "")]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in CHUNKS.split(", ")])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, CHUNKS)


def chunk_ascii(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4096, overlap: int = 256) -> DataFrame:
    """The same for texts of one byte per character, by a closed form that stays in the JVM."""
    n = F.octet_length(text)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(1 + F.ceil((n - size) / (size - overlap))).cast("int")
    rows = docs.filter((F.octet_length(text) == F.char_length(text)) & (n > 0)).withColumn("_i", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("_i") * (size - overlap)
    return rows.select(
        F.col(key).cast("long").alias("doc_id"), F.col("_i").cast("long").alias("ordinal"), F.substring(F.col(text), start + 1, F.lit(size)).alias("text"),
        start.cast("long").alias("byte_start"), F.least(start + size, F.octet_length(text)).cast("long").alias("byte_end"),
    )


# ---- office documents -------------------------------------------------------------------------------------------

# Bounds on archives.
MAX_ENTRIES, MAX_RATIO, MAX_DEPTH, MAX_EVENTS, MAX_TEXT, MAX_SHARED = 4096, 200, 128, 1_000_000, 256 * 1024, 65_536
MAX_PARTS, MAX_UNITS, MAX_UNPACKED = 1024, 100_000, 64 * 1024 * 1024
WORD, DRAWING, SHEET = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


class _Events:
    """Namespaced start, text and end events of an XML part, within the bounds; document type declarations are refused."""

    def __init__(self, data: bytes, start, chars, end) -> None:
        self.depth = self.events = 0
        parser = expat.ParserCreate(namespace_separator="}")

        def count() -> None:
            self.events += 1
            if self.events > MAX_EVENTS:
                raise ExtractionError("extraction_xml_limit_exceeded")

        def on_start(tag: str, attrs: dict) -> None:
            count()
            self.depth += 1
            if self.depth > MAX_DEPTH or len(attrs) > 128:
                raise ExtractionError("extraction_xml_limit_exceeded")
            start(tag, attrs)

        def on_text(text: str) -> None:
            count()
            chars(text)

        def on_end(tag: str) -> None:
            self.depth -= 1
            end(tag)

        def refuse(*_) -> None:
            raise ExtractionError("extraction_xml_doctype_refused")

        parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = on_start, on_text, on_end, refuse
        try:
            parser.Parse(data, True)
        except expat.ExpatError:
            raise ExtractionError("extraction_malformed_document") from None


def _blocks(data: bytes, ns: str, block: str) -> list[str]:
    """The text of each block element: its text runs joined, tabs and breaks as white space."""
    out, runs, state = [], [], {"in": 0, "t": 0}

    def start(tag, attrs):
        if tag == f"{ns}}}{block}":
            state["in"] += 1
        elif tag == f"{ns}}}t":
            state["t"] += 1
        elif state["in"] and tag in (f"{ns}}}tab", f"{ns}}}br", f"{ns}}}cr"):
            runs.append("\t" if tag.endswith("}tab") else "\n")

    def chars(text):
        if state["in"] and state["t"]:
            runs.append(text)

    def end(tag):
        if tag == f"{ns}}}t":
            state["t"] -= 1
        elif tag == f"{ns}}}{block}":
            state["in"] -= 1
            if not state["in"]:
                text = "".join(runs)
                runs.clear()
                if len(text.encode()) > MAX_TEXT:
                    raise ExtractionError("extraction_text_node_too_large")
                if text.strip():
                    out.append(text)

    _Events(data, start, chars, end)
    return out


def _cells(data: bytes, shared: list[str]) -> list[tuple[str, str]]:
    """(reference, text) of cells: shared, inline and plain values; formulas themselves are ignored."""
    out, cell = [], {"ref": None, "kind": "", "field": "", "text": []}

    def start(tag, attrs):
        name = tag.rpartition("}")[2]
        if name == "c":
            cell.update(ref=attrs.get("r"), kind=attrs.get("t", ""), field="", text=[])
        elif cell["ref"] and name in ("v", "f", "t"):
            cell["field"] = name

    def chars(text):
        if cell["ref"] and (cell["field"] == "v" or (cell["field"] == "t" and cell["kind"] == "inlineStr")):
            cell["text"].append(text)

    def end(tag):
        name = tag.rpartition("}")[2]
        if name in ("v", "f", "t"):
            cell["field"] = ""
        elif name == "c" and cell["ref"]:
            text = "".join(cell["text"])
            if cell["kind"] == "s" and text:
                if not text.isdigit() or int(text) >= len(shared):
                    raise ExtractionError("extraction_malformed_document")
                text = shared[int(text)]
            if text.strip():
                if not re.fullmatch("[A-Z]{1,3}[1-9][0-9]{0,6}", cell["ref"]):
                    raise ExtractionError("extraction_malformed_document")
                out.append((cell["ref"], text))
            cell["ref"] = None

    _Events(data, start, chars, end)
    return out


class _Archive:
    """An office document's parts, read a piece at a time and counted over the whole archive, so that one that unpacks to more than it
    claims stops in the middle of a part. Sizes that members claim are judged before anything is read."""

    def __init__(self, content: bytes, limits: Limits) -> None:
        self.limits, self.unpacked, self.units = limits, 0, 0
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile:
            raise ExtractionError("extraction_malformed_document") from None
        infos = self.zip.infolist()
        self.names = {i.filename for i in infos}
        if len(infos) > MAX_ENTRIES or len(self.names) != len(infos):
            raise ExtractionError("extraction_archive_limit_exceeded")
        for i in infos:
            if i.flag_bits & 1 or i.file_size > MAX_RATIO * max(1, i.compress_size) or i.filename.startswith("/") or ".." in i.filename.split("/"):
                raise ExtractionError("extraction_archive_refused")
            if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ExtractionError("extraction_ooxml_compression_unsupported")
        if sum(i.file_size for i in infos) > min(4 * limits.unpacked_bytes, MAX_UNPACKED):
            raise ExtractionError("extraction_decompression_limit_exceeded")
        places = sorted((i.header_offset, i.header_offset + 30 + len(i.filename.encode()) + i.compress_size) for i in infos)
        if any(end > start for (_, end), (start, _) in zip(places, places[1:])):
            raise ExtractionError("extraction_archive_refused")  # members that share bytes

    def read(self, name: str) -> bytes:
        pieces = []
        with self.zip.open(name) as part:
            while piece := part.read(1 << 16):
                self.unpacked += len(piece)
                if self.unpacked > self.limits.unpacked_bytes:
                    raise ExtractionError("extraction_decompression_limit_exceeded")
                pieces.append(piece)
        return b"".join(pieces)

    def numbered(self, pattern: str) -> list[tuple[int, str]]:
        """(number, name) of the parts whose names match, in order."""
        found = sorted((int(m[1]), n) for n in self.names if (m := re.fullmatch(pattern, n)))
        if len(found) > MAX_PARTS:
            raise ExtractionError("extraction_archive_limit_exceeded")
        return found

    def counted(self, units: list) -> list:
        self.units += len(units)
        if self.units > MAX_UNITS:
            raise ExtractionError("extraction_ooxml_structure_limit_exceeded")
        return units


def office_units(content: bytes, ext: str, limits: Limits = Limits()) -> Iterator[tuple[str, int, str | None, str]]:
    """(provenance kind, unit number, cell reference, text) in document order; parts in numeric order."""
    archive = _Archive(content, limits)
    if ext == "docx":
        for n, text in enumerate(archive.counted(_blocks(archive.read("word/document.xml"), WORD, "p")), 1):
            yield "document_unit", n, None, text
    elif ext == "pptx":
        for n, name in archive.numbered(r"ppt/slides/slide(\d+)\.xml"):
            if texts := archive.counted(_blocks(archive.read(name), DRAWING, "p")):
                yield "slide", n, None, "\n".join(texts)
    else:
        shared = _shared(archive.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in archive.names else []
        for n, name in archive.numbered(r"xl/worksheets/sheet(\d+)\.xml"):
            for ref, text in archive.counted(_cells(archive.read(name), shared)):
                yield "cell", n, ref, text


def _shared(data: bytes) -> list[str]:
    out, runs, state = [], [], {"t": 0}

    def start(tag, attrs):
        if tag == f"{SHEET}}}t":
            state["t"] += 1

    def chars(text):
        if state["t"]:
            runs.append(text)

    def end(tag):
        if tag == f"{SHEET}}}t":
            state["t"] -= 1
        elif tag == f"{SHEET}}}si":
            out.append("".join(runs))
            runs.clear()
            if len(out) > MAX_SHARED:
                raise ExtractionError("extraction_archive_limit_exceeded")

    _Events(data, start, chars, end)
    return out


# ---- image headers ----------------------------------------------------------------------------------------------


def image_header(data: bytes, ext: str) -> tuple[str, int, int]:
    """(format, width, height) from the first bytes; the signature must be that of the extension."""
    kind = {"jpg": "jpeg", "tif": "tiff"}.get(ext, ext)
    try:
        size = _IMAGES[kind](data)
    except (struct.error, IndexError, KeyError):
        raise ExtractionError("extraction_malformed_image") from None
    if size is None:
        raise ExtractionError("extraction_image_format_mismatch")
    w, h = size
    if not (1 <= w <= 100_000 and 1 <= h <= 100_000 and w * h <= 500_000_000):
        raise ExtractionError("extraction_image_dimensions_invalid")
    return kind, w, h


def _png(d: bytes):
    return struct.unpack(">II", d[16:24]) if d[:8] == b"\x89PNG\r\n\x1a\n" and d[12:16] == b"IHDR" else None


def _gif(d: bytes):
    return struct.unpack("<HH", d[6:10]) if d[:6] in (b"GIF87a", b"GIF89a") else None


def _bmp(d: bytes):
    if d[:2] != b"BM":
        return None
    w, h = struct.unpack("<ii", d[18:26])
    return abs(w), abs(h)


def _jpeg(d: bytes):
    if d[:3] != b"\xff\xd8\xff":
        return None
    at = 2
    while True:
        if d[at] != 0xFF:
            raise IndexError
        marker = d[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker in (0x01, *range(0xD0, 0xD9)):
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", d[at + 5 : at + 9])
            return w, h
        else:
            at += 2 + struct.unpack(">H", d[at + 2 : at + 4])[0]


def _webp(d: bytes):
    if d[:4] != b"RIFF" or d[8:12] != b"WEBP":
        return None
    if d[12:16] == b"VP8X":
        return int.from_bytes(d[24:27], "little") + 1, int.from_bytes(d[27:30], "little") + 1
    if d[12:16] == b"VP8L":
        bits = struct.unpack("<I", d[21:25])[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if d[12:16] == b"VP8 " and d[23:26] == b"\x9d\x01\x2a":
        w, h = struct.unpack("<HH", d[26:30])
        return w & 0x3FFF, h & 0x3FFF
    raise IndexError


def _tiff(d: bytes):
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(d[:4])
    if order is None:
        return None
    at = struct.unpack(order + "I", d[4:8])[0]
    found = {}
    for i in range(struct.unpack(order + "H", d[at : at + 2])[0]):
        tag, kind, _ = struct.unpack(order + "HHI", d[at + 2 + 12 * i : at + 10 + 12 * i])
        if tag in (256, 257):
            value = d[at + 10 + 12 * i : at + 14 + 12 * i]
            found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), value[:2] if kind == 3 else value)[0]
    return found[256], found[257]


_IMAGES = {"png": _png, "gif": _gif, "bmp": _bmp, "jpeg": _jpeg, "webp": _webp, "tiff": _tiff}


def png_size(content: Column) -> Column:
    """struct(width, height) of PNG content by expressions alone; null for other content."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


# ---- extraction over a table of files ---------------------------------------------------------------------------

EXTRACTED = (
    "path string, media string, status string, error_code string, ordinal long, text string, provenance_kind string, source_byte_start long, source_byte_end long, "
    "source_unit_number long, source_cell_reference string, source_fragment_index long, image_format string, pixel_width int, pixel_height int"
)


def _extract(path: str, media: str | None, content: bytes, limits: Limits) -> list[dict]:
    row = {"path": path, "media": media, "status": "completed"}
    ext = path.rpartition(".")[2].lower()
    try:
        if media in ("plain_text", "markdown", "source_code"):
            return [row | {"ordinal": i, "text": t, "provenance_kind": "byte_range", "source_byte_start": a, "source_byte_end": b} for i, (t, a, b) in enumerate(utf8_chunks(content, limits))] or [row]
        if media == "office":
            out = []
            for kind, unit, ref, text in office_units(content, ext, limits):
                out += [row | {"ordinal": len(out) + i, "text": t, "provenance_kind": kind, "source_unit_number": unit, "source_cell_reference": ref, "source_fragment_index": i} for i, (t, _, _) in enumerate(split_text(text, limits))]
                if len(out) > limits.chunks:
                    raise ExtractionError("extraction_chunk_limit_exceeded")
            return out or [row]
        if media == "image":
            kind, w, h = image_header(content[: 2 * 1024 * 1024], ext)
            return [row | {"image_format": kind, "pixel_width": w, "pixel_height": h}]
        raise ExtractionError("extraction_provider_unavailable" if media == "pdf" else "extraction_unsupported_media")
    except ExtractionError as e:
        return [{"path": path, "media": media, "status": "failed", "error_code": e.code}]
    except (KeyError, zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):  # members that are damaged, cut off, encrypted or packed in an unknown way
        return [{"path": path, "media": media, "status": "failed", "error_code": "extraction_malformed_document"}]


def extract(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Chunks and image facts of files (path, content): a row for each chunk or image, or one that says why there is none.
    A file fails as a whole: no chunk of it appears beside an error."""

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in EXTRACTED.split(", "))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, media, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                if content.is_valid:
                    rows = _extract(path.as_py(), media.as_py(), content.as_py(), limits)
                else:  # too large to be read
                    rows = [{"path": path.as_py(), "media": media.as_py(), "status": "failed", "error_code": "extraction_source_too_large"}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", media_kind(filename(F.col("path"))).alias("media"), "content").mapInArrow(run, EXTRACTED)


def read_files(spark: SparkSession, root: str, max_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """(path, content) below a root; content is null, and never read, of files whose size in the metadata exceeds the bound."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    large = files.filter(F.col("length") > max_bytes).select("path", F.lit(None).cast("binary").alias("content"))
    return files.filter(F.col("length") <= max_bytes).select("path", "content").unionByName(large)


def read_evaluation(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSON: a malformed document fails, as does a field that the schema doesn't know."""
    known = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    extra = set(spark.read.option("multiLine", True).json(path).columns) - set(known.columns)
    if extra:
        raise ExtractionError("evaluation_unknown_field")
    return known
