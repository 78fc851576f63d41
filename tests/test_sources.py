"""Listing, extraction and image headers."""

import io
import os
import random
import struct
import zipfile

import pytest

from siltstone.errors import EngineError
from siltstone.sources import content as C
from siltstone.sources import listing as L

LIMITS = C.Limits(chunk_bytes=12, overlap_bytes=3)


def test_chunk_offsets():
    text = "資料abc夾脈絡 end"
    data = text.encode()
    got = C.split_text(text, LIMITS)
    assert [data[a:b].decode() for _, a, b in got] == [t for t, _, _ in got]
    assert got[0][1] == 0 and got[-1][2] == len(data) and all(b - a <= 12 for _, a, b in got)
    assert all(a < nb <= b for (_, a, b), (_, nb, _) in zip(got, got[1:]))  # windows overlap or touch, and advance


def test_chunk_rule_by_hand():
    # bytes: 4 characters of 3 bytes fill a window; the next starts 3 bytes back, on a character
    assert [(a, b) for _, a, b in C.split_text("一二三四五六", LIMITS)] == [(0, 12), (9, 18)]
    assert C.split_text("", LIMITS) == [] and C.split_text("abc", LIMITS) == [("abc", 0, 3)]
    assert [(a, b) for _, a, b in C.split_text("a" * 30, LIMITS)] == [(0, 12), (9, 21), (18, 30)]


def test_byte_order_mark_counts_in_offsets():
    assert C.utf8_chunks(b"\xef\xbb\xbfabc", LIMITS) == [("abc", 3, 6)]


def test_limits_give_no_partial_output():
    for limits, code in ((C.Limits(chunk_bytes=4, overlap_bytes=1, chunks=2), "extraction_chunk_limit_exceeded"), (C.Limits(chunk_bytes=4, overlap_bytes=1, output_bytes=9), "extraction_output_limit_exceeded")):
        with pytest.raises(C.ExtractionError) as e:
            C.split_text("x" * 20, limits)
        assert e.value.code == code
    with pytest.raises(C.ExtractionError) as e:
        C.utf8_chunks(b"\xff", LIMITS)
    assert e.value.code == "extraction_invalid_utf8"


def test_closed_form_equals_loop(spark):
    texts = [(i, "x" * n) for i, n in enumerate([0, 1, 4096, 4097, 7936, 7937, 12_500])] + [(90, None), (91, "é")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    a = sorted(tuple(r) for r in C.chunk_ascii(df).collect())
    b = sorted(tuple(r)[:5] for r in C.chunk_documents(df.filter("doc_id < 90")).collect())
    assert a == b and len(a) == 1 + 1 + 2 + 2 + 3 + 4


def test_chunks_of_mixed_text_rebuild_it(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("aé本\U0001f600 ") for _ in range(9000))
    rows = C.chunk_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("ordinal").collect()
    data, at = b"", 0
    for r in rows:
        data += r.text.encode()[at - r.byte_start :]
        at = r.byte_end
    assert data.decode() == text and [r.ordinal for r in rows] == list(range(len(rows)))


# ---- office documents


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


DOCX = office({"word/document.xml": f'<w:document xmlns:w="{C.WORD}"><w:body><w:p><w:r><w:t>First</w:t></w:r><w:r><w:tab/><w:t>part</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>第二段</w:t></w:r></w:p></w:body></w:document>'})
SLIDE = '<p:sld xmlns:p="p" xmlns:a="%s"><a:p><a:r><a:t>%s</a:t></a:r></a:p></p:sld>'
PPTX = office({f"ppt/slides/slide{n}.xml": SLIDE % (C.DRAWING, f"slide {n}") for n in (10, 2, 1)})
XLSX = office({
    "xl/sharedStrings.xml": f'<sst xmlns="{C.SHEET}"><si><t>shared</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>',
    "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{C.SHEET}"><sheetData><row><c r="A1" t="s"><v>1</v></c><c r="B1"><f>SUM(A1)</f><v>42</v></c><c r="C1" t="inlineStr"><is><t>inline</t></is></c><c r="D1"/></row></sheetData></worksheet>',
})


def test_office_units():
    assert list(C.office_units(DOCX, "docx")) == [("document_unit", 1, None, "First\tpart"), ("document_unit", 2, None, "第二段")]
    assert [x[1] for x in C.office_units(PPTX, "pptx")] == [1, 2, 10]
    assert [(x[2], x[3]) for x in C.office_units(XLSX, "xlsx")] == [("A1", "rich"), ("B1", "42"), ("C1", "inline")]


@pytest.mark.parametrize(
    "data,code",
    [
        (b"no zip", "extraction_malformed_document"), (office({"../x": "y"}), "extraction_archive_refused"), (office({"word/document.xml": "0" * 10_000_000}), "extraction_archive_refused"),
        (office({"word/document.xml": "<!DOCTYPE x [<!ENTITY a 'b'>]><x>&a;</x>"}), "extraction_xml_doctype_refused"), (office({"word/document.xml": "<a>" * 200}), "extraction_xml_limit_exceeded"),
    ],
)
def test_office_refusals(data, code):
    with pytest.raises(C.ExtractionError) as e:
        list(C.office_units(data, "docx"))
    assert e.value.code == code


def test_archives_are_counted_as_they_unpack(spark, tmp_path):
    words = lambda n: f'<w:document xmlns:w="{C.WORD}">' + "".join(f"<w:p><w:r><w:t>{i:x}</w:t></w:r></w:p>" for i in range(n)) + "</w:document>"
    small = C.Limits(unpacked_bytes=1000)
    assert len(list(C.office_units(office({"word/document.xml": words(5)}), "docx", small))) == 5

    def lying(data: bytes, claimed: int) -> bytes:  # the directory claims fewer bytes than the member unpacks to
        at = data.index(b"PK\x01\x02")
        return data[: at + 24] + struct.pack("<I", claimed) + data[at + 28 :]

    big = office({"word/document.xml": words(3000)})
    overlapping = office({"word/document.xml": words(5), "x": words(6)})
    second = overlapping.rindex(b"PK\x01\x02")
    overlapping = overlapping[: second + 42] + struct.pack("<I", 0) + overlapping[second + 46 :]
    flipped = bytearray(big)
    for i in range(120, 160):
        flipped[i] ^= 0x55
    cases = {
        "claims": (big, small, "extraction_decompression_limit_exceeded"), "lies": (lying(big, 900), small, None), "overlap": (overlapping, C.Limits(), "extraction_archive_refused"),
        "units": (office({"word/document.xml": words(100_001)}), C.Limits(), "extraction_ooxml_structure_limit_exceeded"), "flipped": (bytes(flipped), C.Limits(), "extraction_malformed_document"),
        "cut": (big[: len(big) // 2], C.Limits(), "extraction_malformed_document"), "good": (office({"word/document.xml": words(3)}), C.Limits(), "completed"),
        "parts": (office({f"ppt/slides/slide{n}.xml": SLIDE % (C.DRAWING, "x") for n in range(1025)}), C.Limits(), "extraction_archive_limit_exceeded"),
    }
    for name, (data, limits, code) in cases.items():
        rows = C._extract(f"{name}.pptx" if name == "parts" else f"{name}.docx", "office", data, limits)
        assert code in (None, rows[0].get("error_code"), rows[0]["status"]), (name, rows[0])
        assert name != "lies" or rows[0]["status"] == "failed"
        (tmp_path / f"{name}.docx").write_bytes(data)
    got = {os.path.basename(r.path): r.status for r in C.extract(C.read_files(spark, str(tmp_path))).select("path", "status").distinct().collect()}
    assert len(got) == len(cases) and got["flipped.docx"] == got["cut.docx"] == "failed" and got["good.docx"] == "completed"


# ---- images

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 1440, 900)
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 600, 800)
GIF = b"GIF89a" + struct.pack("<HH", 3, 4)
BMP = b"BM" + bytes(16) + struct.pack("<ii", 7, -9)
WEBP = b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
LOSSLESS = b"RIFF\0\0\0\0WEBPVP8L" + bytes(4) + b"\x2f" + struct.pack("<I", 31 | 15 << 14)
TIFF = b"II*\0" + struct.pack("<IHHHIHHHHII", 8, 2, 256, 3, 1, 640, 0, 257, 4, 1, 480)


@pytest.mark.parametrize("data,ext,want", [(PNG, "png", ("png", 1440, 900)), (JPEG, "jpg", ("jpeg", 800, 600)), (GIF, "gif", ("gif", 3, 4)), (BMP, "bmp", ("bmp", 7, 9)), (WEBP, "webp", ("webp", 100, 50)), (LOSSLESS, "webp", ("webp", 32, 16)), (TIFF, "tif", ("tiff", 640, 480))])
def test_image_headers(data, ext, want):
    assert C.image_header(data, ext) == want


@pytest.mark.parametrize("data,ext,code", [(PNG, "gif", "format_mismatch"), (PNG[:18], "png", "malformed"), (JPEG[:9], "jpeg", "malformed"), (PNG[:16] + struct.pack(">II", 100_000, 100_000), "png", "dimensions_invalid"), (GIF[:6] + bytes(4), "gif", "dimensions_invalid")])
def test_bad_images(data, ext, code):
    with pytest.raises(C.ExtractionError) as e:
        C.image_header(data, ext)
    assert code in e.value.code


def test_extraction_of_a_tree(spark, tmp_path):
    for name, data in {"a.md": "hello 本機".encode(), "b.png": PNG, "c.docx": DOCX, "d.bin": b"x", "e.txt": b"\xff\xfe", "f.pdf": b"%PDF", "g.txt": b""}.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in C.extract(C.read_files(spark, str(tmp_path))).collect():
        got.setdefault(os.path.basename(r.path), []).append(r)
    assert [(r.text, r.source_byte_start, r.source_byte_end) for r in got["a.md"]] == [("hello 本機", 0, 12)]
    assert (got["b.png"][0].image_format, got["b.png"][0].pixel_width, got["b.png"][0].pixel_height) == ("png", 1440, 900)
    assert [(r.ordinal, r.source_unit_number, r.source_fragment_index) for r in sorted(got["c.docx"], key=lambda r: r.ordinal)] == [(0, 1, 0), (1, 2, 0)]
    assert {k: v[0].error_code for k, v in got.items() if v[0].status == "failed"} == {"d.bin": "extraction_unsupported_media", "e.txt": "extraction_invalid_utf8", "f.pdf": "extraction_provider_unavailable"}
    assert "g.txt" not in got  # the reader makes no split of a file without content
    sizes = C.read_files(spark, str(tmp_path)).select("path", C.png_size(C.F.col("content")).alias("s")).filter("s is not null").collect()
    assert [(r.s.width, r.s.height) for r in sizes] == [(1440, 900)]


# ---- listing


def test_walk_rules(spark, tmp_path):
    root = tmp_path / "root"
    (root / "sub" / "deep").mkdir(parents=True)
    (root / "no").mkdir()
    for name in ("b.md", "a.md", ".hidden", "x.part", "sub/deep/c.txt", "no/secret.txt"):
        (root / name).write_text("x")
    (tmp_path / "outside.txt").write_text("o")
    (root / "link").symlink_to(tmp_path / "outside.txt")
    os.link(root / "a.md", root / "sub" / "hard.md")
    os.mkfifo(root / "pipe")
    df = L.listing(spark, str(root), frozenset({str(root / "no")}))
    got = {r.name: r for r in df.collect()}
    assert {k: r.issue_code for k, r in got.items() if r.issue_code} == {".hidden": "hidden_entry_excluded", "x.part": "temporary_download_excluded", "link": "symlink_not_followed", "pipe": "unsupported_entry_type"}
    assert got["no"].skipped and got["no"].issue_code is None and "secret.txt" not in got
    assert got["a.md"].identity_key == got["hard.md"].identity_key and got["a.md"].link_count == 2 and len(got["a.md"].identity_key) == 17
    assert got["c.txt"].kind == "file" and got["deep"].kind == "folder"
    files = [r.name for r in df.collect() if r.kind == "file"]
    assert files == ["a.md", "b.md", "c.txt", "hard.md"]  # in path order
    by_identity = {r.name for r in L.listing(spark, str(root), excluded_identities=frozenset({bytes(got["b.md"].identity_key)})).filter("kind = 'file'").collect()}
    assert "b.md" not in by_identity
    assert L.listing_by_spark(spark, str(root)).count() >= 4


def test_protected_roots():
    for bad in ("/", "/etc", "/etc/ssl", "/proc/1"):
        with pytest.raises(EngineError):
            L.check_root(bad)
    L.check_root("/home/someone/docs")


def test_tree_fixture_refuses_to_overwrite(tmp_path):
    L.tree_fixture(str(tmp_path / "t"), 20, 4)
    assert sum(len(f) for _, _, f in os.walk(tmp_path / "t")) == 20
    with pytest.raises(FileExistsError):
        L.tree_fixture(str(tmp_path / "t"), 1, 1)


def test_search_corpus(spark):
    from siltstone.operators import graph
    from siltstone.operators import search as S

    locations, chunks, edges = L.search_corpus(spark, 300, 10)
    count = lambda **k: S.search(S.Request(**k), locations, chunks).count()
    assert (count(query="本機文件搜尋"), count(query="project evidence"), count(query="document-00042.md"), count(query="no such phrase")) == (20, 20, 1, 0)
    scope = graph.descendants(edges, spark.createDataFrame([(5,)], "node_id long")).select("node_id")
    inside = S.search(S.Request("project evidence", source="content"), locations, chunks, scope).collect()
    assert len(inside) == 20 and {r.display_path.split("/")[2] for r in inside} == {"group-003"}


def test_strict_evaluation_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"case_id": "1", "text": "x"}')
    assert C.read_evaluation(spark, str(tmp_path / "a.json"), "case_id string, text string").count() == 1
    (tmp_path / "b.json").write_text('{"case_id": "1", "text": "x", "more": 1}')
    with pytest.raises(C.ExtractionError):
        C.read_evaluation(spark, str(tmp_path / "b.json"), "case_id string, text string")


def test_files_beyond_the_bound_fail_visibly(spark, tmp_path):
    (tmp_path / "small.txt").write_text("x")
    (tmp_path / "large.txt").write_text("x" * 100)
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.error_code) for r in C.extract(C.read_files(spark, str(tmp_path), max_bytes=50)).collect()}
    assert got == {"small.txt": ("completed", None), "large.txt": ("failed", "extraction_source_too_large")}


def test_texts_beyond_the_limits_give_an_error_row(spark):
    df = spark.createDataFrame([(1, "x" * 50), (2, "ok"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.error_code) for r in C.chunk_documents(df, limits=C.Limits(chunk_bytes=8, overlap_bytes=0, output_bytes=40)).collect())
    assert got == [(1, None, "extraction_output_limit_exceeded"), (2, "ok", None)]
