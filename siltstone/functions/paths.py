"""Path and name functions: segment-safe containment, file names, media routing, version names, portable names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which extensions route to which kind of extraction.
MEDIA = {
    "plain_text": "txt text log csv tsv",
    "markdown": "md markdown mdown mkd mdx",
    "source_code": "rs c h cc cpp cxx hpp cs go java kt kts swift js jsx mjs cjs ts tsx py rb php sh bash zsh fish sql html htm css scss sass less json jsonl toml yaml yml xml",
    "pdf": "pdf",
    "office": "docx pptx xlsx",
    "image": "png jpg jpeg gif webp bmp tif tiff",
}
# Our own choice of categories; only a few cases of the seven are prescribed.
CATEGORIES = {
    "document": "md markdown mdown mkd mdx txt text log pdf docx pptx rtf odt html htm",
    "code": "rs c h cc cpp cxx hpp cs go java kt kts swift js jsx mjs cjs ts tsx py rb php sh bash zsh fish sql css scss sass less toml",
    "data": "csv tsv json jsonl yaml yml xml xlsx parquet",
    "image": "png jpg jpeg gif webp bmp tif tiff",
    "audio": "mp3 wav flac ogg m4a",
    "video": "mp4 mov mkv avi webm",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(c, UPPER, LOWER)


def filename(path: Column) -> Column:
    """The last segment, on either separator."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(name: Column) -> Column:
    """The lower-case extension of a name, or an empty string."""
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def is_under(child: Column, root: Column, separator: str = "/") -> Column:
    """Whether a path lies under a root or is it; segments count, so /a/bc is not under /a/b."""
    return F.startswith(child, root) & ((child == root) | F.endswith(root, F.lit(separator)) | (F.substring(child, F.char_length(root) + 1, F.lit(1)) == separator))


def ancestors(path: Column, separator: str = "/") -> Column:
    """The path and everything above it, so that containment can be an equi-join: a, a/b, a/b/c for a/b/c."""
    parts = F.split(path, "[" + ("\\\\" if separator == "\\" else separator) + "]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def is_hidden(name: Column) -> Column:
    return F.startswith(name, F.lit("."))


def is_temporary_download(name: Column) -> Column:
    return ascii_lower(name).rlike(r"\.(part|crdownload|download)$")


def _routed(ext: Column, table: dict[str, str], otherwise: str | None) -> Column:
    entries = [F.lit(x) for kind, exts in table.items() for e in exts.split() for x in (e, kind)]
    return F.coalesce(F.try_element_at(F.create_map(*entries), ext), F.lit(otherwise))


def media_kind(name: Column) -> Column:
    """The extraction that a file name routes to; null if none."""
    return _routed(extension(name), MEDIA, None)


def category(name: Column) -> Column:
    """One of seven categories, ``other`` if no extension says more."""
    return _routed(extension(name), CATEGORIES, "other")


def explicit_version(name: Column) -> Column:
    """struct(base, version, ext) of names such as plan-v2.md, or null.

    The stem ends in a separator (one of ``-_ .``), a v and 1 to 999,999 without leading zeros; what is before it, trimmed,
    is neither empty nor a version name itself; base of 1,024 and extension of 64 bytes at most; no path separator.
    """
    pattern = r"^(.*)[-_ .][vV]([1-9][0-9]{0,5})$"
    ext = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    stem = F.when(ext != "", F.substring(name, F.lit(1), F.char_length(name) - F.char_length(ext) - 1)).otherwise(name)
    base, number = F.trim(F.regexp_extract(stem, pattern, 1)), F.regexp_extract(stem, pattern, 2)
    good = (number != "") & (base != "") & ~base.rlike(pattern) & ~name.rlike(r"[/\\]") & (F.octet_length(base) <= 1024) & (F.octet_length(ext) <= 64)
    return F.when(good, F.struct(F.lower(base).alias("base"), number.cast("int").alias("version"), F.lower(ext).alias("ext")))


def portable_name(name: Column) -> Column:
    """Whether a name is valid on all common file systems: 1 to 255 bytes, no trailing space or dot, no control or reserved
    punctuation characters, no reserved device stem."""
    stem = F.upper(F.substring_index(name, ".", 1))
    device = stem.rlike("^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    return (F.octet_length(name).between(1, 255)) & ~name.rlike(r"[ .]$") & ~name.rlike(r'[\x00-\x1f\x7f<>:"/\\|?*]') & ~device & ~name.isin(".", "..")


def case_only_rename(a: Column, b: Column) -> Column:
    """Names that differ, but only in the case of A-Z: such a rename needs a staged strategy."""
    return (a != b) & (ascii_lower(a) == ascii_lower(b))


def cell_reference_valid(ref: Column) -> Column:
    """A1 to XFD1048576, without leading zeros."""
    letters = F.regexp_extract(ref, r"^([A-Z]{1,3})[1-9][0-9]{0,6}\z", 1)
    column = F.aggregate(F.split(letters, ""), F.lit(0), lambda a, x: a * 26 + F.when(x == "", F.lit(0)).otherwise(F.ascii(x) - 64))
    row = F.regexp_extract(ref, r"^[A-Z]{1,3}([1-9][0-9]{0,6})\z", 1)
    return (letters != "") & (column <= 16_384) & (F.coalesce(row.try_cast("int"), F.lit(0)).between(1, 1_048_576))


def comparison_key(path: Column, windows: bool = False) -> Column:
    """NFC of a path; on Windows in lower case as well."""
    from siltstone.functions.text import nfc

    key = nfc(path)
    return F.lower(key) if windows else key
