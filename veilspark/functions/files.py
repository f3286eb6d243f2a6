"""Facts about files as expressions over path, length and content."""

from __future__ import annotations

from .sql import case, lit

# Format by extension, in lower case.
FORMATS = {
    ".csv": "csv", ".tsv": "tsv", ".json": "json", ".yaml": "yaml", ".yml": "yaml",
    ".xlsx": "excel", ".xls": "excel", ".parquet": "parquet", ".xml": "xml",
    ".txt": "text", ".md": "text", ".log": "text",
}

# Byte order marks and what they announce.
BYTE_ORDER_MARKS = (("EFBBBF", "utf-8-sig"), ("FFFE", "utf-16-le"), ("FEFF", "utf-16-be"))
DEFAULT_ENCODING = "utf-8"

# Fixed value: hash functions on offer.
HASHES = {"sha256": "sha2({v}, 256)", "sha512": "sha2({v}, 512)", "sha384": "sha2({v}, 384)",
          "sha224": "sha2({v}, 224)", "sha1": "sha1({v})", "md5": "md5({v})"}


def filename(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*)$', 1)"


def directory(path: str) -> str:
    return f"regexp_extract({path}, '^(.*)/[^/]*$', 1)"


def extension(path: str) -> str:
    """With the dot; empty for names that have none or only start with one."""
    return f"regexp_extract({path}, {lit(r'[^/]([.][^./]+)$')}, 1)"


def stem(path: str) -> str:
    return f"left({filename(path)}, length({filename(path)}) - length({extension(path)}))"


def parent_name(path: str) -> str:
    return filename(directory(path))


def format_of(path: str) -> str:
    """Data format by extension, NULL if unknown."""
    ext = f"lower({extension(path)})"
    return case([(f"{ext} = {lit(e)}", lit(f)) for e, f in FORMATS.items()])


def size_text(n: str) -> str:
    """Bytes for people, in binary units. Negative sizes are an error."""
    small = [(f"{n} < 0", "raise_error('size must not be negative')"),
             (f"{n} < 1024", f"concat({n}, ' B')")]
    shown = lambda unit, power: f"format_string('%.2f {unit}', bround({n} / {float(1024 ** power)}D, 2))"
    steps = [(f"{n} < {float(1024 ** (i + 2))}D", shown(unit, i + 1))
             for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"))]
    return case(small + steps, shown("PiB", 5))


def size_mb(n: str) -> str:
    return f"round({n} / 1048576D, 2)"


def content_hash(v: str, algorithm: str = "sha256") -> str:
    if algorithm not in HASHES:
        raise ValueError(f"unsupported hash algorithm: {algorithm}")
    return HASHES[algorithm].format(v=v)


def encoding_by_mark(content: str) -> str:
    """Encoding of bytes as far as marks and UTF-8 validity tell, else NULL; empty is the default."""
    marks = [(f"startswith({content}, X'{hexed}')", lit(enc)) for hexed, enc in BYTE_ORDER_MARKS]
    return case([(f"length({content}) = 0", lit(DEFAULT_ENCODING)), *marks,
                 (f"is_valid_utf8(CAST({content} AS STRING))", "'utf-8'")])


def audit_name(path: str, stamp: str) -> str:
    """Name of an audit record: stem without blanks, 50 characters, and a time stamp."""
    return f"concat('audit_', left(replace({stem(path)}, ' ', '_'), 50), '_', {stamp})"
