"""File facts, inventories and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.functions import files as fx
from veilspark.operators import inventory as inv
from veilspark.session import scratch, spread
from veilspark.sources.documents import oversized, redacted_name, write_documents
from veilspark.sources.documents import read_documents as documents_of
from veilspark.sources.tables import format_column

from .base import documents, query, table

# documents as files: a path, a length and bytes for each
SUFFIXES = (".txt", ".CSV", ".json", ".tar.gz", "", ".yaml", ".xlsx", ".log", ".png", ".tsv")
PATH = ("concat('/data/', lang, '/', source, '/doc ', doc_id, "
        f"element_at(array({', '.join(repr(s) for s in SUFFIXES)}), cast(doc_id % {len(SUFFIXES)} + 1 as int)))")
PATH_SQL = (f"'/data/' || lang || '/' || source || '/doc ' || doc_id || "
            f"([{', '.join(repr(s) for s in SUFFIXES)}])[doc_id % {len(SUFFIXES)} + 1]")


def _files(spark, sf_dir):
    return documents(spark, sf_dir, "lang", "source", "n_chars").select(
        "doc_id", F.expr(PATH).alias("path"), F.octet_length("text").cast("bigint").alias("length"),
        F.col("text").cast("binary").alias("content"))


FILES = f"(select doc_id, {PATH_SQL} as path, strlen(text) as length, text from documents)"
FORMAT_SQL = ("case lower(extension) when '.csv' then 'csv' when '.tsv' then 'tsv' when '.json' then 'json' "
              "when '.yaml' then 'yaml' when '.xlsx' then 'excel' when '.txt' then 'text' when '.log' then 'text' end")
PARTS = f"""(select *, length - length as z, regexp_extract(path, '^(.*)/[^/]*$', 1) as directory,
 regexp_extract(path, '([^/]*)$', 1) as filename, regexp_extract(path, '[^/](\\.[^./]+)$', 1) as extension from {FILES} f)"""


@query(f"""select path, directory, filename, left(filename, length(filename) - length(extension)) as stem, extension,
 regexp_extract(directory, '([^/]*)$', 1) as parent_dir_name, {FORMAT_SQL} as format from {PARTS} p""")
def format_of_path(spark, sf_dir):
    """Paths taken apart, and the data format each suffix stands for."""
    return inv.describe_paths(_files(spark, sf_dir).select("path"))


@query(r"""select url, regexp_extract(url, '^(.*)/[^/]*$', 1) as directory, regexp_extract(url, '([^/]*)$', 1) as filename,
 regexp_extract(url, '[^/](\.[^./]+)$', 1) as extension from pages""")
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages", "url").select(
        "url", F.expr(fx.directory("url")).alias("directory"), F.expr(fx.filename("url")).alias("filename"),
        F.expr(fx.extension("url")).alias("extension"))


@query("""select o_orderkey, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.2f KiB', n / 1024.0::double)
 when n < 1073741824 then printf('%.2f MiB', n / 1048576.0::double) when n < 1099511627776 then printf('%.2f GiB', n / 1073741824.0::double)
 when n < 1125899906842624 then printf('%.2f TiB', n / 1099511627776.0::double) else printf('%.2f PiB', n / 1125899906842624.0::double) end as size
from (select o_orderkey, o_orderkey * (case o_orderkey % 5 when 0 then 1 when 1 then 1000 when 2 then 1000000 when 3 then 1000000000 else 100000000000 end)::bigint as n from orders) x""")
def size_display(spark, sf_dir):
    """Sizes for people."""
    n = "o_orderkey * CASE o_orderkey % 5 WHEN 0 THEN 1L WHEN 1 THEN 1000L WHEN 2 THEN 1000000L WHEN 3 THEN 1000000000L ELSE 100000000000L END"
    return spread(table(spark, sf_dir, "orders", "o_orderkey")).withColumn("n", F.expr(n)) \
        .select("o_orderkey", F.expr(fx.size_text("n")).alias("size"))


@query("select doc_id, sha256(text) as sha256, md5(text) as md5, sha1(text) as sha1 from documents")
def content_hashes(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", *[F.expr(fx.content_hash("text", a)).alias(a) for a in ("sha256", "md5", "sha1")])


@query("""select doc_id, hash, copies, doc_id = first as is_first from (select doc_id, sha256(text) as hash,
 count(*) over (partition by text) as copies, min(doc_id) over (partition by text) as first from documents) d""")
def document_copies(spark, sf_dir):
    """Every document with its number of exact copies and whether it is the first."""
    hashed = documents(spark, sf_dir).select("doc_id", F.expr(fx.content_hash("text")).alias("hash"))
    return inv.with_copies(hashed, "hash", ["doc_id"])


@query("select sha256(text) as hash, count(*) as copies from documents group by 1 having count(*) > 1")
def duplicate_documents(spark, sf_dir):
    hashed = documents(spark, sf_dir).select(F.expr(fx.content_hash("text")).alias("hash"))
    return inv.duplicates(hashed, "hash")


@query(f"""select path, round(length / 1048576.0::double, 2) as size_mb from {FILES} f where length > cast(0.01 * 1048576 as bigint)""")
def oversized_files(spark, sf_dir):
    """Files beyond a size limit."""
    return oversized(_files(spark, sf_dir).drop("content"), max_mb=0.01)


@query(f"""select path from {PARTS} p where lower(extension) in ('.txt','.csv','.json','.xlsx','.log') and length <= cast(0.02 * 1048576 as bigint)""")
def scannable_files(spark, sf_dir):
    """Files a scan takes, by suffix and size."""
    return inv.scannable(_files(spark, sf_dir), max_mb=0.02).select("path")


@query(f"""select path from {FILES} f where length between 500 and 20000 and not regexp_matches(path, '\\.png$') and not regexp_matches(path, '/doc [^/]*\\.log$')""")
def found_files(spark, sf_dir):
    """Files narrowed by depth, excluded names and size."""
    return inv.find_files(_files(spark, sf_dir), "/data", max_depth=2, exclude=("*.png", "doc *.log"),
                          min_size=500, max_size=20000).select("path")


ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')"


@query(f"""select doc_id, case doc_id % 8 when 0 then 'utf-8-sig' when 1 then 'utf-16-le' when 2 then 'utf-16-be' when 5 then 'gbk'
 when 6 then case when length({ASCII}) % 2 = 1 then 'utf-16' else 'latin-1' end else 'utf-8' end as encoding from documents""")
def detected_encodings(spark, sf_dir):
    """Encodings told by byte order marks, by UTF-8 validity, and by trying others."""
    ascii_text = "regexp_replace(text, '[^\\\\x00-\\\\x7F]', '')"
    content = ("CASE doc_id % 8 WHEN 0 THEN concat(X'EFBBBF', encode(text, 'UTF-8')) WHEN 1 THEN concat(X'FFFE', encode(text, 'UTF-16LE')) "
               "WHEN 2 THEN concat(X'FEFF', encode(text, 'UTF-16BE')) WHEN 3 THEN X'' "
               f"WHEN 5 THEN concat(X'C4E3BAC3', CAST({ascii_text} AS BINARY)) WHEN 6 THEN concat(X'FF', CAST({ascii_text} AS BINARY)) "
               "ELSE encode(text, 'UTF-8') END")
    raw = documents(spark, sf_dir).select("doc_id", F.expr(content).alias("content"))
    return inv.with_encoding(raw).select("doc_id", "encoding")


@query(f"""select path, left(filename, length(filename) - length(extension)) || '_redacted' || extension as redacted,
 case when lower(extension) in ('.csv', '.sql', '.json') then substr(lower(extension), 2) end as table_format,
 'audit_' || left(replace(left(filename, length(filename) - length(extension)), ' ', '_'), 50) || '_20240101_000000' as audit_name from {PARTS} p""")
def output_names(spark, sf_dir):
    """Names of what a run writes, and the reader each file goes to."""
    return _files(spark, sf_dir).select(
        "path", F.expr(redacted_name("path")).alias("redacted"), F.expr(format_column("path")).alias("table_format"),
        F.expr(fx.audit_name("path", "'20240101_000000'")).alias("audit_name"))


SIZE_SQL = "case when length < 1024 then length || ' B' when length < 1048576 then printf('%.2f KiB', length / 1024.0::double) else printf('%.2f MiB', length / 1048576.0::double) end"


@query(f"""select path, directory, filename, left(filename, length(filename) - length(extension)) as stem, extension,
 regexp_extract(directory, '([^/]*)$', 1) as parent_dir_name, {FORMAT_SQL} as format, length, {SIZE_SQL} as size, sha256(text) as hash, 'utf-8' as encoding,
 count(*) over (partition by text) as copies, path = min(path) over (partition by text) as is_first from {PARTS} p""")
def file_inventory(spark, sf_dir):
    """Documents as files: path parts, format, size, hash, encoding, copies."""
    return inv.inventory(_files(spark, sf_dir).drop("doc_id"))


@query("select doc_id, text || chr(10) as text, strlen(text) + 1 as length, 'utf-8' as encoding, 'read' as status from documents")
def read_documents(spark, sf_dir):
    """Documents written as a tree of text files, found and read again."""
    path = scratch(spark, "tree")
    write_documents(documents(spark, sf_dir), path)
    doc_id = F.regexp_extract("path", "doc_id=(-?[0-9]+)_[0-9]+[.]txt$", 1).try_cast("bigint").alias("doc_id")
    return documents_of(spark, path).select(doc_id, "text", "length", "encoding", "status")
