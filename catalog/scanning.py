"""Scan, overlap, redaction, report and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.functions.spans import overlaps_loosely, overlaps_strictly, redact
from veilspark.functions.detectors import parse_model_findings
from veilspark.operators import audit, chunking, overlap, report
from veilspark.operators.detect import explode_findings, marked_findings, model_replies, raw_findings, scan, scan_with_model
from veilspark.session import checkpoint, scratch, spread
from veilspark.sources.documents import findings_export, redacted_documents
from veilspark.sources.tables import row_text

from . import oracle as o
from .base import CONTACT_COLUMNS, CONTACTS, contacts, documents, query, table

KEPT_COLUMNS = 'k as doc_id, category, type, match, start, "end"'


@query(lambda: o.scan("documents", "doc_id", "text", f"select {KEPT_COLUMNS} from kept"))
def scan_findings(spark, sf_dir):
    """Every finding of every document, overlaps resolved."""
    return explode_findings(scan(documents(spark, sf_dir), "text"), "doc_id") \
        .select("doc_id", "category", "type", "match", "start", "end")


@query(lambda: o.scan("pages", "page_id", "html", 'select k as page_id, type, match, start, "end" from kept'))
def scan_pages(spark, sf_dir):
    """Findings in raw web pages, markup and all."""
    pages = spread(table(spark, sf_dir, "pages", "page_id", "html"))
    return explode_findings(scan(pages, "html"), "page_id").select("page_id", "type", "match", "start", "end")


def _texts(spark, sf_dir):
    """Every text table as one stream of (source, key, text)."""
    parts = [("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("benchmark", "item_id", "text"),
             ("conversations", "conv_id * 1000 + turn", "text")]
    frames = [table(spark, sf_dir, t).select(F.lit(t).alias("source"), F.expr(k).alias("id"), F.col(c).alias("text"))
              for t, k, c in parts]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return spread(out)


TEXTS = """(select 'documents' as source, doc_id as id, text from documents
 union all select 'pages', page_id, html from pages
 union all select 'benchmark', item_id, text from benchmark
 union all select 'conversations', conv_id * 1000 + turn, text from conversations)"""


@query(lambda: o.scan("documents", "doc_id", "text",
                      "select category, type, count(*) as n from kept group by all"))
def scan_stats_by_type(spark, sf_dir):
    return report.totals(scan(documents(spark, sf_dir), "text"), "category", "type")


@query(lambda: o.scan("documents", "doc_id", "text", "select category, count(*) as n from kept group by all"))
def scan_stats_by_category(spark, sf_dir):
    return report.totals(scan(documents(spark, sf_dir), "text"), "category")


@query(lambda: o.scan("documents", "doc_id", "text",
                      "select 'regex' as method, count(*) as n from kept group by all"))
def scan_stats_by_method(spark, sf_dir):
    return report.totals(scan(documents(spark, sf_dir), "text"), "method")


@query(lambda: o.scan(TEXTS, "source || ':' || id", "text", """
select split_part(k, ':', 1) as source, category, count(*) as n from kept
group by rollup (split_part(k, ':', 1), category)"""))
def scan_stats_rollup(spark, sf_dir):
    """Findings over all text tables, with subtotals per table and a grand total."""
    return report.rollup(scan(_texts(spark, sf_dir), "text"), "source")


@query(lambda: o.scan(TEXTS, "source || ':' || id", "text", """
, per as (select src.k, any_value(length(src.text)) as chars, count(kept.k) as n
    from src left join kept on kept.k = src.k group by src.k)
select split_part(k, ':', 1) as source, count(*) as documents, count(*) filter (where n > 0) as with_findings,
 cast(sum(n) as bigint) as findings, cast(sum(chars) as bigint) as scanned_chars from per group by 1""".lstrip("\n")))
def scan_totals(spark, sf_dir):
    """Per text table: documents, documents with findings, findings, characters."""
    scanned = scan(_texts(spark, sf_dir), "text")
    n = F.size("findings")
    return scanned.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(n > 0).alias("with_findings"),
        F.sum(n).alias("findings"), F.sum(F.length("text")).alias("scanned_chars"))


REPORT = """
, per as (select k, category, count(*) as n from kept group by all),
top as (select k, sum(n) as total, string_agg(case when r <= 3 then category || ' (' || n || ')' end, ', ' order by r) as categories
    from (select *, row_number() over (partition by k order by n desc, category) as r from per) group by k)
select src.k as doc_id, cast(coalesce(total, 0) as integer) as total, coalesce(categories, 'clean') as categories
from src left join top on top.k = src.k""".lstrip("\n")


@query(lambda: o.scan("documents", "doc_id", "text", REPORT))
def doc_report(spark, sf_dir):
    """Every document with its count and top three categories; clean ones too."""
    return report.document_report(scan(documents(spark, sf_dir), "text"), "doc_id")


@query(lambda: o.scan("documents", "doc_id", "text", """
select src.k as doc_id, any_value(length(src.text))::integer as scanned_chars, cast(count(kept.k) as integer) as total,
 coalesce(max(case when kept.k is not null then 'regex' end), '') as methods
from src left join kept on kept.k = src.k group by src.k"""))
def document_stats(spark, sf_dir):
    """Per document: findings, scanned characters and the detectors that fired."""
    stats = report.document_stats(scan(documents(spark, sf_dir), "text"), "doc_id")
    return stats.select("doc_id", "scanned_chars", "total",
                        F.expr(report.method_label("by_method")).alias("methods"))


@query(lambda: o.scan("documents", "doc_id", "text", """
, per as (select src.k, count(kept.k) as n from src left join kept on kept.k = src.k group by src.k)
select quality, toxic, count(*) as documents, count(*) filter (where n > 0) as with_findings, cast(sum(n) as bigint) as findings
from labels join per on per.k = labels.doc_id group by all""".lstrip("\n")))
def labelled_report(spark, sf_dir):
    """Findings by the labels some documents carry; labelled documents without findings count."""
    labelled = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    per = report.document_report(scan(labelled, "text"), "doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    return (per.groupBy("quality", "toxic").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("total") > 0).alias("with_findings"),
        F.sum("total").alias("findings")))


SAMPLE = """
, r as (select *, row_number() over (partition by k order by start, start - "end", rank) as nr,
    count(*) over (partition by k) as total from kept)
select k as doc_id, cast(nr as integer) as rank, category, replace(left(match, 60), chr(10), '\\n') as snippet,
 cast(greatest(total - 5, 0) as integer) as more from r where nr <= 5""".lstrip("\n")


@query(lambda: o.scan("documents", "doc_id", "text", SAMPLE))
def sample_findings(spark, sf_dir):
    """The first five findings of every document."""
    return report.sample_findings(scan(documents(spark, sf_dir), "text"), "doc_id").drop("confidence")


@query(lambda: o.scan("documents", "doc_id", "text", SAMPLE + " and k = (select min(k) from kept)"))
def first_sample(spark, sf_dir):
    """The same for the first document that has findings."""
    return report.first_sample(scan(documents(spark, sf_dir), "text"), "doc_id").drop("confidence")


# --- overlaps ---------------------------------------------------------------

@query(lambda: o.scan(CONTACTS, "contact_id", "notes",
                      'select k as contact_id, type, match, start, "end" from kept'))
def dedup_overlaps(spark, sf_dir):
    """Findings left standing where patterns claim the same text."""
    marked = marked_findings(contacts(spark, sf_dir), "notes")
    return overlap.kept_findings(marked, "contact_id").select("contact_id", "type", "match", "start", "end")


@query(lambda: o.scan(CONTACTS, "contact_id", "notes",
                      'select k as contact_id, type, match, start, "end" from marked where not kept'))
def dropped_findings(spark, sf_dir):
    """Findings that gave way."""
    marked = marked_findings(contacts(spark, sf_dir), "notes")
    return overlap.dropped_findings(marked, "contact_id").select("contact_id", "type", "match", "start", "end")


@query(lambda: o.scan(CONTACTS, "contact_id", "notes", """
select a.k as contact_id, a.type as type_a, a.start as start_a, a."end" as end_a,
 b.type as type_b, b.start as start_b, b."end" as end_b
from found a join found b on a.k = b.k and (a.start, -a."end", a.type) < (b.start, -b."end", b.type)
 and a.start < b."end" - 2 and b.start < a."end" - 2"""))
def overlap_pairs(spark, sf_dir):
    """Which findings collide with which."""
    return overlap.overlap_pairs(raw_findings(contacts(spark, sf_dir), "notes"), "contact_id")


@query(lambda: o.scan(CONTACTS, "contact_id", "notes", """
, pairs as (select *, lag(start) over w as s, lag("end") over w as e from found
    window w as (partition by k order by start, start - "end", rank))
select k as contact_id, start, "end", type, (s < "end" - 2 and start < e - 2) as loosely,
 greatest(s, start) < least(e, "end") as strictly from pairs where s is not null""".lstrip("\n")))
def overlap_predicates(spark, sf_dir):
    """Both overlap tests between each finding and the one before it."""
    found = raw_findings(contacts(spark, sf_dir), "notes").select("contact_id", "findings")
    pairs = found.select("contact_id", F.explode(F.expr(
        "transform(sequence(1, greatest(size(findings) - 1, 1)), i -> named_struct("
        "'a', get(findings, i - 1), 'b', get(findings, i)))")).alias("p")).where("p.b IS NOT NULL")
    spans = ("p.a.start", "p.a.`end`", "p.b.start", "p.b.`end`")
    return pairs.select("contact_id", "p.b.start", "p.b.end", "p.b.type",
                        F.expr(overlaps_loosely(*spans)).alias("loosely"),
                        F.expr(overlaps_strictly(*spans)).alias("strictly"))


# --- redaction --------------------------------------------------------------

def _redact(spark, sf_dir, style):
    return scan(documents(spark, sf_dir), "text").select(
        "doc_id", F.expr(redact("text", "findings", style)).alias("redacted"))


@query(lambda: o.redacted("documents", "doc_id", "text", "'[REDACTED]'"))
def redact_block(spark, sf_dir):
    return _redact(spark, sf_dir, "block")


@query(lambda: o.redacted("documents", "doc_id", "text", "'[' || upper(type) || ']'"))
def redact_placeholder(spark, sf_dir):
    return _redact(spark, sf_dir, "placeholder")


@query(lambda: o.redacted("documents", "doc_id", "text", "repeat('X', length(match))"))
def redact_mask(spark, sf_dir):
    return _redact(spark, sf_dir, "mask")


@query(lambda: o.redacted("documents", "doc_id", "text", o.partial_redaction("match", "type")))
def redact_partial(spark, sf_dir):
    return _redact(spark, sf_dir, "partial")


@query(lambda: o.redacted("documents", "doc_id", "text", "'[REDACTED]'"))
def redact_unknown_style(spark, sf_dir):
    """A style nobody knows behaves like block."""
    return _redact(spark, sf_dir, "shred")


@query(lambda: o.redacted(CONTACTS, "contact_id", "notes", "'[' || upper(type) || ']'"))
def redact_overlapping(spark, sf_dir):
    """Redaction where patterns overlap."""
    return scan(contacts(spark, sf_dir), "notes").select(
        "contact_id", F.expr(redact("notes", "findings", "placeholder")).alias("redacted"))


@query(lambda: o.redacted("documents", "doc_id", "text", "'[REDACTED]'", having=True))
def redacted_sink(spark, sf_dir):
    """Only documents in which something was found get a redacted copy."""
    return redacted_documents(scan(documents(spark, sf_dir), "text"), "doc_id")


KINDS = ("email", "phone_us", "phone", "ssn", "cn_id", "credit_card", "name", "ipv4", "ipv6", "address",
         "location", "generic")


@query(lambda: f"""select contact_id, kind, v, {o.partial_redaction('v', 'kind')} as masked from (
select contact_id, unnest([full_name, email, phone, ssn, credit_card, ip_address, salary, remark]) as v
from {CONTACTS} c) u, (select unnest({list(KINDS)}) as kind) k where v is not null and v <> ''""")
def redact_partial_all_types(spark, sf_dir):
    """The partial rule of every type on every kind of cell."""
    from veilspark.functions.redaction import partial_redaction
    cells = contacts(spark, sf_dir).select("contact_id", F.explode(F.array(
        "full_name", "email", "phone", "ssn", "credit_card", "ip_address", "salary", "remark")).alias("v"))
    typed = cells.where("v <> ''").withColumn("kind", F.explode(F.array(*map(F.lit, KINDS))))
    return typed.withColumn("masked", F.expr(partial_redaction("v", "kind")))


# --- chunks, rows, models ---------------------------------------------------

@query(lambda: o.scan("documents", "doc_id", "text", 'select k as doc_id, type, match, start, "end" from kept'))
def chunk_scan(spark, sf_dir):
    """Documents scanned in chunks of equal stride; equals the scan of whole texts."""
    chunks = chunking.stride_chunks(documents(spark, sf_dir), "text", 2000, 200)
    return chunking.scan_chunks(chunks, "doc_id").select("doc_id", "type", "match", "start", "end")


def _rfind(window: str, mark: str) -> str:
    """0-based position of the last occurrence, -1 if there is none."""
    w = f"reverse({window})"
    return (f"case when position(reverse({mark}) in {w}) = 0 then -1 "
            f"else length({window}) - position(reverse({mark}) in {w}) - length({mark}) + 1 end")


BOUNDARY = f"""with recursive cut as (
select doc_id, text, 0 as a, case when text = '' then 0 else -1 end as b from documents
union all
select doc_id, text, case when b < 0 then 0 else b - 200 end,
 (select case when length(text) <= start + 2000 then length(text)
   when para > 1000 then start + para + 2 when sent > 1000 then start + sent + 1 else start + 2000 end
  from (select start, {_rfind('w', "chr(10) || chr(10)")} as para,
   greatest({_rfind('w', "'. '")}, {_rfind('w', "'.' || chr(10)")}, {_rfind('w', "'? '")}, {_rfind('w', "'! '")}) as sent
   from (select start, substr(text, start + 1, 2000) as w from (select case when b < 0 then 0 else b - 200 end as start) s1) s2) s3)
from cut where b < length(text))
select doc_id, cast(a as integer) as chunk_start, substr(text, a + 1, b - a) as chunk from cut where b > 0"""


@query(BOUNDARY)
def boundary_chunks(spark, sf_dir):
    """Documents cut into overlapping chunks at paragraph or sentence ends."""
    return chunking.boundary_chunks(documents(spark, sf_dir), "text").drop("text")


ROW_TEXT = ", ".join(f"coalesce(cast({c} as varchar), '')" for c in CONTACT_COLUMNS)


@query(lambda: o.scan(f"(select contact_id, concat_ws(' | ', {ROW_TEXT}) as text from {CONTACTS} c)", "contact_id",
                      "text", 'select k as contact_id, type, match, start, "end" from kept'))
def row_text_scan(spark, sf_dir):
    """A table scanned as lines of text."""
    lines = contacts(spark, sf_dir).select("contact_id", F.expr(row_text(list(CONTACT_COLUMNS))).alias("text"))
    return explode_findings(scan(lines, "text"), "contact_id").select("contact_id", "type", "match", "start", "end")


# replies as a contextual detector gives them: fenced, plain, unsure, broken
REPLY = """case k % 5
 when 0 then concat('```json\n{"findings": [{"category": "PERSON_NAME", "text": "', nm, '", "start": 0, "end": ', length(nm), ', "confidence": 0.95, "reason": "name"}]}\n```')
 when 1 then concat('{"findings": [{"category": "ADDRESS", "text": "x', k, '", "start": "3", "end": 9, "confidence": 0.7}, {"category": "MEDICAL", "text": "m", "confidence": 0.4}]}')
 when 2 then concat('{"findings": [{"text": "y', k, '", "start": 2, "end": 5, "confidence": 0.8}, {"category": "FAMILY", "text": "z"}]}')
 when 3 then '{"findings": []}'
 else 'sorry, no JSON' end"""


def _replies(spark, sf_dir):
    return spark.sql("select c_custkey as k, c_name as nm, " + REPLY.replace("{", "{{").replace("}", "}}").replace("\n{{", "\\n{{").replace("}}\n", "}}\\n")
                     + " as reply from {customer}", customer=table(spark, sf_dir, "customer", "c_custkey", "c_name"))


@query("""select c_custkey as k, 'PERSON_NAME' as category, 'person_name' as type, c_name as match, 0 as start,
 length(c_name)::integer as "end", 0.95::double as confidence from customer where c_custkey % 5 = 0
union all select c_custkey, 'ADDRESS', 'address', 'x' || c_custkey, 3, 9, 0.7 from customer where c_custkey % 5 = 1
union all select c_custkey, 'UNKNOWN', 'unknown', 'y' || c_custkey, 2, 5, 0.8 from customer where c_custkey % 5 = 2""")
def model_findings_parse(spark, sf_dir):
    """Findings out of a contextual detector's replies; unsure and broken ones give none."""
    parsed = _replies(spark, sf_dir).withColumn("findings", F.expr(parse_model_findings("reply")))
    return explode_findings(parsed, "k").drop("method")


@query(lambda: f"""with recursive {o.found("(select c_custkey, c_name from customer)", "c_custkey", "c_name")},
model as (select c_custkey as k, 'person_name' as type, 0 as start, length(c_name)::integer as "end" from customer where c_custkey % 5 = 0
 union all select c_custkey, 'address', 3, 9 from customer where c_custkey % 5 = 1
 union all select c_custkey, 'unknown', 2, 5 from customer where c_custkey % 5 = 2),
both_ as (select k, type, start, "end", 'llm' as method, 0 as m, 0 as rank from model
 union all select k, type, start, "end", 'regex', 1, rank from found),
num as (select *, row_number() over (partition by k order by start, m, start - "end", rank) as n from both_),
walk as (select k, n, [{{'s': start, 'e': "end"}}] as spans, true as keep from num where n = 1
 union all select num.k, num.n,
  case when len(list_filter(spans, lambda x: num.start < x.e - 2 and x.s < num."end" - 2)) = 0
   then list_append(spans, {{'s': num.start, 'e': num."end"}}) else spans end,
  len(list_filter(spans, lambda x: num.start < x.e - 2 and x.s < num."end" - 2)) = 0
 from walk join num on num.k = walk.k and num.n = walk.n + 1)
select num.k, type, start, "end", method from num join walk on num.k = walk.k and num.n = walk.n where keep""")
def union_of_detectors(spark, sf_dir):
    """Patterns and model findings together; where they collide the earlier or the model wins."""
    both = scan_with_model(_replies(spark, sf_dir), "nm", "reply")
    return explode_findings(both, "k").select("k", "type", "start", "end", "method")


# --- export and audit -------------------------------------------------------

@query(lambda: o.scan("documents", "doc_id", "text", """
select k as doc_id, (count(*) over (partition by k))::integer as findings_count, category, type, start, "end",
 'regex' as method, 1.0::double as confidence from kept"""))
def findings_export_rows(spark, sf_dir):
    """The value-free export, one row per finding."""
    export = findings_export(scan(documents(spark, sf_dir), "text"), "doc_id")
    return export.select("doc_id", "findings_count", F.explode(F.expr("transform(findings, f -> f)")).alias("f")) \
        .select("doc_id", "findings_count", "f.*")


def _audits(spark, sf_dir):
    scanned = scan(documents(spark, sf_dir), "text").withColumn("file", F.expr("concat('/in/doc_', doc_id, '.txt')"))
    at = F.expr("timestamp_seconds(1704067200 + doc_id)")
    return audit.scan_audit(scanned, "file", at=at)


@query(lambda: o.scan("documents", "doc_id", "text", """
, per as (select k, count(*) as n from kept group by k)
select epoch_ms((1704067200 + per.k) * 1000) as timestamp, '/in/doc_' || per.k || '.txt' as file, 'block' as redaction_style,
 cast(n as integer) as total_findings, length(src.text)::integer as scanned_chars from per join src on src.k = per.k""".lstrip("\n")))
def audit_scan(spark, sf_dir):
    """Audit records of a scan."""
    return _audits(spark, sf_dir).select("timestamp", "file", "redaction_style", "total_findings", "scanned_chars")


@query(lambda: o.scan("documents", "doc_id", "text", """
, per as (select k, count(*) as n from kept group by k)
select strftime(epoch_ms((1704067200 + k) * 1000), '%Y-%m-%d %H:%M:%S') as date, 'doc_' || k || '.txt' as file,
 cast(n as integer) as total_findings, 'regex' as method, (select count(*) from per) as of_total
from per order by k desc limit 10""".lstrip("\n")))
def audit_recent(spark, sf_dir):
    """The ten newest records of an audit table, and how many there are; documents are scanned once."""
    path = scratch(spark, "audits")
    audit.append_audit(_audits(spark, sf_dir), path)
    return audit.recent_audits(spark.read.parquet(path))


AUDITED = """
, per as (select k, count(*) as n from kept group by k)
select epoch_ms((1704067200 + per.k) * 1000) as timestamp, '/in/doc_' || per.k || '.txt' as file, 'block' as redaction_style,
 cast(n as integer) as total_findings, length(src.text)::integer as scanned_chars, date '2024-01-01' + (per.k // 86400)::integer as date,
 2::bigint as appended, 2::bigint as audit_ids from per join src on src.k = per.k"""


@query(lambda: o.scan("documents", "doc_id", "text", AUDITED.lstrip("\n")))
def audit_log_roundtrip(spark, sf_dir):
    """Audit records appended in two runs to a table by date, and read back."""
    path, records = scratch(spark, "audits"), checkpoint(_audits(spark, sf_dir))
    audit.append_audit(records, path)
    audit.append_audit(records, path)
    return (spark.read.parquet(path).groupBy("timestamp", "file", "redaction_style", "total_findings", "scanned_chars", "date")
            .agg(F.count(F.lit(1)).alias("appended"), F.count_distinct("audit_id").alias("audit_ids")))


@query(lambda: o.scan("documents", "doc_id", "text", """
select k as doc_id, string_agg(type, ',' order by n) as types from (
  select k, type, min(n) as n from kept group by k, type) t group by k""".lstrip("\n")))
def types_in_order(spark, sf_dir):
    """The types found in a document, each once, in order of their first finding."""
    found = scan(documents(spark, sf_dir), "text").where(F.size("findings") > 0)
    return found.select("doc_id", F.expr("array_join(array_distinct(transform(findings, f -> f.type)), ',')").alias("types"))


def _ask(text: str) -> str:
    """Stands for a model: what looks like a greeting of a name is a person."""
    import json
    import re
    hits = [(m.start(), m.end(), m[0]) for m in re.finditer(r"write to user\d+", text)]
    return json.dumps({"findings": [{"category": "PERSON_NAME", "text": t, "start": a, "end": b, "confidence": 0.9} for a, b, t in hits]})


@query(lambda: f"""select contact_id, 'person_name' as type, regexp_extract(remark, 'write to user[0-9]+') as match,
 'llm' as method from {CONTACTS} c where remark like 'write to user%'""")
def contextual_hook(spark, sf_dir):
    """A detector of one's own, called on every text, joins the patterns; it wins where both start, or comes first."""
    asked = model_replies(contacts(spark, sf_dir).select("contact_id", "remark"), "remark", _ask)
    found = explode_findings(scan_with_model(asked, "remark", "reply"), "contact_id")
    return found.select("contact_id", "type", "match", "method")


@query(lambda: o.scan("documents", "doc_id", "text", """
, per as (select k, count(*) as n from kept group by k)
select case when k % 7 <> 0 then epoch_ms((1704067200 + 86400 * (k % 40)) * 1000) end as timestamp,
 case when k % 7 = 0 then '?' else '/in/doc_' || k || '.txt' end as file, case when k % 7 = 0 then '?' else n::varchar end as total_findings,
 k % 7 <> 0 as readable, date '2024-01-01' + (k % 40)::integer as date from per""".lstrip("\n")))
def audit_json_logs(spark, sf_dir):
    """Audit records as JSON logs in folders by date, some of them damaged, and what is read of them."""
    path = scratch(spark, "logs")
    doc = F.regexp_extract("file", r"(\d+)", 1).cast("bigint")
    records = _audits(spark, sf_dir).withColumn("timestamp", F.timestamp_seconds(1704067200 + 86400 * (doc % 40)))
    audit.write_audit_logs(records.drop("findings"), path + "-whole")
    cut = spark.read.text(path + "-whole")
    doc = F.regexp_extract("value", r"doc_(\d+)", 1).cast("bigint")
    cut.withColumn("value", F.when(doc % 7 == 0, F.substring("value", 1, 40)).otherwise(F.col("value"))).write.partitionBy("date").text(path)
    return audit.read_audit_logs(spark, path).select("timestamp", "file", "total_findings", "readable", "date")


@query(lambda: o.scan("documents", "doc_id", "text",
                      "select 'regex' as method, count(distinct k) as records, count(*) as findings from kept"))
def audit_by_method(spark, sf_dir):
    return audit.by_method(_audits(spark, sf_dir))
