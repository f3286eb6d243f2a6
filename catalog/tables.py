"""Sources, sinks, normalisation and streams."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from veilspark.functions.masks import TOKENIZE
from veilspark.functions.values import coerce
from veilspark.operators.normalize import cast_columns, infer_types as infer
from veilspark.operators.normalize import lower_names, normalize_rows as normalize
from veilspark.operators import vault
from veilspark.operators.classify import sensitive_columns
from veilspark.operators.scrub import plan_levels
from veilspark.plans.jobs import recover_table, scrub_table
from veilspark.session import scratch, spread
from veilspark.sources import sqldump, tables as src
from veilspark.streaming import scrub as streaming

from . import oracle as o
from .base import CONTACTS, contacts, query, table
from .masking import ROW_KEY, _scrub_sql, demo_key

STRINGS = ("full_name", "email", "phone", "ssn", "credit_card", "ip_address", "salary", "dept", "remark", "notes")


@query(f"select cast(contact_id as varchar) as contact_id, {', '.join(STRINGS)} from {CONTACTS} c")
def csv_roundtrip(spark, sf_dir):
    """A table written as CSV and read back, NULL and empty text told apart."""
    path = scratch(spark, "csv")
    src.write_csv(contacts(spark, sf_dir), path)
    return src.read_csv(spark, path)


@query("select cast(doc_id as varchar) as doc_id, text, lang from documents")
def csv_documents(spark, sf_dir):
    """Texts with newlines and quotes through CSV."""
    path = scratch(spark, "csv")
    src.write_csv(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), path, sep="\t")
    return src.read_csv(spark, path, sep=None)


@query(f"select contact_id, {', '.join(STRINGS)} from {CONTACTS} c")
def json_roundtrip(spark, sf_dir):
    path = scratch(spark, "json")
    src.write_json(contacts(spark, sf_dir), path, sort_keys=True)
    return src.read_json(spark, path)


@query("select cast(doc_id as varchar) as doc_id, text, lang, source from documents where not coalesce(text, '') = ''")
def csv_json_csv(spark, sf_dir):
    """Documents from CSV to JSON and back, with all their quotes and line breaks."""
    first, second, third = (scratch(spark, n) for n in ("csv", "json", "csv"))
    src.write_csv(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").where("text <> ''"), first)
    src.csv_to_json(spark, first, second)
    src.json_to_csv(spark, second, third)
    return src.read_csv(spark, third)


@query(f"select cast(contact_id as varchar) as contact_id, {', '.join(STRINGS)} from {CONTACTS} c")
def sql_dump_roundtrip(spark, sf_dir):
    """A table written as INSERT statements and read back."""
    path = scratch(spark, "sql")
    sqldump.write_sql_dump(contacts(spark, sf_dir), path, table="contacts", comments=("it's a dump",))
    return sqldump.read_sql_dump(spark, path)


@query("select cast(doc_id as varchar) as doc_id, text from documents")
def sql_dump_documents(spark, sf_dir):
    """Texts with quotes, brackets, semicolons and newlines through INSERT statements."""
    path = scratch(spark, "sql")
    sqldump.write_sql_dump(table(spark, sf_dir, "documents", "doc_id", "text"), path)
    return sqldump.read_sql_dump(spark, path)


def _foreign(spark, sf_dir, quote):
    """A dump of two tables, with CRLF lines, several statements in a line, and comments."""
    path = scratch(spark, "foreign")
    one = F.format_string("INSERT INTO `s`.`customers` (k, name) VALUES (%s, '%s;\r\nit" + quote + "s');", "c_custkey", "c_name")
    two = F.format_string("INSERT INTO other VALUES (%s, NULL), (0, 'x'); -- done; \r", "c_custkey")
    table(spark, sf_dir, "customer").select(F.concat(one, two).alias("value")).write.text(path)
    return path


@query("select cast(c_custkey as varchar) as k, c_name || ';' || chr(13) || chr(10) || 'it''s' as name from customer")
def sql_dump_foreign(spark, sf_dir):
    """One of two tables."""
    return sqldump.read_sql_dump(spark, _foreign(spark, sf_dir, "''"), table="customers")


@query("select c_custkey::varchar as col_0, null::varchar as col_1 from customer union all select '0', 'x' from customer")
def sql_dump_backslashes(spark, sf_dir):
    """The other table of a dump whose quotes are escaped by backslashes."""
    return sqldump.read_sql_dump(spark, _foreign(spark, sf_dir, "\\'"), table="other", backslash_escapes=True)


@query("select 'supplier' as \"table\", count(*) as n_rows, 4::bigint as n_cells from supplier")
def sql_dump_tuples(spark, sf_dir):
    """The table name survives."""
    path = scratch(spark, "sql")
    sqldump.write_sql_dump(table(spark, sf_dir, "supplier"), path, table="supplier")
    return sqldump.sql_tuples(spark, path).groupBy("table").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("cells")).cast("bigint").alias("n_cells"))


@query("""select event_type, a, count(*) as n from (select case when event_id % 3 = 0 then ' ' else event_type end as event_type,
 case when event_id % 2 = 0 then '' else props end as a from events) e where trim(event_type) <> '' or trim(a) <> '' group by all""")
def blank_rows_dropped(spark, sf_dir):
    """Rows whose cells are all blank go away."""
    df = spread(table(spark, sf_dir, "events", "event_id", "event_type", "props")).select(
        F.expr("if(event_id % 3 = 0, ' ', event_type)").alias("event_type"),
        F.expr("if(event_id % 2 = 0, '', props)").alias("a"))
    return src.drop_blank_rows(df).groupBy("event_type", "a").agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey, c_name as c_label, c_mktsegment from customer")
def lower_case_names(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey as C_CustKey", "c_name as C_LABEL", "c_mktsegment")
    return lower_names(df)


# --- typed cells ------------------------------------------------------------

# Spark and DuckDB read this alike: events as text cells of every kind
RAW = """select event_id,
 case event_id % 12 when 0 then '' when 1 then ' TRUE ' when 2 then 'false' when 3 then 'N/A' when 4 then concat('-', event_id)
  when 5 then concat(event_id, '.5') when 6 then '1e3' when 7 then 'None' when 8 then event_type when 9 then concat(' ', event_id, ' ')
  when 10 then '1_000.5' else '12345678901234567890' end as cell,
 cast(event_id as varchar(20)) as whole, concat(event_id, '.25') as fraction,
 case when event_id % 2 = 0 then 'true' else 'FALSE' end as flag,
 case when event_id % 3 = 0 then 'null' else event_type end as word,
 case when event_id % 3 = 0 then concat(event_id, '') else concat(event_id, '.5') end as mixed, props
from {events}"""
RAW_SQL = "(" + RAW.replace("{events}", "events") + ")"


def _raw(spark, sf_dir):
    return spark.sql(RAW, events=spread(table(spark, sf_dir, "events", "event_id", "event_type", "props")))


def _kind_sql(v: str) -> str:
    return f"""case when {v} = '' or lower({v}) in ('null','none','nil','na','n/a') then 'null'
 when lower({v}) in ('true','false') then 'bool' when regexp_matches({v}, '^-?[0-9]+$') then 'int'
 when regexp_matches({v}, '^[+-]?([0-9]+(_[0-9]+)*(\\.([0-9]+(_[0-9]+)*)?)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$') then 'float' else 'str' end"""


@query(f"""select event_id, kind, case when kind = 'bool' then lower(v) = 'true' end as b,
 case when kind = 'int' then try_cast(v as bigint) end as l, case when kind = 'float' then try_cast(replace(v, '_', '') as double) end as d,
 case when kind = 'str' or (kind = 'int' and try_cast(v as bigint) is null) then v end as s
from (select event_id, v, {_kind_sql('v')} as kind from (select event_id, trim(cell) as v from {RAW_SQL} r) a) b""")
def normalize_rows(spark, sf_dir):
    """Text cells read as the values they stand for."""
    return normalize(_raw(spark, sf_dir).select("event_id", "cell"), ["cell"]).select("event_id", "cell.*")


@query(f"""select event_id, case when cell <> trim(cell) then 'str' else {_kind_sql('cell')} end as kind from {RAW_SQL} r""")
def normalize_unstripped(spark, sf_dir):
    """Cells with outer blanks stay text when nothing is stripped."""
    return _raw(spark, sf_dir).select("event_id", F.expr(coerce("cell", strip_first=False)).alias("t")) \
        .select("event_id", "t.kind")


INFERRED = {"cell": "string", "whole": "bigint", "fraction": "double", "flag": "boolean", "word": "string",
            "mixed": "double", "props": "string"}


@query(" union all ".join(
    f"""select '{c}' as "column", count(*) filter (where k = 'null') as n_null, count(*) filter (where k = 'bool') as n_bool, count(*) filter (where k = 'int') as n_int,
 count(*) filter (where k = 'float') as n_float, count(*) filter (where k = 'str') as n_str, '{t}' as type
 from (select {_kind_sql(f'trim({c})')} as k from {RAW_SQL} r) a""" for c, t in INFERRED.items()))
def infer_types(spark, sf_dir):
    """The narrowest type every cell of a column agrees with."""
    return infer(_raw(spark, sf_dir), list(INFERRED))


@query(f"""select event_id, cast(whole as bigint) as whole, cast(fraction as double) as fraction, cast(flag as boolean) as flag,
 case when word <> 'null' then word end as word, cast(mixed as double) as mixed from {RAW_SQL} r""")
def typed_columns(spark, sf_dir):
    """Columns in the types inferred for them."""
    df = _raw(spark, sf_dir).drop("cell", "props")
    types = {r["column"]: r["type"] for r in infer(df).collect()}
    return cast_columns(df, types)


# --- jobs and streams -------------------------------------------------------

SCRUBBED_CSV = "select cast(contact_id as varchar) as contact_id, * exclude (contact_id) from ({}) s"


@query(lambda: SCRUBBED_CSV.format(_scrub_sql(o.mask_full, drop=("notes",))))
def scrub_csv_job(spark, sf_dir):
    """CSV in, classified, scrubbed, written, read back."""
    source, target = scratch(spark, "in") + ".csv", scratch(spark, "out") + ".csv"
    src.write_csv(contacts(spark, sf_dir), source)
    scrub_table(spark, source, target, "external", audit_path=scratch(spark, "audit"), row_key=ROW_KEY)
    return src.read_csv(spark, target)


@query(lambda: f"select cast(contact_id as varchar) as contact_id, {', '.join(STRINGS)} from {CONTACTS} c")
def recover_csv_job(spark, sf_dir):
    """Tokenised with a password, then recovered with it."""
    source, masked, back = (scratch(spark, n) + ".csv" for n in ("in", "masked", "back"))
    src.write_csv(contacts(spark, sf_dir), source)
    scrub_table(spark, source, masked, "admin", password="open sesame", row_key=ROW_KEY)
    recover_table(spark, masked, back, "open sesame")
    return src.read_csv(spark, back)


@query(lambda: f"select contact_id, {', '.join(STRINGS)} from {CONTACTS} c")
def recover_json_job(spark, sf_dir):
    """JSON lines tokenised with a password, then recovered with it."""
    source, masked, back = (scratch(spark, n) + ".json" for n in ("in", "masked", "back"))
    src.write_json(contacts(spark, sf_dir), source)
    scrub_table(spark, source, masked, "admin", password="open sesame", row_key=ROW_KEY)
    recover_table(spark, masked, back, "open sesame")
    return src.read_json(spark, back)


@query("select c_custkey, c_name, c_mktsegment from customer")
def json_array(spark, sf_dir):
    """Files that are one array of objects read as their rows."""
    path = scratch(spark, "array")
    rows = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    whole = rows.groupBy((F.col("c_custkey") / 100).cast("int").alias("g")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    # few bytes in many files: as many tasks as there are cores write them, whatever the size of the rows
    whole.repartition(spark.sparkContext.defaultParallelism, "g").write.partitionBy("g").text(path)
    return src.read_json(spark, path).drop("g")


@query(lambda: _scrub_sql(o.mask_full, drop=("notes",)))
def stream_scrub(spark, sf_dir):
    """Classified by what has arrived, then scrubbed as a file stream; equals the batch."""
    incoming, out, state = (scratch(spark, n) for n in ("incoming", "scrubbed", "state"))
    contacts(spark, sf_dir).write.parquet(incoming)
    first = spark.read.parquet(incoming)
    levels = plan_levels(sensitive_columns(first, ROW_KEY), "external")
    streaming.scrub_stream(spark.readStream.schema(first.schema).parquet(incoming), levels, out, state).awaitTermination()
    return spark.read.parquet(out)


@query(lambda: o.scan("documents", "doc_id", "text", "select k as doc_id, type, count(*) as n from kept group by all"))
def stream_scan(spark, sf_dir):
    """Findings of documents arriving as files, long ones in overlapping chunks."""
    incoming, out, state = (scratch(spark, n) for n in ("incoming", "found", "state"))
    spread(table(spark, sf_dir, "documents", "doc_id", "text")).write.parquet(incoming)
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(incoming)
    streaming.scan_stream(stream, "text", out, state, size=2000).awaitTermination()
    return spark.read.parquet(out).select("doc_id", F.explode(F.expr("transform(findings, f -> f.type)")).alias("type")) \
        .groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


def _two_phase(spark, sf_dir):
    """A stream whose files arrive in two lots; a batch of the first lot runs twice, as it does after a failure."""
    incoming, out, state = (scratch(spark, n) for n in ("incoming", "scrubbed", "state"))
    rows = contacts(spark, sf_dir)
    # every row is in one lot, also with a negative key or none; all files of a lot are one batch
    second = F.coalesce(F.col("contact_id") % 2 != 0, F.lit(False))
    for number, lot in enumerate((~second, second)):
        rows.where(lot).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(rows.schema).parquet(incoming)
        streaming.scrub_arriving(stream, out, state, "external", row_key=ROW_KEY).awaitTermination()
        if number == 0:
            streaming.scrub_batch(spark.read.parquet(incoming), 0, out, state, "external", row_key=ROW_KEY)
    return out, state


@query(lambda: _scrub_sql(o.mask_full, drop=("notes",)))
def stream_two_phase(spark, sf_dir):
    """Classified by its first batch inside the stream, restarted, a batch run twice; equals the batch job."""
    return streaming.read_scrubbed(spark, _two_phase(spark, sf_dir)[0])


COUNTED = ("full_name", "email", "phone", "ssn", "credit_card", "ip_address", "salary")


@query(lambda: f"select '_rows' as counter, count(*) as n from {CONTACTS} c" + "".join(
    f" union all select '{c}', count(*) filter (where regexp_matches(coalesce({c}::varchar, ''), '\\S')) from {CONTACTS} c" for c in COUNTED))
def stream_counters(spark, sf_dir):
    """Rows and cells the stream has masked, each batch counted once whatever ran twice."""
    return streaming.counters(spark, _two_phase(spark, sf_dir)[1]).where("counter <> 'contact_id'")


DEPARTMENTS = ("Engineering", "Legal", "Sales", "Support")  # nobody is in Legal


@query(" union all ".join(f"""select '{d}' as dept, count(*) filter (where dept = '{d}') as total_rows,
 count(*) filter (where dept = '{d}' and coalesce(email, '') <> '') as emails, 0::bigint as rows_read from {CONTACTS} c""".replace(
     "0::bigint as rows_read", f"count(*) filter (where dept = '{d}') as rows_read") for d in DEPARTMENTS))
def empty_table_job(spark, sf_dir):
    """A job per department; the table of one has a header and no rows, and so has its result."""
    done = []
    for dept in DEPARTMENTS:
        source, target = scratch(spark, "in") + ".csv", scratch(spark, "out") + ".csv"
        src.write_csv(contacts(spark, sf_dir).where(F.col("dept") == dept), source)
        result = scrub_table(spark, source, target, "external", row_key=ROW_KEY)
        back = src.read_csv(spark, target)
        if back.columns and "notes" in back.columns:
            raise ValueError("a deleted column came back")
        done.append(back.agg(F.lit(dept).alias("dept"), F.lit(result.total_rows).cast("bigint").alias("total_rows"),
                             F.lit(result.pii_by_column.get("email", 0)).cast("bigint").alias("emails"), F.count(F.lit(1)).alias("rows_read")))
    return functools.reduce(lambda a, b: a.unionByName(b), done)


ORDER_EMAILS = "select o_orderkey, 'user' || o_custkey || '@example.com' as email from orders"


@query(f"""select c.contact_id::varchar as contact_id, count(*) as orders from {CONTACTS} c join ({ORDER_EMAILS}) x on x.email = c.email group by all""")
def vault_shared(spark, sf_dir):
    """Two tables tokenised by two jobs with one vault join on their tokens as they did on their values."""
    people, buys, one, two = (scratch(spark, n) + ".csv" for n in ("people", "orders", "one", "two"))
    common = scratch(spark, "vault")
    src.write_csv(contacts(spark, sf_dir).select("contact_id", "email"), people)
    src.write_csv(table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat('user', o_custkey, '@example.com') as email"), buys)
    for source, target in ((people, one), (buys, two)):
        scrub_table(spark, source, target, password="open sesame", levels={"email": TOKENIZE}, vault_path=common)
    masked = src.read_csv(spark, one)
    if not masked.where("email like 'user%'").isEmpty():
        raise ValueError("an e-mail is not masked")
    return masked.join(src.read_csv(spark, two), "email").groupBy("contact_id").agg(F.count(F.lit(1)).alias("orders"))


@query(f"""with a as (select distinct email as v from {CONTACTS} c where regexp_matches(coalesce(email, ''), '\\S')),
b as (select distinct phone as v from {CONTACTS} c)
select (select count(*) from a) as first_run, (select count(*) from b where v not in (select v from a)) as second_run, 0::bigint as third_run,
 (select count(*) from (from a union from b) t) as entries""")
def vault_grows(spark, sf_dir):
    """A second job adds only what is new to a vault, and a job that runs again adds nothing."""
    path, key = scratch(spark, "vault"), demo_key()
    df = contacts(spark, sf_dir)
    added = [vault.extend_vault(df, columns, path, key) for columns in (["email"], ["email", "phone"], ["phone", "email"])]
    return spark.read.parquet(path).agg(*(F.lit(n).cast("bigint").alias(c) for n, c in zip(added, ("first_run", "second_run", "third_run"), strict=True)),
                                        F.count(F.lit(1)).alias("entries"))


@query(lambda: " union all ".join(f"""select '{p}' as preset, 'csv' as format, count(*) as total_rows, 11 as total_columns,
 count(*) filter (where regexp_matches(coalesce(email, ''), '\\S')) as emails, count(*) as phones, 'clean' as dept, 'SENSITIVE' as salary from {CONTACTS} c"""
                                  for p in ("external", "internal")))
def scrub_audit(spark, sf_dir):
    """The audit records of scrub jobs, appended to a table and read back."""
    audits = scratch(spark, "audits")
    source = scratch(spark, "in") + ".csv"
    src.write_csv(contacts(spark, sf_dir), source)
    for preset in ("external", "internal"):
        scrub_table(spark, source, scratch(spark, "out") + ".csv", preset, audit_path=audits, row_key=ROW_KEY)
    return spark.read.parquet(audits).select(
        "preset", "format", "total_rows", "total_columns", F.col("pii_by_column")["email"].alias("emails"), F.col("pii_by_column")["phone"].alias("phones"),
        F.col("column_classification")["dept"].alias("dept"), F.col("column_classification")["salary"].alias("salary"))
