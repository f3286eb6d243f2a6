"""Cell types, classification, masks, scrubbing, tokens and joins."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from veilspark.functions.detectors import cell_type as cell_type_sql
from veilspark.functions.detectors import has_pii
from veilspark.functions.masks import fake_value as fake_value_sql
from veilspark.functions.masks import is_private_ip, mask_full, mask_partial
from veilspark.operators import joins, vault
from veilspark.operators.classify import SAMPLE_ROWS, classify, sensitive_columns
from veilspark.operators.scrub import plan_levels, scrub, scrub_counts as count_cells
from veilspark.operators.scrub import scrub_summary as summarize
from veilspark.policy import is_sensitive_name
from veilspark.session import checkpoint, spread

from . import oracle as o
from .base import CONTACT_COLUMNS, CONTACTS, contacts, query, table

#: columns of the contacts table that classify as sensitive
SENSITIVE = ("full_name", "email", "phone", "ssn", "credit_card", "ip_address", "salary", "notes")
CELLS = ("full_name", "email", "phone", "ssn", "credit_card", "ip_address", "salary", "dept", "remark", "notes")
KINDS = ("email", "phone_us", "phone_uk", "phone_intl", "phone_cn", "ssn", "ni_uk", "cn_id", "passport",
         "credit_card", "iban", "swift", "ipv4", "api_key", "name", "full_name", "address", "dob", "salary",
         "generic")


def _cells(spark, sf_dir):
    return contacts(spark, sf_dir).select("contact_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in CELLS])))


CELLS_SQL = "(" + " union all ".join(
    f"select contact_id, '{c}' as \"column\", {c} as v from {CONTACTS} c" for c in CELLS) + ")"


@query(lambda: f"""select contact_id, "column", {o.first_type('v')} as pii_type from {CELLS_SQL} u""")
def cell_type(spark, sf_dir):
    """The dominant type of every cell."""
    return _cells(spark, sf_dir).select("contact_id", "column", F.expr(cell_type_sql("v")).alias("pii_type"))


@query(lambda: f"""select "column", count(*) as cells, count(*) filter (where {o.first_type('v')} is not null) as with_pii
from {CELLS_SQL} u group by all""")
def cells_with_pii(spark, sf_dir):
    """Cells with any finding, per column."""
    return _cells(spark, sf_dir).groupBy("column").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.expr(has_pii("v"))).alias("with_pii"))


# --- classification ---------------------------------------------------------

# table: sort keys, columns looked at
CLASSIFIED = {
    "customer": (["c_custkey"], ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "supplier": (["s_suppkey"], ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    "part": (["p_partkey"], ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "orders": (["o_orderkey"], ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                                "o_orderpriority"]),
    "lineitem": (["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
                 ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]),
    "nation": (["n_nationkey"], ["n_nationkey", "n_name", "n_regionkey"]),
}


def _classify_sql(source: str, keys: list[str], columns: list[str], rows: int | None = 100) -> str:
    order = ", ".join(keys)
    head = (f"(select *, row_number() over (order by {order}) as _row from {source} s "
            f"qualify _row <= {rows})" if rows else f"(select *, 11 as _row from {source} s)")
    # of a sample the type of the first filled cell, else the most frequent, by registry order if equally so
    kinds = ("select \"column\", arg_min(coalesce(t, 'mixed'), _row) as kind from typed where filled and _row <= 10 group by all" if rows else
             f"""select "column", arg_max(t, n * 1000 - list_position({o.TYPES}, t)) as kind from (
  select "column", t, count(*) as n from typed where t is not null group by all) per_type group by all""")
    cells = " union all ".join(
        f"select {i} as position, '{c}' as \"column\", {str(is_sensitive_name(c)).lower()} as by_name, _row, "
        f"cast({c} as varchar) as v from head" for i, c in enumerate(columns))
    return f"""with head as materialized {head},
cells as ({cells}),
typed as (select *, regexp_matches(coalesce(v, ''), '\\S') as filled, {o.first_type('v')} as t from cells),
counted as (select "column", by_name, count(*) filter (where filled and not by_name and t is not null) as hits, count(*) filter (where filled) as filled
  from typed group by all),
kinds as ({kinds}),
judged as (select *, case when by_name or filled = 0 then 0.0::double else hits / filled end as rate, coalesce(kind, 'mixed') as kind from counted left join kinds using ("column"))
select "column", by_name, hits, filled, rate, (by_name or (filled > 0 and rate >= 0.3)) as sensitive,
 case when by_name or (filled > 0 and rate >= 0.3) then kind else '-' end as pii_type from judged"""


def _union_classified(frames):
    out = None
    for label, df in frames:
        df = df.select(F.lit(label).alias("table"), "*")
        out = df if out is None else out.unionByName(df)
    return out


@query(lambda: " union all ".join(
    f"select '{t}' as \"table\", * from ({_classify_sql(t, *spec)}) x" for t, spec in CLASSIFIED.items()))
def classify_columns(spark, sf_dir):
    """Sensitive columns of the business tables, from their first hundred rows by key."""
    return _union_classified(
        (t, classify(table(spark, sf_dir, t, *columns), order_by=keys, sample_rows=SAMPLE_ROWS)) for t, (keys, columns) in CLASSIFIED.items())


@query(lambda: _classify_sql(CONTACTS, ["contact_id"], list(CONTACT_COLUMNS)))
def classify_contacts(spark, sf_dir):
    """Sensitive columns of the contacts, from their first hundred rows by key."""
    return classify(contacts(spark, sf_dir), order_by="contact_id", sample_rows=SAMPLE_ROWS)


@query(lambda: " union all ".join(
    f"select '{t}' as \"table\", * from ({_classify_sql(t, *CLASSIFIED[t], rows=None)}) x"
    for t in ("customer", "part", "lineitem")))
def classify_whole_tables(spark, sf_dir):
    """The same judged by every row instead of a sample."""
    return _union_classified(
        (t, classify(spread(table(spark, sf_dir, t, *CLASSIFIED[t][1]))))
        for t in ("customer", "part", "lineitem"))


LATE = f"(select contact_id, case when contact_id > 100 then email else 'none' end as remark, case when contact_id > 100 then ssn else 'none' end as code from {CONTACTS} c)"


@query(lambda: _classify_sql(LATE, ["contact_id"], ["contact_id", "remark", "code"], rows=None))
def classify_late_rows(spark, sf_dir):
    """Columns in which personal data comes only after the rows a sample would see."""
    late = lambda c: F.when(F.col("contact_id") > 100, F.col(c)).otherwise("none")
    return classify(contacts(spark, sf_dir).select("contact_id", late("email").alias("remark"), late("ssn").alias("code")))


# --- masks ------------------------------------------------------------------

def _every_kind(spark, sf_dir):
    return _cells(spark, sf_dir).where("v IS NOT NULL") \
        .withColumn("kind", F.explode(F.array(*map(F.lit, KINDS))))


EVERY_KIND = f"(select u.*, kind from {CELLS_SQL} u, (select unnest({list(KINDS)}) as kind) k where v is not null)"


@query(lambda: f'select contact_id, "column", kind, {o.mask_partial("v", "kind")} as masked from {EVERY_KIND} e')
def mask_partial_all_types(spark, sf_dir):
    """The partial mask of every type on every kind of cell."""
    return _every_kind(spark, sf_dir).select("contact_id", "column", "kind", F.expr(mask_partial("v", "kind")).alias("masked"))


@query(lambda: f'select contact_id, "column", kind, {o.mask_full("v", "kind")} as masked from {EVERY_KIND} e')
def mask_full_all_types(spark, sf_dir):
    return _every_kind(spark, sf_dir).select("contact_id", "column", "kind", F.expr(mask_full("v", "kind")).alias("masked"))


@query(lambda: f'select contact_id, "column", kind, {o.fake_value("v", "kind")} as masked from {EVERY_KIND} e')
def fake_value(spark, sf_dir):
    return _every_kind(spark, sf_dir).select("contact_id", "column", "kind", F.expr(fake_value_sql("v", "kind")).alias("masked"))


@query(lambda: f"""select contact_id, ip_address from {CONTACTS} c where {o.PRIVATE.format(v='ip_address')}""")
def private_ip_filter(spark, sf_dir):
    return contacts(spark, sf_dir).where(F.expr(is_private_ip("ip_address"))).select("contact_id", "ip_address")


# --- scrubbing --------------------------------------------------------------

ROW_KEY = "contact_id"


def _levels(spark, sf_dir, preset):
    df = contacts(spark, sf_dir)
    return df, plan_levels(sensitive_columns(df, ROW_KEY), preset)


GENERIC = "'generic'"


def _scrub_sql(mask, keep=(), drop=()) -> str:
    """Contacts with every sensitive column masked, some kept, some dropped."""
    columns = []
    for c in CONTACT_COLUMNS:
        if c in drop:
            continue
        if c in SENSITIVE and c not in keep:
            columns.append(f"case when {c} is null or not regexp_matches({c}, '\\S') then {c} "
                           f"else {mask(c, f'coalesce({c}_t, {GENERIC})')} end as {c}")
        else:
            columns.append(c)
    types = ", ".join(f"{o.first_type(c)} as {c}_t" for c in SENSITIVE if c not in drop)
    return f"select {', '.join(columns)} from (select *, {types} from {CONTACTS} c) t"


@query(lambda: _scrub_sql(o.mask_full, drop=("notes",)))
def scrub_external(spark, sf_dir):
    """For publication: everything sensitive hashed, free text dropped."""
    df, levels = _levels(spark, sf_dir, "external")
    return scrub(df, levels)


@query(lambda: _scrub_sql(o.mask_partial, keep=("ip_address",)))
def scrub_internal(spark, sf_dir):
    """For colleagues: edges stay visible."""
    df, levels = _levels(spark, sf_dir, "internal")
    return scrub(df, levels)


@functools.cache
def demo_key() -> vault.VaultKey:
    return vault.VaultKey.derive("correct horse", b"fixed demo salt", rounds=600_000)


ADMIN_KEPT = ("salary", "ip_address", "notes")
TOKENISED = ("full_name", "email", "phone", "ssn", "credit_card")


@query(lambda: _scrub_sql(lambda v, kind: o.token(v, kind, demo_key().token), keep=ADMIN_KEPT))
def scrub_admin(spark, sf_dir):
    """Recoverable: tokens in place of values."""
    df, levels = _levels(spark, sf_dir, "admin")
    return scrub(df, levels, token_key=demo_key().token)


@query(lambda: _scrub_sql(o.mask_partial, keep=tuple(c for c in SENSITIVE if c not in ("email", "phone")),
                          drop=("notes", "ssn")))
def scrub_custom_policy(spark, sf_dir):
    """A policy of one's own instead of a preset."""
    policy = {"email": "partial", "phone": "partial", "notes": "delete", "ssn": "delete", "_default": "preserve"}
    df, levels = _levels(spark, sf_dir, policy)
    return scrub(df, levels)


COLUMN_TYPES = {"full_name": "name", "email": "email", "ssn": "ssn", "credit_card": "credit_card", "salary": "salary"}


@query(lambda: "select contact_id, " + ", ".join(
    f"case when {c} is null or not regexp_matches({c}, '\\S') then {c} "
    f"else {o.mask_partial(c, f'''coalesce({c}_t, '{COLUMN_TYPES[c]}')''')} end as {c}"
    for c in COLUMN_TYPES) + f" from (select *, {', '.join(f'{o.first_type(c)} as {c}_t' for c in COLUMN_TYPES)} from {CONTACTS} c) t")
def scrub_typed_by_column(spark, sf_dir):
    """Cells without a detected type take the one their column name stands for."""
    df = contacts(spark, sf_dir).select("contact_id", *COLUMN_TYPES)
    return scrub(df, dict.fromkeys(COLUMN_TYPES, "partial"), type_from_column=True)


@query(lambda: o.redacted(CONTACTS, "contact_id", "remark", "'[' || upper(type) || ']'"))
def scrub_spans(spark, sf_dir):
    """Only the spans found in a free-text column are replaced."""
    df = contacts(spark, sf_dir).select("contact_id", "remark")
    return scrub(df, {"remark": "scrub"}, span_style="placeholder").withColumnRenamed("remark", "redacted")


FILLED = {c: f"count(*) filter (where regexp_matches(coalesce({c}, ''), '\\S'))" for c in SENSITIVE}


@query(lambda: " union all ".join(
    f"select '{c}' as \"column\", '{'preserve' if c == 'ip_address' else 'partial'}' as level, {FILLED[c]} as cells_seen, "
    f"{'0::bigint' if c == 'ip_address' else FILLED[c]} as cells_masked from {CONTACTS} c" for c in SENSITIVE))
def scrub_counts(spark, sf_dir):
    """Cells seen and masked per column."""
    df, levels = _levels(spark, sf_dir, "internal")
    return count_cells(df, levels)


@query(lambda: f"""select count(*) as total_rows, {len(CONTACT_COLUMNS) - 1} as total_columns, {len(SENSITIVE)} as sensitive_columns,
 1 as deleted_columns, {' + '.join(FILLED[c] for c in SENSITIVE if c != 'notes')} as cells_seen,
 {' + '.join(FILLED[c] for c in SENSITIVE if c != 'notes')} as cells_masked from {CONTACTS} c""")
def scrub_summary(spark, sf_dir):
    """Totals of an external scrub."""
    df, levels = _levels(spark, sf_dir, "external")
    return summarize(df, levels)


# --- tokens -----------------------------------------------------------------

VALUES = "(" + " union ".join(f"select {c} as v from {CONTACTS} c where regexp_matches(coalesce({c}, ''), '\\S')" for c in TOKENISED) + ")"


@query(lambda: f"""select {o.token('v', 'pii_type', demo_key().token)} as token, pii_type, v as value
from (select v, coalesce({o.first_type('v')}, 'generic') as pii_type from {VALUES} u) t""")
def tokenize(spark, sf_dir):
    """The vault: every distinct value with its token, encrypted and opened again."""
    stored = vault.build_vault(contacts(spark, sf_dir), TOKENISED, demo_key())
    return stored.select("token", "pii_type", F.expr(
        f"decode(aes_decrypt(value_enc, unhex('{demo_key().cipher}'), 'GCM'), 'UTF-8')").alias("value"))


@query(lambda: f"""select token, count(*) as values_per_token from (
select distinct v, {o.token('v', "coalesce(" + o.first_type('v') + ", 'generic')", demo_key().token)} as token from {VALUES} u)
group by token having count(*) > 1""")
def vault_collisions(spark, sf_dir):
    """Tokens that stand for two values; there must be none."""
    return vault.collisions(vault.build_vault(contacts(spark, sf_dir), TOKENISED, demo_key()))


def _recovered(spark, sf_dir, **options):
    df, levels = _levels(spark, sf_dir, "admin")
    masked = scrub(df, levels, token_key=demo_key().token)
    stored = checkpoint(vault.build_vault(df, vault.tokenised_columns(levels), demo_key()))
    opened = vault.open_vault(stored, demo_key())
    return vault.recover(masked, opened, row_key=["contact_id"], **options)


FILLED_TOKENS = " + ".join(f"case when regexp_matches(coalesce({c}, ''), '\\S') then 1 else 0 end" for c in TOKENISED)


@query(lambda: f"select *, {FILLED_TOKENS} as recovered_cells from {CONTACTS} c")
def recover_roundtrip(spark, sf_dir):
    """Tokenised and recovered equals the original."""
    return _recovered(spark, sf_dir)


@query(lambda: f"select *, {FILLED_TOKENS} as recovered_cells from {CONTACTS} c")
def recover_large_vault(spark, sf_dir):
    """The same with a vault too large to broadcast."""
    return _recovered(spark, sf_dir, broadcast_rows=0)


@query(lambda: f"select count(*) as total_rows, cast(sum({FILLED_TOKENS}) as bigint) as recovered_cells from {CONTACTS} c")
def recovered_cells(spark, sf_dir):
    return vault.recovered_total(_recovered(spark, sf_dir))


# --- joins ------------------------------------------------------------------

@query("""select (select count(*) from orders join customer on o_custkey = c_custkey) as raw_rows,
 (select count(*) from orders join customer on o_custkey = c_custkey) as masked_rows,
 (select count(*) from orders where o_custkey not in (select c_custkey from customer)) as left_only,
 (select count(*) from customer where c_custkey not in (select o_custkey from orders)) as right_only,
 0::bigint as collisions""")
def join_preserved(spark, sf_dir):
    """Joining orders and customers on pseudonyms equals joining them on keys."""
    return joins.join_preservation(
        spread(table(spark, sf_dir, "orders", "o_custkey")), table(spark, sf_dir, "customer", "c_custkey"),
        "o_custkey", "c_custkey")


@query(lambda: f"""with a as (select phone, {o.mask_full('phone', o.first_type('phone'))} as m from {CONTACTS} c)
select count(*) - count(distinct m) as collisions, count(distinct m) as pseudonyms from (select distinct phone, m from a)""")
def pseudonym_collisions(spark, sf_dir):
    """How many phone numbers share one of the customary four-digit pseudonyms."""
    phones = contacts(spark, sf_dir).select("phone").distinct().withColumn("m", F.expr(joins.pseudonym("phone")))
    per = phones.groupBy("m").agg((F.count(F.lit(1)) - 1).alias("extra"))
    return per.agg(F.sum("extra").alias("collisions"), F.count(F.lit(1)).alias("pseudonyms"))


@query(lambda: f"""select m as pseudonym, count(*) as orders, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from
 (select o_totalprice, {o.mask_full('cast(o_custkey as varchar)', "coalesce(" + o.first_type('cast(o_custkey as varchar)') + ", 'generic')")} as m from orders) x group by m""")
def orders_by_pseudonym(spark, sf_dir):
    """Grouping by pseudonym gives the groups of the key."""
    orders = spread(table(spark, sf_dir, "orders", "o_custkey", "o_totalprice"))
    per_key = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"))
    return per_key.groupBy(F.expr(joins.pseudonym("o_custkey")).alias("pseudonym")).agg(
        F.sum("n").alias("orders"), F.sum("t").cast("double").alias("total"))


@query(lambda: f"""select value, coalesce({o.first_type('value')}, 'generic') as pii_type
from (select distinct cast(l_extendedprice as varchar) as value from lineitem) x""")
def value_dictionary(spark, sf_dir):
    """Types of the distinct values of a column."""
    return joins.value_dictionary(spread(table(spark, sf_dir, "lineitem", "l_extendedprice")), "l_extendedprice")


@query(lambda: f"""select p_type, coalesce({o.first_type('p_type')}, 'generic') as pii_type, count(*) as parts
from part group by all""")
def typed_by_dictionary(spark, sf_dir):
    """Types joined back to the rows they belong to."""
    typed = joins.with_types(table(spark, sf_dir, "part", "p_partkey", "p_type"), "p_type")
    return typed.groupBy("p_type", "pii_type").agg(F.count(F.lit(1)).alias("parts"))
