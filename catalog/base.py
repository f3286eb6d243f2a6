"""Registration of checked queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def query(oracle: Callable[[], str] | str | None = None):
    """Register a function under its name, with the SQL that must agree with it."""
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle if callable(oracle) else (lambda: oracle)
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents", "doc_id", "text", *more))


CONTACTS_SQL = """
select k as contact_id,
 concat(case k%4 when 0 then 'Alice' when 1 then 'Bob' when 2 then 'Chloe' else 'Dan' end,' ',
        case k%3 when 0 then 'Stone' when 1 then 'Reed' else 'Vale' end) as full_name,
 case when k%11=0 then null when k%7=0 then '' else concat('user',k,'@example.com') end as email,
 concat('+1-',lpad(cast(k%700+200 as varchar(9)),3,'0'),'-555-',lpad(cast(k%10000 as varchar(9)),4,'0')) as phone,
 concat(lpad(cast(k%900+100 as varchar(9)),3,'0'),'-',lpad(cast(k%90+10 as varchar(9)),2,'0'),'-',lpad(cast(k%10000 as varchar(9)),4,'0')) as ssn,
 concat('4111-1111-1111-',lpad(cast(k%10000 as varchar(9)),4,'0')) as credit_card,
 case when k%3=0 then concat('192.168.1.',k%250) else concat('8.8.',k%250,'.',k%199) end as ip_address,
 concat('$95,',lpad(cast(k%1000 as varchar(9)),3,'0')) as salary,
 case k%3 when 0 then 'Engineering' when 1 then 'Sales' else 'Support' end as dept,
 case when k%5=0 then concat('write to user',k,'@example.com') else 'nothing here' end as remark,
 concat('ids A',lpad(cast(k as varchar(9)),8,'0'),' GB',lpad(cast(k as varchar(9)),8,'0'),
        ' password: GB',lpad(cast(k as varchar(9)),8,'0'),'X end') as notes
from (select c_custkey as k from {customer}) s
"""
CONTACT_COLUMNS = ("contact_id", "full_name", "email", "phone", "ssn", "credit_card", "ip_address",
                   "salary", "dept", "remark", "notes")


def contacts(spark: SparkSession, sf_dir: str, base: str = "customer", key: str = "c_custkey") -> DataFrame:
    """A table with personal data in every shape, one row per row of the base table."""
    keys = table(spark, sf_dir, base).select(F.col(key).alias("c_custkey"))
    # concat of the SQL side leaves NULLs out, so a row without a key has cells there
    return spark.sql(CONTACTS_SQL.replace("concat(", "concat_ws('',"), customer=spread(keys))


CONTACTS = "(" + CONTACTS_SQL.replace("{customer}", "customer") + ")"
