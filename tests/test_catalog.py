import duckdb
import pytest

import __spark_entry__ as entry
import check

SMALL = "/root/testdata/sf0.001"
SQLS = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return check.database(SMALL)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_agrees_with_its_sql(spark, db, name):
    good, note = check.compare(spark, db, name, SMALL, SQLS.get(name))
    assert good, note


def test_entry(spark):
    assert entry.entry(spark).columns == ["category", "type", "n"]


@pytest.mark.parametrize("most", ["0", "7"])
def test_a_stream_in_two_lots_holds_every_row(spark, tmp_path, most):
    """Negative keys and none, and lots of several files."""
    spark.range(-40, 40).selectExpr("if(id = 3, null, id) as c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", most)
    try:
        found = entry.queries()["stream_two_phase"](spark, str(tmp_path))
        assert sorted(r[0] for r in found.where("contact_id is not null").collect()) == [k for k in range(-40, 40) if k != 3]
        assert found.count() == 80
        counted = {r["counter"]: r["n"] for r in entry.queries()["stream_counters"](spark, str(tmp_path)).collect()}
        assert counted["_rows"] == 80 and counted["salary"] == 80
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


@pytest.mark.parametrize("name", ["scrub_admin", "scrub_counts", "scrub_csv_job", "stream_two_phase"])
def test_contacts_without_a_key_agree_with_the_sql(spark, tmp_path, name):
    spark.range(60).selectExpr("if(id % 20 = 7, null, id) as c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    with duckdb.connect() as made:
        made.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
        good, note = check.compare(spark, made, name, str(tmp_path), SQLS[name])
    assert good, note
