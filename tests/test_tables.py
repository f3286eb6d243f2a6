import json
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests import plain
from veilspark.operators import audit, classify, inventory, joins, normalize, vault
from veilspark.operators.lookup import lookup, salted_lookup
from veilspark.operators.scrub import plan_levels, scrub, scrub_counts, scrub_summary
from veilspark.plans.jobs import recover_table, scan_documents, scrub_table
from veilspark.session import hide_keys, scratch, shared_dir
from veilspark.sources import csvblocks, documents, sqldump, tables
from veilspark.streaming import scrub as scrub_module
from veilspark.streaming.scrub import RunningCounters, freeze_policy, scrub_stream

EMPLOYEES = ("name,email,phone,notes\n"
             "Alice Johnson,alice@example.com,415-555-0134,call later\n"
             'Bob "B" Smith,bob@example.com,212-555-0199,"two\nlines"\n')


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def file(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


# --- sources and sinks ------------------------------------------------------

def test_csv_with_newlines_inside_quotes(spark, tmp_path):
    path = file(tmp_path, "e.csv", EMPLOYEES)
    assert tables.has_quoted_newlines(spark, path)
    df = tables.read_csv(spark, path)
    assert df.count() == 2 and df.where("notes = 'two\nlines'").first()["name"] == 'Bob "B" Smith'
    tables.write_csv(df, str(tmp_path / "out"))
    assert rows(tables.read_csv(spark, str(tmp_path / "out"))) == rows(df)


@pytest.mark.parametrize("sep", [",", "\t", "|"])
def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path, sep):
    rng = random.Random(sep)
    cells = ["", "x", 'say "hi"', "two\nlines", "three\r\n\n lines", '"', '""', sep, f'a{sep}"b"\n', "é\u3000", " pad ", "long " * 60, '\n', '5" pipe']
    want = [tuple(rng.choice(cells) for _ in range(3)) for _ in range(400)]

    def write(name, quote_all, end):
        quoted = lambda c: '"' + c.replace('"', '""') + '"' if quote_all or any(x in c for x in ('"', sep, "\n", "\r")) or c == "" else c
        return file(tmp_path, name, end.join(["a" + sep + "b" + sep + '"c\nd"', *(sep.join(map(quoted, r)) for r in want)]) + end)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for name, quote_all, end in (("a.csv", True, "\n"), ("b.csv", False, "\r\n"), ("c.csv", False, "\n")):
            path = write(name, quote_all, end)
            assert tables.has_quoted_newlines(spark, path, sep)
            df = tables.read_csv(spark, path, sep=sep)
            assert df.columns == ["a", "b", "c\nd"]
            assert sorted(map(tuple, df.collect())) == sorted(want)
            assert csvblocks.records(spark, path, sep).withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_stray_quotes_open_no_cell(spark, tmp_path):
    plain = file(tmp_path, "p.csv", 'size,what\n5",pipe\n6" wide,"a, b"\n"x"y,z"\n')
    assert not tables.has_quoted_newlines(spark, plain)
    assert {('5"', "pipe"), ('6" wide', "a, b")} < set(rows(tables.read_csv(spark, plain)))
    mixed = file(tmp_path, "m.csv", 'size,what\n5",pipe\n6","two\nlines"\n7",x\n')
    assert rows(tables.read_csv(spark, mixed)) == [('5"', "pipe"), ('6"', "two\nlines"), ('7"', "x")]


@given(st.lists(st.text(alphabet='ab,"\n', max_size=12), max_size=8), st.booleans())
@settings(max_examples=200, deadline=None)
def test_a_block_has_one_effect_per_state(parts, inside):
    """Going line by line is the same as going through the text at once."""
    text, state, at_start = "".join(parts), inside, not inside
    i = 0
    while i < len(text):
        c = text[i]
        if state and c == '"':
            if text[i + 1:i + 2] == '"':
                i += 1
            else:
                state, at_start = False, False
        elif not state:
            if c == '"' and at_start:
                state = True
            at_start = c in ",\n"
        i += 1
    now = inside
    for line in text.split("\n"):
        now = csvblocks.inside_after(line, now, ",")
    assert now == state


def test_csv_options(spark, tmp_path):
    assert tables.sniff_separator(spark, file(tmp_path, "a.tsv", "a\tb,c\td\n1\t2\t3\n")) == "\t"
    gaps = file(tmp_path, "g.csv", "col1,col2\n,\nx,y\n  , \n")
    assert rows(tables.read_csv(spark, gaps, skip_blank_rows=True)) == [("x", "y")]
    utf16 = file(tmp_path, "u.csv", "a,b\né,2\n", "utf-16")
    assert rows(tables.read_csv(spark, utf16, encoding="UTF-16")) == [("é", "2")]
    latin = file(tmp_path, "l.csv", "name,value\nJosé,1\n", "latin-1")
    assert rows(tables.read_csv(spark, latin, encoding="ISO-8859-1")) == [("José", "1")]
    short = file(tmp_path, "s.csv", "a,b\n1\n")
    assert rows(tables.read_csv(spark, short)) == [("1", None)]
    assert tables.read_csv(spark, file(tmp_path, "h.csv", "a,b,c\n")).count() == 0


def test_json_shapes(spark, tmp_path):
    array = file(tmp_path, "a.json", '[{"name": "A", "score": 1}, {"name": "B", "score": null}]')
    assert rows(tables.read_json(spark, array)) == [("A", 1), ("B", None)]
    assert tables.read_json(spark, file(tmp_path, "o.json", '{"name": "A"}')).count() == 1
    with pytest.raises(Exception):
        tables.read_json(spark, file(tmp_path, "bad.json", "[1, 2]")).collect()
    tables.write_json(tables.read_json(spark, array), str(tmp_path / "j"), sort_keys=True)
    assert {json.loads(r[0])["score"] for r in spark.read.text(str(tmp_path / "j")).collect()} == {1, None}
    tables.json_to_csv(spark, array, str(tmp_path / "c"))
    assert rows(tables.read_csv(spark, str(tmp_path / "c"))) == [("A", "1"), ("B", None)]


def test_many_array_files_are_read_by_the_schema_of_all(spark, tmp_path):
    for i, text in enumerate(('[{"a": 1}, {"a": 2}]', '[{"b": "x", "a": 3.5}]', " \n", '{"c": [1]}')):
        (tmp_path / "many" / f"g={i}").mkdir(parents=True)
        file(tmp_path / "many" / f"g={i}", "one.json", text)
    df = tables.read_json(spark, str(tmp_path / "many"))
    assert df.dtypes == [("a", "double"), ("b", "string"), ("c", "array<bigint>"), ("g", "int")]
    assert rows(df) == sorted([(1.0, None, None, 0), (2.0, None, None, 0), (3.5, "x", None, 1), (None, None, [1], 3)], key=str)
    assert rows(tables.read_json(spark, str(tmp_path / "many")).select("a", "g")) == rows(df.select("a", "g"))
    # texts of a batch are gone through together; only what follows a value moves
    batch = tables.pd.DataFrame({"value": ["[1] 2", "{}", ""]})
    assert [o["rest"].tolist() for o in tables._whole_value(iter([batch]))] == [["2"]]
    file(tmp_path / "many" / "g=0", "two.json", "[{}]\n[{}]")
    with pytest.raises(ValueError, match="after the first JSON value"):
        tables.read_json(spark, str(tmp_path / "many"))


DUMP = '''-- it's a dump
SET NAMES utf8;
INSERT INTO `users` (`id`, `name`, "note") VALUES (1, 'O''Brien, (x)', NULL), (2, "say ""hi""", NOW()),
  (3, 'a
b; c', '');
# more
INSERT INTO users VALUES (4, 'no list');
SELECT 1;
insert into other (a) values ('x');
'''


def test_sql_dump(spark, tmp_path):
    path = file(tmp_path, "d.sql", DUMP)
    df = sqldump.read_sql_dump(spark, path, table="users")
    assert df.columns == ["id", "name", "note", "col_0", "col_1"]
    assert sorted(rows(df), key=str) == sorted([
        ("1", "O'Brien, (x)", None, None, None), ("2", 'say "hi"', "NOW()", None, None),
        ("3", "a\nb; c", "", None, None), (None, None, None, "4", "no list")], key=str)
    with pytest.raises(ValueError, match="other, users"):
        sqldump.read_sql_dump(spark, path)
    assert sqldump.sql_tuples(spark, path).select("table").distinct().count() == 2
    generic = sqldump.read_sql_dump(spark, file(tmp_path, "g.sql", "INSERT INTO t VALUES (1,'a'),(2,'b');\n"))
    assert generic.columns == ["col_0", "col_1"] and generic.count() == 2
    df = spark.range(120).selectExpr("cast(id as string) id", "if(id = 3, 'null', concat('it''s ', id)) t").coalesce(1)
    sqldump.write_sql_dump(df, str(tmp_path / "w"), comments=("made by a test",))
    text = "".join(r[0] + "\n" for r in spark.read.text(str(tmp_path / "w"), wholetext=True).collect())
    assert text.count("INSERT INTO `scrubbed_data` (`id`, `t`) VALUES") == 3 and text.startswith("-- made by a test\n")
    back = rows(sqldump.read_sql_dump(spark, str(tmp_path / "w")))
    assert len(back) == 120 and ("3", None) in back and ("4", "it's 4") in back


FOREIGN = ("/* a; b */ INSERT INTO `s`.`t` (a, b) VALUES (1, 'x;\r\ny');INSERT IGNORE INTO t (a, b) VALUES (2, 'it''s'), (3, '--no');\r\n"
           "INSERT INTO t (a) VALUES ('z') ON CONFLICT DO NOTHING; -- end; of it\r\ninsert into t values\r\n('p', NULL)")


def test_foreign_dumps(spark, tmp_path):
    want = sorted([("1", "x;\r\ny"), ("2", "it's"), ("3", "--no"), ("z", None), ("p", None)], key=str)
    assert sorted(rows(sqldump.read_sql_dump(spark, file(tmp_path, "f.sql", FOREIGN))), key=str) == want
    # blocks of a few bytes give the same rows
    long = file(tmp_path, "l.sql", "".join(FOREIGN.replace("('p', NULL)", f"('p{i}', 'a\n; b');\n") for i in range(40)))
    whole = sorted(rows(sqldump.read_sql_dump(spark, long)), key=str)
    assert len(whole) == 200
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(before, ("97", "1"), strict=True):
            spark.conf.set(k, v)
        assert spark.read.text(long).rdd.getNumPartitions() > 50
        assert sorted(rows(sqldump.read_sql_dump(spark, long)), key=str) == whole
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    escaped = file(tmp_path, "e.sql", r"INSERT INTO t VALUES ('it\'s; \\', 'a\nb');")
    assert rows(sqldump.read_sql_dump(spark, escaped, backslash_escapes=True)) == [("it's; \\", "a\nb")]
    for i, wrong in enumerate(("INSERT INTO t VALUES ('a'", "INSERT INTO t VALUES ('a') nonsense;", "INSERT INTO t SELECT 1;",
                               r"INSERT INTO t VALUES ('it\'s');", "INSERT INTO t VALUES (1),;")):
        with pytest.raises(Exception, match="can't be read"):
            sqldump.read_sql_dump(spark, file(tmp_path, f"wrong{i}.sql", wrong)).collect()


def test_tuples_of_short_statements_travel_together():
    batch = sqldump.pd.DataFrame({"piece": [f"INSERT INTO t VALUES ({i})" for i in range(2500)] + ["SET x = 1"]})
    out = list(sqldump._parse(False)(iter([batch, batch])))
    assert [len(o) for o in out] == [2500, 2500] and out[1]["cells"][7] == ["7"]


def test_formats(spark, tmp_path):
    assert tables.table_format(spark, "/x/y.CSV") == "csv" and tables.table_format(spark, "/x/y.sql") == "sql"
    assert tables.table_format(spark, file(tmp_path, "noext", "insert into t values (1);\n")) == "sql"
    assert tables.table_format(spark, file(tmp_path, "plain.dat", "a,b\n")) == "csv"


def test_documents_and_inventory(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    for name, data in {"a.txt": "mail a@b.com".encode(), "b.txt": "mail a@b.com".encode(), "g.md": "中文邮件 x@y.org 测试".encode("gbk"),
                       "sub/u.log": "ü".encode("utf-16"), "sub/l.txt": b"caf\xe9 \xff", "sub/.hidden": b"x", "p.png": b"\x00"}.items():
        (root / name).write_bytes(data)
    docs = documents.read_documents(spark, str(root))
    got = {r["path"].rsplit("/", 1)[-1]: (r["encoding"], r["text"]) for r in docs.collect()}
    assert set(got) == {"a.txt", "b.txt", "g.md", "u.log", "l.txt"}
    assert got["g.md"] == ("gbk", "中文邮件 x@y.org 测试") and got["a.txt"][0] == "utf-8" and got["u.log"][0] == "utf-16-le"
    assert documents.read_utf8_documents(spark, str(root / "a.txt")).first()["text"] == "mail a@b.com"
    facts = {r["filename"]: r for r in inventory.inventory(inventory.list_files(spark, str(root))).collect()}
    assert facts["a.txt"]["copies"] == 2 and facts["a.txt"]["is_first"] and not facts["b.txt"]["is_first"]
    assert facts["u.log"]["parent_dir_name"] == "sub" and facts["a.txt"]["size"] == "12 B" and facts["g.md"]["format"] == "text"
    listed = inventory.list_files(spark, str(root), glob="*.txt")
    assert listed.count() == 3 and inventory.find_files(listed, str(root), max_depth=0).count() == 2
    assert inventory.find_files(listed, str(root), exclude=["a.*"], max_size=12).count() == 2
    assert inventory.list_files(spark, str(root), recursive=False).count() == 4


def test_documents_as_files_of_few_folders(spark, tmp_path):
    texts = ["", None, "two\nlines", "é\u3000\x00 end\r\n", "x" * 70000, "same", "same"]
    data = [(i // 2 if i < 8 else i, texts[i % 7]) for i in range(2300)] + [(-3, "minus")]
    root = f"file://{tmp_path}/tree"
    documents.write_documents(spark.createDataFrame(data, "doc_id bigint, text string").repartition(2), root)
    back = documents.read_documents(spark, root)
    got = back.select(F.regexp_extract("path", "doc_id=(-?[0-9]+)_", 1).cast("bigint"), "text", "length", "encoding", "status").collect()
    want = [(k, (t or "") + "\n", len((t or "").encode()) + 1, "utf-8", "read") for k, t in data]
    assert sorted(map(tuple, got)) == sorted(want)
    folders = [f for f in (tmp_path / "tree").iterdir()]
    assert len(folders) == 4 and max(len(list(f.iterdir())) for f in folders) == 1000
    documents.write_documents(back.where("false"), str(tmp_path / "none"), "path")
    assert documents.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_trees_are_listed_and_read_by_tasks(spark, tmp_path):
    root = tmp_path / "a tree"
    data = {"top.txt": b"", "a b/x.txt": b"x", "p%20q.txt": b"q", "_x=1.txt": b"y", "_x.txt": b"n", "_metadata/m.MD": b"m", "_metadata.txt": b"n",
            "_y/z.txt": b"n", "_k=1/z.txt": b"z", ".h/z.txt": b"n", "d._COPYING_/q.txt": b"n", "e._COPYING_": b"n", "é/Ä.TXT": "ä".encode(),
            "x.PDF": b"p", "noext": b"n", ".txt": b"n", "deep/er/and/deeper/mark.txt": b"\xef\xbb\xbfm", "deep/le.log": b"\xff\xfeu\x00\x00\xd8",
            "deep/be.log": b"\xfe\xff\x00u", "deep/g.md": "测试".encode("gbk"), "deep/l.txt": b"caf\xe9 \xff", "deep/s.txt": b"\xed\xa0\x80ab",
            "big.txt": b"b" * 20000} | {f"many/{i}/{j}.txt": f"{i}é{j}".encode() for i in range(7) for j in range(9)}
    for name, content in data.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    for link, to in {"link": "a b", "file.txt": "a b/x.txt", "broken.txt": "none", "loop": "loop"}.items():
        (root / link).symlink_to(to)
    docs = documents.read_documents(spark, str(root), max_mb=0.01)
    # the driver has no listing; the patterns are for Spark's own readers
    assert docs.inputFiles() == [] and documents.read_documents(spark, str(root / "de*")).inputFiles() != []
    got = {r["path"]: r for r in docs.collect()}
    by_spark = {r["path"]: r["length"] for r in inventory.scannable(inventory.list_files(spark, str(root)), None).collect()}
    assert {p: r["length"] for p, r in got.items()} == by_spark and len(got) == 16 + 63
    whole = {r["path"]: tuple(r) for r in documents.read_documents(spark, f"file:{root}/").collect()}
    other = {r["path"]: tuple(r) for name in ("de*", "man*", "[abép]*") for r in documents.read_documents(spark, str(root / name)).collect()}
    assert {p: whole[p] for p in other} == other and len(other) > 60
    state = {p.rsplit("/", 1)[-1]: (r["encoding"], r["status"], r["text"]) for p, r in got.items()}
    assert state["x.PDF"] == (None, "binary format", None) and state["big.txt"] == (None, "too large", None)
    assert state["mark.txt"][0] == "utf-8-sig" and state["le.log"][0] == "utf-16-le" and state["Ä.TXT"] == ("utf-8", "read", "ä")
    (root / "later.txt").write_text("listed when worked out")
    assert docs.count() == len(got) + 1


def test_walks_pass_files_and_leave_folders(tmp_path, monkeypatch):
    for i in range(5):
        (tmp_path / "t" / str(i)).mkdir(parents=True)
        for j in range(70):
            (tmp_path / "t" / str(i) / f"{j}.txt").write_text("x")
    monkeypatch.setattr(inventory, "BATCH_ROWS", 50)
    batch = lambda rows: inventory.pa.RecordBatch.from_pylist(rows, inventory.LISTED)
    rows = lambda found: [r for b in found for r in b.to_pylist()]
    known = {"path": "file:/known.txt", "length": 3, "lot": 7}
    start = batch([known, {"path": f"file:{tmp_path}", "length": None, "lot": 0}])
    first = rows(inventory._walk(4)([start]))
    assert first[0] == known and sorted(r["path"][-4:] for r in first[1:]) == [f"/t/{i}" for i in range(5)]
    out = list(inventory._walk(None)([batch(first[:3]), batch(first[3:])]))
    lots = Counter(r["lot"] for r in rows(out)[1:])
    assert len(rows(out)) == 351 and max(b.num_rows for b in out) == 50 and max(lots.values()) == 32 and len(lots) == 15
    assert {r["path"] for r in rows(inventory._walk(1000)([start]))} == {r["path"] for r in rows(out)}
    monkeypatch.setattr(inventory, "FILES_OF_ONE", 100)
    assert sum(r["length"] is None for r in rows(inventory._walk(1000)([start]))) == 3


def test_texts_leave_in_batches(tmp_path, monkeypatch):
    paths = [f"file:{file(tmp_path, f'{i}.txt', 'x' * 40)}" for i in range(5)] + ["file:/none.pdf"]
    monkeypatch.setattr(documents, "BATCH_BYTES", 80)
    batch = documents.pa.RecordBatch.from_pydict({"path": paths, "length": [40] * 6, "status": ["read"] * 5 + ["binary format"]})
    out = list(documents._texts([batch, batch.slice(5), batch.slice(0, 0)]))
    assert [b.num_rows for b in out] == [2, 2, 2, 1] and [r["text"] for b in out for r in b.to_pylist()] == ["x" * 40] * 5 + [None] * 2


def test_size_limits_are_nearest_bytes(spark, tmp_path):
    # 0.01 MB are 10485.76 bytes, 0.02 MB 20971.52
    files = spark.createDataFrame([(f"/d/{n}.txt", n) for n in (10485, 10486, 10487, 20971, 20972, 20973)], "path string, length bigint")
    over = lambda mb: {r["path"] for r in documents.oversized(files, mb).collect()}
    assert over(0.01) == {f"/d/{n}.txt" for n in (10487, 20971, 20972, 20973)} and over(0.02) == {"/d/20973.txt"}
    assert {r["path"] for r in inventory.scannable(files, 0.01).collect()} == {"/d/10485.txt", "/d/10486.txt"}
    file(tmp_path, "a.txt", "x" * 10486)
    assert documents.read_documents(spark, str(tmp_path), max_mb=0.01).first()["status"] == "read"


# --- classification and scrubbing ------------------------------------------

def test_classification(spark):
    data = [(i, f"u{i}@x.org" if i % 2 else "", "sales", None, f"e{i}@x.org" if i >= 50 else "text", [1]) for i in range(55)]
    df = spark.createDataFrame(data, "id int, contact string, dept string, empty string, rare string, nested array<int>")
    judged = {r["column"]: r for r in classify.classify(df, order_by="id").collect()}
    assert judged["contact"]["sensitive"] and judged["contact"]["rate"] == 1.0 and judged["contact"]["pii_type"] == "email"
    assert not any(judged[c]["sensitive"] for c in ("id", "dept", "empty", "rare")) and "nested" not in judged
    assert classify.sensitive_columns(df, order_by="id") == ["contact"]
    assert classify.sensitive_columns(df, sample_rows=None) == ["contact"]
    assert classify.column_labels(df, ["contact"])["dept"] == "clean"
    named = spark.createDataFrame([("x", "y")], "Full_Name string, other string")
    assert classify.sensitive_columns(named) == ["Full_Name"]


def test_row_numbers_are_not_sensitive(spark, tmp_path):
    many = spark.range(1, 30001)
    look = {"numbers": "id", "evens": "id * 2", "as_text": "cast(id as string)", "twice": "id div 2", "gaps": "if(id % 10 = 0, null, id)",
            "zips": "10000 + id % 700", "sparse": "10000 + id * 2", "padded": "lpad(id, 5, '0')", "passports": "100000000 + id",
            "mixed": "if(id = 9, 'a@b.com', cast(id as string))", "mail": "concat('u', id, '@x.org')", "zip_code": "id"}
    df = many.select(*[F.expr(v).alias(c) for c, v in look.items()])
    assert {r["column"] for r in classify.classify(df).where("sensitive").collect()} == set(look)
    assert classify.sensitive_columns(df) == ["zips", "sparse", "padded", "passports", "mixed", "mail", "zip_code"]
    # a few zip codes one after another, or one in each row, are not the rows' numbers
    few = spark.range(5).selectExpr("10001 + id as a", "cast(90210 - id as string) as b", "id as c")
    assert classify.sensitive_columns(few) == ["a", "b"]
    # the whole job leaves the key alone
    source = str(tmp_path / "k.csv")
    tables.write_csv(many.selectExpr("id as contact", "concat('u', id, '@x.org') as email"), source)
    result = scrub_table(spark, source, str(tmp_path / "out.csv"), "external")
    out = tables.read_csv(spark, str(tmp_path / "out.csv"))
    assert result.sensitive_columns == ["email"] and out.agg(F.count_distinct("contact"), F.sum("contact")).first()[:] == (30000, 450015000.0)


def test_row_numbers_with_jumps_or_repeats_are_not_sensitive(spark):
    look = {"from_0": "id + id div 5000 * 999995000", "from_1": "id + 1 + id div 5000 * 99995000", "holes": "if(id % 3 = 0, null, id + id div 5000 * 999995000)",
            "as_text": "cast(id + id div 5000 * 999995000 as string)", "references": "id % 30000 div 2", "many_references": "id % 15000",
            "passports": "100000000 + id", "and_a_zero": "if(id = 0, 0, 100000000 + id)", "and_a_few": "if(id < 200, id, 100000000 + id)",
            "zips": "if(id = 0, 1, 10000 + id * 7 % 9000)", "phones": "if(id < 60, id, 2000000000 + id * 9973)",
            "not_from_0": "2000000000 + id + id div 5000 * 999995000", "padded": "lpad(id, 9, '0')"}
    df = spark.range(60000).select(*[F.expr(v).alias(c) for c, v in look.items()])
    assert {"from_0", "from_1", "holes", "as_text"} <= {r["column"] for r in classify.classify(df).where("sensitive").collect()}
    assert classify.sensitive_columns(df) == ["passports", "and_a_zero", "and_a_few", "zips", "phones", "not_from_0", "padded"]


def test_row_numbers_with_jumps_of_any_width_are_not_sensitive(spark):
    look = {"odd_jumps": "id + id div 5000 * 1000000007", "powers_of_2": "id % 5000 + shiftleft(id div 5000, 30)",
            "evens": "id % 5000 * 2 + id div 5000 * 1000000007", "holes": "if(id % 7 > 3, null, id + id div 5000 * 1000000007)",
            "ragged": "if(id % 5000 > 4997 - id * 7 div 5000 % 3, null, id + 1 + id div 5000 * 1000000007)",
            "short_first": "if(id < 900, id, id + (1 + id div 10000) * 1000000007)", "far_apart": "if(id < 60, id, 2000000000 + id * 53)",
            "not_from_0": "id + (1 + id div 5000) * 1000000007"}
    df = spark.range(60000).select(*[F.expr(v).alias(c) for c, v in look.items()])
    assert {r["column"] for r in classify.classify(df).where("sensitive").collect()} == set(look)
    assert classify.sensitive_columns(df) == ["short_first", "far_apart", "not_from_0"]


def test_a_row_key_that_the_caller_names_is_not_masked(spark, tmp_path):
    df = spark.range(2000000000, 2000000300).selectExpr("id as account", "id as other", "concat('u', id, '@x.org') as email")
    assert classify.sensitive_columns(df) == ["account", "other", "email"]
    assert classify.sensitive_columns(df, "account") == classify.sensitive_columns(df, ["account"], order_by="account", sample_rows=9) == ["other", "email"]
    assert classify.sensitive_columns(df, ["account", "other", "email"]) == ["email"]
    source, target = str(tmp_path / "in.csv"), str(tmp_path / "out.csv")
    tables.write_csv(df, source)
    assert scrub_table(spark, source, target, "external", row_key="account").sensitive_columns == ["other", "email"]
    assert tables.read_csv(spark, target).agg(F.min("account"), F.count_distinct("account")).first()[:] == ("2000000000", 300)
    incoming, out, state = (str(tmp_path / n) for n in ("incoming", "scrubbed", "state"))
    df.write.parquet(incoming)
    scrub_module.scrub_arriving(spark.readStream.schema(df.schema).parquet(incoming), out, state, "external", row_key="account").awaitTermination()
    assert scrub_module.read_scrubbed(spark, out).agg(F.min("account"), F.count_distinct("account")).first()[:] == (2000000000, 300)


def test_scrub_levels_and_counts(spark):
    df = spark.createDataFrame([(1, "Alice", "a@b.com", "x"), (2, None, " ", "y")], "id int, name string, email string, notes string")
    external = scrub(df, plan_levels(["name", "email", "notes"], "external"))
    assert external.columns == ["id", "name", "email"]
    assert rows(external)[1] == (2, None, " ") and rows(external)[0][2] == "anon_d6b948fc08f7@scrubbed.local"
    assert rows(scrub(df, {"name": "partial"}))[0][1] == "Alic*"
    assert rows(scrub(df, {"name": "partial"}, type_from_column=True))[0][1] == "Al***"
    text = spark.createDataFrame([("Contact a@b.com now",)], "t string")
    assert scrub(text, {"t": "scrub"}, span_style="placeholder").first()[0] == "Contact [EMAIL] now"
    assert scrub(text, {"t": "partial"}).first()[0] == "Con***@b.com now"
    with pytest.raises(ValueError):
        scrub(df, {"name": "tokenize"})
    levels = {"name": "partial", "email": "preserve", "notes": "delete"}
    assert rows(scrub_counts(df, levels)) == [("email", "preserve", 1, 0), ("name", "partial", 1, 1)]
    assert tuple(scrub_summary(df, levels).first()) == (2, 3, 3, 1, 2, 1)


def test_scrub_job_on_every_format(spark, tmp_path):
    source = file(tmp_path, "e.csv", EMPLOYEES)
    result = scrub_table(spark, source, str(tmp_path / "o.csv"), "external", audit_path=str(tmp_path / "audit"))
    assert result.total_rows == 2 and result.deleted_columns == ["notes"] and result.cells_masked == 6
    out = tables.read_csv(spark, str(tmp_path / "o.csv"))
    assert out.columns == ["name", "email", "phone"] and all(r["email"].endswith("@scrubbed.local") for r in out.collect())
    record = spark.read.parquet(str(tmp_path / "audit")).first()
    assert record["column_classification"]["notes"] == "SENSITIVE" and record["total_cells_scrubbed"] == 6
    users = file(tmp_path, "u.json", '[{"user": "a", "contact": "a@b.com"}, {"user": "b", "contact": "b@c.org"}]')
    assert scrub_table(spark, users, str(tmp_path / "o.json")).sensitive_columns == ["contact"]
    clean = file(tmp_path, "c.csv", "dept,role\nhr,lead\n")
    assert scrub_table(spark, clean, str(tmp_path / "oc.csv")).cells_seen == 0
    assert rows(tables.read_csv(spark, str(tmp_path / "oc.csv"))) == [("hr", "lead")]
    dump = file(tmp_path, "d.sql", "INSERT INTO t (id, email) VALUES (1, 'a@b.com'), (2, NULL);\n")
    assert scrub_table(spark, dump, str(tmp_path / "o.sql"), "external").cells_masked == 1
    assert ("2", None) in rows(sqldump.read_sql_dump(spark, str(tmp_path / "o.sql")))
    header = scrub_table(spark, file(tmp_path, "h.csv", "name,email\n"), str(tmp_path / "oh.csv"))
    assert header.total_rows == 0 and header.cells_seen == 0


def test_admin_roundtrip_and_wrong_password(spark, tmp_path):
    source = file(tmp_path, "e.csv", EMPLOYEES)
    with pytest.raises(ValueError):
        scrub_table(spark, source, str(tmp_path / "x.csv"), "admin")
    target = str(tmp_path / "m.csv")
    scrub_table(spark, source, target, "admin", password="s3cret")
    assert all(r["email"].startswith("tok_") for r in tables.read_csv(spark, target).collect())
    with pytest.raises(ValueError, match="wrong password"):
        recover_table(spark, target, str(tmp_path / "no.csv"), "guess")
    assert recover_table(spark, target, str(tmp_path / "b.csv"), "s3cret") == {"total_rows": 2, "recovered_cells": 6}
    assert rows(tables.read_csv(spark, str(tmp_path / "b.csv"))) == rows(tables.read_csv(spark, source))


def test_recover_all_ways_agree(spark):
    key = vault.VaultKey.derive("pw", b"salt", rounds=10)
    df = spark.createDataFrame([(i, "hot@x.org" if i % 3 else f"u{i}@x.org", f"n{i % 4}", None) for i in range(60)],
                               "id int, email string, name string, gap string")
    levels = {"email": "tokenize", "name": "tokenize"}
    masked = scrub(df, levels, token_key=key.token)
    opened = vault.open_vault(vault.build_vault(df, levels, key), key)
    want = rows(df.withColumn("recovered_cells", F.lit(2)))
    for options in ({}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "row_key": ["id"]}):
        assert rows(vault.recover(masked, opened, **options)) == want
    # a row whose key is NULL is a row like any other; keys that repeat are refused, whatever the size of the vault
    gap = masked.withColumn("id", F.when(F.col("id") != 7, F.col("id")))
    for options in ({}, {"broadcast_rows": 0}):
        back = vault.recover(gap, opened, row_key=["id"], **options)
        assert back.where("email like 'tok%' or recovered_cells <> 2").count() == 0 and back.count() == 60
        with pytest.raises(ValueError, match="share a key"):
            vault.recover(masked, opened, row_key=["name"], **options)
    assert vault.collisions(vault.build_vault(df, levels, key)).count() == 0
    assert rows(scrub(df.repartition(1), levels, token_key=key.token)) == rows(scrub(df.repartition(7), levels, token_key=key.token))


def test_single_blob_vault(spark, tmp_path):
    key = vault.VaultKey.derive("pw", b"old salt")
    blob = spark.sql(f"""select translate(base64(aes_encrypt(encode('{{"TOK_1": "Zoë", "TOK_2": "b"}}', 'UTF-8'),
        unhex('{key.cipher}'), 'GCM')), '+/', '-_') v""").first()[0]
    path = file(tmp_path, "x.vault", blob)
    assert rows(vault.read_single_blob_vault(spark, path, "pw", b"old salt")) == [("TOK_1", "Zoë"), ("TOK_2", "b")]
    with pytest.raises(ValueError, match="wrong password"):
        vault.read_single_blob_vault(spark, path, "nope", b"old salt")


def test_keys_stay_out_of_plans(spark):
    hide_keys(spark)
    key = vault.VaultKey.derive("pw", b"salt", rounds=10)
    df = spark.createDataFrame([("a@b.com",)], "email string")
    plan = vault.build_vault(df, ["email"], key)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert key.cipher not in plan.lower() and key.token not in plan and key.cipher not in repr(key)


# --- joins, skew, normalisation, audit, streams -----------------------------

def test_lookup_with_hot_and_null_keys(spark):
    left = spark.range(500).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else cast(id % 50 as string) end k")
    table = spark.createDataFrame([("hot", 1), *[(str(i), i) for i in range(0, 50, 2)]], "k string, v int")
    want = rows(left.join(table, "k", "left").select("id", "k", "v"))
    assert rows(lookup(left, table, "k").select("id", "k", "v")) == want
    assert rows(salted_lookup(left, table, "k", ["id"], hot_rows=50).select("id", "k", "v")) == want
    assert rows(salted_lookup(left, table, "k", hot_rows=10**9).select("id", "k", "v")) == want


def test_broadcast_size_counts_nested_columns(spark):
    from veilspark.operators.lookup import fits_broadcast
    df = spark.range(100).select("id", F.array_repeat(F.lit(12345678), 100).alias("a"), F.struct(F.lit("x" * 50).alias("s")).alias("t"),
                                 F.create_map(F.lit(1), F.lit("y" * 50)).alias("m"))
    assert fits_broadcast(df, size=150_000) and not fits_broadcast(df, size=90_000)
    assert not fits_broadcast(df.select("a"), size=80_000) and not fits_broadcast(df.select("m"), size=5_000)
    assert fits_broadcast(df.select("id"), size=800) and not fits_broadcast(df.select("id"), size=799) and not fits_broadcast(df, rows=99)


def test_join_preservation(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",), ("x",), (None,)], "k string")
    right = spark.createDataFrame([("a",), ("b",), ("b",), ("y",)], "k string")
    assert tuple(joins.join_preservation(left, right, "k", "k").first()) == (4, 4, 1, 1, 0)
    typed = joins.with_types(spark.createDataFrame([("a@b.com",), ("x",), (None,)], "v string"), "v")
    assert rows(typed) == [("a@b.com", "email"), ("x", "generic"), (None, None)]


def test_normalisation(spark):
    df = spark.createDataFrame([("1", "true", "x", "9" * 20), ("2.5", "", "null", "1")], "N string, b string, s string, w string")
    assert normalize.lower_names(df).columns == ["n", "b", "s", "w"]
    types = {r["column"]: r["type"] for r in normalize.infer_types(df).collect()}
    assert types == {"N": "double", "b": "boolean", "s": "string", "w": "decimal(38,0)"}
    assert [str(v) for v in rows(normalize.cast_columns(df, types))[0]] == ["1.0", "True", "x", "9" * 20]
    assert normalize.normalize_rows(df, lowercase_keys=True).first()["n"]["l"] == 1
    with pytest.raises(ValueError):
        normalize.lower_names(spark.createDataFrame([(1, 2)], "`a` int, `A` int"))


def test_audit_holds_no_values(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "mail secret@corp.com"), ("d2", "clean")], "id string, text string")
    scan_documents(docs, "id", style="block", redacted_path=str(tmp_path / "red"), audit_path=str(tmp_path / "aud"))
    assert rows(spark.read.parquet(str(tmp_path / "red"))) == [("d1", "mail [REDACTED]")]
    records = spark.read.parquet(str(tmp_path / "aud"))
    assert records.count() == 1 and "secret@corp.com" not in records.toPandas().to_json(default_handler=str)
    for i, text in enumerate(['{"timestamp": "2024-01-0%dT00:00:00Z", "file": "/x/f%d.txt", "total_findings": 2, "by_method": {"regex": 1, "llm": 1}}' % (i, i)
                              for i in (1, 2)] + ["broken"]):
        file(tmp_path, f"audit_{i}.json", text)
    recent = audit.recent_audits(audit.read_audit_files(spark, str(tmp_path)), 2).collect()
    assert [(r["file"], r["method"], r["of_total"]) for r in recent] == [("f2.txt", "llm+regex", 3), ("f1.txt", "llm+regex", 3)]


def test_stream_equals_batch_and_freezes_policy(spark, tmp_path):
    incoming, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df = spark.createDataFrame([(i, f"u{i}@x.org") for i in range(20)], "id int, email string")
    df.where("id < 10").write.parquet(incoming)
    counters = RunningCounters()
    spark.streams.addListener(counters)
    run = lambda levels: scrub_stream(spark.readStream.schema(df.schema).parquet(incoming), levels, out, state).awaitTermination()
    run({"email": "scrub"})
    df.where("id >= 10").write.mode("append").parquet(incoming)
    run({"email": "partial"})
    assert rows(spark.read.parquet(out)) == rows(scrub(df, {"email": "scrub"}))
    assert freeze_policy(spark, f"{state}/policy", {}) == {"email": "scrub"}
    for _ in range(50):
        if counters.totals.get("_rows") == 20:
            break
        import time
        time.sleep(0.2)
    spark.streams.removeListener(counters)
    assert counters.totals == {"_rows": 20, "email": 20}


def test_a_stream_that_fails_between_rows_and_counts(spark, tmp_path, monkeypatch):
    incoming, out, state = (str(tmp_path / n) for n in ("incoming", "out", "state"))
    rows_of = lambda lo, hi: spark.createDataFrame([(i, f"user{i}@example.com", "x" if i % 2 else None) for i in range(lo, hi)], "id int, email string, contact string")
    for lo in (0, 10, 20):
        rows_of(lo, lo + 10).coalesce(1).write.mode("append").parquet(incoming)
    stream = lambda: spark.readStream.schema("id int, email string, contact string").option("maxFilesPerTrigger", 1).parquet(incoming)
    whole, calls = scrub_module.Observation, []

    class Breaks(whole):
        @property
        def get(self):
            calls.append(1)
            if len(calls) == 2:
                raise RuntimeError("lost between rows and counts")
            return super().get
    monkeypatch.setattr(scrub_module, "Observation", Breaks)
    with pytest.raises(StreamingQueryException):
        scrub_module.scrub_arriving(stream(), out, state, "external").awaitTermination()
    scrub_module.scrub_arriving(stream(), out, state, "internal").awaitTermination()  # the frozen policy holds
    got = scrub_module.read_scrubbed(spark, out)
    assert got.count() == 30 == got.select("id").distinct().count() and got.where("email like 'anon_%'").count() == 30
    assert {r["counter"]: r["n"] for r in scrub_module.counters(spark, state).collect()} == {"_rows": 30, "email": 30}
    assert scrub_module.frozen_policy(spark, f"{state}/policy") == {"email": "scrub"}


def test_streams_without_rows_write_nothing(spark, tmp_path):
    incoming, out, state = (str(tmp_path / n) for n in ("incoming", "out", "state"))
    spark.createDataFrame([], "id int, email string").coalesce(1).write.parquet(incoming)
    scrub_module.scrub_arriving(spark.readStream.schema("id int, email string").parquet(incoming), out, state).awaitTermination()
    assert scrub_module.frozen_policy(spark, f"{state}/policy") is None


def test_one_vault_for_many_jobs(spark, tmp_path):
    path, other, merged = (str(tmp_path / n) for n in ("v", "w", "m"))
    one = spark.createDataFrame([("a@b.com", "x1"), ("c@d.org", None)], "email string, note string")
    key = vault.vault_key(spark, path, "pw", rounds=1000)
    assert vault.extend_vault(one, ["email"], path, key) == 2 and vault.extend_vault(one, ["email", "note"], path, key) == 1
    assert vault.extend_vault(one, ["email", "note"], path, key) == 0
    again = vault.vault_key(spark, path, "pw", rounds=1000)
    assert again == key
    with pytest.raises(ValueError, match="wrong password"):
        vault.vault_key(spark, path, "other", rounds=1000)
    key2 = vault.vault_key(spark, other, "pw", rounds=1000)
    assert key2.salt != key.salt and vault.extend_vault(one, ["email"], other, key2) == 2
    assert vault.merge_vaults(spark, [path, other], "pw", merged, rounds=1000) == 5
    opened = vault.open_vault(*vault.load_vault(spark, merged, "pw", rounds=1000))
    for k in (key, key2):
        masked = scrub(one, {"email": "tokenize"}, k.token)
        assert rows(vault.recover(masked, opened).select("email", "note")) == rows(one)
    # the same entry twice, as two jobs at once may add it, is no collision; two values are
    twice = spark.read.parquet(path).drop("salt")
    assert vault.collisions(twice.union(twice), key).isEmpty() and not vault.collisions(twice.union(twice)).isEmpty()
    clash = twice.withColumn("token", F.lit("TOK_0"))
    assert vault.collisions(clash, key).count() == 1
    empty = str(tmp_path / "e")
    assert vault.extend_vault(one.limit(0), ["email"], empty, key) == 0
    assert vault.vault_key(spark, empty, "any", rounds=1000).salt


def test_only_cells_like_tokens_are_shuffled(spark):
    key = vault.VaultKey.derive("pw", b"salt", 1000)
    df = spark.createDataFrame([(i, f"user{i}@example.com", f"plain {i}", None) for i in range(50)], "id int, email string, a string, b string")
    masked = scrub(df, {"email": "tokenize"}, key.token)
    opened = vault.open_vault(vault.build_vault(df, ["email"], key), key)
    out = vault.recover(masked, opened, row_key=["id"], broadcast_rows=0)
    assert rows(out.drop("recovered_cells")) == rows(df)
    cells = masked.select(F.explode(F.array("email", "a", "b")).alias("c"))
    assert cells.where(F.col("c").rlike(vault.TOKEN_SHAPE)).count() == 50


def test_recent_audits_read_the_newest_days(spark, tmp_path):
    path = str(tmp_path / "audits")
    days = spark.range(400).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 43200).alias("timestamp"), F.format_string("/in/f%d.txt", "id").alias("file"),
                                   F.lit(1).alias("total_findings"), F.create_map(F.lit("regex"), F.lit(1).cast("bigint")).alias("by_method"))
    audit.append_audit(days, path)
    records = spark.read.parquet(path)
    got = audit.recent_audits(records, 5)
    assert [r["file"] for r in got.collect()] == [f"f{i}.txt" for i in range(399, 394, -1)] and got.first()["of_total"] == 400
    assert re.search(r"PartitionFilters: \[.*date.*>= 2024-07-1", got._jdf.queryExecution().executedPlan().toString())
    assert audit.recent_audits(records.drop("date"), 5).collect() == got.collect()
    assert audit.recent_audits(records.where("false"), 5).count() == 0


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named.rstrip("/")
    assert scratch(spark, "x") != scratch(spark, "x")


def test_plain_helper_agrees_with_itself():
    assert plain.greedy(plain.raw("ids A00000001 password: GB00000001X")) [0][0] == "passport_us"
