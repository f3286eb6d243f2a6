import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import plain
from veilspark.functions.celltypes import rank_of
from veilspark.functions.detectors import cell_type, find_pii, has_pii, parse_model_findings, scan_text, union_detectors
from veilspark.functions.shapes import candidates, loosened, shape
from veilspark.functions.spans import mark_kept, redact
from veilspark.operators import chunking, overlap
from veilspark.operators.detect import explode_findings, marked_findings, model_replies, raw_findings, scan
from veilspark.patterns import PATTERNS, Pattern

LITERALS = [
    ("Contact john.doe@example.com for details", ["email"]),
    ("Call (555) 123-4567 or 555-987-6543", ["phone_us", "phone_us"]),
    ("Card: 4111-1111-1111-1111 and 5500 0000 0000 0004", ["credit_card", "credit_card"]),
    ("SSN: 123-45-6789", ["ssn"]),
    ("Server at 192.168.1.1 responded", ["ipv4"]),
    ("a+4412345678", ["phone_intl", "phone_us"]),
    ("+44 7911 123456", None),
    ("the quick brown fox jumps over the lazy dog", []),
    ("Senior Engineer", []), ("NULL", []), ("", []),
]


@pytest.mark.parametrize("text,types", LITERALS)
def test_literals(one, text, types):
    found = [(f["type"], f["start"], f["end"], f["match"]) for f in one(find_pii("t"), t=text)]
    assert found == plain.raw(text)
    if types is not None:
        assert [f[0] for f in found] == types


def test_first_us_phone_keeps_its_bracket(one):
    assert one(find_pii("t"), t="Call (555) 123-4567")[0]["match"] == "555) 123-4567"


PIECES = ["a@b.com", ".x@y.org", "+1 415-555-0134", "(212) 555-0199", "07911 123456", "+447911123456", "13812345678",
          "123-45-6789", "AB 12 34 56 C", "11010519491231002X", "A12345678", "123456789", "GB1234567",
          "GB82WEST12345698765432", "DEUTDEFF", "COMPUTER", "10.0.0.1", "1:2:3:4:5:6:7:8", "api_key = abcdefgh1234",
          "sk-abcdefghij0123456789xyz", "password: GB00000001X", "12345", "12345-6789", "SW1A 1AA", "4111 1111 1111 1111",
          "é", "ß", " ", "\n", "-", "_", "x", "7", "٣", "１２３４５", "ſ", "K", "中文", "²", ":", "=", "'", " ", "😀"]


def _random_texts(n, seed, most=9):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) + rng.choice(["", "", " ", ",", "\n"]) for _ in range(rng.randint(0, most)))
            for _ in range(n)]


def test_findings_equal_plain_python(spark):
    texts = _random_texts(1500, 7) + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(4)
    got = df.select("id", F.expr(find_pii("t")).alias("raw"), F.expr(scan_text("t")).alias("kept"),
                    F.expr(cell_type("t")).alias("kind"), F.expr(has_pii("t")).alias("any")).collect()
    for r in got:
        text = texts[r["id"]]
        flat = [[(f["type"], f["start"], f["end"], f["match"]) for f in r[c]] for c in ("raw", "kept")]
        assert flat[0] == plain.raw(text), text
        assert flat[1] == plain.greedy(flat[0]), text
        assert r["kind"] == plain.cell_type(text), text
        assert r["any"] == bool(flat[0]), text


def test_long_dense_text(spark):
    text = " ".join(f"10.0.{i % 250}.{i % 199} mail{i}@example.com" for i in range(3000))
    row = spark.createDataFrame([(text,)], "t string").withColumn("f", F.expr(scan_text("t")))
    found, masked = row.select("f", F.expr(redact("t", "f", "mask"))).first()
    assert [(f["type"], f["start"], f["end"], f["match"]) for f in found] == plain.greedy(plain.raw(text))
    assert len(masked) == len(text) and "@" not in masked


def test_ranks_of_cells_agree(spark):
    from veilspark.functions.celltypes import cell_ranks, rank_of
    texts = _random_texts(400, 8) + ["1@2.||3", "", " ", None, "4111-1111-1111-1111", "x" * 500 + " a@b.com"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", F.expr(cell_type("t")).alias("kind"), cell_ranks([F.col("t"), F.lower("t")]).alias("r")).collect():
        rank = rank_of(r["t"])
        assert r["kind"] == plain.cell_type(r["t"]) == (PATTERNS[rank].type if rank >= 0 else None), r["t"]
        assert r["r"]["c0"] == rank and r["r"]["c1"] == rank_of(r["t"].lower() if r["t"] else r["t"])


@pytest.mark.parametrize("place", range(len(PATTERNS)))
def test_shapes_rule_out_no_match(place):
    p = PATTERNS[place]
    compiled = re.compile(p.regex, re.IGNORECASE if p.ignore_case else 0)
    possible = candidates(PATTERNS)
    assert loosened(p.regex, p.ignore_case) is not None

    around = st.sampled_from(["", "a", "é", " ", "-", "7"])

    @given(around, st.from_regex(re.compile(p.regex.replace(r"\b", ""), compiled.flags), fullmatch=True), around)
    @settings(max_examples=80, deadline=None)
    def check(before, text, after):
        text = before + text + after
        assert not compiled.search(text) or place in possible(text), text
    check()


@given(st.text(max_size=30) | st.text(alphabet="aZé_09\u0663 \t\u00a0-.@:+()ſ", max_size=30))
@settings(max_examples=300, deadline=None)
def test_typing_by_shape_equals_the_plain_rule(text):
    rank = rank_of(text)
    assert plain.cell_type(text) == (PATTERNS[rank].type if rank >= 0 else None)
    assert len(shape(text)) == len(text) and shape(text).isascii()


def test_grammar_that_shapes_do_not_know():
    for regex in (r"[^a]x", r"(?=a)b", r"(a)\1", r"^a", r"a.b", r"\Wa", r"(a)?"):
        assert loosened(regex) is None or re.compile(loosened(regex))
    odd = (Pattern("X", "not_a", r"[^a]x"), Pattern("X", "look", r"(?<=a)b"), Pattern("X", "start", r"^q"))
    assert [rank_of(t, odd) for t in ("bx", "ax", "ab", "qb", "b")] == [0, -1, 1, 2, -1]


def test_custom_patterns(one):
    mine = (*PATTERNS, Pattern("STAFF", "badge", r"\bBDG-\d{4}\b"))
    assert one(scan_text("t", mine), t="see BDG-1234")[0]["type"] == "badge"
    assert one(cell_type("t", mine), t="BDG-1234") == "badge"


def test_general_overlap_rule_with_short_spans(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        spans = sorted((s, s + rng.randint(0, 9)) for s in (rng.randint(0, 30) for _ in range(rng.randint(0, 8))))
        rows.append((i, [("C", "t", "", s, e, "llm", 1.0) for s, e in spans]))
    from veilspark.functions.spans import FINDINGS
    df = spark.createDataFrame(rows, f"id int, f {FINDINGS}").withColumn("m", F.expr(mark_kept("f", short_spans=True)))
    for r in df.collect():
        spans = [("t", f["start"], f["end"]) for f in r["f"]]
        kept = [(f["type"], f["start"], f["end"]) for f in r["m"] if f["kept"]]
        assert kept == plain.greedy(spans)


def test_redaction_clamps_and_replaces(one, spark):
    text = "Contact John at john@example.com"
    spans = "array(named_struct('start', 16, 'end', 33, 'type', 'email'), named_struct('start', 8, 'end', 12, 'type', 'name'))"
    assert one(redact("t", spans), t=text) == "Contact [REDACTED] at [REDACTED]"
    assert one(redact("t", spans, "placeholder"), t=text) == "Contact [NAME] at [EMAIL]"
    assert one(redact("t", scan_text("t"), "mask"), t="SSN: 123-45-6789") == "SSN: " + "X" * 11
    assert one(redact("t", scan_text("t"), "partial"), t="mail john.smith@example.com!") == "mail j********h@example.com!"
    assert one(redact("t", scan_text("t")), t="nothing") == "nothing"


def test_overlap_pairs_and_dropped(spark):
    texts = _random_texts(200, 11, 14)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = overlap.overlap_pairs(raw_findings(df, "t"), "id")
    pairs = {(r["id"], r["type_a"], r["start_a"], r["type_b"], r["start_b"]) for r in found.collect()}
    want = set()
    for i, t in enumerate(texts):
        spans = [(s, -e, k) for k, s, e, _ in plain.raw(t)]
        want |= {(i, a[2], a[0], b[2], b[0]) for a in spans for b in spans
                 if a < b and a[0] < -b[1] - 2 and b[0] < -a[1] - 2}
    assert pairs == want
    assert not re.search("Exchange|Join", found._jdf.queryExecution().executedPlan().toString())
    many = spark.createDataFrame([(1, [(i, i + 9, "x") for i in range(0, 60_000, 3)])], "id int, findings array<struct<start:int,`end`:int,type:string>>")
    assert overlap.overlap_pairs(many, "id").count() == 2 * 20_000 - 3
    marked = marked_findings(df, "t")
    kept, dropped = overlap.kept_findings(marked, "id"), overlap.dropped_findings(marked, "id")
    assert kept.count() + dropped.count() == sum(len(plain.raw(t)) for t in texts)


def test_model_replies(one):
    fenced = '```json\n{"findings": [{"category": "PERSON_NAME", "text": "Al", "start": 1, "end": "3", "confidence": 0.9}]}\n```'
    f, = one(parse_model_findings("r"), r=fenced)
    assert (f["type"], f["category"], f["match"], f["start"], f["end"], f["method"]) == ("person_name", "PERSON_NAME", "Al", 1, 3, "llm")
    assert one(parse_model_findings("r"), r="no json") == []
    assert one(parse_model_findings("r"), r=None) == []
    assert one(parse_model_findings("r"), r='{"findings": [{"category": "X", "confidence": 0.69}, {"category": "Y"}]}') == []


def test_model_hook_skips_failures(spark):
    def model(text):
        if "bad" in text:
            raise ValueError(text)
        return '{"findings": [{"category": "FAMILY", "text": "%s", "start": 0, "end": 4, "confidence": 1}]}' % text[:4]
    df = spark.createDataFrame([("anna a@b.com",), ("bad",), (None,)], "t string")
    out = model_replies(df, "t", model).withColumn("f", F.expr(union_detectors(find_pii("t"), parse_model_findings("reply"))))
    assert [[x["type"] for x in r["f"]] for r in out.collect()] == [["family", "email"], [], []]


def test_lost_model_ends_the_job(spark):
    def gone(_text):
        raise ConnectionError("gone")
    with pytest.raises(Exception, match="gone"):
        model_replies(spark.createDataFrame([("x",)], "t string"), "t", gone).collect()


def test_chunks(one, spark):
    parts = one(chunking.fixed_chunks("t", 20, 5), t="x" * 50)
    assert [(c["start"], len(c["text"])) for c in parts] == [(0, 20), (15, 20), (30, 20)]
    text = "word. " * 700 + "\n\n" + "abc " * 900
    df = spark.createDataFrame([(1, text), (2, ""), (3, "short")], "id int, t string")
    rows = chunking.boundary_chunks(df, "t").where("id = 1").orderBy("chunk_start").collect()
    assert all(text[r["chunk_start"]:].startswith(r["chunk"]) for r in rows)
    assert rows[-1]["chunk_start"] + len(rows[-1]["chunk"]) == len(text)
    assert all(b["chunk_start"] == a["chunk_start"] + len(a["chunk"]) - 200 for a, b in zip(rows, rows[1:]))
    assert chunking.boundary_chunks(df, "t").where("id = 2").count() == 0
    with pytest.raises(ValueError):
        chunking.fixed_chunks("t", 5, 5)


def test_chunked_findings_equal_whole_text(spark):
    text = " ".join(f"mail{i}@example.com" for i in range(400))
    df = spark.createDataFrame([(1, text)], "id int, t string")
    whole = {(f["start"], f["end"]) for f in scan(df, "t").first()["findings"]}
    inside = df.select(F.expr(chunking.chunked_findings("t", 500, 100)).alias("f")).first()["f"]
    assert whole == {(f["start"], f["end"]) for f in inside}
    rows = chunking.scan_chunks(chunking.stride_chunks(df, "t", 500, 100), "id")
    assert whole == {(r["start"], r["end"]) for r in rows.collect()}


def test_seams_show_nothing_that_is_not_there(spark):
    texts = [" " * k + t for k in range(70) for t in ("123456789012 and more", "123-45-6789", "x" * 30 + "@example.com tail", "4111-1111-1111-1111")]
    df = spark.createDataFrame(list(enumerate(texts + [""])) + [(-1, None)], "id int, t string")
    want = sorted((r["id"], r["type"], r["start"], r["end"]) for r in explode_findings(scan(df, "t"), "id").collect())
    rows = chunking.scan_chunks(chunking.stride_chunks(df, "t", 40, 30), "id").collect()
    assert sorted((r["id"], r["type"], r["start"], r["end"]) for r in rows) == want
    inside = df.withColumn("findings", F.expr(chunking.chunked_findings("t", 40, 30)))
    assert sorted((r["id"], r["type"], r["start"], r["end"]) for r in explode_findings(inside, "id").collect()) == want


def test_partitioning_does_not_matter(spark):
    df = spark.createDataFrame(list(enumerate(_random_texts(100, 5))), "id int, t string")
    once = lambda n: sorted(map(tuple, explode_findings(scan(df.repartition(n), "t"), "id").drop("confidence").collect()))
    assert once(1) == once(8)


def test_detection_runs_once_per_row(spark):
    df = spark.createDataFrame([(1, "a@b.com")], "id int, t string")
    plan = explode_findings(scan(df, "t"), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ipv6 AS type") + plan.count("ipv6, regex") <= 1 or plan.count("Filter") == 0
