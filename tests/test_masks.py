import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.functions.masks import apply_mask, fake_value, is_filled, mask_full, mask_partial, strip, tokenize
from veilspark.functions.redaction import partial_redaction
from veilspark.functions.values import coerce
from veilspark.policy import PRESETS, SENSITIVE_NAMES, masking_level

PARTIAL = [
    ("sarah@acme.com", "email", "sar***@acme.com"), ("bob@x.org", "email", "b***@x.org"), ("nomail", "email", "nom***"),
    ("a@b@c.de", "email", "a***@c.de"),
    ("+1-415-555-0134", "phone_us", "+1--***-***"), ("4155550134", "phone_us", "415555****"), ("12", "phone_us", "1****"),
    ("529-37-4812", "ssn", "***-**-4812"), ("4111-1111-1111-1111", "credit_card", "4***********-1111"),
    ("Sarah Lee", "name", "Sa*** Le*"), ("Al Li", "name", "Al Li"), ("Bo", "name", "Bo*"), ("Sarah", "person_name", "Sa***"),
    ("742 Evergreen Terrace, Springfield", "address", "742 Evergreen Terrac***"), ("12 Elm", "address", "12 El***"),
    ("AB123456C", "ni_uk", "*****456C"), ("2001/02/03", "dob", "****-**-2001"), ("soon", "dob", "s***"),
    ("$95,000", "salary", "***"), ("$95,000", "generic", "$95,***"), ("8.8.8.8", "ipv4", "8.***.***.***"),
    ("8.8.8", "ipv4", "8.***"), ("Alice", "generic", "Alic*"), ("abcd", "generic", "a***"), ("x" * 30, "generic", "xxxx" + "*" * 10),
    ("", "email", ""), ("  ", "email", "  "), (None, "email", None),
]


@pytest.mark.parametrize("value,kind,want", PARTIAL)
def test_partial(one, value, kind, want):
    assert one(mask_partial("v", f"'{kind}'"), v=value) == want


REDACTED = [
    ("john.smith@example.com", "email", "j********h@example.com"), ("jo@x.org", "email", "j*@x.org"),
    ("555-123-4567", "phone_us", "555-***-*567"), ("(555) 123-4567", "phone", "(555) ***-*567"), ("12345", "phone", "1***5"),
    ("123-45-6789", "ssn", "*****6789"), ("4111-1111-1111-1111", "credit_card", "****-****-****-1111"),
    ("12345", "credit_card", "**23-45"), ("John Smith", "name", "J*** S****"), ("  ", "name", "***"),
    ("10.1.2.3", "ipv4", "10.*.*.*"), ("fe80:1", "ipv6", "f****1"), ("12 Elm St", "address", "12 ***"), ("Elm", "address", "***"),
    ("abcdef", "generic", "a****f"), ("ab", "generic", "**"),
]


@pytest.mark.parametrize("value,kind,want", REDACTED)
def test_partial_redaction(one, value, kind, want):
    assert one(partial_redaction("v", f"'{kind}'"), v=value) == want


def test_full_hash(one):
    assert one(mask_full("v", "'email'"), v="a@b.com") == "anon_d6b948fc08f7@scrubbed.local"
    assert one(mask_full("v", "'ipv4'"), v="192.168.1.1") == "192.168.1.1"
    assert one(mask_full("v", "'ipv4'"), v="8.8.8.8").startswith("10.")
    assert one(mask_full("v", "'phone_cn'"), v="13812345678").startswith("+1-555-")
    assert len(one(mask_full("v", "'ssn'", digits=12), v="123-45-6789")) == len("XXX-XX-") + 12
    assert one(mask_full("v", "'name'"), v="") == ""
    assert one(mask_full("v", "'generic'"), v="x") != one(mask_full("v", "'name'"), v="x")
    assert one(fake_value("v", "'cn_id'"), v="x").startswith("ID-")


def test_tokens(one):
    a = one(tokenize("v", "'email'", "k" * 8), v="a@b.com")
    assert a.startswith("tok_") and a.endswith("@masked.local")
    assert a == one(tokenize("v", "'email'", "k" * 8), v="a@b.com") != one(tokenize("v", "'email'", "other"), v="a@b.com")
    with pytest.raises(ValueError):
        tokenize("v", "'email'", "k", digits=8)
    with pytest.raises(ValueError):
        apply_mask("v", "'email'", "tokenize")
    assert apply_mask("v", "'x'", "delete") is None and apply_mask("v", "'x'", "whatever") == "v"


def test_policy():
    assert len(SENSITIVE_NAMES) == 51 and set(PRESETS) == {"external", "internal", "admin"}
    assert masking_level("Notes", "external") == "delete" and masking_level("anything", "external") == "scrub"
    assert masking_level("IP_Address", "internal") == "preserve" and masking_level("x", "no such") == "partial"
    assert masking_level("first_name", "admin") == "tokenize" and masking_level("dob", "admin") == "preserve"
    assert masking_level("a", {"a": "delete"}) == "delete" and masking_level("b", {"a": "delete"}) == "partial"


COERCED = [
    ("true", ("bool", True)), (" FALSE ", ("bool", False)), ("42", ("int", 42)), ("-7", ("int", -7)), ("--5", ("str", "--5")),
    ("1.5", ("float", 1.5)), ("1e3", ("float", 1000.0)), (".5", ("float", 0.5)), ("5.", ("float", 5.0)), ("+5", ("float", 5.0)),
    ("1_000", ("float", 1000.0)), ("1__0", ("str", "1__0")), ("-inf", ("float", float("-inf"))), ("1d", ("str", "1d")),
    ("", ("null", None)), ("NULL", ("null", None)), ("none", ("null", None)), ("nil", ("null", None)), ("NA", ("null", None)),
    ("n/a", ("null", None)), ("N.A.", ("str", "N.A.")), (" Alice ", ("str", "Alice")),
    ("12345678901234567890", ("int", "12345678901234567890")),
]


@pytest.mark.parametrize("value,want", COERCED)
def test_coercion(one, value, want):
    got = one(coerce("v"), v=value)
    filled = [got[f] for f in "blds" if got[f] is not None]
    assert (got["kind"], filled[0] if filled else None) == want


def test_unstripped_coercion(one):
    assert one(coerce("v", strip_first=False), v=" 42 ")["s"] == " 42 "
    assert one(coerce("v", strip_first=False), v="42")["l"] == 42


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=30))
def test_blank_and_strip_agree_with_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    got = df.select("v", F.expr(is_filled("v")).alias("f"), F.expr(strip("v")).alias("s")).collect()
    for r in got:
        assert r["f"] == bool(r["v"].strip()) and r["s"] == r["v"].strip()
