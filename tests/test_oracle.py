import ast
import inspect

import duckdb
import pytest

from catalog import oracle
from tests import plain
from veilspark.patterns import PATTERNS


@pytest.mark.parametrize("text, kind", [("API_KEY = ABCDEFGH12345678", "api_key"), ("ab 12 34 56 c", "ni_uk"), ("sw1a 1aa", "postcode_uk")])
def test_sql_ignores_case_where_the_grammar_does(text, kind):
    sql = oracle.scan("docs", "k", "text", "select type, match from kept")
    assert (kind, text) in duckdb.connect().execute(f"create table docs as select 1 as k, '{text}' as text").execute(sql).fetchall()


def test_the_grammar_is_written_out():
    names = [a.name for n in ast.walk(ast.parse(inspect.getsource(oracle))) if isinstance(n, ast.Import) for a in n.names]
    names += [n.module for n in ast.walk(ast.parse(inspect.getsource(oracle))) if isinstance(n, ast.ImportFrom)]
    assert not [n for n in names if n.startswith("veilspark")]
    assert [tuple(r) for r in oracle.PATTERNS] == [(p.category, p.type, p.regex, p.ignore_case) for p in PATTERNS]


# Texts and the types published for them.
VECTORS = [
    ("Contact john.doe@example.com for details", ["email"]),
    ("Call (555) 123-4567 or 555-987-6543", ["phone_us", "phone_us"]),
    ("Card: 4111-1111-1111-1111 and 5500 0000 0000 0004", ["credit_card", "credit_card"]),
    ("SSN: 123-45-6789", ["ssn"]),
    ("Server at 192.168.1.1 responded", ["ipv4"]),
    ("api_key = sk-abc123def456ghi789jkl", ["api_key"]),
    ("no: 11010519491231002X", ["cn_id"]),
    ("The quick brown fox jumps over the lazy dog", []),
    ("Senior Engineer", []),
    ("NULL", []),
]


@pytest.mark.parametrize("text, types", VECTORS)
def test_both_grammars_by_published_vectors(text, types):
    sql = oracle.scan("docs", "k", "text", "select type from kept order by start")
    db = duckdb.connect().execute("create table docs as select 1 as k, ? as text", [text])
    assert [t for t, in db.execute(sql).fetchall()] == types
    assert [t for t, *_ in plain.greedy(plain.raw(text))] == types
