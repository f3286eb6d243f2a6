import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def slow(rows, least=10, top=10):
    """The same by plain counting, term after term."""
    texts = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, la, so in rows]
    groups, docs, counts = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for la, so, words in texts:
        groups[la].add(so)
        docs[la].update(set(words))
        counts[la, so].update(words)
    out = set()
    for la, sources in groups.items():
        kept = [t for t, n in docs[la].items() if n >= least]
        def share(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}
        p = {so: share(counts[la, so]) for so in sources}
        q = share(sum((counts[la, so] for so in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for so in sources:
            pair = [(-sum(f(p[so][t], p[o][t]) for t in kept), o.encode()) for o in sources - {so}]
            term = [(-f(p[so][t], q[t]), t.encode()) for t in kept if counts[la, so][t] and p[so][t] > q[t]]
            out |= {(la, so, part, i.decode(), -v, k + 1) for part, found in (("pair", pair), ("term", term))
                    for k, (v, i) in enumerate(sorted(found)) if part == "pair" or k < top}
    return out


def found(df, **how):
    got = [tuple(r) for r in divergence.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def random_rows(seed, n=400):
    rng = random.Random(seed)
    words = ["a", "B", "Été", "été", "x-y", "don't", " z", "ß", "日本", "\U0001f600", "q1q", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    rows = [(i, " ".join(rng.choices(words[: rng.choice((6, 20, 71))], k=rng.randrange(0, 30))), rng.choice(["en", "en", "de", "", None]),
             rng.choice(["s1", "s1", "s1", "s2", "", None, "\x00", "é"])) for i in range(n)]
    return rows + [rows[0]] * 5 + [(None, None, "en", "only null"), (1, "", "xx", "no terms"), (2, "rare words only", "xx", "b")]


def test_against_a_slow_restatement(spark):
    rows = random_rows(1)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"value": F.lit("x"), "Rank": F.lit(1), "part": F.lit(None).cast("string")})
    assert found(df) == slow(rows)
    assert found(df.repartition(7), least=3, top=2) == slow(rows, 3, 2)


def test_small_tables_and_stretches(spark, monkeypatch):
    rows = random_rows(2)
    monkeypatch.setattr(divergence, "HELD", 5)
    monkeypatch.setattr(divergence, "STRETCH", 16)
    assert found(spark.createDataFrame(rows, SCHEMA)) == slow(rows)


def test_empty_and_lone(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == set()
    assert found(spark.createDataFrame([(1, "word " * 50, "en", "a")], SCHEMA)) == set()
    long = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(200_000))
    rows = [(i, long if i == 3 else "ab cd", "en", "abc"[i % 3]) for i in range(12)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == slow(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 10**11)), min_size=1, max_size=40))
def test_common_runs(pairs):
    a, b = (np.array(c, np.int64) for c in zip(*pairs))
    b = np.where(a == 2, 7, b)  # some runs
    x, y, lengths = divergence.common_runs(divergence.run_lengths(a), divergence.run_lengths(b), len(a))
    assert np.repeat(x, lengths).tolist() == a.tolist() and np.repeat(y, lengths).tolist() == b.tolist()
    assert divergence.share(b, 10**12, 5).tolist() == [1 + 10**9 * (int(c) + 2) // (10**12 + 10) for c in b]
