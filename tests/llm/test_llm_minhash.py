import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm import minhash

SCHEMA = "doc_id long, text string"


def slow_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def slow(rows, percent=85):
    """Every pair of sets, compared as they are."""
    sets = [slow_set(t) for _, t in rows]
    above = list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    above[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(s), least.get(top(i)), d == least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def found(df, **how):
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, **how).collect()]


ORDER = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
    return words


def families(seed, of=12, copies=25, size=(3, 120)):
    """Groups of copies at all distances: of the first text, of the one before, and of nothing but a common passage."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for f in range(of):
        base = last = [f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(*size))]
        for _ in range(copies):
            last = edited(rng, last, rng.randrange(3)) if f % 3 else base
            words = last if f % 3 == 1 else edited(rng, base, rng.randrange(5)) if f % 3 == 2 else passage + edited(rng, base[:20], rng.randrange(9))
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, monkeypatch, seed):
    tile = minhash.unsettled.__defaults__
    monkeypatch.setattr(minhash.unsettled, "__defaults__", (5, 3000))
    rows = families(seed)
    assert tile == (minhash.TILE, minhash.TILE_BYTES) and sorted(found(spark.createDataFrame(rows, SCHEMA))) == sorted(slow(rows))


def test_links_right_at_the_bound(spark):
    # 17 of 20 shingles are exactly 85 hundredths
    base = [f"b{i}" for i in range(20)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "y", "z"])), (3, " ".join([*base, "u", "v", "w"])), (4, " ".join(["q", *base, "r", "s"])),
            (5, " ".join([f"b{i}" for i in range(19)])), (6, " ".join([f"b{i}" for i in range(22)] + ["o"]))]
    assert sorted(found(spark.createDataFrame(rows, SCHEMA))) == sorted(slow(rows))
    rows = [(1, " ".join(f"b{i}" for i in range(19))), (2, " ".join(f"b{i}" for i in range(22)))]
    assert found(spark.createDataFrame(rows, SCHEMA)) == [(1, 17, 1, True), (2, 20, 1, False)] == slow(rows)


def test_given_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert sorted(found(table)) == sorted(slow([tuple(r) for r in table.collect()]))


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(None, None), (None, "no id here"), (50, "two words"), (51, "Two  WORDS "), (52, "two"), (53, "two\twords more"), (None, "alone as such")]
    want = [(d, n, c, d == c) if n else (d, 0, d, True) for d, n, c, _ in slow(rows)]
    assert sorted(found(spark.createDataFrame(rows, SCHEMA)), key=ORDER) == sorted(want, key=ORDER)
    assert sorted(found(odd_docs), key=ORDER) == sorted(((d, n, c, d == c) if n else (d, 0, d, True) for d, n, c, _ in slow([tuple(r) for r in docs.collect()])), key=ORDER)
    assert found(no_docs) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB \n\t\x0b é", max_size=60), st.text(alphabet="abAB \n\t\x0b é", max_size=60))
def test_sets(a, b):
    x, y = minhash.shingles(a), minhash.shingles(b)
    assert len(x) == len(slow_set(a)) and len(set(x.tolist()) & set(y.tolist())) == len(slow_set(a) & slow_set(b))


def test_minima_estimate_similarity():
    rng = np.random.default_rng(1)
    for common in (0, 50, 90, 100):
        pool = rng.integers(0, 1 << 63, 300, np.uint64)
        a, b = np.concatenate((pool[:common], pool[100:200 - common])), np.concatenate((pool[:common], pool[200:300 - common]))
        j = common / (200 - common)
        agree = (minhash.minima(a) == minhash.minima(b)).mean()
        assert abs(agree - j) < 5 * max(j * (1 - j) / minhash.MINIMA, 1e-9) ** 0.5
