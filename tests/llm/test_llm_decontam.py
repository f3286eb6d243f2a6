import hashlib
import re

from pyspark.sql import functions as F

from veilspark.llm import decontam
from veilspark.llm.common import with_row_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, length):
    wins = set()
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - length + 1) if w else 0):
            wins.add(("" if item is None else str(item), tuple(w[i:i + length])))
    out = []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for item, run in wins:
            for s in range(len(w) - len(run) + 1):
                if tuple(w[s:s + len(run)]) == run:
                    hit.update(range(s, s + len(run)))
                    found.add(item)
        ids = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_matches_agree_with_brute_force(spark, odd_docs):
    items = [(1, "alpha beta gamma delta epsilon zeta"), (2, "The Kelvin \u212a sign"), (3, "ıİ ß É"), (4, None), (5, ""), (6, "--"), (None, "one"),
             (7, "x x x"), (7, "beta gamma delta"), (8, "beta gamma delta"), (9, "alpha beta gamma delta epsilon zeta"), (10, "quick brown fox jumps")]
    docs = [(1, "Alpha, beta GAMMA delta; epsilon zeta! and alpha beta gamma"), (2, "the kelvin \u212a sign, the kelvin k sign"), (3, "IıiİI ß É ıİ ß É"),
            (4, "x x x x x one x"), (5, "alpha beta gamma delta"), (5, "alpha beta gamma delta"), (6, " ".join(["pad"] * 300) + " beta gamma delta"), (7, None)]
    docs += [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("N_Hit", F.lit("x"))
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, win int")
    for length in (3, 4, 13):
        got = decontam.judge(df, bench, length=length)
        rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()]
        assert sorted(rows, key=str) == slow(docs, items, length)


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha x beta gamma delta"), (2, "alpha beta gamma delta"), (3, "beta alpha gamma delta"), (4, "alpha " + "x " * 9 + "beta")],
                                 "doc_id long, text string")
    exact, near, _ = decontam.matches(with_row_key(docs), bench, length=4)
    assert {r._k1 for r in exact.collect()} == {2}
    # the rarest words, gamma and delta, stand together, but not in the whole phrase
    assert {(r._k1, r.apart) for r in near.collect()} == {(1, 0), (3, 0)}


def test_empty_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "the quick brown")], "item_id long, text string")
    assert decontam.judge(no_docs, bench).count() == 0
    got = decontam.judge(odd_docs, bench.limit(0))
    assert got.count() == odd_docs.count() and got.where("contaminated or n_hit > 0").count() == 0
