import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm import simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    runs = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    """Smallest id reachable by links of at most two bits, for (id, fingerprint)."""
    prints = [f for _, f in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, f in enumerate(prints):
            least = min(label[j] for j, g in enumerate(prints) if bin(f ^ g).count("1") <= 2)
            changed |= least < label[i]
            label[i] = least
    ids = {}
    for (i, _), k in zip(rows, label, strict=True):
        if i is not None:
            ids[k] = min(i, ids.get(k, i))
    return [ids.get(k) for k in label]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB \n\t\x0b\u2003é", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == slow_fingerprint(text)


def test_queries_agree_with_brute_force(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text").union(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100", "text"))
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(rows, slow_components(rows), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(3)
    prints = rng.integers(-2**63, 2**63, 60).tolist()
    for p in list(prints):  # chains of neighbours, two bits apart
        for _ in range(3):
            a, b = rng.choice(64, 2, replace=False)
            p = int(np.int64(p) ^ np.int64(np.uint64(1) << np.uint64(a)) ^ np.int64(np.uint64(1) << np.uint64(b)))
            prints.append(p)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    rows = [(p, p & (1 << 64) - 1) for p in prints]
    want = dict(zip(prints, slow_components(rows), strict=True))
    for parts, tile_rows in ((2, 7), (4, 4096), (8, 2)):
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, 2, parts, tile_rows)).collect()}
        groups = {}
        for p in prints:
            groups.setdefault(roots.get(p, p), set()).add(want[p])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_a_star_and_a_long_chain(spark):
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(60)]
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(200)} | {1000 + i: 1000 for i in range(61)}


def test_one_per_group_keeps_columns(odd_docs, no_docs):
    kept = simhash.one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # 2 copies 1, 4 and 5 have no words as 3
    assert sorted(i for i in ids if i is not None) == [1, 1, 3, 6, 7] and None in ids
    assert simhash.one_per_group(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0
