import hashlib
import random

from pyspark.sql import functions as F

from veilspark.llm import linededup

SCHEMA = "doc_id long, text string"


def words(line):
    return len(line.encode().split())


def chunks(lines):
    """(start, end) of chunks; a line's own hash or a long line ends one."""
    out, start = [], 0
    for i, x in enumerate(lines):
        if (i == len(lines) - 1 or words(x) > 50 or words(lines[i + 1]) > 50 or int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % 3 == 0):
            out.append((start, i))
            start = i + 1
    return out


def large(lines):
    n = sum(map(words, lines))
    return sum(words(x) > 0 for x in lines) >= 2 and n >= 10 or n > 50


def slow(rows):
    """Texts without chunks that stand in an earlier document or place, one document after another."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        for a, b in chunks(lines):
            part = "\n".join(lines[a:b + 1])
            if large(lines[a:b + 1]):
                if part in seen:
                    gone.update(range(a, b + 1))
                seen.add(part)
        out[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)
    return out


def found(spark, rows):
    return {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}


def own(rng, n):
    return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))


def planted(lines, seed=7, of=60):
    """Passages of over 50 words in so many lines, each planted among three documents' own lines."""
    rng = random.Random(seed)
    passages = ["\n".join(own(rng, 60 // lines + 1) for _ in range(lines)) for _ in range(of)]
    rows = [(i * 10 + k, "\n".join([own(rng, 9), own(rng, 12), p, own(rng, 12), own(rng, 9)])) for i, p in enumerate(passages) for k in range(3)]
    return passages, rows


def test_long_lines_stay_once(spark):
    passages, rows = planted(1)
    got, before = found(spark, rows), dict(rows)
    for i, p in enumerate(passages):
        assert got[i * 10][0] == before[i * 10]
        assert [got[i * 10 + k][0] for k in (1, 2)] == [before[i * 10 + k].replace(p + "\n", "") for k in (1, 2)]


def test_longer_passages_lose_all_but_their_edges(spark):
    passages, rows = planted(20)
    got = found(spark, rows)
    gone = [got[i * 10 + k][2] for i in range(len(passages)) for k in (1, 2)]
    assert sum(gone) / len(gone) > 0.5 * 20 and all(got[i * 10][2] == 0 for i in range(len(passages)))


def test_against_a_slow_restatement(spark):
    rng = random.Random(3)
    pool = ["a", "b b", "", " \t", "own words", "three words here and seven more to make ten", own(rng, 51), own(rng, 50), " " + "\t".join(own(rng, 60).split()) + " ",
            *(own(rng, 7) for _ in range(6))]
    rows = [(i, "\n".join(rng.choice(pool if rng.random() < 0.8 else [own(rng, 3)]) for _ in range(rng.randrange(1, 14)))) for i in range(300)]
    got = found(spark, rows)
    assert got == slow(rows) and sum(n for _, _, n in got.values()) > 100


def test_what_goes_stands_elsewhere_in_one_piece(spark):
    rng = random.Random(9)
    x, a, b = (own(rng, 12) for _ in range(3))
    for docs in ([(1, f"{x}\n{a}"), (2, f"{x}\n{a}\n{b}"), (3, f"{a}\n{b}")], [(1, f"{a}\n{b}"), (2, f"{b}\n{a}\n{b}"), (3, f"{a}\n{b}\n{a}\n{b}")]):
        kept = "\n\n".join(t for t, _, _ in found(spark, docs).values())
        assert f"{a}\n{b}" in kept and all(y in kept for _, t in docs for y in t.split("\n"))
    rows = [(i, "\n".join(rng.choice([x, a, b, own(rng, 12)]) for _ in range(6))) for i in range(60)]
    got = found(spark, rows)
    for key, text in rows:
        lines = text.split("\n")
        for s, e in chunks(lines):
            assert any("\n".join(lines[s:e + 1]) in t for t, _, _ in got.values())


def test_small_chunks_stay(spark):
    rows = [(1, "q\nq\nq"), (2, "f(x) {\n  }\n}"), (3, "g(x) {\n  }\n}"), (4, "q\nq\nq"), (5, ""), (6, "\n\n"), (7, "\n\n")]
    assert found(spark, rows) == {k: (t, t.count("\n") + 1, 0) for k, t in rows}


def test_bytes_decide_where_numbers_collide(spark, monkeypatch):
    monkeypatch.setattr(linededup, "digest", lambda chunk: F.length(chunk).cast("bigint") % 7)
    rng = random.Random(5)
    pool = [own(rng, 6)[:40] for _ in range(6)] + [own(rng, 51)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 7)))) for i in range(60)]
    assert found(spark, rows) == slow(rows)


def test_a_passage_in_every_document(spark):
    """No task gathers the copies: each gives away one row, and one chunk's texts meet as a least and a greatest."""
    rng = random.Random(2)
    p = own(rng, 80)
    rows = [(i, f"{own(rng, 4)}\n{p}\n{own(rng, 4)}") for i in range(3000)]
    got = found(spark, rows)
    assert got[0][2] == 0 and all(got[i][2] == 1 for i in range(1, 3000))
