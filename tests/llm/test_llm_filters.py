import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.llm import chat, linededup, mixing, quality, toxicity, urlfilter


# -- URLs

@pytest.mark.parametrize("url, host, path", [
    (None, "", ""), ("", "", ""), ("no scheme", "", ""), ("http://A.Org", "a.org", ""), ("http://a.org?x=/y", "a.org", ""),
    ("x://É.Com:80/A/b?c#d", "É.com:80", "/A/b"), ("http://a/b#c?d", "a", "/b"), ("a://b://c/d", "b:", "//c/d")])
def test_url_parts(url, host, path):
    assert urlfilter.split_url(url) == (host, path)


def test_longest_rule_wins():
    rules = urlfilter.Rules(urlfilter.RULES)
    assert rules.find("www.example.org", "/es/1") == ("example.org/es/", "block")
    assert rules.find("www.example.org", "/en/12") == ("example.org/en/1", "block")
    assert rules.find("example.org", "/en/2") == ("org/", "allow")
    assert rules.find("notexample.org", "/es/") == ("org/", "allow")
    assert rules.find("org", "") is None
    assert rules.find("com", "/de/") == ("com/de/", "block")


def test_terms_need_boundaries():
    terms = urlfilter.automaton(urlfilter.VOCABULARY)
    assert urlfilter.hits("http://CASINO-win.example.org/", terms) == (1, 1)
    assert urlfilter.hits("http://essex.example.org/winner/xxxl", terms) == (0, 0)
    assert urlfilter.hits("http://free.free/free", terms) == (0, 1)
    assert urlfilter.hits("http://cheap-pills.example.net/", terms) == (0, 2)
    assert urlfilter.hits("http://a/", urlfilter.automaton({})) == (0, 0)


def test_urls_of_all_kinds(spark):
    pages = spark.createDataFrame([(1, None, "h"), (2, "", "h"), (3, "http://casino.example.net/x", "h"), (3, "http://casino.example.net/x", "h"),
                                   (4, "http://a.org/" + "y" * 100_000, "h"), (None, "casino", "h")], "page_id long, url string, Host string")
    got = urlfilter.judge(pages)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict", "n_strict", "n_soft"]
    assert [r.verdict for r in got.orderBy(F.coalesce("page_id", F.lit(9))).collect()] == ["allow", "allow", "block", "block", "allow", "block"]
    assert urlfilter.judge(pages.limit(0)).count() == 0


# -- quality

@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.integers(1, 6))
def test_repeated_windows(words, window):
    words = [w.encode() for w in words]
    runs = [tuple(words[i:i + window]) for i in range(len(words) - window + 1)]
    marked = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(window)}
    assert quality.repeated_words(words, window) == len(marked)


def test_measures():
    zero = quality.np.zeros(8)
    text = "a É# \n\n b|\na É# \n \n"
    assert quality.measure(text, zero)[:5] == (5, 8, 3, 1, 0)
    assert quality.measure(None, zero)[:5] == quality.measure("", zero)[:5] == (0, 0, 0, 0, 0)


def test_quality_agrees_with_plain_sums(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1").select("doc_id")
    got = {r.doc_id: r for r in quality.judge(docs, labels.union(labels), buckets=512).collect()}
    good = {r.doc_id for r in labels.collect()}
    raw, target = [0] * 512, [0] * 512
    for i, r in got.items():
        for b in quality.buckets_of(r.text.encode().split(), 512).tolist():
            raw[b] += 1
            target[b] += i in good
    ratio = [math.log((t * 512 / sum(target) + 1) / (n * 512 / sum(raw) + 1)) for t, n in zip(target, raw, strict=True)]
    for r in got.values():
        at = quality.buckets_of(r.text.encode().split(), 512).tolist()
        assert r.llr == pytest.approx(sum(ratio[b] for b in at) / len(at), abs=1e-9)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and round(r.llr, 9) >= quality.THRESHOLD)
    odd = quality.judge(odd_docs.withColumn("Kept", F.lit(1)), odd_docs.select("doc_id"))
    assert odd.count() == odd_docs.count()
    assert odd.where("base_failed is null or kept is null or llr is null").count() == 0
    assert quality.judge(no_docs, labels).count() == 0
    assert quality.judge(odd_docs, labels.limit(0)).where("llr <> 0").count() == 0


# -- toxicity

def test_lexicon_is_picked_by_coverage():
    toxic = {"=bad": {1, 2, 3, 4}, "vile": {4, 5, 6, 7}, "viler": {5, 6, 7}, "rare": {8, 9}, "both": {1, 2, 3, 4, 5, 6, 7}}
    assert toxicity.pick(toxic, {"both": 5}) == ["vile", "=bad"]


def test_features():
    f = dict(zip(toxicity.FEATURES, toxicity.features("You IDIOT! you 1d1ot", frozenset({"=idiot"})), strict=True))
    assert f["insults"] == 0.5 and f["stems"] == 0.5 and f["near_second"] == 0.5 and f["obfuscated"] == 0.25
    assert toxicity.features(None, frozenset()) == toxicity.features("", frozenset()) == [0.0] * len(toxicity.FEATURES)
    assert len(toxicity.features("x " * 200_000, frozenset({"=x"}))) == len(toxicity.FEATURES)


def test_toxicity_on_held_out_rows(spark):
    plain = ["soft rain falls on the quiet hills", "bread and cheese for the long walk", "a lamp burns in the small window"]
    rows = [(i, f"{plain[i % 3]} {i} {'you worthless idiot' if i % 4 == 0 else 'my dear friend'} {plain[i % 2]}", i % 4 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "x", True) for i, t, _ in rows], "doc_id long, text string, lang string, Held_Out boolean")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(None, 1), (1, None), (9999, 1)], "doc_id long, toxic int")
    got = toxicity.judge(docs, labels)
    assert got.columns == ["doc_id", "text", "lang", "held_out", "score", "predicted"]
    held = got.where("held_out").collect()
    import zlib
    assert {r.doc_id for r in held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.predicted == (r.doc_id % 4 == 0) and 0 <= r.score <= 1 for r in held)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(2, 1), (6, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.judge(odd_docs, none).collect()} == {0.0}
    assert {r.score for r in toxicity.judge(odd_docs, one).collect()} <= {0.0, 1.0}
    two = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    got = toxicity.judge(odd_docs, two)
    assert got.count() == odd_docs.count() and got.where("score is null or predicted is null or held_out is null").count() == 0
    assert toxicity.judge(no_docs, two).count() == 0


# -- mixing

def slow_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    held = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in held)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in held) for s in names if s not in held}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in held else share[s] for s in names}
        held |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 50}, {"a": 7}, {None: 0, "b": 3}, {"a": 1, "b": 1, "c": 1, "d": 4000}])
def test_targets(spark, sizes):
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = slow_targets(sizes)
    assert {r.source for r in got} == set(want)
    for r in got:
        assert r.target == pytest.approx(want[r.source])


def test_mix_of_odd_rows(odd_docs, no_docs):
    got = mixing.mix(odd_docs)
    rows = got.collect()
    assert len(rows) == odd_docs.count() and "Size" not in got.columns and rows == mixing.mix(odd_docs).collect()
    assert all(r.taken == r.passes * r.size and r.passes <= 3 for r in rows)
    assert {r.size for r in rows if not (r.text or "").strip(" \t\n")} == {0}
    assert mixing.mix(no_docs).count() == 0
    assert mixing.copies(got).count() == sum(r.passes for r in rows)


def test_mix_takes_the_best_keys_up_to_the_target(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 5 + 1) + "#" * (i % 3), f"s{i % 4}") for i in range(2000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs.withColumn("_w", F.lit(1.0)), weight=F.lit(1.0)).collect()
    import hashlib
    import math
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        u = {r.doc_id: (int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:12], 16) + .5) / 2**48 for r in mine}
        mine.sort(key=lambda r: -math.log(u[r.doc_id]))
        least = min(r.passes for r in mine)
        more = [r.passes > least for r in mine]
        assert more == sorted(more, reverse=True)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 6


# -- lines

def test_repeated_chunks_go_and_the_first_stays(spark, odd_docs, no_docs):
    passage = "\n".join(f"line number {i} of a passage that is passed around" for i in range(12))
    rows = [(i, f"own start {i}\nsecond own {i * 7}\n{passage}\nown end {i}", "x") for i in range(5)] + [(9, "own\n\n\n\n\n", "x"), (8, "\n\n\n\n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_Lines string")
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert got[0].text == rows[0][1] and got[0].n_removed == 0
    for i in range(1, 5):
        assert got[i].n_removed >= 4 and got[i].n_lines == 15 and len(got[i].text.split("\n")) == 15 - got[i].n_removed
        assert got[i].text.startswith(f"own start {i}\n") and got[i].text.endswith(f"own end {i}")
    assert got[9].text == rows[5][1] and got[8].text == rows[6][1]
    odd = linededup.dedup_lines(odd_docs)
    assert odd.columns == [*odd_docs.columns, "n_lines", "n_removed"]
    assert sorted(map(str, odd.select(*odd_docs.columns).collect())) == sorted(map(str, odd_docs.collect()))
    assert [r.n_lines for r in odd.where("text is null").collect()] == [0]
    assert linededup.dedup_lines(no_docs).count() == 0


# -- conversations

def slow_maximal(rows):
    convs = {}
    for c, turn, role, text in {(c, t if c is not None else None, r or "", x or "") for c, t, r, x in rows}:
        convs.setdefault((c,) if c is not None else (None, role, text), {}).setdefault(turn, set()).add((role, text))
    flat = {k: tuple(tuple(sorted(v[t])) for t in sorted(v, key=lambda t: (t is not None, t or 0))) for k, v in convs.items()}
    order = sorted(flat, key=lambda k: (k[0] is None, k[0] or 0, k))
    first = {}
    for k in order:
        first.setdefault(flat[k], k)
    return {k: u for u, k in first.items() if not any(len(v) > len(u) and v[:len(u)] == u for v in first)}


@pytest.mark.parametrize("block", [2, 1024])
def test_snapshots_collapse(spark, block):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "how"), ("assistant", "fine"), ("user", "bye")]
    rows = [(c, t, *turns[t]) for c, n in ((1, 3), (2, 5), (3, 5), (4, 1), (5, 2)) for t in range(n)]
    rows += [(5, 2, "user", "other"), (6, 0, None, None), (6, 1, "user", ""), (None, 0, "user", "alone"), (None, 7, "user", "hi"),
             (7, None, "user", "x"), (7, 3, "user", "y"), (7, 3, "user", "z"), (2, 0, "user", "hi"), (8, 5, "user", "hi")]
    df = spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {}
    for r in chat.render(df, block).orderBy("part").collect():
        key = (r.conv_id,) if r.conv_id is not None else (None, r.text)
        got.setdefault(key, ["", r.n_turns])[0] += r.text
    want = {}
    for k, units in slow_maximal(rows).items():
        text = "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for u in units for r, x in u)
        want[(k[0],) if k[0] is not None else (None, text)] = [text, len(units)]
    assert got == want
    assert chat.render(df.limit(0)).count() == 0


def test_a_long_conversation_comes_in_parts(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(2500)] + [(2, t, "user", f"t{t}") for t in range(2400)]
    got = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id, r.part, r.n_turns) for r in got) == [(1, 0, 2500), (1, 1, 2500), (1, 2, 2500)]


# --- restated independently ---------------------------------------------------

def documents(spark, folder="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text")


def test_quality_columns_against_brute_force(spark):
    docs = documents(spark)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1").select("doc_id")
    for r in quality.judge(docs, labels).collect():
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        often = {w for w, n in Counter(windows).items() if n > 1}
        covered = {i + k for i, w in enumerate(windows) if w in often for k in range(5)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)


def slow_features(text, lexicon):
    """The thirteen features, word by word."""
    text = text or ""
    signs = dict(zip("01345 7@$!".replace(" ", ""), "oieastasi"))
    found = re.findall(r"[^\W_]+(?:[@$!*'’][^\W_]+)*", text.lower())
    inside = r"[^\W\d_][013457@$!*]+[^\W\d_]"
    words = ["".join(signs.get(c, c) for c in w) if re.search(inside, w) else w for w in found]
    listed = [any(m == "=" + w or not m.startswith("=") and w.startswith(m) and len(w) > len(m) for m in lexicon) for w in words]
    you = [w in toxicity.SECOND_PERSON for w in words]
    insults = sum(w in toxicity.INSULTS for w in words)
    near = sum(any(you[max(0, i - 3): i + 4]) for i, hit in enumerate(listed) if hit)
    n, chars = max(1, len(words)), max(1, len(text))
    shouted = [w for w in text.split() if len(w) > 2 and w.isupper()]
    return [insults / n, math.log1p(insults), sum(listed) / n, math.log1p(sum(listed)), math.log1p(len({w for w, x in zip(words, listed) if x})),
            near / n, sum(you) / n, sum(c.isupper() for c in text) / chars, len(shouted) / n, len(re.findall(r"[!-/:-@\[-`{-~]", text)) / chars,
            text.count("!") / chars, len(re.findall(inside, text)) / n, math.log1p(len(words))]


def test_features_against_brute_force(spark):
    lexicon = frozenset(["=the", "=und", "conn", "idio", "=ciónes", "ther", "abscha"])
    odd = ["You 1d10t!! you IDIOT", "st*pid a$$hole @nd y0u", "tu es un connard, toi", None, "", "don’t SHOUT at me!", "ABSCHAUM_und du"]
    texts = [r.text for r in documents(spark).collect()][:120] + odd
    for t in texts:
        assert toxicity.features(t, lexicon) == pytest.approx(slow_features(t, lexicon), abs=1e-12), t


def test_scores_are_calibrated_and_learn_from_other_folds_only(spark):
    docs = documents(spark, "sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    judged = toxicity.judge(docs, labels)
    rows = [r for r in judged.join(labels, "doc_id").where("toxic is not null").select("doc_id", "toxic", "score", "predicted", "held_out").collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    ones, zeros = [r.score for r in held if r.toxic == 1], [r.score for r in held if r.toxic == 0]
    area = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert area > 0.93 and sum(r.predicted == r.toxic for r in held) / len(held) > 0.95
    # a calibrated score is a frequency: among the held-out rows the mean score is near the share of toxic ones
    assert abs(sum(r.score for r in held) / len(held) - len(ones) / len(held)) < 0.03
    # labels of the held-out fold change nothing
    turned = labels.withColumn("toxic", F.when(F.expr("pmod(crc32(cast(doc_id as string)), 5)") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = {r.doc_id: r.score for r in toxicity.judge(docs, turned).where("doc_id % 50 = 0").select("doc_id", "score").collect()}
    same = {r.doc_id: r.score for r in judged.where("doc_id % 50 = 0").select("doc_id", "score").collect()}
    assert other == same
