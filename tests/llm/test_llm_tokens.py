import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.llm import bytelevel, idcodec, tokencount


def slow_count(word, costs):
    """(cost, pieces) of the best segmentation, by trying all."""
    byte = max(costs.values(), default=0) + tokencount.BYTE_PENALTY * tokencount.UNIT
    best = {0: (0, 0)}
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        found = [(best[end - 1][0] + n * byte, best[end - 1][1] + n)]
        found += [(best[s][0] + costs[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in costs]
        best[end] = min(found)
    return best[len(word)][1]


COSTS = tokencount.zipf_costs(["▁a", "a", "b", "ab", "▁ab", "bab", "abab", "▁", "é"])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abcé", min_size=1, max_size=9), max_size=8))
def test_trie_agrees_with_plain_programming(words):
    trie = tokencount.Trie(COSTS)
    trie.add({"▁" + w for w in words})
    assert trie.counts == {"▁" + w: slow_count("▁" + w, COSTS) for w in words}


def test_common_beginnings_are_scored_once():
    trie = tokencount.Trie(COSTS)
    trie.add(["▁ababab", "▁ababb", "▁abab"])
    assert trie.scored == len("▁ababab") + len("b")


def test_counts_of_documents(odd_docs, no_docs):
    got = tokencount.token_counts(odd_docs.withColumn("N_Words", F.lit("x")), tokencount.public_costs, batch_bytes=50).collect()
    costs = tokencount.public_costs()
    assert len(got) == odd_docs.count()
    for r in got:
        words = [w.decode() for w in (r.text or "").encode().split()]
        assert r.n_words == len(words)
        if len(words) < 100:
            assert r.n_tokens == sum(slow_count("▁" + w, costs) for w in words)
    assert tokencount.token_counts(no_docs, tokencount.public_costs).count() == 0


def test_a_small_store_changes_nothing():
    texts = ["a ab abab", "b b ab", None, "", "abab a"]
    whole = tokencount.count_batch(texts, tokencount.Trie(COSTS))
    trie = tokencount.Trie(COSTS)
    assert [tokencount.count_batch([t], trie, 2)[0] for t in texts] == whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=400), st.integers(6, 16), st.integers(1, 70))
def test_codes_round_trip(ids, longest, every):
    ids = np.array(ids)
    counts = np.bincount(ids)
    lengths = idcodec.code_lengths(counts, longest)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= longest
    bits, offsets = idcodec.pack(ids, idcodec.canonical(lengths), lengths, every)
    table = idcodec.decoding_table(lengths, longest)
    for back in idcodec.unpack([(bits, offsets, len(ids)), (bits, offsets, len(ids))], table, every, longest):
        assert (back == ids).all()


def test_lengths_are_best_where_unlimited():
    import heapq
    counts = np.array([5, 9, 12, 13, 16, 45, 1, 1, 1, 30])
    heap, total = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    assert (idcodec.code_lengths(counts, 16) * counts).sum() == total
    assert idcodec.code_lengths(counts, 4).max() == 4
    with pytest.raises(ValueError):
        idcodec.code_lengths(counts, 3)


def test_files_hold_what_the_tokenizer_says(spark, odd_docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    docs = odd_docs.union(odd_docs.limit(2)).repartition(5)
    got = idcodec.digest(idcodec.round_trip(docs)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for r in docs.collect():
        raw = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        ids.setdefault(r.doc_id, []).append((len(raw), zlib.crc32(raw.tobytes())))
    want = {k: sorted(v) for k, v in ids.items()}
    have, at = {}, 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == want
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert idcodec.digest(idcodec.round_trip(no_docs)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 'st\n\t\x1c\x85\xa0é.,!19<|endoftext|>世ß\u0301 ", max_size=24) | st.text(max_size=12))
def test_pieces_say_what_the_tokenizer_says(text):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert bytelevel.PATTERN == public_tokenizers.PATTERN
    assert np.frombuffer(bytelevel.encoder_of(path, "<u4")(text), "<u4").tolist() == \
        bytelevel.tokenizer_of(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=127), st.sampled_from(" \n\t\x0b\x1c\x1f'stremvld1a.")), max_size=20))
def test_ascii_is_cut_by_the_standard_library(text):
    import public_tokenizers
    import regex
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = bytelevel.Encoder(bytelevel.tokenizer_of(path), "<u4")
    assert encoder.find_ascii(text) == regex.findall(bytelevel.PATTERN, text)
    encoder.find = None
    assert np.frombuffer(encoder(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_known_words_are_not_encoded_anew():
    import public_tokenizers
    encoder = bytelevel.Encoder(bytelevel.tokenizer_of(public_tokenizers.path("byte_bpe_50k.json")), "<u2")
    model, asked = encoder.model, []
    encoder.model = lambda spelt: asked.append(spelt) or model(spelt)
    for text in ("a thbleed über", "a thbleed### thbleed, thbleed\nA über\n### über99", "A\n###\nb\u00a0c a\n\nb 1\n 2"):
        assert encoder(text) == encoder.whole(text)
    assert asked.count("Ġthbleed") == 1 and asked.count("ĠÃ¼ber") == 1


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_ids_of_a_slice_share_its_memory(kind):
    import pyarrow as pa
    texts = [[5, 70], [], [65535], [1, 2, 3], []]
    raw = pa.array([np.array(t, kind).tobytes() for t in texts], pa.binary())
    for a, b in ((0, 5), (1, 4), (2, 2), (4, 5)):
        ids, bounds = idcodec._flat(raw[a:b], kind)
        assert [ids[x:y].tolist() for x, y in zip(bounds, bounds[1:])] == texts[a:b]
    assert [x.tolist() for x in idcodec._flat(pa.array([], pa.binary()), kind)] == [[], [0]]


def test_other_tokenizers_go_whole():
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = bytelevel.encoder_of(path, "<u4")
    assert not encoder.by_pieces
    assert np.frombuffer(encoder("Two  Words"), "<u4").tolist() == bytelevel.tokenizer_of(path).encode("Two  Words", add_special_tokens=False).ids


def test_rows_without_ids_and_texts(spark):
    docs = spark.createDataFrame([(None, None), (None, "a"), (None, None)], "doc_id long, text string")
    got = sorted((r.start, r.n_tokens) for r in idcodec.digest(idcodec.round_trip(docs)).collect())
    assert [n for _, n in got] in ([1, 1, 2], [1, 2, 1], [2, 1, 1]) and got[0][0] == 0


def test_blocks_and_files_of_any_size(spark, tmp_path):
    rows = [(i, np.arange(i % 7, dtype="<u4").tobytes() + b"\2\0\0\0") for i in range(300)]
    tokens = spark.createDataFrame(rows, "doc_id long, ids binary")
    for blocks, every in ((1, 1), (10, 3), (10_000, 512)):
        path = f"file:{tmp_path}/{blocks}"
        idcodec.write_ids(tokens, path, block_ids=blocks, every=every)
        back = sorted((r.doc_id, bytes(r.ids), r.start) for r in idcodec.read_ids(spark, path).collect())
        assert [r[:2] for r in back] == rows
        assert [r[2] for r in back] == np.cumsum([0] + [len(x) // 4 for _, x in rows[:-1]]).tolist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_found_as_by_the_library(name):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path(name)
    plain, encode = Tokenizer.from_file(path), bytelevel.encoder_of(path, "<u4")
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    assert added
    for t in added:
        for text in (t, f"a {t} b", f"a{t}{t}b  {t}\n", f"x {t[:-1]} y", f" {t.upper()} é {t}", "plain text"):
            assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
