"""Token counts under a unigram model, with dynamic programming shared along a trie.

A text is cut into pre-tokens, words with a mark in front. The best segmentation of
a pre-token into vocabulary pieces has the least cost; its length is the count. The
distinct pre-tokens of a batch, in sorted order, are a trie read depth first: forward
scores up to the common beginning with the word before are kept, so every shared
prefix is scored once. Counts at the ends of words are stored and summed by document.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clear_of

MARK = "▁"
VOCABULARY = "piece_bpe_32k.model"
#: bytes of text whose pre-tokens go through one trie
BATCH_BYTES = 8 << 20
#: stored terminal counts; a store that grows beyond this is begun anew
MOST_STORED = 300_000
#: costs are whole millionths, so sums are exact
UNIT = 1_000_000
#: cost of a byte where no piece fits, above the dearest piece, in natural logarithms
BYTE_PENALTY = 10

COUNTS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])


def zipf_costs(pieces: Iterable[str]) -> dict[str, int]:
    """Costs of pieces by rank, the commonest first: rank r has a probability in proportion to 1 / r."""
    pieces = list(dict.fromkeys(p for p in pieces if p))
    whole = math.log(sum(1 / r for r in range(1, len(pieces) + 1))) if pieces else 0.0
    return {p: round(UNIT * (math.log(r) + whole)) for r, p in enumerate(pieces, 1)}


def vocabulary(path: str) -> dict[str, int]:
    """Costs of the pieces of a public vocabulary file; its control and byte pieces are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size())
           if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return zipf_costs(model.id_to_piece(i) for i in sorted(ids, key=lambda i: (-model.get_score(i), i)))


class Trie:
    """Terminal counts of words; words are scored in sorted order, common beginnings once."""

    def __init__(self, costs: dict[str, int]):
        self.costs = costs
        self.longest = max(map(len, costs), default=0)
        self.byte = max(costs.values(), default=0) + BYTE_PENALTY * UNIT
        self.counts: dict[str, int] = {}
        #: characters scored so far
        self.scored = 0

    def add(self, words: Iterable[str]) -> None:
        get, longest = self.costs.get, self.longest
        before, cost, count = "", [0], [0]
        for word in sorted(words):
            same = 0
            for a, b in zip(word, before):  # noqa: B905
                if a != b:
                    break
                same += 1
            del cost[same + 1:], count[same + 1:]
            for end in range(same + 1, len(word) + 1):
                n = len(word[end - 1].encode("utf-8", "surrogatepass"))
                best, used = cost[end - 1] + n * self.byte, count[end - 1] + n
                for start in range(max(0, end - longest), end):
                    step = get(word[start:end])
                    if step is not None:
                        total = cost[start] + step
                        if total < best or total == best and count[start] + 1 < used:
                            best, used = total, count[start] + 1
                cost.append(best)
                count.append(used)
            self.scored += len(word) - same
            self.counts[word] = count[-1]
            before = word


def count_batch(texts: list[str | None], trie: Trie, most_stored: int = MOST_STORED) -> list[tuple[int, int]]:
    """(words, tokens) of each text."""
    found = [Counter((t or "").encode("utf-8", "surrogatepass").split()) for t in texts]
    named = {w: MARK + w.decode("utf-8", "surrogatepass") for w in set().union(*found)}
    if len(trie.counts) + len(named) > most_stored:
        trie.counts.clear()
    trie.add({w for w in named.values() if w not in trie.counts})
    counts = trie.counts
    of = {w: counts[name] for w, name in named.items()}
    return [(sum(c.values()), sum(n * of[w] for w, n in c.items())) for c in found]


def _slices(texts: pd.Series, most: int) -> Iterator[list[str | None]]:
    some: list[str | None] = []
    size = 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def token_counts(docs: DataFrame, costs: Callable[[], dict[str, int]], text: str = "text",
                 batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """docs with n_words and n_tokens.

    ``costs`` is called in each task and gives the cost of every piece, in whole numbers. Words are
    runs of characters other than ASCII white space. Of segmentations of equal cost the shortest
    counts; a character no piece fits counts as its UTF-8 bytes. NULL and empty texts have none.
    Texts are read whole, however long; repeated rows each get their count; columns with the
    names of the results are replaced. An empty table gives none.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = Trie(costs())
        for texts in batches:
            out = [row for some in _slices(texts, batch_bytes) for row in count_batch(some, trie)]
            yield pd.DataFrame(out, columns=COUNTS.names)

    docs = clear_of(docs, *COUNTS.names)
    counted = F.pandas_udf(run, COUNTS)
    return docs.withColumn("_counts", counted(F.col(text))).select(*docs.columns, "_counts.*")


@functools.cache
def public_costs(name: str = VOCABULARY) -> dict[str, int]:
    """Costs from a file of the public tokenizers, worked out once per process."""
    import public_tokenizers
    return vocabulary(public_tokenizers.path(name))
