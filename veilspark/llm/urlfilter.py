"""URL filter: allow and block rules first, then a weighted vocabulary.

The vocabulary is found by an Aho-Corasick automaton over the whole URL. A term
counts where it stands between characters that are neither ASCII letters nor digits.
One strict term rejects a URL, or several different soft terms.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, clear_of

# Fixed values of the query: verdict, host, start of the path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

STRICT, SOFT = "strict", "soft"
#: terms and their weight; words that also occur in harmless addresses are soft
VOCABULARY = {
    "porn": STRICT, "porno": STRICT, "xxx": STRICT, "sex": STRICT, "hentai": STRICT, "escort": STRICT, "escorts": STRICT,
    "casino": STRICT, "casinos": STRICT, "viagra": STRICT, "cialis": STRICT, "warez": STRICT, "spam": STRICT,
    "camgirls": STRICT, "milf": STRICT, "payday-loan": STRICT, "payday-loans": STRICT,
    "adult": SOFT, "x": SOFT, "bet": SOFT, "bets": SOFT, "betting": SOFT, "free": SOFT, "cheap": SOFT, "pill": SOFT,
    "pills": SOFT, "win": SOFT, "bonus": SOFT, "poker": SOFT, "slots": SOFT, "ads": SOFT, "track": SOFT, "tracker": SOFT,
    "farm": SOFT, "nude": SOFT, "hot": SOFT, "girls": SOFT, "loan": SOFT, "loans": SOFT, "crack": SOFT, "torrent": SOFT,
    "gambling": SOFT, "jackpot": SOFT, "dating": SOFT, "pharmacy": SOFT, "replica": SOFT, "click": SOFT,
}
#: so many different soft terms reject
SOFT_HITS = 2

_LOWER = str.maketrans(UPPER, LOWER)
_INNER = frozenset(LOWER + "0123456789")

ADDED = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()),
                      T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()),
                      T.StructField("n_strict", T.IntegerType()), T.StructField("n_soft", T.IntegerType())])


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    at = min(ends, default=len(rest))
    path = rest[at:]
    for c in "?#":
        path = path.split(c, 1)[0]
    return rest[:at].translate(_LOWER), path


class Rules:
    """Rules by host; the longest of those that fit wins, of equally long ones that with the longer host."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        while host:
            for start, verdict in self.by_host.get(host, ()):
                if path.startswith(start):
                    found = (len(host) + len(start), len(host), host + start, verdict)
                    best = max(best, found) if best else found
            host = host.partition(".")[2]
        return best[2:] if best else None


def automaton(vocabulary: Mapping[str, str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for term, kind in vocabulary.items():
        made.add_word(term.translate(_LOWER), (term, kind))
    if len(made):
        made.make_automaton()
    return made


def hits(url: str, terms: ahocorasick.Automaton) -> tuple[int, int]:
    """Different strict and soft terms of a URL that stand between boundaries."""
    low = url.translate(_LOWER)
    found: dict[str, set[str]] = {STRICT: set(), SOFT: set()}
    for end, (term, kind) in terms.iter(low) if len(terms) else ():
        start = end - len(term) + 1
        if (start == 0 or low[start - 1] not in _INNER) and (end + 1 == len(low) or low[end + 1] not in _INNER):
            found[kind].add(term)
    return len(found[STRICT]), len(found[SOFT])


def judge(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
          vocabulary: Mapping[str, str] = VOCABULARY, soft_hits: int = SOFT_HITS) -> DataFrame:
    """pages with host, path, rule, verdict, n_strict and n_soft.

    A NULL URL, or one without ``://``, has empty host and path and fits no rule;
    the vocabulary still judges its text (NULL: none, so it is allowed). Long URLs are
    read whole, repeated rows judged alike; columns with the names of the results are
    replaced. No row is dropped; an empty table gives none.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        by_host, terms = Rules(rules), automaton(vocabulary)
        for urls in batches:
            out = []
            for u in urls:
                host, path = split_url(u)
                rule = by_host.find(host, path)
                strict, soft = hits(u or "", terms)
                reject = strict > 0 or soft >= soft_hits
                out.append((host, path, rule[0] if rule else None,
                            rule[1] if rule else "block" if reject else "allow", strict, soft))
            yield pd.DataFrame(out, columns=ADDED.names)

    judged = F.pandas_udf(run, ADDED)
    pages = clear_of(pages, *(n for n in ADDED.names if n != url))
    return pages.withColumn("_judged", judged(F.col(url))).select(*pages.columns, "_judged.*")
