"""Plain Python restatements, row by row, to test the Spark expressions against."""

import re

from veilspark.patterns import PATTERNS

COMPILED = [re.compile(p.regex, re.I if p.ignore_case else 0) for p in PATTERNS]


def raw(text):
    out = [(m.start(), m.start() - m.end(), i, p.type, m.group()) for i, (p, rx) in enumerate(zip(PATTERNS, COMPILED))
           for m in rx.finditer(text or "")]
    return [(t, s, s - neg, match) for s, neg, _, t, match in sorted(out)]


def greedy(spans):
    kept = []
    for f in spans:
        if not any(f[1] < k[2] - 2 and k[1] < f[2] - 2 for k in kept):
            kept.append(f)
    return kept


def cell_type(text):
    found = raw(text)
    return found[0][0] if found else None
