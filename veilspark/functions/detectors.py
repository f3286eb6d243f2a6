"""Detection expressions: text in, findings or a type out."""

from __future__ import annotations

from collections.abc import Sequence

from ..patterns import PATTERNS, Pattern, java_regex
from .spans import FINDING, NO_FINDINGS, finding, resolve_overlaps, sort_findings
from .sql import filter_, let, lit, running, struct, transform, transform_indexed

# Fixed value: findings a model is less sure of are ignored.
CONFIDENCE_THRESHOLD = 0.7

_ANY_DIGIT = lit(r"\p{Nd}")


def find_pii(text: str, patterns: Sequence[Pattern] = PATTERNS) -> str:
    """Every non-overlapping match of every pattern, as an array of findings.

    Offsets are 0-based, end-exclusive and count characters. The order is by
    start, then longest, then registry. NULL and empty text give no findings.

    All patterns that need a digit sit behind one cheap digit test, so prose
    without digits runs a few regular expressions instead of all of them.
    Matches come first; only patterns that have some are split for offsets.
    """
    def entry(rank: int, p: Pattern) -> str:
        hits = f"regexp_extract_all({text}, {lit(java_regex(p))}, 0)"
        if p.literal:
            hits = f"IF(contains({text}, {lit(p.literal)}), {hits}, NULL)"
        return struct(rank=str(rank), category=lit(p.category), type=lit(p.type),
                      regex=lit(java_regex(p)), hits=hits)

    entries = "array<struct<rank:int,category:string,type:string,regex:string,hits:array<string>>>"

    def group(members) -> str:
        return f"CAST(array({', '.join(entry(i, p) for i, p in members)}) AS {entries})"

    numbered = list(enumerate(patterns))
    with_digits, without = [x for x in numbered if x[1].digits], [x for x in numbered if not x[1].digits]
    groups = []
    if with_digits:
        groups.append(f"IF({text} RLIKE {_ANY_DIGIT}, {group(with_digits)}, CAST(array() AS {entries}))")
    if without:
        groups.append(group(without))
    found = filter_(f"concat({', '.join(groups)})", lambda e: f"coalesce(size({e}.hits), 0) > 0")

    def locate(e: str) -> str:
        # the gaps between matches and the matches themselves give the offsets
        def step(cursor: str, item: str) -> tuple[str, str]:
            start = f"{cursor} + {item}.gap"
            end = f"{start} + length({item}.hit)"
            return end, struct(start=start, size=f"-length({item}.hit)", rank=f"{e}.rank",
                               category=f"{e}.category", type=f"{e}.type", match=f"{item}.hit", end=end)
        items = let(f"split({text}, {e}.regex, -1)", lambda gaps: transform_indexed(
            f"{e}.hits", lambda hit, i: struct(hit=hit, gap=f"length(get({gaps}, {i}))")))
        return running(items, "0", step, "struct<start:int,size:int,rank:int,category:string,"
                                         "type:string,match:string,`end`:int>")

    located = f"array_sort(flatten({transform(found, locate)}))"
    findings = transform(located, lambda f: "CAST(" + struct(
        category=f"{f}.category", type=f"{f}.type", match=f"{f}.match", start=f"{f}.start",
        end=f"{f}.`end`", method="'regex'", confidence="CAST(NULL AS DOUBLE)") + f" AS {FINDING})")
    return f"IF({text} IS NULL, {NO_FINDINGS}, {findings})"


def scan_text(text: str, patterns: Sequence[Pattern] = PATTERNS) -> str:
    """Findings of a text with overlaps resolved."""
    return resolve_overlaps(find_pii(text, patterns))


def _with_features(value: str, body) -> str:
    """Bind a cell with what tells cheaply which patterns cannot match it.

    In ASCII cells digits are counted without a regular expression.
    """
    digits = (f"IF(octet_length({value}) = length({value}), "
              f"length({value}) - length(translate({value}, '0123456789', '')), "
              f"length(regexp_replace({value}, {lit(chr(92) + 'P{Nd}+')}, '')))")
    return let(struct(v=value, digits=digits), lambda c: let(struct(
        v=f"{c}.v", digits=f"{c}.digits",
        run=f"{c}.digits >= 5 AND {c}.v RLIKE {lit(chr(92) + 'p{Nd}{5}')}",
        letters=f"lower({c}.v) <> upper({c}.v)", capitals=f"lower({c}.v) <> {c}.v"), body))


def _matches(cell: str, p: Pattern) -> str:
    """Whether a pattern matches a bound cell; cheap necessary conditions come first."""
    tests = [f"{cell}.digits >= {p.digits}"] if p.digits else []
    tests += [f"length({cell}.v) >= {p.size}"] if p.size else []
    tests += [f"{cell}.{flag}" for flag in ("run", "capitals", "letters") if getattr(p, flag)]
    tests += [f"contains({cell}.v, {lit(p.literal)})"] if p.literal else []
    return "(" + " AND ".join([*tests, f"{cell}.v RLIKE {lit(java_regex(p))}"]) + ")"


def has_pii(value: str, patterns: Sequence[Pattern] = PATTERNS) -> str:
    """True iff any pattern matches; stops at the first that does."""
    found = _with_features(value, lambda c: " OR ".join(_matches(c, p) for p in patterns))
    return f"coalesce({found}, false)"


def cell_type(value: str, patterns: Sequence[Pattern] = PATTERNS) -> str:
    """Dominant type of a cell, NULL if nothing is found.

    That is the type of the first finding: smallest start, then longest match,
    then registry order. The first finding always survives overlap resolution,
    so first matches suffice. Only cells that several patterns claim are looked
    at for positions.
    """
    types = f"array({', '.join(lit(p.type) for p in patterns)})"

    def place(cell: str, hits: str) -> str:
        def first(rank: int, p: Pattern) -> str:
            rx = lit(java_regex(p))
            return f"IF(array_contains({hits}, {rank}), " + struct(
                start=f"regexp_instr({cell}.v, {rx})", size=f"-length(regexp_substr({cell}.v, {rx}))",
                rank=str(rank)) + ", NULL)"
        return f"array_min(array({', '.join(first(i, p) for i, p in enumerate(patterns))})).rank"

    def choose(cell: str) -> str:
        hits = ", ".join(f"IF({_matches(cell, p)}, {i}, NULL)" for i, p in enumerate(patterns))
        return let(f"array_compact(array({hits}))", lambda h: (
            f"get({types}, CASE size({h}) WHEN 0 THEN NULL WHEN 1 THEN {h}[0] ELSE {place(cell, h)} END)"))

    return _with_features(value, choose)


def dominant_type(findings: str) -> str:
    """Type of the first of some resolved findings."""
    return f"get({findings}, 0).type"


def union_detectors(*findings: str) -> str:
    """Findings of several detectors together, overlaps resolved."""
    return resolve_overlaps(
        sort_findings(f"concat({', '.join(findings)})", tuple(p.type for p in PATTERNS)), short_spans=True)


def shift(findings: str, by: str) -> str:
    """Findings of a chunk in document offsets."""
    return transform(findings, lambda f: f"CAST(" + finding(
        f, start=f"CAST({f}.start + {by} AS INT)", end=f"CAST({f}.`end` + {by} AS INT)") + f" AS {FINDING})")


def parse_model_findings(reply: str, threshold: float = CONFIDENCE_THRESHOLD) -> str:
    """A model's JSON reply as an array of findings; malformed replies give none.

    The JSON may stand in a code fence. Missing positions are 0, a missing
    confidence counts as 0.
    """
    fenced = f"regexp_replace(get(split({reply}, '```'), 1), '^json', '')"
    body = f"IF(contains({reply}, '```'), {fenced}, {reply})"
    schema = ("struct<findings:array<struct<category:string,text:string,start:string,"
              "`end`:string,confidence:double>>>")
    rows = f"from_json({body}, {lit(schema)}, map('mode', 'PERMISSIVE')).findings"
    position = lambda c: f"coalesce(CAST(try_cast({c} AS DOUBLE) AS INT), 0)"
    parsed = transform(rows, lambda r: "CAST(" + struct(
        category=f"coalesce({r}.category, 'UNKNOWN')", type=f"lower(coalesce({r}.category, 'unknown'))",
        match=f"coalesce({r}.text, '')", start=position(f"{r}.start"), end=position(f"{r}.`end`"),
        method="'llm'", confidence=f"{r}.confidence") + f" AS {FINDING})")
    sure = filter_(parsed, lambda f: f"coalesce({f}.confidence, 0D) >= {threshold}D")
    return f"coalesce({sure}, {NO_FINDINGS})"
