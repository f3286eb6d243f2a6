"""Findings as arrays of spans: overlap rules and redaction."""

from __future__ import annotations

from .redaction import partial_redaction
from .sql import (BLOCK, blocks, case, exists, filter_, let, lit, running, struct,
                  transform, transform_indexed)

FINDING_FIELDS = ("category", "type", "match", "start", "end", "method", "confidence")
FINDING = ("struct<category:string,type:string,match:string,start:int,`end`:int,"
           "method:string,confidence:double>")
FINDINGS = f"array<{FINDING}>"
MARKED = FINDING[:-1] + ",kept:boolean>"
NO_FINDINGS = f"CAST(array() AS {FINDINGS})"

# Fixed value: two spans may share this many characters and still both stand.
TOLERANCE = 2


def overlaps_loosely(a_start: str, a_end: str, b_start: str, b_end: str) -> str:
    """Overlap test used when findings are deduplicated."""
    return f"({a_start} < {b_end} - {TOLERANCE} AND {b_start} < {a_end} - {TOLERANCE})"


def overlaps_strictly(a_start: str, a_end: str, b_start: str, b_end: str) -> str:
    """Plain overlap of two half-open spans."""
    return f"greatest({a_start}, {b_start}) < least({a_end}, {b_end})"


def finding(f: str, **changed: str) -> str:
    """A finding copied field by field, some fields changed or added."""
    return struct(**{**{n: f"{f}.`{n}`" for n in FINDING_FIELDS}, **changed})


def sort_findings(findings: str, types: tuple[str, ...] = ()) -> str:
    """Order by start, model before regex, longest; equals follow ``types``."""
    order = f"array({', '.join(map(lit, types))})" if types else "array('')"
    keyed = transform(findings, lambda f: struct(
        a=f"{f}.start", b=f"IF({f}.method = 'llm', 0, 1)", c=f"{f}.start - {f}.`end`",
        d=f"array_position({order}, {f}.type)", f=f))
    return transform(f"array_sort({keyed})", lambda k: f"{k}.f")


def _neighbours_clash(fs: str) -> str:
    """True iff a finding reaches into its successor; if none does, nothing overlaps."""
    pairs = transform_indexed(fs, lambda f, i: (
        f"{i} > 0 AND {f}.start < get({fs}, {i} - 1).`end` - {TOLERANCE}"))
    return exists(pairs, lambda clash: clash)


def mark_kept(findings: str, short_spans: bool = False) -> str:
    """Greedy overlap resolution over sorted findings; adds a ``kept`` flag to each.

    A finding is kept iff it does not overlap any finding kept before it. Spans
    of three or more characters only need the furthest end kept so far. With
    ``short_spans`` (a model may report one or two characters) the furthest ends of
    spans that start one, two and three characters back are told apart. Either way one
    pass over the findings is enough.
    """
    def step(reach: str, f: str) -> tuple[str, str]:
        keep = f"{f}.start >= {reach} - {TOLERANCE}"
        return f"IF({keep}, greatest({reach}, {f}.`end`), {reach})", finding(f, kept=keep)

    # r0 to r3: the furthest end of spans kept that start at s or before, at s - 1 or before, and so on
    state = "struct<s:int,r0:int,r1:int,r2:int,r3:int>"

    def short_step(st: str, f: str) -> tuple[str, str]:
        moved = f"({f}.start - {st}.s)"

        def reach(i: int) -> str:
            older = " ".join(f"WHEN {i - k} THEN {st}.r{k}" for k in range(1, i + 1))
            return f"IF({moved} >= {i}, {st}.r0, CASE {moved} {older} END)" if i else f"{st}.r0"
        # a span of one or two characters only clashes with spans that start before it, or further back
        limit = (f"CASE WHEN {f}.`end` - {f}.start > {TOLERANCE} THEN {reach(0)} WHEN {f}.`end` - {f}.start = 2 THEN {reach(1)} "
                 f"WHEN {f}.`end` - {f}.start = 1 THEN {reach(2)} ELSE {reach(3)} END")
        keep = f"{f}.start >= {limit} - {TOLERANCE}"
        following = struct(s=f"{f}.start", r0=f"IF({keep}, greatest({st}.r0, {f}.`end`), {st}.r0)", r1=reach(1), r2=reach(2), r3=reach(3))
        return following, finding(f, kept=keep)

    def resolve(fs: str) -> str:
        untouched = transform(fs, lambda f: f"CAST({finding(f, kept='true')} AS {MARKED})")
        low = str(-(1 << 30))
        none = struct(s=low, r0=low, r1=low, r2=low, r3=low)
        fold = running(fs, none, short_step, MARKED, state) if short_spans else running(fs, low, step, MARKED)
        return f"IF({_neighbours_clash(fs)}, {fold}, {untouched})"

    return let(findings, resolve)


def kept_only(marked: str) -> str:
    return transform(filter_(marked, lambda f: f"{f}.kept"), finding)


def dropped_only(marked: str) -> str:
    return transform(filter_(marked, lambda f: f"NOT {f}.kept"), finding)


def resolve_overlaps(findings: str, short_spans: bool = False) -> str:
    """Sorted findings without those that overlap an earlier kept one."""
    return let(findings, lambda fs: (
        f"IF({_neighbours_clash(fs)}, {kept_only(mark_kept(fs, short_spans))}, {fs})"))


# Redaction styles; any other style behaves like block.
STYLES = ("block", "placeholder", "mask", "partial")
BLOCK_TEXT = "[REDACTED]"


def _replacement(style: str, kind: str, original: str) -> str:
    if style == "placeholder":
        return f"concat('[', upper({kind}), ']')"
    if style == "mask":
        return f"repeat('X', length({original}))"
    if style == "partial":
        return let(original, lambda v: partial_redaction(v, kind))
    return lit(BLOCK_TEXT)


def redact(text: str, findings: str, style: str = "block") -> str:
    """Replace every finding in ``text``; spans past the end are clamped.

    One pass from left to right with a cursor: where two kept spans share the
    tolerated two characters, the later one starts at the cursor. Text is cut
    block by block, so long texts with many findings are not rescanned.
    """
    def spans(fs: str) -> str:
        def step(cursor: str, f: str) -> tuple[str, str]:
            start = f"greatest(least({f}.start, length({text})), {cursor})"
            end = f"greatest(least({f}.`end`, length({text})), {start})"
            return end, struct(gap=cursor, start=start, stop=end, type=f"coalesce({f}.type, 'generic')")
        return running(fs, "0", step, "struct<gap:int,start:int,stop:int,type:string>")

    def render(block: str) -> str:
        origin = f"{block}[0].gap"
        segment = f"substr({text}, {origin} + 1, element_at({block}, -1).stop - {origin})"

        def pieces(bound: str) -> str:
            def piece(s: str) -> str:
                before = f"substr({bound}.text, {s}.gap - {bound}.origin + 1, {s}.start - {s}.gap)"
                original = f"substr({bound}.text, {s}.start - {bound}.origin + 1, {s}.stop - {s}.start)"
                return f"concat({before}, {_replacement(style, f'{s}.type', original)})"
            return f"array_join({transform(block, piece)}, '')"
        return let(struct(text=segment, origin=origin), pieces)

    def rebuild(ss: str) -> str:
        return (f"concat(array_join({transform(blocks(ss, BLOCK), render)}, ''), "
                f"substr({text}, element_at({ss}, -1).stop + 1))")

    ordered = "array_sort(" + transform(
        findings, lambda f: struct(start=f"{f}.start", end=f"{f}.`end`", type=f"{f}.type")) + ")"
    return case([(f"size({findings}) > 0", let(spans(ordered), rebuild))], text)
