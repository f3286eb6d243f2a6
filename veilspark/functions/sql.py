"""Building blocks for expression text.

Convention of this package: a function under ``functions/`` takes and returns
Spark SQL expression text, to be used with ``F.expr`` or ``selectExpr``. One
parsed expression replaces thousands of driver round trips that the same
expression would need when assembled operator by operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count

#: elements per inner fold; keeps array appends short for rows with many findings
BLOCK = 256

_names = count()


def lit(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    """A column reference, whatever characters the name has."""
    return "`" + column.replace("`", "``") + "`"


def fresh() -> str:
    """A lambda variable that cannot hide a column."""
    return f"_x{next(_names)}_"


def case(branches: Iterable[tuple[str, str]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {e}" for c, e in branches) + f" ELSE {default} END"


def by_type(kind: str, rules: Iterable[tuple[tuple[str, ...], str]], default: str) -> str:
    """Pick an expression by detected type."""
    return case(((f"{kind} IN ({', '.join(map(lit, types))})", e) for types, e in rules), default)


def transform(items: str, body: Callable[[str], str]) -> str:
    x = fresh()
    return f"transform({items}, {x} -> {body(x)})"


def transform_indexed(items: str, body: Callable[[str, str], str]) -> str:
    x, i = fresh(), fresh()
    return f"transform({items}, ({x}, {i}) -> {body(x, i)})"


def filter_(items: str, test: Callable[[str], str]) -> str:
    x = fresh()
    return f"filter({items}, {x} -> {test(x)})"


def exists(items: str, test: Callable[[str], str]) -> str:
    x = fresh()
    return f"exists({items}, {x} -> {test(x)})"


def aggregate(items: str, zero: str, merge: Callable[[str, str], str],
              finish: Callable[[str], str] | None = None) -> str:
    acc, x, end = fresh(), fresh(), fresh()
    tail = f", {end} -> {finish(end)}" if finish else ""
    return f"aggregate({items}, {zero}, ({acc}, {x}) -> {merge(acc, x)}{tail})"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return f"element_at({transform(f'array({value})', body)}, 1)"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"{lit(k)}, {v}" for k, v in fields.items()) + ")"


def blocks(items: str, size: int = BLOCK) -> str:
    """Cut an array into consecutive slices of at most ``size`` elements."""
    cut = transform(f"sequence(0, CAST((size({items}) - 1) DIV {size} AS INT))",
                    lambda b: f"slice({items}, {b} * {size} + 1, {size})")
    return f"IF(size({items}) > 0, {cut}, slice(array({items}), 1, 0))"


def running(items: str, start: str, step: Callable[[str, str], tuple[str, str]], out_type: str,
            cursor_type: str = "INT") -> str:
    """Left-to-right scan: ``step(cursor, item) -> (next cursor, output)``.

    Returns the outputs in order. Appends happen inside
    blocks, so the cost stays close to linear for very long arrays.
    """
    def state(cursor: str, out: str) -> str:
        return struct(cursor=f"CAST({cursor} AS {cursor_type})", out=out)

    def push(acc: str, item: str) -> str:
        cursor, out = step(f"{acc}.cursor", item)
        return state(cursor, f"concat({acc}.out, array(CAST({out} AS {out_type})))")

    def block(acc: str, part: str) -> str:
        inner = aggregate(part, state(f"{acc}.cursor", f"CAST(array() AS array<{out_type}>)"), push)
        return let(inner, lambda r: state(f"{r}.cursor", f"concat({acc}.out, array({r}.out))"))

    zero = state(start, f"CAST(array() AS array<array<{out_type}>>)")
    return let(items, lambda xs: f"flatten({aggregate(blocks(xs), zero, block, lambda acc: f'{acc}.out')})")
