"""Types of whole cells, by the patterns their shapes leave possible.

Typing a cell by the rule costs some twenty regular expressions. Columns repeat themselves: in
their values, which Arrow makes distinct per batch, and far more in their shapes. A shape says which few
patterns can match at all, and only these run. Long cells go by cheap necessary conditions
instead. Only type numbers go back; masks stay expressions of the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..patterns import PATTERNS, Pattern
from .shapes import LONGEST, candidates
from .sql import lit

NONE = -1

_DIGIT = re.compile(r"\d")
_RUN = re.compile(r"\d{5}")


def ranker(patterns: Sequence[Pattern] = PATTERNS) -> Callable[[str], int]:
    """A function from a cell to the place in the registry of its dominant type, NONE if nothing is found.

    That is the type of the first finding: smallest start, then longest match, then registry order.
    """
    search = [re.compile(p.regex, re.IGNORECASE if p.ignore_case else 0).search for p in patterns]
    gates = [(i, p.digits, p.size, p.run, p.literal) for i, p in enumerate(patterns)]
    possible = candidates(patterns)

    def by_conditions(value: str) -> list[int]:
        digits = len(_DIGIT.findall(value))
        run = digits >= 5 and _RUN.search(value) is not None
        return [i for i, least, size, needs_run, literal in gates if digits >= least and len(value) >= size
                and (run or not needs_run) and (not literal or literal in value)]

    def rank(value: str) -> int:
        places = possible(value) if len(value) <= LONGEST else by_conditions(value)
        if len(places) == 1:
            return places[0] if search[places[0]](value) else NONE
        best = None
        for i in places:
            if found := search[i](value):
                key = (found.start(), found.start() - found.end(), i)
                best = key if best is None or key < best else best
        return NONE if best is None else best[2]
    return rank


def rank_of(value: str | None, patterns: Sequence[Pattern] = PATTERNS) -> int:
    return ranker(patterns)(value) if value else NONE


def typer(patterns: Sequence[Pattern]) -> Callable[[pa.Array], tuple[pa.Array, pa.Array, np.ndarray]]:
    """A function from cells to (distinct values, the place of each cell among them, type of each distinct value)."""
    rank = ranker(patterns)

    def types(cells: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        coded = pc.dictionary_encode(cells)
        return coded.dictionary, coded.indices, np.fromiter(map(rank, coded.dictionary.to_pylist()), np.int8, len(coded.dictionary))
    return types


def cell_ranks(columns: Sequence[Column], patterns: Sequence[Pattern] = PATTERNS) -> Column:
    """A struct c0, c1, ... with the rank of the dominant type of each of some text columns."""
    chosen = tuple(patterns)
    names = [f"c{i}" for i in range(len(columns))]
    schema = T.StructType([T.StructField(c, T.ByteType()) for c in names])

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        types = typer(chosen)
        for batch in batches:
            out = []
            for cells in (batch,) if isinstance(batch, pa.Array) else batch:
                _, codes, ranks = types(cells)
                out.append(pc.fill_null(pa.array(ranks, pa.int8()).take(codes), NONE))
            yield pa.StructArray.from_arrays(out, names)
    if len(names) == 1:  # one column comes as itself, not as a tuple
        def alone(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return run(batches)
        return F.arrow_udf(alone, schema)(*columns)
    return F.arrow_udf(run, schema)(*columns)


def type_name(rank: str, patterns: Sequence[Pattern] = PATTERNS) -> str:
    """The type of a rank, NULL for NONE."""
    return f"get(array({', '.join(lit(p.type) for p in patterns)}), CAST({rank} AS INT))"
