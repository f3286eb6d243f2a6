"""SQL dumps made of INSERT statements, in and out.

A statement ends at a semicolon outside quotes and comments, wherever that stands in a line.
Dumps still split between tasks: a first pass works out, for every block of a file, how it
changes the state of quotes from each state it may begin in; from that follows the state each block does
begin in, and a second pass cuts all blocks by themselves. Only the two pieces at the ends
of a block are put together with those of its neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sql import lit, name

# Rows per INSERT statement and the table name when none is given.
ROWS_PER_INSERT = 50
DEFAULT_TABLE = "scrubbed_data"

#: where a line may begin: outside, in a quotation, in a block comment
OUTSIDE, COMMENT = "", "*"
STATES = (OUTSIDE, "'", '"', "`", COMMENT)

_MARK = re.compile(r"""['"`;]|/\*|--(?=\s|$)|^\s*(?:--|#)""")
_NAME = r"""(?:`(?:[^`]|``)+`|"(?:[^"]|"")+"|\[[^\]]+\]|[\w$]+)"""
_INSERT = re.compile(rf"\s*(?:INSERT|REPLACE)\b(?:\s+(?:OR\s+)?\w+)*?\s+INTO\s+({_NAME}(?:\s*\.\s*{_NAME})*)\s*(?:\(([^)]*)\))?\s*VALUES?\s*", re.I)
_IS_INSERT = re.compile(r"\s*(?:INSERT|REPLACE)\s", re.I)
_COLUMN = re.compile(_NAME)
_TAIL = re.compile(r"\s*(?:(?:ON|RETURNING|AS)\b.*)?$", re.I | re.S)
_TOKEN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|[(),]|[^'"`(),]+""")
_TOKEN_ESCAPED = re.compile(r"""'(?:[^'\\]|''|\\.)*'|"(?:[^"\\]|""|\\.)*"|`[^`]*`|[(),]|[^'"`(),]+""", re.S)
# What a letter after a backslash stands for.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}

#: tuples of short statements are handed over together, up to this many and this much text
ROWS_AT_ONCE = 10_000
CHARS_AT_ONCE = 16 << 20

TUPLE = "table string, columns array<string>, cells array<string>"


def walk_line(line: str, state: str, escapes: bool) -> tuple[str, list[tuple[int, int]], list[int]]:
    """State after a line, the spans of its comments, and the places of its statement ends."""
    comments, ends, at, line_end = [], [], 0, len(line)
    while at < line_end:
        if state == COMMENT:
            close = line.find("*/", at)
            comments.append((at, line_end if close < 0 else close + 2))
            if close < 0:
                break
            state, at = OUTSIDE, close + 2
        elif state:
            close = line.find(state, at)
            back = line.find("\\", at) if escapes and state != "`" else -1
            if 0 <= back and (close < 0 or back < close):
                at = back + 2
            elif close < 0:
                break
            else:
                state, at = OUTSIDE, close + 1
        else:
            found = _MARK.search(line, at)
            if not found:
                break
            mark, at = found[0], found.end()
            if mark == ";":
                ends.append(found.start())
            elif mark in ("'", '"', "`"):
                state = mark
            elif mark == "/*":
                state, at = COMMENT, found.start() + 2
                comments.append((found.start(), at))
            else:
                comments.append((found.start(), line_end))
                break
    return state, comments, ends


def _states(escapes: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, to = None, list(STATES)
        for batch in batches:
            for file, block, line in zip(batch["file"], batch["block"], batch["value"], strict=True):
                if (file, block) != now:
                    if now:
                        yield pd.DataFrame([(*now, to)], columns=["file", "block", "ends"])
                    now, to = (file, block), list(STATES)
                after: dict[str, str] = {}
                to = [after[s] if s in after else after.setdefault(s, walk_line(line, s, escapes)[0]) for s in to]
        if now:
            yield pd.DataFrame([(*now, to)], columns=["file", "block", "ends"])
    return run


def _pieces(begins: dict[tuple[str, int], str], escapes: bool):
    """Statements that begin and end in a block (kind 1), what ends in it (0), and what it leaves open (2)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, parts, kind = None, OUTSIDE, [], 0
        for batch in batches:
            out = []
            for file, block, line in zip(batch["file"], batch["block"], batch["value"], strict=True):
                if (file, block) != now:
                    if now:
                        out.append((*now, 2 if kind else 3, "".join(parts)))
                    now, parts, kind = (file, block), [], 0
                    state = begins[now]
                state, comments, ends = walk_line(line, state, escapes)
                at = 0
                cuts = sorted([(a, b, False) for a, b in comments] + [(e, e + 1, True) for e in ends])
                for a, b, ended in cuts:
                    parts.append(line[at:a] if ended else line[at:a] + " ")
                    if ended:
                        out.append((*now, kind, "".join(parts)))
                        parts, kind = [], 1
                    at = b
                parts.append(line[at:] + "\n")
            if out:
                yield pd.DataFrame(out, columns=["file", "block", "kind", "piece"])
        if now:
            yield pd.DataFrame([(*now, 2 if kind else 3, "".join(parts))], columns=["file", "block", "kind", "piece"])
    return run


def _unquote(v: str, escapes: bool) -> str | None:
    v = v.strip()
    if v.upper() == "NULL":
        return None
    if len(v) > 1 and v[0] in "'\"" and v[-1] == v[0]:
        body = v[1:-1]
        if escapes and "\\" in body:
            return re.sub(r"(?s)\\(.)|" + v[0] * 2, lambda m: v[0] if m[1] is None else ESCAPES.get(m[1], m[1]), body)
        return body.replace(v[0] * 2, v[0])
    return v


def _bare(identifier: str) -> str:
    quote = identifier[0]
    return identifier[1:-1].replace(quote * 2, quote) if quote in "`\"" else identifier.strip("[]")


def parse_insert(statement: str, escapes: bool = False) -> list[tuple[str, list[str], list[str | None]]]:
    """(table, columns, cells) of each VALUES tuple; nothing for other statements, an error for an INSERT it can't read whole."""
    if not _IS_INSERT.match(statement):
        return []
    head = _INSERT.match(statement)
    wrong = ValueError(f"an INSERT that can't be read: {statement.strip()[:120]}")
    if not head:
        raise wrong
    table = _bare(_COLUMN.findall(head[1])[-1])
    columns = [_bare(c) for c in _COLUMN.findall(head[2] or "")]
    rows, cells, depth, at, value = [], [], 0, head.end(), ""
    tokens = _TOKEN_ESCAPED if escapes else _TOKEN
    expect = True  # a tuple must follow
    while at < len(statement):
        found = tokens.match(statement, at)
        if not found:
            raise wrong
        token = found[0]
        if depth == 0:
            if token == "(" and expect:
                depth, cells, value, expect = 1, [], "", False
            elif token == "," and not expect:
                expect = True
            elif token.strip():
                if expect or not _TAIL.match(statement, at):
                    raise wrong
                break
        elif depth == 1 and token == ",":
            cells.append(_unquote(value, escapes))
            value = ""
        elif depth == 1 and token == ")":
            if cells or value.strip():
                cells.append(_unquote(value, escapes))
            rows.append((table, columns, cells))
            depth = 0
        else:
            depth += (token == "(") - (token == ")")
            value += token
        at = found.end()
    if depth or expect or not rows:
        raise wrong
    return rows


def _parse(escapes: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for piece in batch["piece"]:
                rows += parse_insert(piece, escapes)
                size += len(piece)
                if len(rows) >= ROWS_AT_ONCE or size >= CHARS_AT_ONCE:
                    if rows:
                        yield pd.DataFrame(rows, columns=["table", "columns", "cells"])
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["table", "columns", "cells"])
    return run


def sql_tuples(spark: SparkSession, path: str, backslash_escapes: bool = False) -> DataFrame:
    """``(table, columns, cells)``: one row per VALUES tuple.

    Comments and other statements are skipped; quotes are taken off, doubled quotes undone,
    NULL becomes NULL. ``columns`` is empty if the statement lists none. Backslashes are text as
    in standard SQL unless ``backslash_escapes`` says otherwise. An INSERT that can't be read to its end raises.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    # one row per block of a file
    begins, state = {}, {}
    for r in lines.mapInPandas(_states(backslash_escapes), "file string, block long, ends array<string>").orderBy("file", "block").toLocalIterator():
        begins[r["file"], r["block"]] = state.get(r["file"], OUTSIDE)
        state[r["file"]] = r["ends"][STATES.index(begins[r["file"], r["block"]])]
    pieces = lines.mapInPandas(_pieces(begins, backslash_escapes), "file string, block long, kind int, piece string")
    # 0 ends a statement begun earlier, 2 begins one, 3 goes through
    edges = pieces.where("kind <> 1")
    earlier = Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == 0, 0).otherwise(1))
    numbered = edges.withColumn("n", F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(earlier.rowsBetween(Window.unboundedPreceding, -1)))
    stitched = (numbered.groupBy("file", F.coalesce("n", F.lit(0)).alias("n"))
                .agg(F.sort_array(F.collect_list(F.struct("block", (F.col("kind") != 0).alias("open"), "piece"))).alias("all"))
                .select(F.array_join("all.piece", "").alias("piece")))
    whole = pieces.where("kind = 1").select("piece")
    return whole.union(stitched).mapInPandas(_parse(backslash_escapes), TUPLE)


def read_sql_dump(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                  table: str | None = None, backslash_escapes: bool = False) -> DataFrame:
    """The rows of a table of a dump, as strings.

    Columns are those that INSERTs list, the longest list first. A tuple without a list goes by
    place under the longest list if it fits; one that fits neither goes under ``col_0``, ``col_1`` and
    so on. ``columns`` saves the pass that finds them. A dump of several tables needs ``table``.
    """
    tuples = sql_tuples(spark, path, backslash_escapes)
    if table:
        tuples = tuples.where(F.col("table") == table)
    if columns is None:
        # one row per table, column list and number of cells
        kinds = tuples.groupBy("table", "columns", F.size("cells").alias("n")).count().collect()
        if len({r["table"] for r in kinds}) > 1:
            raise ValueError(f"name one of the tables of the dump: {', '.join(sorted({r['table'] for r in kinds}))}")
        lists = sorted({tuple(r["columns"]) for r in kinds if r["columns"]}, key=lambda c: (-len(c), c))
        longest = lists[0] if lists else ()
        fits = lambda r: r["n"] == len(r["columns"] or longest)
        generic = max((r["n"] for r in kinds if not fits(r)), default=0)
        columns = list(dict.fromkeys([c for some in lists for c in some] + [f"col_{i}" for i in range(generic)]))
    else:
        longest = tuple(columns)
    listed = F.when(F.size("columns") > 0, F.col("columns")).otherwise(F.array(*map(F.lit, longest)).cast("array<string>"))
    generic = F.expr("transform(sequence(1, size(cells)), i -> concat('col_', i - 1))")
    keyed = tuples.where(F.size("cells") > 0).withColumn("keys", listed).withColumn(
        "keys", F.when(F.size("keys") == F.size("cells"), F.col("keys")).otherwise(generic))
    named = keyed.select(F.map_from_arrays("keys", "cells").alias("row"))
    return named.select(*[F.try_element_at("row", F.lit(c)).alias(c) for c in columns])


def write_sql_dump(df: DataFrame, path: str, table: str = DEFAULT_TABLE, comments: Sequence[str] = (),
                   rows_per_insert: int = ROWS_PER_INSERT, mode: str = "errorifexists") -> None:
    """INSERT statements of a fixed number of rows; every task writes its own file.

    NULL and the text NULL become a bare NULL, all else is quoted. Comments
    head every file.
    """
    def sql_value(c: str) -> str:
        v = f"CAST({name(c)} AS STRING)"
        quoted = f"concat({lit(chr(39))}, replace({v}, {lit(chr(39))}, {lit(chr(39) * 2)}), {lit(chr(39))})"
        return f"IF({name(c)} IS NULL OR upper({v}) = 'NULL', 'NULL', {quoted})"

    tuples = df.select(F.expr(f"concat('(', concat_ws(', ', {', '.join(map(sql_value, df.columns))}), ')')").alias("t"))
    names = ", ".join("`" + c.replace("`", "``") + "`" for c in df.columns)
    head = f"INSERT INTO `{table}` ({names}) VALUES\n"
    opening = "".join(f"-- {line}\n" for line in comments)

    def statements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[str] = []
        prefix = opening
        for batch in batches:
            waiting.extend(batch["t"])
            full = len(waiting) - len(waiting) % rows_per_insert
            out = [head + ",\n".join(waiting[i:i + rows_per_insert]) + ";"
                   for i in range(0, full, rows_per_insert)]
            del waiting[:full]
            if out:
                out[0], prefix = prefix + out[0], ""
                yield pd.DataFrame({"value": out})
        if waiting:
            yield pd.DataFrame({"value": [prefix + head + ",\n".join(waiting) + ";"]})

    tuples.mapInPandas(statements, "value string").write.mode(mode).text(path)
