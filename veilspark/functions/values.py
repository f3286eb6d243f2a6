"""Typed reading of text cells."""

from __future__ import annotations

from .masks import strip
from .sql import case, let, lit

# Words that mean no value, in any case.
NULL_WORDS = ("null", "none", "nil", "na", "n/a")

KINDS = ("null", "bool", "int", "float", "str")
TYPED = "struct<kind:string,b:boolean,l:bigint,d:double,s:string>"

_INT = r"^-?[0-9]+$"
_FLOAT = (r"^[+-]?(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)"
          r"(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?$")
_SIGNED_INF = r"(?i)^[+-]?inf(?:inity)?$"
_NAN = r"(?i)^[+-]?nan$"


def kind_of(v: str) -> str:
    """``null``, ``bool``, ``int``, ``float`` or ``str`` for a stripped cell."""
    words = ", ".join(map(lit, NULL_WORDS))
    number = " OR ".join(f"{v} RLIKE {lit(rx)}" for rx in (_FLOAT, _SIGNED_INF, _NAN))
    return case([
        (f"{v} IS NULL OR {v} = '' OR lower({v}) IN ({words})", "'null'"),
        (f"lower({v}) IN ('true', 'false')", "'bool'"),
        (f"{v} RLIKE {lit(_INT)}", "'int'"),
        (number, "'float'"),
    ], "'str'")


def as_double(v: str) -> str:
    plain = f"replace({v}, '_', '')"
    return case([(f"{v} RLIKE {lit(_NAN)}", "double('NaN')")], f"try_cast({plain} AS DOUBLE)")


def coerce(value: str, strip_first: bool = True) -> str:
    """A text cell as a tagged value: its kind and the field that kind fills.

    Integers beyond 64 bits keep kind ``int`` with their digits in ``s``. Not
    stripped, a cell with outer white space is text whatever it looks like.
    """
    def tagged(v: str, kind: str) -> str:
        only = lambda k, e, t: f"CAST(IF({kind} = '{k}', {e}, NULL) AS {t})"
        wide = f"{kind} = 'int' AND try_cast({v} AS BIGINT) IS NULL"
        return (f"named_struct('kind', {kind}, 'b', {only('bool', f"lower({v}) = 'true'", 'BOOLEAN')}, "
                f"'l', {only('int', f'try_cast({v} AS BIGINT)', 'BIGINT')}, "
                f"'d', {only('float', as_double(v), 'DOUBLE')}, "
                f"'s', IF({kind} = 'str' OR ({wide}), {v}, NULL))")

    if strip_first:
        return let(strip(value), lambda v: let(kind_of(v), lambda k: tagged(v, k)))
    kind = lambda v: f"IF({v} = {strip(v)} OR {v} IS NULL, {kind_of(v)}, 'str')"
    return let(value, lambda v: let(kind(v), lambda k: tagged(v, k)))
