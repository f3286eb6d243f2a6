"""Analytics-friendly partial redaction of one detected value.

A different rule set from the table masks in ``masks.py``.
"""

from __future__ import annotations

from ..patterns import SPACE_CLASS
from .sql import by_type, filter_, let, lit, transform


def stars(n: str) -> str:
    return f"repeat('*', greatest({n}, 0))"


def digits_of(v: str) -> str:
    return f"regexp_replace({v}, {lit(chr(92) + 'P{Nd}+')}, '')"


def words(v: str) -> str:
    """Split on any white space, without empty words."""
    return filter_(f"split({v}, {lit(SPACE_CLASS + '+')})", lambda w: f"{w} <> ''")


def mask_middle(v: str) -> str:
    """First and last character visible; two characters or fewer vanish."""
    return (f"IF(length({v}) <= 2, {stars(f'length({v})')}, "
            f"concat(left({v}, 1), {stars(f'length({v}) - 2')}, right({v}, 1)))")


def _email(v: str) -> str:
    local = f"substring_index({v}, '@', 1)"
    masked = let(local, lambda p: (
        f"IF(length({p}) <= 2, concat(left({p}, 1), {stars(f'length({p}) - 1')}), "
        f"concat(left({p}, 1), {stars(f'greatest(length({p}) - 2, 1)')}, right({p}, 1)))"))
    return f"IF(contains({v}, '@'), concat({masked}, substr({v}, length({local}) + 1)), {mask_middle(v)})"


def _phone(v: str) -> str:
    # three outer digits on each side stay, with whatever stands between them
    regex = lit(r"(?s)^((?:\P{Nd}*\p{Nd}){3})(.*)((?:\p{Nd}\P{Nd}*){3})$")
    head, middle, tail = (f"regexp_extract({v}, {regex}, {i})" for i in (1, 2, 3))
    veiled = f"regexp_replace({middle}, {lit(chr(92) + 'p{Nd}')}, '*')"
    return f"IF(length({digits_of(v)}) >= 6, concat({head}, {veiled}, {tail}), {mask_middle(v)})"


def _national_id(v: str) -> str:
    return let(digits_of(v), lambda d: (
        f"IF(length({d}) >= 4, concat({stars(f'length({d}) - 4')}, right({d}, 4)), {mask_middle(v)})"))


def _card(v: str) -> str:
    def grouped(d: str) -> str:
        masked = f"concat({stars(f'greatest(length({d}) - 4, 2)')}, right({d}, 4))"
        return f"IF(length({d}) >= 4, regexp_replace({masked}, '(.{{4}})(?=.)', '$1-'), {mask_middle(v)})"
    return let(digits_of(v), grouped)


def _name(v: str) -> str:
    veiled = transform(words(v), lambda w: f"concat(left({w}, 1), {stars(f'length({w}) - 1')})")
    return let(veiled, lambda p: f"IF(size({p}) > 0, array_join({p}, ' '), '***')")


def _ip(v: str) -> str:
    return f"IF(contains({v}, '.'), concat(substring_index({v}, '.', 1), '.*.*.*'), {mask_middle(v)})"


def _place(v: str) -> str:
    return let(words(v), lambda w: f"IF(size({w}) > 1, concat({w}[0], ' ***'), '***')")


# Which types follow which rule.
RULES = (
    (("email",), _email),
    (("phone_us", "phone_uk", "phone_intl", "phone_cn", "phone"), _phone),
    (("ssn", "ni_uk", "cn_id"), _national_id),
    (("credit_card",), _card),
    (("name", "person_name"), _name),
    (("ipv4", "ipv6"), _ip),
    (("address", "location"), _place),
)


def partial_redaction(v: str, kind: str) -> str:
    """Mask the middle of a value by the rule of its type."""
    return by_type(kind, [(types, rule(v)) for types, rule in RULES], mask_middle(v))
