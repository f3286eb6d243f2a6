"""Cell masks: one expression per masking level."""

from __future__ import annotations

from ..patterns import SPACE_CLASS, SPACES
from .redaction import digits_of, stars, words
from .sql import by_type, let, lit, transform

# Masking levels, from keeping a value to deleting its column.
PRESERVE, PARTIAL, TOKENIZE, SCRUB, DELETE = "preserve", "partial", "tokenize", "scrub", "delete"

# Fixed value: prefix of every irreversible hash.
HASH_SALT = "dc-scrub-v1"

# Type groups the formats below speak of.
PHONES = ("phone_us", "phone_uk", "phone_intl", "phone_cn")
NAMES = ("name", "person_name", "full_name")
PRIVATE_IP_PREFIXES = ("192.168.", "10.", "172.16.")


def is_filled(v: str) -> str:
    """Something other than white space; most cells show it by their first character."""
    return f"(ascii({v}) BETWEEN 33 AND 126 OR {v} RLIKE {lit('[^' + SPACE_CLASS[1:])})"


def strip(v: str) -> str:
    """Trim every kind of white space, not only blanks."""
    return f"btrim({v}, {lit(SPACES)})"


def is_private_ip(v: str) -> str:
    """Private by prefix; of 172.16/12 only 172.16 counts."""
    return "(" + " OR ".join(f"startswith({v}, {lit(p)})" for p in PRIVATE_IP_PREFIXES) + ")"


def mask_partial(v: str, kind: str) -> str:
    """Hide the middle of a cell, keep the edges useful. Blank cells stay as they are."""
    n = f"length({v})"
    half = f"left({v}, {n} DIV 2)"
    generic = (f"IF({n} > 4, concat(left({v}, 4), {stars(f'least({n} - 4, 10)')}), "
               f"concat(left({v}, 1), {stars(f'{n} - 1')}))")

    domain = f"substring_index({v}, '@', -1)"
    local = f"left({v}, {n} - length({domain}) - 1)"
    email = (f"IF(contains({v}, '@'), concat(left({v}, IF(length({local}) > 3, 3, least(length({local}), 1))), "
             f"'***@', {domain}), concat(left({v}, 3), '***'))")

    phone = (f"CASE WHEN length({digits_of(v)}) < 4 THEN concat({half}, '****') "
             f"WHEN contains({v}, '-') THEN concat(left({v}, 3), '-***-***') "
             f"ELSE concat(left({v}, {n} - 4), '****') END")

    ssn = f"IF({n} >= 4, concat('***-**-', right({v}, 4)), {generic})"

    card = let(f"translate({v}, ' -', '')", lambda c: (
        f"IF(length({c}) >= 4, concat(left({c}, 1), {stars(f'length({c}) - 5')}, '-', right({c}, 4)), {generic})"))

    def person(parts: str) -> str:
        veiled = transform(parts, lambda w: (
            f"IF(length({w}) <= 2, {w}, concat(left({w}, 2), {stars(f'length({w}) - 2')}))"))
        return (f"IF(size({parts}) >= 2, array_join({veiled}, ' '), "
                f"concat(left({v}, 2), {stars(f'greatest({n} - 2, 1)')}))")

    address = f"concat(IF({n} > 20, left({v}, 20), left({v}, greatest({n} DIV 2, 5))), '***')"
    tail = f"IF({n} >= 4, concat({stars(f'{n} - 4')}, right({v}, 4)), {generic})"
    birth = let(f"split(replace({v}, '/', '-'), '-')", lambda d: (
        f"IF(size({d}) = 3, concat('****-**-', {d}[0]), {generic})"))
    ip = let(f"split({v}, '[.]')", lambda o: (
        f"IF(size({o}) = 4, concat({o}[0], '.***.***.***'), concat({half}, '***'))"))

    # Types per rule.
    masked = by_type(kind, [
        (("email",), email),
        (PHONES, phone),
        (("ssn",), ssn),
        (("credit_card",), card),
        (("name", "person_name"), let(words(v), person)),
        (("address",), address),
        (("passport", "cn_id", "ni_uk"), tail),
        (("dob", "date_of_birth", "birth_date"), birth),
        (("salary", "income", "wage"), "'***'"),
        (("ipv4",), ip),
    ], generic)
    return f"IF({is_filled(v)}, {masked}, {v})"


def _ip_from(v: str, h: str) -> str:
    def public(d: str) -> str:
        byte = lambda at: f"conv(substr({d}, {at}, 2), 16, 10)"
        return f"concat('10.', {byte(1)}, '.', {byte(3)}, '.', {byte(5)})"
    return f"IF({is_private_ip(v)}, {v}, {let(h, public)})"


def mask_full(v: str, kind: str, digits: int = 4) -> str:
    """Irreversible typed pseudonym: equal values of a type give equal pseudonyms.

    Phones, social security and card numbers carry ``digits`` hex digits. Four
    is the customary format; for joins over many values ask for more.
    """
    h = f"sha2(concat({lit(HASH_SALT + ':')}, {kind}, ':', {v}), 256)"
    h12, short = f"left({h}, 12)", f"left({h}, {digits})"
    # Pseudonym formats.
    masked = by_type(kind, [
        (("email",), f"concat('anon_', {h12}, '@scrubbed.local')"),
        (PHONES, f"concat('+1-555-', {short})"),
        (("ssn",), f"concat('XXX-XX-', {short})"),
        (("credit_card",), f"concat('XXXX-XXXX-XXXX-', {short})"),
        (NAMES, f"concat('Person_', {h12})"),
        (("ipv4",), _ip_from(v, h)),
    ], f"concat('[SCRUBBED:', {h12}, ']')")
    return f"IF({v} = '', {v}, {masked})"


def fake_value(v: str, kind: str) -> str:
    """Format-preserving stand-in whose hash ignores the type."""
    h = f"sha2(concat({lit(HASH_SALT + ':')}, {v}), 256)"
    h4, h8, h12 = (f"left({h}, {n})" for n in (4, 8, 12))
    # Stand-in formats.
    return by_type(kind, [
        (("email",), f"concat('anon_', {h12}, '@scrubbed.local')"),
        (PHONES, f"concat('+1-555-', {h4})"),
        (("ssn",), f"concat('XXX-XX-', {h4})"),
        (("credit_card",), f"concat('XXXX-XXXX-XXXX-', {h4})"),
        (("cn_id", "ni_uk"), f"concat('ID-', {h8})"),
        (("ipv4",), _ip_from(v, h)),
        (("iban", "swift"), f"concat('XX', {h8})"),
        (("api_key",), f"concat('sk-redacted-', {h8})"),
    ], f"concat('[SCRUBBED:', {h8}, ']')")


def tokenize(v: str, kind: str, token_key: str, digits: int = 24) -> str:
    """Recoverable token: a keyed digest of type and value.

    It depends on nothing but key, type and value, so every partition and every
    run gives the same token. 24 hex digits keep tokens apart for any number of
    values a cluster can hold.
    """
    if digits < 12:
        raise ValueError("tokens need at least 12 hex digits to stay distinct")

    h = f"left(sha2(concat({lit(token_key + ':')}, {kind}, ':', {v}), 256), {digits})"
    # Token formats.
    return by_type(kind, [
        (("email",), f"concat('tok_', {h}, '@masked.local')"),
        (("phone_us", "phone_uk", "phone_intl"), f"concat('+1-555-', {h})"),
        (("ssn",), f"concat('XXX-XX-', {h})"),
        (("credit_card",), f"concat('TOK-CC-', {h})"),
        (NAMES, f"concat('Person_', {h})"),
    ], f"concat('TOK_', {h})")


def apply_mask(v: str, kind: str, level: str, token_key: str | None = None,
               digits: int = 4, token_digits: int = 24) -> str | None:
    """Expression for a level; ``None`` means the column goes away."""
    if level == PARTIAL:
        return mask_partial(v, kind)
    if level == SCRUB:
        return mask_full(v, kind, digits)
    if level == TOKENIZE:
        if not token_key:
            raise ValueError("tokenising needs a key: pass a password")
        return tokenize(v, kind, token_key, token_digits)
    if level == DELETE:
        return None
    return v
