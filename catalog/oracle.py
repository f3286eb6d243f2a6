"""The rules once more, independently, as DuckDB SQL text."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    category: str
    type: str
    regex: str
    ignore_case: bool = False


# The published detection grammar, written out and not taken from the engine.
PATTERNS = (
    Rule("CONTACT", "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    Rule("CONTACT", "phone_us", r"\b(?:\+?1[-.\s]?)?\(?[2-9]\d{2}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    Rule("CONTACT", "phone_uk", r"\b(?:\+44[-.\s]?|0)7\d{3}[-.\s]?\d{6}\b"),
    Rule("CONTACT", "phone_intl", r"\b\+[1-9]\d{1,3}[-.\s]?\d{1,14}(?:[-.\s]?\d{1,13})?\b"),
    Rule("CONTACT", "phone_cn", r"\b1[3-9]\d{9}\b"),
    Rule("IDENTITY", "ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    Rule("IDENTITY", "ni_uk", r"\b[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b", True),
    Rule("IDENTITY", "cn_id", r"\b[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b"),
    Rule("IDENTITY", "passport_us", r"\b[A-Z]\d{8}\b"),
    Rule("IDENTITY", "passport_uk", r"\b\d{9}\b"),
    Rule("IDENTITY", "passport_generic", r"\b[A-Z]{1,2}\d{6,9}\b"),
    Rule("FINANCIAL", "credit_card", r"\b(?:4[0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|5[1-5][0-9]{2}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}|6(?:011|5[0-9]{2})[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4})\b"),
    Rule("FINANCIAL", "iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{1,30}\b"),
    Rule("FINANCIAL", "swift", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"),
    Rule("TECHNICAL", "ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    Rule("TECHNICAL", "ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
    Rule("TECHNICAL", "api_key", r"""\b(?:sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{36}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z\-_]{35}|(?:api[_-]?key|apikey|secret|token|password|passwd)\s*[:=]\s*["']?[A-Za-z0-9_\-+=\/]{8,})["']?\b""", True),
    Rule("LOCATION", "zip_us", r"\b\d{5}(?:-\d{4})?\b"),
    Rule("LOCATION", "postcode_uk", r"\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b", True),
)

TYPES = "[" + ", ".join(f"'{p.type}'" for p in PATTERNS) + "]"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(p) -> str:
    return quote(("(?i)" if p.ignore_case else "") + p.regex)


def ascii_words(text: str) -> str:
    """RE2's word boundary is ASCII: letters beyond become a word character of equal length."""
    return rf"regexp_replace({text}, '[^\x00-\x7F\P{{L}}]', '_', 'g')"


def found(source: str, key: str, text: str) -> str:
    """CTEs ending in ``found``: every match as (k, category, type, rank, start, end, match)."""
    per_pattern = "\nunion all ".join(
        f"select k, text, {quote(p.category)} as category, {quote(p.type)} as type, {i} as rank, "
        f"regexp_extract_all(t, {re2(p)}) as m, regexp_split_to_array(t, {re2(p)}) as s from src"
        for i, p in enumerate(PATTERNS))
    return f"""
src as materialized (select {key} as k, {text} as text, {ascii_words(text)} as t from {source}),
hits as ({per_pattern}),
placed as (select *, unnest(range(1, len(m) + 1)) as i from hits where len(m) > 0),
spans as (select *, list_sum(list_transform(s[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as a, length(m[i]) as n from placed),
found as materialized (select k, category, type, rank, cast(a as integer) as start, cast(a + n as integer) as "end",
    substr(text, cast(a as integer) + 1, n) as match from spans)"""


def marked(source: str, key: str, text: str) -> str:
    """CTEs ending in ``marked``: matches with the flag of greedy overlap resolution."""
    return found(source, key, text) + """,
num as materialized (select *, row_number() over (partition by k order by start, start - "end", rank) as n from found),
walk as (select k, n, "end" as reach, true as kept from num where n = 1
    union all select num.k, num.n,
        case when num.start >= walk.reach - 2 then greatest(walk.reach, num."end") else walk.reach end,
        num.start >= walk.reach - 2
    from walk join num on num.k = walk.k and num.n = walk.n + 1),
marked as materialized (select num.*, walk.kept from num join walk on num.k = walk.k and num.n = walk.n)"""


def kept(source: str, key: str, text: str) -> str:
    """CTEs ending in ``kept``."""
    return marked(source, key, text) + ",\nkept as (select * from marked where kept)"


def scan(source: str, key: str, text: str, rest: str) -> str:
    return f"with recursive {kept(source, key, text)}\n{rest}"


def stars(n: str) -> str:
    return f"repeat('*', cast(greatest({n}, 0) as bigint))"


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def mask_middle(v: str) -> str:
    return (f"case when length({v}) <= 2 then {stars(f'length({v})')} "
            f"else left({v}, 1) || {stars(f'length({v}) - 2')} || right({v}, 1) end")


def partial_redaction(v: str, kind: str) -> str:
    d = digits(v)
    local = f"split_part({v}, '@', 1)"
    email = (f"case when position('@' in {v}) = 0 then {mask_middle(v)} "
             f"when length({local}) <= 2 then left({local}, 1) || {stars(f'length({local}) - 1')} || substr({v}, length({local}) + 1) "
             f"else left({local}, 1) || {stars(f'length({local}) - 2')} || right({local}, 1) || substr({v}, length({local}) + 1) end")
    at = lambda i: f"length({digits(f'left({v}, {i})')})"
    veiled = (f"array_to_string(list_transform(range(1, length({v}) + 1), lambda i: case "
              f"when not regexp_matches(substr({v}, i, 1), '[0-9]') then substr({v}, i, 1) "
              f"when {at('i')} <= 3 or {at('i')} > length({d}) - 3 then substr({v}, i, 1) else '*' end), '')")
    phone = f"case when length({d}) >= 6 then {veiled} else {mask_middle(v)} end"
    ids = f"case when length({d}) >= 4 then {stars(f'length({d}) - 4')} || right({d}, 4) else {mask_middle(v)} end"
    masked = f"({stars(f'greatest(length({d}) - 4, 2)')} || right({d}, 4))"
    card = (f"case when length({d}) >= 4 then array_to_string(list_transform(range(0, cast(ceil(length({masked}) / 4.0) as bigint)), "
            f"lambda g: substr({masked}, cast(g * 4 + 1 as bigint), 4)), '-') else {mask_middle(v)} end")
    words = f"list_filter(regexp_split_to_array({v}, '\\s+'), lambda w: w <> '')"
    name = (f"case when len({words}) > 0 then array_to_string(list_transform({words}, "
            f"lambda w: left(w, 1) || {stars('length(w) - 1')}), ' ') else '***' end")
    ip = f"case when position('.' in {v}) > 0 then split_part({v}, '.', 1) || '.*.*.*' else {mask_middle(v)} end"
    place = f"case when len({words}) > 1 then {words}[1] || ' ***' else '***' end"
    return f"""case when {kind} = 'email' then {email}
 when {kind} in ('phone_us','phone_uk','phone_intl','phone_cn','phone') then {phone}
 when {kind} in ('ssn','ni_uk','cn_id') then {ids}
 when {kind} = 'credit_card' then {card}
 when {kind} in ('name','person_name') then {name}
 when {kind} in ('ipv4','ipv6') then {ip}
 when {kind} in ('address','location') then {place}
 else {mask_middle(v)} end"""


def redacted(source: str, key: str, text: str, replacement: str, having: bool = False) -> str:
    """``key, redacted``: kept spans replaced, ``replacement`` may use match and type."""
    return f"""with recursive {kept(source, key, text)},
cut as (select kept.k, start, "end", match, type,
    coalesce(lag("end") over (partition by kept.k order by start), 0) as gap, text
    from kept join src on src.k = kept.k),
parts as (select k, string_agg(substr(text, gap + 1, start - gap) || ({replacement}), '' order by start) as body,
    max("end") as stop from cut group by k)
select src.k as {key}, case when parts.k is null then src.text
    else body || substr(src.text, stop + 1) end as redacted
from src {"join" if having else "left join"} parts on parts.k = src.k"""


def first_type(v: str) -> str:
    """Type of the first finding of a short cell: earliest, longest, first in registry."""
    options = ", ".join(
        f"case when regexp_matches({v}, {re2(p)}) then {{'a': length(regexp_split_to_array({v}, {re2(p)})[1]), "
        f"'b': -length(regexp_extract({v}, {re2(p)})), 'c': {i}, 'type': {quote(p.type)}}} end"
        for i, p in enumerate(PATTERNS))
    return f"list_min(list_filter([{options}], lambda x: x is not null)).type"


PHONES = "('phone_us','phone_uk','phone_intl','phone_cn')"
PRIVATE = "(starts_with({v}, '192.168.') or starts_with({v}, '10.') or starts_with({v}, '172.16.'))"


def mask_partial(v: str, kind: str) -> str:
    n = f"length({v})"
    half = f"left({v}, {n} // 2)"
    generic = (f"case when {n} > 4 then left({v}, 4) || {stars(f'least({n} - 4, 10)')} "
               f"else left({v}, 1) || {stars(f'{n} - 1')} end")
    local, domain = (f"regexp_extract({v}, '^(.*)@([^@]*)$', {i})" for i in (1, 2))
    clean = f"translate({v}, ' -', '')"
    words = f"list_filter(regexp_split_to_array({v}, '\\s+'), lambda w: w <> '')"
    date = f"string_split(replace({v}, '/', '-'), '-')"
    octets = f"string_split({v}, '.')"
    return f"""case when {v} is null or not regexp_matches({v}, '\\S') then {v}
 when {kind} = 'email' then case when position('@' in {v}) > 0
   then left({local}, case when length({local}) > 3 then 3 else 1 end) || '***@' || {domain} else left({v}, 3) || '***' end
 when {kind} in {PHONES} then case when length({digits(v)}) < 4 then {half} || '****'
   when position('-' in {v}) > 0 then left({v}, 3) || '-***-***' else left({v}, {n} - 4) || '****' end
 when {kind} = 'ssn' then case when {n} >= 4 then '***-**-' || right({v}, 4) else {generic} end
 when {kind} = 'credit_card' then case when length({clean}) >= 4
   then left({clean}, 1) || {stars(f'length({clean}) - 5')} || '-' || right({clean}, 4) else {generic} end
 when {kind} in ('name','person_name') then case when len({words}) >= 2
   then array_to_string(list_transform({words}, lambda w: case when length(w) <= 2 then w else left(w, 2) || {stars('length(w) - 2')} end), ' ')
   else left({v}, 2) || {stars(f'greatest({n} - 2, 1)')} end
 when {kind} = 'address' then case when {n} > 20 then left({v}, 20) else left({v}, greatest({n} // 2, 5)) end || '***'
 when {kind} in ('passport','cn_id','ni_uk') then case when {n} >= 4 then {stars(f'{n} - 4')} || right({v}, 4) else {generic} end
 when {kind} in ('dob','date_of_birth','birth_date') then case when len({date}) = 3 then '****-**-' || {date}[1] else {generic} end
 when {kind} in ('salary','income','wage') then '***'
 when {kind} = 'ipv4' then case when len({octets}) = 4 then {octets}[1] || '.***.***.***' else {half} || '***' end
 else {generic} end"""


def _ip(v: str, h: str) -> str:
    byte = lambda i: f"cast(('0x' || substr({h}, {i}, 2))::int as varchar)"
    return (f"case when {PRIVATE.format(v=v)} then {v} "
            f"else '10.' || {byte(1)} || '.' || {byte(3)} || '.' || {byte(5)} end")


def mask_full(v: str, kind: str, n: int = 4) -> str:
    h = f"sha256('dc-scrub-v1:' || {kind} || ':' || {v})"
    return f"""case when {v} is null or {v} = '' then {v}
 when {kind} = 'email' then 'anon_' || left({h}, 12) || '@scrubbed.local'
 when {kind} in {PHONES} then '+1-555-' || left({h}, {n})
 when {kind} = 'ssn' then 'XXX-XX-' || left({h}, {n})
 when {kind} = 'credit_card' then 'XXXX-XXXX-XXXX-' || left({h}, {n})
 when {kind} in ('name','person_name','full_name') then 'Person_' || left({h}, 12)
 when {kind} = 'ipv4' then {_ip(v, h)}
 else '[SCRUBBED:' || left({h}, 12) || ']' end"""


def fake_value(v: str, kind: str) -> str:
    h = f"sha256('dc-scrub-v1:' || {v})"
    return f"""case when {v} is null then null
 when {kind} = 'email' then 'anon_' || left({h}, 12) || '@scrubbed.local'
 when {kind} in {PHONES} then '+1-555-' || left({h}, 4)
 when {kind} = 'ssn' then 'XXX-XX-' || left({h}, 4)
 when {kind} = 'credit_card' then 'XXXX-XXXX-XXXX-' || left({h}, 4)
 when {kind} in ('cn_id','ni_uk') then 'ID-' || left({h}, 8)
 when {kind} = 'ipv4' then {_ip(v, h)}
 when {kind} in ('iban','swift') then 'XX' || left({h}, 8)
 when {kind} = 'api_key' then 'sk-redacted-' || left({h}, 8)
 else '[SCRUBBED:' || left({h}, 8) || ']' end"""


def token(v: str, kind: str, key: str, n: int = 24) -> str:
    h = f"left(sha256('{key}:' || {kind} || ':' || {v}), {n})"
    return f"""case when {v} is null then null
 when {kind} = 'email' then 'tok_' || {h} || '@masked.local'
 when {kind} in ('phone_us','phone_uk','phone_intl') then '+1-555-' || {h}
 when {kind} = 'ssn' then 'XXX-XX-' || {h}
 when {kind} = 'credit_card' then 'TOK-CC-' || {h}
 when {kind} in ('name','person_name','full_name') then 'Person_' || {h}
 else 'TOK_' || {h} end"""
