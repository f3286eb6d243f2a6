"""The detector registry.

Order matters: two patterns that match the very same span are settled in
favour of the one listed first.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    category: str
    type: str
    regex: str
    ignore_case: bool = False
    #: character class every match starts with; lets the engine skip fast
    first: str | None = None
    #: decimal digits every match contains at least
    digits: int = 0
    #: True if every match contains five decimal digits in a row
    run: bool = False
    #: True if every match contains a letter, or even a capital
    letters: bool = False
    capitals: bool = False
    #: characters of the shortest possible match, as far as it helps
    size: int = 0
    #: literal every match contains, or None
    literal: str | None = None
    #: False if a match may start with a sign or bracket
    word_start: bool = True


# The published detection grammar. Word boundary, digit and
# space escapes have Unicode meaning; see java_regex().
PATTERNS: tuple[Pattern, ...] = (
    Pattern("CONTACT", "email",
            r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
            literal="@", word_start=False),
    Pattern("CONTACT", "phone_us",
            r"\b(?:\+?1[-.\s]?)?\(?[2-9]\d{2}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
            first=r"[+(1-9]", word_start=False, digits=10),
    Pattern("CONTACT", "phone_uk", r"\b(?:\+44[-.\s]?|0)7\d{3}[-.\s]?\d{6}\b",
            first=r"[+0]", word_start=False, run=True, digits=11),
    Pattern("CONTACT", "phone_intl",
            r"\b\+[1-9]\d{1,3}[-.\s]?\d{1,14}(?:[-.\s]?\d{1,13})?\b",
            first=r"\+", literal="+", word_start=False, digits=3),
    Pattern("CONTACT", "phone_cn", r"\b1[3-9]\d{9}\b", first="1", run=True, digits=11),
    Pattern("IDENTITY", "ssn", r"\b\d{3}-\d{2}-\d{4}\b", first=r"\d", literal="-", digits=9),
    Pattern("IDENTITY", "ni_uk", r"\b[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b",
            ignore_case=True, digits=6, letters=True),
    Pattern("IDENTITY", "cn_id",
            r"\b[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b",
            first="[1-9]", run=True, digits=17),
    Pattern("IDENTITY", "passport_us", r"\b[A-Z]\d{8}\b", first="[A-Z]", run=True, digits=8, letters=True, capitals=True),
    Pattern("IDENTITY", "passport_uk", r"\b\d{9}\b", first=r"\d", run=True, digits=9),
    Pattern("IDENTITY", "passport_generic", r"\b[A-Z]{1,2}\d{6,9}\b",
            first="[A-Z]", run=True, digits=6, letters=True, capitals=True),
    Pattern("FINANCIAL", "credit_card",
            r"\b(?:4[0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"
            r"|5[1-5][0-9]{2}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"
            r"|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}"
            r"|6(?:011|5[0-9]{2})[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4})\b",
            first="[3-6]", digits=15),
    Pattern("FINANCIAL", "iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{1,30}\b",
            first="[A-Z]", digits=2, letters=True, capitals=True),
    Pattern("FINANCIAL", "swift", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b",
            first="[A-Z]{6}", size=8, letters=True, capitals=True),
    Pattern("TECHNICAL", "ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", first=r"\d", literal=".", digits=4),
    Pattern("TECHNICAL", "ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
            literal=":"),
    Pattern("TECHNICAL", "api_key",
            r"\b(?:sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{36}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z\-_]{35}"
            r"|(?:api[_-]?key|apikey|secret|token|password|passwd)"
            r"""\s*[:=]\s*["']?[A-Za-z0-9_\-+=\/]{8,})["']?\b""",
            ignore_case=True, first="[sgapt]", size=14, letters=True),
    Pattern("LOCATION", "zip_us", r"\b\d{5}(?:-\d{4})?\b", first=r"\d", run=True, digits=5),
    Pattern("LOCATION", "postcode_uk", r"\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b",
            ignore_case=True, digits=2, letters=True),
)

# Contextual categories a plugged-in model may report.
MODEL_CATEGORIES = (
    "PERSON_NAME", "ADDRESS", "ORGANIZATION", "MEDICAL", "FINANCIAL_CTX",
    "AGE_DOB", "FAMILY", "VEHICLE", "PERSONAL_ID", "CREDENTIALS",
)

#: Unicode white space as the detectors and the blank test understand it.
SPACES = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x20), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

_WORD = r"[\p{L}\p{N}_]"
_BOUNDARY = rf"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
SPACE_CLASS = (r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a"
               r"\u2028\u2029\u202f\u205f\u3000]")


def _unicode(regex: str) -> str:
    """Spell Unicode-aware escapes out, so no JVM version or flag changes them."""
    return regex.replace(r"\b", _BOUNDARY).replace(r"\d", r"\p{Nd}").replace(r"\s", SPACE_CLASS)


def java_regex(p: Pattern) -> str:
    """The pattern as a Java regular expression for Spark's regexp functions.

    Same matches, found faster: the class of the first character is tested
    before anything else, and before a word character the boundary is simply
    the absence of another one.
    """
    regex = p.regex
    if p.word_start and regex.startswith(r"\b"):
        regex = f"(?<!{_WORD})" + regex[2:]
    skip = f"(?={p.first})" if p.first else ""
    return ("(?iu)" if p.ignore_case else "") + _unicode(skip + regex)
