"""Which columns count as sensitive by name, and what each preset does to them."""

from __future__ import annotations

from .functions.masks import DELETE, PARTIAL, PRESERVE, SCRUB, TOKENIZE

# Column names that are sensitive whatever they hold.
SENSITIVE_NAMES = frozenset((
    "full_name", "first_name", "last_name", "name", "person_name",
    "email", "email_address", "e_mail", "mail",
    "phone", "phone_number", "mobile", "cell", "fax",
    "ssn", "social_security", "social_security_number", "national_id",
    "passport", "passport_number",
    "credit_card", "credit_card_number", "cc_number", "card_number",
    "salary", "income", "wage", "bank_account", "account_number", "iban", "swift", "routing_number",
    "address", "street_address", "home_address", "postal_address", "zip_code", "postal_code", "zipcode",
    "dob", "date_of_birth", "birth_date",
    "ip_address", "ip", "mac_address",
    "driver_license", "dl_number",
    "notes", "comments", "medical_history", "health_info",
))

# Masking level per column name and preset.
PRESETS: dict[str, dict[str, str]] = {
    "external": {
        **dict.fromkeys(
            ("name", "full_name", "first_name", "last_name", "email", "phone", "ssn",
             "credit_card", "passport", "salary", "address", "ip_address", "dob"), SCRUB),
        **dict.fromkeys(("notes", "comments"), DELETE),
        "_default": SCRUB,
    },
    "internal": {"ip_address": PRESERVE, "_default": PARTIAL},
    "admin": {
        **dict.fromkeys(("salary", "ip_address", "dob", "notes", "comments"), PRESERVE),
        "_default": TOKENIZE,
    },
}
DEFAULT_PRESET = "internal"

# Which type a column name stands for, when the cell itself has none.
NAME_TYPES = {
    **dict.fromkeys(("full_name", "first_name", "last_name", "name", "person_name"), "name"),
    **dict.fromkeys(("address", "street_address", "home_address", "postal_address"), "address"),
    **dict.fromkeys(("passport", "passport_number"), "passport"),
    **dict.fromkeys(("dob", "date_of_birth", "birth_date"), "dob"),
    **dict.fromkeys(("salary", "income", "wage"), "salary"),
    **dict.fromkeys(("ssn", "social_security", "social_security_number"), "ssn"),
    **dict.fromkeys(("email", "email_address", "e_mail", "mail"), "email"),
    **dict.fromkeys(("credit_card", "credit_card_number", "cc_number", "card_number"), "credit_card"),
}


def is_sensitive_name(column: str) -> bool:
    return column.lower() in SENSITIVE_NAMES


def masking_level(column: str, preset: str | dict[str, str] = DEFAULT_PRESET) -> str:
    """Level of a column; an unknown preset behaves like the default one.

    ``preset`` may also be a policy of your own: column name to level, with an
    optional ``_default``.
    """
    policy = preset if isinstance(preset, dict) else PRESETS.get(preset, PRESETS[DEFAULT_PRESET])
    return policy.get(column.lower(), policy.get("_default", PARTIAL))
