"""Queries over the given tables, each with DuckDB SQL that must agree with it."""

from . import files, masking, scanning, tables  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
