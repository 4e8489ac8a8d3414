"""Identifiers and literals in SQL text."""

from __future__ import annotations

import unicodedata

from gneiss.errors import InvalidIdentifier


def validate_ident(name: str) -> str:
    """Anything goes but empty and blank names and control characters."""
    if not name.strip() or any(unicodedata.category(c) == "Cc" for c in name):
        raise InvalidIdentifier(name)
    return name


def quote_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quote_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def resolve_database(name: str | None) -> str | None:
    """Blank names mean the active database."""
    name = (name or "").strip()
    return validate_ident(name) if name else None
