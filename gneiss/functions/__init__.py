"""Identifiers, cursors and the JSON form of rows."""
