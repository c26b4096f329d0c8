"""Rows made comparable."""

from __future__ import annotations


def comparable(rows: list[dict]) -> list[str]:
    """Rows as sorted texts, floats to nine places."""
    return sorted(str(sorted((k, round(v, 9) if isinstance(v, float) else v) for k, v in r.items())) for r in rows)
