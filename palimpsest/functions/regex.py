"""Patterns written for ASCII word boundaries and Unicode case folding, for Spark."""

from __future__ import annotations

_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def re2(pattern: str) -> str:
    """The same matches in Spark: its ``\\b`` knows Unicode letters and its ``(?i)`` folds only ASCII."""
    for flags in ("(?i)", "(?is)"):
        pattern = pattern.replace(flags, flags.replace("i", "iu"))
    return pattern.replace(r"\b", _EDGE)
