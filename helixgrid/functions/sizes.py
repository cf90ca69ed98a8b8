"""Byte sizes as text."""

from __future__ import annotations

import re

_UNITS = {"": 1, "B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}


def format_bytes(n: int) -> str:
    """1536 -> '1.50 KB'; below a kilobyte '512 B'."""
    if n < 1024:
        return f"{n} B"
    for unit in ("KB", "MB", "GB"):
        n /= 1024
        if n < 1024:
            return f"{n:.2f} {unit}"
    return f"{n / 1024:.2f} TB"


def parse_bytes(text: str) -> int:
    """'2GB' -> 2147483648; a bare number is bytes; units are powers of 1024."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([KMGT]?B?)\s*", text.upper())
    if not m or (m[2] and m[2] not in _UNITS and m[2] + "B" not in _UNITS):
        raise ValueError(f"not a size: {text!r}")
    unit = m[2] if m[2] in _UNITS else m[2] + "B"
    size = float(m[1]) * _UNITS[unit]
    if size < 1:
        raise ValueError(f"a size must be positive: {text!r}")
    return int(size)
