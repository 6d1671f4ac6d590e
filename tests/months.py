"""Dates of the test panels."""

from __future__ import annotations

import datetime as dt


def month(i: int, year: int = 2000) -> dt.date:
    return dt.date(year + i // 12, i % 12 + 1, 1)
