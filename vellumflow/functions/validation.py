"""Checks of what a caller asks for: categories, limits, fetch requests. They run on the driver, on one request."""

from __future__ import annotations

import re

# The form of a category, and the bounds of a request.
CATEGORY = re.compile(r"[A-Za-z]+(?:[.-][A-Za-z]+)+")
MOST_CATEGORIES, MOST_RESULTS, MOST_HOURS = 12, 500, 720
RESULTS, HOURS = 200, 24


def whole_number(value: object, name: str, most: int, least: int = 1) -> int:
    """An integer between least and most; truth values are none."""
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError(f"{name} must be an integer")
    if not least <= value <= most:
        raise ValueError(f"{name} must be between {least} and {most}")
    return value


def categories(values: object) -> list[str]:
    """The distinct categories in their order."""
    if not isinstance(values, list) or not values:
        raise ValueError("at least one category is needed")
    if len(values) > MOST_CATEGORIES:
        raise ValueError(f"at most {MOST_CATEGORIES} categories are allowed")
    for v in values:
        if not isinstance(v, str) or not CATEGORY.fullmatch(v):
            raise ValueError(f"not a category: {v!r}")
    return list(dict.fromkeys(values))


def fetch_request(payload: object) -> dict:
    """The options of fetch() in a request, with defaults for what it leaves out."""
    if not isinstance(payload, dict):
        raise ValueError("a request must be an object")
    chosen = categories(payload.get("categories"))
    cap = whole_number(payload.get("max_results", RESULTS), "max_results", MOST_RESULTS)
    hours = whole_number(payload.get("lookback_hours", HOURS), "lookback_hours", MOST_HOURS)
    scan = payload.get("scan_revisions", True)
    if not isinstance(scan, bool):
        raise ValueError("scan_revisions must be true or false")
    return {"categories": chosen, "cap": cap, "first_run_hours": hours, "scan_revisions": scan}
