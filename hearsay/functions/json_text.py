"""Parsing of JSON texts of unknown depth, for what walks them by recursion."""

from __future__ import annotations

import json
import re

#: Objects and arrays inside each other that a text may have; beyond it counts as not being JSON.
MOST_DEPTH = 200
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)


def depth(text: str) -> int:
    """How deep the brackets of a JSON text are nested."""
    now = most = 0
    for c in _STRING.sub("", text):
        if c in "[{":
            now += 1
            most = max(most, now)
        elif c in "]}":
            now -= 1
    return most


def parsed(text: str):
    """The value of a JSON text; ValueError if it isn't JSON, or is nested deeper than MOST_DEPTH."""
    if text.count("[") + text.count("{") > MOST_DEPTH and depth(text) > MOST_DEPTH:
        raise ValueError("nested too deeply")
    return json.loads(text)
