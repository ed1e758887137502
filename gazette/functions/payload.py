"""JSON payloads of scorers: strict where possible, lenient where the text around the JSON demands it."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names under which a payload may hold its list of items.
ITEM_KEYS = ("decisions", "items", "results", "data", "articles")


def first_value(text: str | None):
    """The first JSON value in a text: fences and prose around it go, a text that is JSON itself is decoded once more."""
    raw = (text or "").strip()
    if raw.startswith("```"):
        raw = raw.split("\n", 1)[-1].rsplit("```", 1)[0].strip()
    for _ in range(2):
        value = None
        decoder = json.JSONDecoder()
        for at, sign in enumerate(raw):
            if sign in '{["':
                try:
                    value, _ = decoder.raw_decode(raw, at)
                    break
                except ValueError:
                    continue
        if not isinstance(value, str):
            return value
        raw = value
    return None


def items(text: str | None) -> list:
    """The items of a payload: a bare list, or the first list under a known name."""
    value = first_value(text)
    if isinstance(value, list):
        return value
    if isinstance(value, dict):
        return next((value[k] for k in ITEM_KEYS if isinstance(value.get(k), list)), [])
    return []


def payload_items(c: Column) -> Column:
    """The items of a payload as an array of JSON texts with sorted keys; an unreadable payload has none."""

    @F.pandas_udf("array<string>")
    def run(texts):
        return texts.map(lambda t: [json.dumps(x, sort_keys=True, ensure_ascii=False) for x in items(t)])

    return run(c)


def parsed(c: Column, schema: str, default: Column | None = None) -> Column:
    """Strict JSON by a schema; what does not parse is the default."""
    value = F.from_json(c, schema, {"mode": "PERMISSIVE"})
    return value if default is None else F.coalesce(value, default)


def encoded(c: Column) -> Column:
    return F.to_json(c)
