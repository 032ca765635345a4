"""Reading and setting parts of JSON text by path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_value(text: Column, path: str) -> Column:
    """The value at a path ($.a.b, $.a[0]) as a string; null where there is none, where it is null, or where the text is no JSON."""
    return F.get_json_object(text, path)


def json_set(text: Column, key: str, value: Column) -> Column:
    """An object with a key set to a value: replaced or added, other values as they were, keys in alphabetical order. Null if the text is no object."""
    entries = F.try_parse_json(text).try_cast("map<string,variant>")
    kept = F.map_filter(entries, lambda k, _: k != key)
    return F.to_json(F.map_concat(kept, F.create_map(F.lit(key), value.cast("variant"))))
