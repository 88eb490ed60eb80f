"""Hypothesis strategies for typed rows, and helpers for tests."""

from __future__ import annotations

import datetime as dt
from typing import Any

from hypothesis import strategies as st

from typeloom.schema import Schema
from typeloom.types import ColumnType

#: Ranges of generated integers and halves, in powers of two.
POWERS = {"int8": 6, "int16": 12, "int32": 18, "int64": 32, "float32": 17, "float64": 33}
TEXT = st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0"), max_size=64)


def values(kind: ColumnType, nulls: bool = True) -> st.SearchStrategy[Any]:
    """Values of a declared type; floats are halves, so that sums of them are exact."""
    name = kind.name.split("(")[0]
    if name.startswith("int"):
        made = st.integers(-(2 ** POWERS[name]), 2 ** POWERS[name])
    elif name.startswith("float"):
        made = st.integers(-(2 ** POWERS[name]), 2 ** POWERS[name]).map(lambda i: i / 2)
    elif name == "decimal":
        made = st.decimals(-(2**20), 2**20, places=2, allow_nan=False)
    elif name == "array":
        made = st.lists(values(kind.inner[0], False), max_size=4)
    elif name == "map":
        made = st.dictionaries(values(kind.inner[0], False), values(kind.inner[1], False), max_size=4)
    elif name == "struct":
        made = st.fixed_dictionaries({f: values(t, nulls) for f, t in zip(kind.fields, kind.inner)})
    else:
        made = {
            "boolean": st.booleans(), "string": TEXT, "binary": st.binary(max_size=64), "uuid": st.uuids(),
            "date": st.dates(dt.date(1970, 1, 1), dt.date(2100, 12, 31)), "timestamp": st.datetimes(dt.datetime(1970, 1, 1), dt.datetime(2100, 12, 31)), "time": st.times(),
            "json": st.recursive(st.none() | st.booleans() | st.integers(-1000, 1000) | TEXT, lambda x: st.lists(x, max_size=3) | st.dictionaries(TEXT, x, max_size=3), max_leaves=5),
        }[name]
    return st.none() | made if nulls else made


def rows(schema: type[Schema], nulls: bool = True, **given: st.SearchStrategy[Any]) -> st.SearchStrategy[Schema]:
    kinds = schema.types()
    return st.tuples(*[given.get(n) or values(t, nulls) for n, t in kinds.items()]).map(lambda v: schema(*v))


def unique(schema: type[Schema], *keys: str, max_size: int = 8, **given: st.SearchStrategy[Any]) -> st.SearchStrategy[list[Schema]]:
    """Rows whose keys are all different."""
    return st.lists(rows(schema, **given), max_size=max_size, unique_by=tuple(lambda r, k=k: getattr(r, k) for k in keys))


def same_rows(a: Any, b: Any) -> bool:
    """Equal as multisets."""
    return sorted(map(str, a)) == sorted(map(str, b))
