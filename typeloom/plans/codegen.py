"""Python modules with the schemas of expressions, as code."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from typeloom.plans.lineage import in_order
from typeloom.schema import Schema, safe_name, snake_case
from typeloom.types import ColumnType

#: Simple type names and the aliases that stand for them in code.
ALIASES = {"int8": "Int8", "int16": "Int16", "int32": "Int32", "int64": "Int64", "float32": "Float32", "float64": "Float64", "boolean": "Boolean", "string": "String", "binary": "Binary", "date": "Date", "timestamp": "Timestamp", "time": "Time", "uuid": "UUID", "json": "JSON"}


def annotation(kind: ColumnType) -> str:
    """The alias of a type, nested as deep as it goes."""
    if kind.name == "array":
        return f"Array[{annotation(kind.inner[0])}]"
    if kind.name == "map":
        return f"Map[{annotation(kind.inner[0])}, {annotation(kind.inner[1])}]"
    if kind.name == "struct":
        return "Struct[{" + ", ".join(f'"{n}": {annotation(t)}' for n, t in zip(kind.fields, kind.inner)) + "}]"
    base = kind.name.split("(")[0]
    return "Decimal" if base == "decimal" else ALIASES[base]


def module_text(schema: type[Schema], name: str | None = None) -> str:
    types = schema.types()
    lines = ['"""Generated. Do not edit."""', "", "from typing import ClassVar", "", "from typeloom.schema import Schema", "from typeloom.types import *  # noqa: F403", "", "", f"class {name or schema.__name__}(Schema):", "    table_schema: ClassVar = {"]
    lines += [f'        "{c}": "{t}",' for c, t in types.items()] + ["    }"]
    lines += [f"    {safe_name(c)}: {annotation(t)}  # noqa: F405" for c, t in types.items()]
    return "\n".join(lines) + "\n"


def package(targets: Iterable[type[Schema]]) -> dict[str, str]:
    """File names and texts: a module per schema, inputs first, and an index."""
    schemas = in_order(targets)
    files = {f"{snake_case(s.__name__)}.py": module_text(s) for s in schemas}
    index = [f"from .{snake_case(s.__name__)} import {s.__name__}" for s in sorted(schemas, key=lambda s: s.__name__)]
    files["__init__.py"] = "\n".join(['"""Generated. Do not edit."""', "", *index, "", "__all__ = [" + ", ".join(f'"{s.__name__}"' for s in sorted(schemas, key=lambda s: s.__name__)) + "]"]) + "\n"
    return files


def write_package(targets: Iterable[type[Schema]], folder: str | Path, check: bool = False) -> list[str]:
    """Write what differs and name it; with ``check``, only name it."""
    folder, changed = Path(folder), []
    for name, text in package(targets).items():
        path = folder / name
        if not path.exists() or path.read_text() != text:
            changed.append(name)
            if not check:
                folder.mkdir(parents=True, exist_ok=True)
                path.write_text(text)
    return changed
