"""The graph of expressions: order of evaluation, column lineage, DOT text."""

from __future__ import annotations

from collections.abc import Iterable
from graphlib import TopologicalSorter

from typeloom.plans.model import is_expression
from typeloom.schema import Schema


def graph_of(targets: Iterable[type[Schema]]) -> dict[type[Schema], list[type[Schema]]]:
    """Each schema and the schemas that it is made from."""
    found: dict[type[Schema], list[type[Schema]]] = {}
    todo = list(targets)
    while todo:
        s = todo.pop()
        if s not in found:
            found[s] = list(s.input_schemas().values()) if is_expression(s) else []
            todo += found[s]
    return found


def in_order(targets: Iterable[type[Schema]]) -> list[type[Schema]]:
    """Inputs before what is made from them."""
    graph = graph_of(targets)
    return list(TopologicalSorter({s: set(i) for s, i in graph.items()}).static_order())


def with_column(graph: dict[type[Schema], list[type[Schema]]], column: str) -> dict[type[Schema], list[type[Schema]]]:
    """The part of the graph whose schemas have a column."""
    return {s: [i for i in inputs if column in i.types()] for s, inputs in graph.items() if column in s.types()}


def common_columns(graph: dict[type[Schema], list[type[Schema]]]) -> dict[tuple[type[Schema], type[Schema]], list[str]]:
    """For each edge, the columns that both ends have."""
    return {(i, s): [c for c in s.types() if c in i.types()] for s, inputs in graph.items() for i in inputs}


def to_dot(graph: dict[type[Schema], list[type[Schema]]], columns: bool = False) -> str:
    lines = ["digraph expressions {", "  rankdir=LR;"]
    for s in sorted(graph, key=lambda s: s.__name__):
        shape = "box" if is_expression(s) else "ellipse"
        label = s.__name__ + ("\\n" + "\\n".join(f"{c}: {t}" for c, t in s.types().items()) if columns else "")
        lines.append(f'  "{s.__name__}" [shape={shape}, label="{label}"];')
    for (a, b), shared in sorted(common_columns(graph).items(), key=lambda e: (e[0][0].__name__, e[0][1].__name__)):
        lines.append(f'  "{a.__name__}" -> "{b.__name__}"' + (f' [label="{", ".join(shared)}"]' if columns else "") + ";")
    return "\n".join([*lines, "}"]) + "\n"
