"""The graph's questions by name, as objects that can be stored and run on any graph."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame

from ..errors import QueryError
from ..model import CodeGraph
from . import queries, traverse


class Query(Protocol):
    """What answers a question about a graph."""

    def run(self, graph: CodeGraph) -> DataFrame: ...


QUESTIONS = {
    "connected-files": queries.connected_files,
    "function-usage": queries.function_usage,
    "cycles": traverse.cycles,
    "cycle-members": traverse.cycle_members,
    "path": traverse.shortest_path,
    "distances": traverse.distances,
    "hubs": queries.hubs,
    "module-centrality": queries.module_centrality,
    "module-parent": queries.module_parent,
    "module-children": queries.module_children,
    "trait-impls": queries.trait_impls,
    "unreferenced-items": queries.unreferenced_items,
    "item-info": queries.item_details,
    "item-lookup": queries.item_lookup,
}


@dataclass(frozen=True)
class Ask:
    """A question of QUESTIONS with its arguments: Ask("hubs", {"metric": "in"}).run(graph)."""

    name: str
    arguments: dict[str, Any] = field(default_factory=dict)

    def run(self, graph: CodeGraph) -> DataFrame:
        if self.name not in QUESTIONS:
            raise QueryError(f"no question is named {self.name!r}")
        return QUESTIONS[self.name](graph, **self.arguments)
