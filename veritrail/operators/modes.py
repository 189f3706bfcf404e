"""Chat modes: what each searches, how many hits it takes, and whether it may be limited to documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mode:
    unit: str
    top_k: int
    hybrid: bool
    document_filter: bool


#: Fixed values.
MODES = {
    "vector": Mode("chunk", 5, False, True),
    "fulltext": Mode("chunk", 5, True, False),
    "entity_vector": Mode("entity", 10, False, False),
    "graph_vector": Mode("chunk", 5, False, True),
    "graph_vector_fulltext": Mode("chunk", 5, True, False),
    "global_vector": Mode("community", 10, True, False),
}
DEFAULT_MODE = "graph_vector_fulltext"


def mode_of(name: str | None, documents: Sequence[str] = ()) -> Mode:
    """The mode of a request; a mode that searches more than chunks of given documents refuses a selection of them."""
    mode = MODES.get(name or DEFAULT_MODE, MODES[DEFAULT_MODE])
    if documents and not mode.document_filter:
        raise ValueError("Please deselect all documents before using this chat mode")
    return mode


def guarded(name: Column, documents: Column) -> Column:
    """struct<mode, top_k, unit, hybrid, refused> for a request's mode and number of selected documents: unknown names get the default mode; a mode that takes no
    selection refuses one."""
    known = F.create_map(*[x for k, m in MODES.items() for x in (F.lit(k), F.struct(F.lit(k).alias("mode"), F.lit(m.top_k).alias("top_k"), F.lit(m.unit).alias("unit"), F.lit(m.hybrid).alias("hybrid"), F.lit(m.document_filter).alias("takes")))])
    mode = F.coalesce(F.try_element_at(known, name), F.element_at(known, F.lit(DEFAULT_MODE)))
    return F.struct(mode["mode"].alias("mode"), mode["top_k"].alias("top_k"), mode["unit"].alias("unit"), mode["hybrid"].alias("hybrid"), ((documents > 0) & ~mode["takes"]).alias("refused"))


Transform = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def post_processed(nodes: DataFrame, edges: DataFrame, tasks: dict[str, Transform], wanted: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the wanted tasks, in the order in which tasks are declared; unknown names are refused."""
    if unknown := set(wanted) - set(tasks):
        raise ValueError(f"unknown tasks: {sorted(unknown)}")
    for name, task in tasks.items():
        if name in wanted:
            nodes, edges = task(nodes, edges)
    return nodes, edges
