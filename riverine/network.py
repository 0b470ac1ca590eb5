"""The value that flows between steps: node, edge and subcatchment tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Network:
    """nodes(node_id, x, y, ...), edges(u, v, key, id, edge_type, length, ...), subs(sub_id, outlet_id, ...)."""

    nodes: DataFrame
    edges: DataFrame
    subs: DataFrame | None = None
    crs: str = "EPSG:32617"
    meta: dict = field(default_factory=dict)

    def with_nodes(self, nodes: DataFrame) -> Network:
        return replace(self, nodes=nodes)

    def with_edges(self, edges: DataFrame) -> Network:
        return replace(self, edges=edges)

    def with_subs(self, subs: DataFrame) -> Network:
        return replace(self, subs=subs)

    def drop_isolated(self) -> Network:
        """Nodes on no edge go."""
        used = self.edges.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
        return self.with_nodes(self.nodes.join(used, "node_id", "left_semi"))

    def has_drains(self) -> bool:
        """Whether any pipe or river is left (the guard between steps); stops at the first such edge."""
        return bool(self.edges.where(F.col("edge_type").isin("pipe", "river")).take(1))
