"""Connected components; the tables of edges are those of the core."""

from loomlog.operators.components import components

__all__ = ["components"]
