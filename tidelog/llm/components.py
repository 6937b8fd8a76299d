"""Connected components, shared with the metadata operators."""

from tidelog.operators.components import connected_components

__all__ = ["connected_components"]
