"""Connected components, from the library's graph operators."""

from tessera.operators.graph import components

__all__ = ["components"]
