"""Connected components; the operator is the library's own."""

from narrata.operators.components import components

__all__ = ["components"]
