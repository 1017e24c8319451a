from orweave.functions.expressions import Between, Binary, Call, Cast, Column, Expr, In, IsNull, Like, Literal, Not, Negate
from orweave.functions.registry import AGGREGATES, SCALARS, register

__all__ = ["AGGREGATES", "SCALARS", "Between", "Binary", "Call", "Cast", "Column", "Expr", "In", "IsNull", "Like", "Literal", "Negate", "Not", "register"]
