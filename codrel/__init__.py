"""Relational algebra with set semantics and ordered record vectors over Spark DataFrames."""

from .functions.predicate import and_, col_eq, not_, or_, val_eq
from .operators.relation import Relation, table
from .operators.vector import Vector
from .plans.schema import Schema

__all__ = ["Relation", "Schema", "Vector", "and_", "col_eq", "not_", "or_", "table", "val_eq"]
