"""Queries over the given tables, one per operator, each with the SQL it must agree with."""

from tabeval.queries import compare, curves, features, fitted, scalars, search, stored, training  # noqa: F401
from tabeval.queries.registry import ORACLES, QUERIES  # noqa: F401
