"""orweave: disjunctive multi-join queries, planned in Python and run by Spark."""

from orweave.engine import Config, Engine, Measures, write_measures
from orweave.errors import QueryError, UnsupportedQuery
from orweave.functions.expressions import Settings
from orweave.plans.planners import PLANNERS
from orweave.plans.query import Parser, Query
from orweave.plans.statistics import Statistics
from orweave.sources.catalog import Catalog

__all__ = ["PLANNERS", "Catalog", "Config", "Engine", "Measures", "Parser", "Query", "QueryError", "Settings", "Statistics", "UnsupportedQuery", "write_measures"]
