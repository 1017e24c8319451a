"""Continuous queries: one of a query's tables may be a stream.

Atoms are evaluated at their tables, in an order that needs no statistics of the stream, and what they
tell of the whole filter drops rows before the joins: an OR over several tables reaches the stream, too. Aggregating queries need an
output mode of ``complete`` or ``update``, as everywhere in Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from orweave.engine import Engine
from orweave.operators.lower import Lowering
from orweave.plans.nodes import Context, split_joins
from orweave.plans.planners import PushAtoms
from orweave.plans.query import Query


class _Even:
    """Statistics of tables about which nothing is known."""

    def rows(self, query, alias):
        return 1000.0

    def unique(self, query, column):
        return 1000.0


def continuous(engine: Engine, query: str | Query) -> DataFrame:
    """A streaming DataFrame of the query's results; register the stream in the engine's catalog first."""
    query = engine.parse(query)
    root, edges = split_joins(query)
    plan = PushAtoms(engine.config.cross_joins).plan(Context(query, root, edges, _Even(), engine.config.costs))
    return Lowering(engine.catalog, query, root, True, engine.config.settings).run(plan)
