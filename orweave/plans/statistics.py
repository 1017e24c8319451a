"""Statistics: row counts, selectivities of atoms and distinct values of join columns.

All that is asked of one table is answered by one aggregation over its needed columns, and
remembered by canonical text, on disk too if a path is given. ``fraction`` below 1 reads a
Bernoulli sample instead of the table. Distinct counts, which multiply rows by columns, are exact for
small tables and approximate for large ones unless ``exact`` says otherwise. A table that is written or
registered anew, or whose files change, has another version, and nothing is known of that yet.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import functions as F

from orweave.functions.expressions import Column, Settings
from orweave.plans.predicates import Node
from orweave.plans.query import Query
from orweave.sources.catalog import Catalog


class Statistics:
    #: Bytes of a table whose distinct values are counted exactly unless the caller says otherwise.
    SMALL = 1 << 30

    def __init__(self, catalog: Catalog, settings: Settings = Settings(), path: str | None = None, exact: bool | None = None, fraction: float = 1.0):
        self.catalog, self.settings, self.path, self.exact, self.fraction = catalog, settings, path, exact, fraction
        #: table -> its version -> what is known of that version
        self.known: dict[str, dict[str, dict[str, float]]] = {}
        if path and os.path.exists(path):
            with open(path) as f:
                self.known = json.load(f)

    def of(self, table: str) -> dict[str, float]:
        """What is known of a table as it is now; what was known of it before it changed is dropped."""
        version = self.catalog.version(table)
        if version not in self.known.get(table, {}):
            self.known[table] = {version: {}}
        return self.known[table][version]

    @staticmethod
    def _atom(table: str, alias: str, atom: Node) -> str:
        return f"pred {atom.text.replace(alias + '.', table + '.')}"

    def gather(self, query: Query, atoms: Iterable[Node], columns: Iterable[Column]) -> None:
        """Answer what isn't known yet, one job for each table."""
        asked: dict[str, dict[str, tuple]] = {}  # table -> key -> (alias, column of the aggregate, whether a sample scales it)

        def ask(alias: str, key: str, value, scales: bool = False) -> None:
            if key not in self.of(query.tables[alias]):
                asked.setdefault(query.tables[alias], {}).setdefault(key, (alias, value, scales))

        def distinct(c: Column):
            frame = self.catalog.table(query.tables[c.table])
            exact = self.exact if self.exact is not None else int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= self.SMALL
            return (F.count_distinct if exact else F.approx_count_distinct)(F.col(f"`{c.slot}`"))

        for alias in query.tables:
            ask(alias, "rows", lambda: F.count(F.lit(1)), True)
        for a in atoms:
            if len(a.tables) == 1:
                (alias,) = a.tables
                ask(alias, self._atom(query.tables[alias], alias, a), lambda a=a: F.avg(F.coalesce(a.expr.lower(self.settings)[0].cast("double"), F.lit(0.0))))
        for c in columns:
            ask(c.table, f"unique {c.name}", lambda c=c: distinct(c))
        for table, values in asked.items():
            aliases = dict.fromkeys(alias for alias, _, _ in values.values())
            frame = self.catalog.table(table)
            frame = frame.sample(self.fraction, seed=0) if self.fraction < 1 else frame
            for alias in aliases:  # the same columns under each alias
                frame = frame.withColumns({f"{alias}__{c}": F.col(f"`{c}`") for c in self.catalog[table].names})
            row = frame.agg(*[v().alias(str(i)) for i, (_, v, _) in enumerate(values.values())]).first()
            for i, (key, (_, _, scales)) in enumerate(values.items()):
                self.of(table)[key] = float(row[i] or 0) / (self.fraction if scales and self.fraction < 1 else 1)
        if asked and self.path:
            with open(self.path + ".new", "w") as f:
                json.dump(self.known, f)
            os.replace(self.path + ".new", self.path)

    def annotate(self, query: Query, root: Node | None) -> None:
        for a in root.atoms() if root else ():
            if len(a.tables) == 1:
                (alias,) = a.tables
                a.selectivity = self.of(query.tables[alias]).get(self._atom(query.tables[alias], alias, a), 1.0)

    def rows(self, query: Query, alias: str) -> float:
        return self.of(query.tables[alias])["rows"]

    def unique(self, query: Query, c: Column) -> float:
        return self.of(query.tables[c.table])[f"unique {c.name}"]
