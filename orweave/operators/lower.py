"""From plans to DataFrames.

Conventional filters become ``where``. Tagged plans carry a nullable boolean column for each
evaluated atom and after every step apply the clauses of the weakened predicate that are new: a
row is dropped as soon as the whole predicate can't become true, atoms are evaluated once, and
what reaches the scans are plain comparisons that Parquet can use.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from orweave.functions.expressions import WIDTHS, Call, Expr, Like, Not, Settings
from orweave.functions.expressions import Column as ColumnRef
from orweave.operators.scan import scan
from orweave.plans import nodes
from orweave.plans.predicates import AND, OR, Node, clauses
from orweave.plans.query import Item, Query
from orweave.plans.tags import weaken
from orweave.sources.catalog import Catalog


@dataclass
class State:
    """A frame, the columns of its evaluated atoms, the nodes its filters made true and the clauses applied."""

    frame: DataFrame
    known: dict[str, str] = field(default_factory=dict)
    true: frozenset[str] = frozenset()
    applied: frozenset[str] = frozenset()


def _costly(e: Expr) -> bool:
    return isinstance(e, Like | Call) or isinstance(e, Not) and _costly(e.inner) or any(map(_costly, e.children()))


class Lowering:
    def __init__(self, catalog: Catalog, query: Query, root: Node | None, tagged: bool, settings: Settings, skip_decided: bool = True, observe: bool = False, build_bytes: int | None = None):
        self.catalog, self.query, self.root, self.tagged, self.settings, self.skip = catalog, query, root, tagged, settings, skip_decided
        self.build_bytes = build_bytes
        #: The rows that each node of the plan gives, counted as the query runs; counting keeps filters from moving past nodes.
        self.observed: dict[nodes.Plan, Observation] | None = {} if observe else None

    def condition(self, n: Node, known: dict[str, str]) -> Column:
        """A predicate over atom columns where there are any."""
        if n.is_atom:
            return F.col(known[n.text]) if n.text in known else n.expr.lower(self.settings)[0]
        parts = [self.condition(c, known) for c in n.ordered()]
        return reduce((lambda a, b: a & b) if n.kind == AND else (lambda a, b: a | b), parts)

    def _proved(self, n: Node, value: bool, known: dict[str, str]) -> Column | None:
        """Whether the known atoms prove n to be value; None if they never can."""
        if n.is_atom:
            if n.text not in known:
                return None
            c = F.col(known[n.text])
            return F.coalesce(c if value else ~c, F.lit(False))
        parts = [self._proved(c, value, known) for c in n.children]
        if (n.kind == OR) == value:
            some = [p for p in parts if p is not None]
            return reduce(lambda a, b: a | b, some) if some else None
        return None if any(p is None for p in parts) else reduce(lambda a, b: a & b, parts)

    def _decided(self, pred: Node, known: dict[str, str]) -> Column | None:
        """Whether a row has a decided ancestor on each of pred's lines; None if it can't."""
        lines = []
        for line in pred.lines():
            some = [p for n in sorted(line) for v in (True, False) if (p := self._proved(n, v, known)) is not None]
            if not some:
                return None
            lines.append(reduce(lambda a, b: a | b, some))
        return reduce(lambda a, b: a & b, lines) if lines else None

    def _drop(self, s: State) -> State:
        """Apply what of the weakened root is new."""
        for clause in self._ordered(weaken(self.root, s.known, s.true)):
            if clause.text not in s.applied:
                s.frame = s.frame.where(self.condition(clause, s.known))
                s.applied |= {clause.text}
                whole = self.root.text == clause.text or clause.text in {c.text for c in clauses(self.root)}
                s.true |= {clause.text} if whole else frozenset()
        return s

    @staticmethod
    def _ordered(root: Node | None) -> list[Node]:
        """The conjuncts of a root in the order of their evaluation."""
        return root.ordered() if root is not None and root.kind == AND else list(clauses(root))

    def lower(self, p: nodes.Plan) -> State:
        s = self._lower(p)
        if self.observed is not None:
            self.observed[p] = Observation()
            s.frame = s.frame.observe(self.observed[p], F.count(F.lit(1)).alias("rows"))
        return s

    def _lower(self, p: nodes.Plan) -> State:
        if isinstance(p, nodes.Base):
            return State(scan(self.catalog, self.query.tables[p.alias], p.alias))
        if isinstance(p, nodes.Filter):
            return self._filter(p)
        if isinstance(p, nodes.Join):
            return self._join(p)
        return self._union(p)

    def _filter(self, p: nodes.Filter) -> State:
        s, pred = self.lower(p.input), p.pred
        if not self.tagged or not pred.is_atom:
            s.frame = s.frame.where(self.condition(pred, s.known))
            s.true |= {pred.text}
            return s
        if pred.text in s.true:
            return s
        value = pred.expr.lower(self.settings)[0]
        if self.skip and _costly(pred.expr) and (decided := self._decided(pred, s.known)) is not None:
            value = F.when(~decided, value)
        name = f"__p{self._number(pred)}"
        s.frame, s.known = s.frame.withColumn(name, value), {**s.known, pred.text: name}
        return self._drop(s)

    def _number(self, pred: Node) -> int:
        return [a.text for a in self.root.atoms()].index(pred.text)

    def _join(self, p: nodes.Join) -> State:
        a, b = self.lower(p.left), self.lower(p.right)
        if p.edges and self.build_bytes is not None:
            side, s = (p.left, a) if p.build_left else (p.right, b)
            parts = int(self.catalog.spark.conf.get("spark.sql.shuffle.partitions"))
            if side.rows * sum(WIDTHS.get(f.dataType.simpleString(), 8) for f in s.frame.schema) / parts <= self.build_bytes:
                s.frame = s.frame.hint("shuffle_hash")
        if p.edges:
            on = reduce(lambda x, y: x & y, [F.col(f"`{e.left.slot}`") == F.col(f"`{e.right.slot}`") for e in p.edges])
            frame = a.frame.join(b.frame, on)
        else:
            frame = a.frame.crossJoin(b.frame)
        s = State(frame, {**a.known, **b.known}, a.true | b.true, a.applied | b.applied)
        return self._drop(s) if self.tagged and self.root else s

    def _union(self, p: nodes.Union) -> State:
        """A row goes to the first branch whose clause it meets, so bags stay bags."""
        out, before = None, []
        for branch, clause in zip(p.inputs, p.clauses, strict=True):
            below = Lowering(self.catalog, self.query, branch.context.root, False, self.settings)
            below.observed = self.observed
            frame = below.lower(branch).frame
            for earlier in before:
                frame = frame.where(~F.coalesce(self.condition(earlier, {}), F.lit(False)))
            out = frame if out is None else out.unionByName(frame)
            before.append(clause)
        return State(out, true=frozenset({self.root.text}) if self.root else frozenset())

    def rows(self, p: nodes.Plan) -> DataFrame:
        """The joined and filtered rows, with all columns of all tables."""
        s = self.lower(p)
        if self.root and self.root.text not in s.true:
            for clause in self._ordered(self.root):
                if clause.text not in s.true:
                    s.frame = s.frame.where(self.condition(clause, s.known))
        return s.frame

    def run(self, p: nodes.Plan) -> DataFrame:
        return project(self.rows(p), self.query, self.settings)


def project(frame: DataFrame, query: Query, settings: Settings) -> DataFrame:
    """The query's outputs; columns of one name are told apart by their tables'."""
    names = [i.alias or i.name for i in query.items]
    names = [f"{i.expr.table}_{n}" if names.count(n) > 1 and isinstance(i.expr, ColumnRef) and not i.alias else n for i, n in zip(query.items, names, strict=True)]
    values = [_result(i, settings) for i in query.items]
    if not query.aggregates:
        return frame.select(*[v.alias(n) for v, n in zip(values, names, strict=True)])
    keys = [g.lower(settings)[0] for g in query.group_by]
    totals = frame.groupBy(*keys).agg(*[v.alias(f"__i{k}") for k, v in enumerate(values)])
    return totals.select(*[F.col(f"__i{k}").alias(n) for k, n in enumerate(names)])


def _result(item: Item, settings: Settings) -> Column:
    return item.expr.lower(settings)[0]
