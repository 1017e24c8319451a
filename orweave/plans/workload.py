"""Generated queries of the planner experiments: a hub joined with satellites, under a filter in DNF or CNF."""

from __future__ import annotations

from dataclasses import dataclass


def table_name(rows: float, number: int) -> str:
    """Number 0 may serve as the hub, the others as its satellites."""
    return f"star{int(rows)}_{number}"


@dataclass(frozen=True)
class Star:
    """A star of ``tables`` tables of ``rows`` rows whose filter has ``clauses`` clauses.

    A clause holds one range of this selectivity for each of the first ``clause_size`` satellites, over a column of
    its own; the first ``redundant`` clauses after the first share the first satellite's column with it. ``outer`` adds
    a range over the hub: to every clause of a DNF, as a clause of its own to a CNF.
    """

    selectivity: float = 0.2
    rows: float = 1e4
    tables: int = 3
    clause_size: int = 2
    clauses: int = 2
    redundant: int = 0
    outer: float | None = None
    cnf: bool = False

    def ranges(self) -> list[list[str]]:
        """The ranges of each clause."""
        hub = table_name(self.rows, 0)
        column = lambda clause, satellite: 0 if satellite == 1 and clause <= self.redundant else clause
        found = [[f"{table_name(self.rows, s)}.even{column(c, s)} < {self.selectivity}" for s in range(1, self.clause_size + 1)] for c in range(self.clauses)]
        if self.outer is None:
            return found
        extra = f"{hub}.even0 < {self.outer}"
        return [*found, [extra]] if self.cnf else [[*c, extra] for c in found]

    def sql(self) -> str:
        hub, *satellites = (table_name(self.rows, i) for i in range(self.tables))
        within, between = (" or ", " and ") if self.cnf else (" and ", " or ")
        where = between.join(f"({within.join(c)})" for c in self.ranges())
        joins = [f"{hub}.id = {s}.skew0" for s in satellites]
        return f"select {', '.join(f'min({t}.id) as low_{t}' for t in (hub, *satellites))} from {', '.join((hub, *satellites))} where {' and '.join([*joins, f'({where})'])}"
