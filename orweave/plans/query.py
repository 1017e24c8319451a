"""Queries, and the parser that makes them from SQL text.

The class: ``SELECT exprs FROM t [AS a], ... [WHERE and/or tree] [GROUP BY exprs]``. Joins are
equalities of columns in the WHERE clause. Anything else raises ``UnsupportedQuery``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

from orweave.errors import QueryError, UnsupportedQuery
from orweave.functions import registry
from orweave.functions.expressions import Between, Binary, Call, Cast, Column, Expr, In, IsNull, Like, Literal, Negate, Not
from orweave.functions.intervals import parse_datetime
from orweave.plans import predicates as P


@dataclass(frozen=True)
class Item:
    """One output of a query: an expression with the name it gets."""

    expr: Expr
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Query:
    """tables: alias -> table name, in FROM order."""

    items: tuple[Item, ...]
    tables: Mapping[str, str]
    filter: P.Node | None = None
    group_by: tuple[Expr, ...] = ()

    @property
    def aggregates(self) -> bool:
        return bool(self.group_by) or any(i.expr.has_aggregate() for i in self.items)

    def __str__(self):
        text = "SELECT " + ", ".join(str(i.expr) for i in self.items)
        text += " FROM " + ", ".join(t if a == t else f"{t} AS {a}" for a, t in self.tables.items())
        if self.filter is not None:
            text += f" WHERE {self.filter}"
        if self.group_by:
            text += " GROUP BY " + ", ".join(map(str, self.group_by))
        return text


TOKEN = re.compile(
    r"""\s*(?:--[^\n]*\n\s*)*(?:(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)
    |(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*")|(?P<word>[A-Za-z_][A-Za-z0-9_$]*)
    |(?P<sign><>|!=|<=|>=|\|\||[-+*/%(),.;<>=]))""",
    re.X,
)
ENDS = {"order", "limit", "having", "union", "intersect", "except", "offset", "window", "fetch", "qualify"}
JOINS = {"join", "inner", "left", "right", "full", "cross", "natural", "outer", "on", "using", "lateral"}
RESERVED = ENDS | JOINS | {"select", "from", "where", "group", "by", "and", "or", "not", "as", "in", "like", "between", "is", "null", "case", "distinct", "exists"}


def tokens(sql: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while sql[at:].strip():
        m = TOKEN.match(sql, at)
        if not m:
            raise QueryError(f"can't read {sql[at:].strip()[:30]!r}")
        kind, text = m.lastgroup, m[m.lastgroup]
        out.append((kind, text[1:-1].replace("''", "'") if kind == "string" else text[1:-1].replace('""', '"') if kind == "quoted" else text))
        at = m.end()
    return out


@dataclass
class Parser:
    """Parses and binds against schemas: table name -> StructType."""

    schemas: Mapping[str, T.StructType]
    _tokens: list[tuple[str, str]] = field(default_factory=list, repr=False)
    _at: int = 0
    _tables: dict[str, str] = field(default_factory=dict, repr=False)

    def parse(self, sql: str) -> Query:
        self._tokens, self._at, self._tables = tokens(sql), 0, {}
        if not self._take("select"):
            raise UnsupportedQuery("only SELECT")
        if self._peek("distinct"):
            raise UnsupportedQuery("DISTINCT")
        start = self._at
        self._skip_to_from()
        self._from()
        resume, self._at = self._at, start
        items = self._items()
        self._at = resume
        root = self._boolean() if self._take("where") else None
        group: list[Expr] = []
        if self._take("group"):
            self._need("by")
            group = [self._scalar()]
            while self._take(","):
                group.append(self._scalar())
        self._take(";")
        if self._at < len(self._tokens):
            raise UnsupportedQuery(f"{self._tokens[self._at][1].upper()} isn't supported here")
        query = Query(tuple(items), dict(self._tables), P.normalize(root), tuple(group))
        self._check(query)
        return query

    def _check(self, q: Query) -> None:
        if q.filter is not None and any(n.expr.has_aggregate() for n in q.filter.atoms()):
            raise QueryError("an aggregate in WHERE")
        if q.aggregates:
            grouped = {str(g) for g in q.group_by}

            def bare(e: Expr) -> bool:
                if str(e) in grouped or isinstance(e, Call) and e.name in registry.AGGREGATES:
                    return False
                return isinstance(e, Column) or any(map(bare, e.children()))

            if wrong := next((i for i in q.items if bare(i.expr)), None):
                raise QueryError(f"{wrong.expr} stands beside an aggregate and isn't grouped")

    # Tokens ------------------------------------------------------------------------------------

    def _peek(self, *texts: str, ahead: int = 0) -> bool:
        at = self._at + ahead
        return at < len(self._tokens) and self._tokens[at][0] in ("word", "sign") and self._tokens[at][1].lower() in texts

    def _take(self, *texts: str) -> bool:
        found = self._peek(*texts)
        self._at += found
        return found

    def _need(self, text: str) -> None:
        if not self._take(text):
            got = self._tokens[self._at][1] if self._at < len(self._tokens) else "the end"
            raise QueryError(f"{text.upper()} expected, found {got!r}")

    def _next(self) -> tuple[str, str]:
        if self._at >= len(self._tokens):
            raise QueryError("the query ends too early")
        self._at += 1
        return self._tokens[self._at - 1]

    def _name(self) -> str:
        kind, text = self._next()
        if kind == "quoted" or kind == "word" and text.lower() not in RESERVED:
            return text
        raise QueryError(f"a name expected, found {text!r}")

    # FROM and SELECT ---------------------------------------------------------------------------

    def _skip_to_from(self) -> None:
        depth = 0
        while self._at < len(self._tokens):
            if depth == 0 and self._peek("from"):
                self._at += 1
                return
            depth += self._peek("(") - self._peek(")")
            self._at += 1
        raise UnsupportedQuery("a query without FROM")

    def _from(self) -> None:
        while True:
            if self._peek("("):
                raise UnsupportedQuery("a sub-query in FROM")
            table = self._name()
            if table not in self.schemas:
                raise QueryError(f"no table {table}")
            alias = table
            if self._take("as"):
                alias = self._name()
            elif self._at < len(self._tokens) and (self._tokens[self._at][0] == "quoted" or self._tokens[self._at][0] == "word" and self._tokens[self._at][1].lower() not in RESERVED):
                alias = self._name()
            if alias in self._tables:
                raise QueryError(f"two tables are called {alias}")
            self._tables[alias] = table
            if self._peek(*JOINS):
                raise UnsupportedQuery("explicit JOIN; join in WHERE")
            if not self._take(","):
                return

    def _columns(self, alias: str) -> list[Column]:
        return [Column(alias, f.name, f.dataType) for f in self.schemas[self._tables[alias]].fields]

    def _items(self) -> list[Item]:
        out: list[Item] = []
        while True:
            if self._take("*"):
                out += [Item(c, c.name) for a in self._tables for c in self._columns(a)]
            elif self._peek(".", ahead=1) and self._peek("*", ahead=2):
                alias = self._name()
                self._at += 2
                if alias not in self._tables:
                    raise QueryError(f"no table {alias}")
                out += [Item(c, c.name) for c in self._columns(alias)]
            else:
                node = self._boolean()
                if not node.is_atom:
                    raise UnsupportedQuery("AND and OR in SELECT")
                alias = self._name() if self._take("as") or self._at < len(self._tokens) and not self._peek(",", "from") else None
                out.append(Item(node.expr, alias or (node.expr.name if isinstance(node.expr, Column) else str(node.expr)), alias))
            if not self._take(","):
                break
        self._need("from")
        return out

    # Predicates --------------------------------------------------------------------------------

    def _boolean(self, negate: bool = False) -> P.Node:
        """An OR; negate moves a NOT inwards by De Morgan."""
        parts = [self._conjunction(negate)]
        while self._take("or"):
            parts.append(self._conjunction(negate))
        return parts[0] if len(parts) == 1 else (P.all_of if negate else P.any_of)(parts)

    def _conjunction(self, negate: bool) -> P.Node:
        parts = [self._negation(negate)]
        while self._take("and"):
            parts.append(self._negation(negate))
        return parts[0] if len(parts) == 1 else (P.any_of if negate else P.all_of)(parts)

    def _negation(self, negate: bool) -> P.Node:
        if self._take("not"):
            return self._negation(not negate)
        if self._peek("exists", "case"):
            raise UnsupportedQuery(self._tokens[self._at][1].upper())
        if self._peek("("):
            # A parenthesis may hold a predicate or the first operand of one.
            start = self._at
            self._at += 1
            try:
                inner = self._boolean(negate)
                if self._take(")") and not self._peek("+", "-", "*", "/", "%", "||", "<", "<=", ">", ">=", "=", "!=", "<>", "between", "in", "like", "is", "not"):
                    return inner
            except QueryError as error:
                if isinstance(error, UnsupportedQuery):
                    raise
            self._at = start
        e = self._comparison()
        if negate:
            e = Literal(not e.value) if isinstance(e, Literal) and isinstance(e.value, bool) else Not(e)
        return P.atom(e)

    def _comparison(self) -> Expr:
        left = self._scalar()
        if self._take("is"):
            negated = self._take("not")
            self._need("null")
            return IsNull(left, negated)
        negated = self._peek("not") and self._peek("between", "in", "like", ahead=1) and self._take("not")
        if self._take("between"):
            low = self._scalar()
            self._need("and")
            found = Between(left, low, self._scalar())
            return Not(found) if negated else found
        if self._take("in"):
            self._need("(")
            if self._peek("select"):
                raise UnsupportedQuery("a sub-query")
            values = [self._scalar()]
            while self._take(","):
                values.append(self._scalar())
            self._need(")")
            if not all(isinstance(v, Literal) for v in values):
                raise UnsupportedQuery("IN takes constants")
            return In(left, tuple(values), negated)
        if self._take("like"):
            kind, text = self._next()
            if kind != "string":
                raise UnsupportedQuery("LIKE takes a constant pattern")
            return Like(left, text, negated)
        for sign in ("<=", ">=", "<>", "!=", "<", ">", "="):
            if self._take(sign):
                return Binary.of("!=" if sign == "<>" else sign, left, self._scalar())
        return left

    # Scalars -----------------------------------------------------------------------------------

    def _scalar(self) -> Expr:
        left = self._term()
        while self._peek("+", "-", "||"):
            op = self._next()[1]
            left = Binary("+" if op == "||" else op, left, self._term())
        return left

    def _term(self) -> Expr:
        left = self._factor()
        while self._peek("*", "/", "%"):
            left = Binary(self._next()[1], left, self._factor())
        return left

    def _factor(self) -> Expr:
        if self._take("-"):
            return Negate.of(self._factor())
        if self._take("+"):
            return self._factor()
        if self._take("("):
            if self._peek("select"):
                raise UnsupportedQuery("a sub-query")
            inner = self._scalar()
            self._need(")")
            return inner
        kind, text = self._next()
        if kind == "number":
            return Literal(int(text) if text.isdigit() else float(text))
        if kind == "string":
            return Literal(text)
        low = text.lower() if kind == "word" else None
        if low in ("true", "false"):
            return Literal(low == "true")
        if low in ("timestamp", "date", "interval") and self._at < len(self._tokens) and self._tokens[self._at][0] == "string":
            value = self._next()[1]
            if low == "interval":
                unit = self._name() if self._at < len(self._tokens) and self._tokens[self._at][0] == "word" and not self._peek(*RESERVED) else ""
                return Literal(f"{value} {unit}".strip().lower())
            return Cast(Literal(str(parse_datetime(value))), "timestamp")
        if low == "case":
            raise UnsupportedQuery("CASE")
        if low == "cast" and self._take("("):
            inner = self._scalar()
            self._need("as")
            to = self._name().lower()
            self._need(")")
            return Cast(inner, to)
        if kind == "word" and self._take("("):
            return self._call(low)
        if low in RESERVED or kind == "sign":
            raise QueryError(f"unexpected {text!r}")
        if self._take("."):
            return self._resolve(self._next()[1], text)
        return self._resolve(text, None)

    def _call(self, name: str) -> Expr:
        if self._take("*"):
            self._need(")")
            if name != "count":
                raise QueryError(f"{name}(*)")
            return Call(name, (), True)
        if self._peek("distinct"):
            raise UnsupportedQuery("DISTINCT")
        args = []
        if not self._take(")"):
            args.append(self._comparison())
            while self._take(","):
                args.append(self._comparison())
            self._need(")")
        if self._peek("over"):
            raise UnsupportedQuery("window functions")
        return Call(name, tuple(args))

    def _resolve(self, name: str, qualifier: str | None) -> Expr:
        if qualifier is not None and qualifier not in self._tables:
            # A table's name serves beside its alias while it names one table.
            named = [a for a, t in self._tables.items() if t == qualifier]
            if len(named) != 1:
                raise QueryError(f"no table {qualifier}")
            qualifier = named[0]
        found = [c for a in ([qualifier] if qualifier else self._tables) for c in self._columns(a) if c.name == name]
        if not found:
            raise QueryError(f"no column {name}")
        if len(found) > 1:
            raise QueryError(f"{name} is ambiguous: {', '.join(map(str, found))}")
        return found[0]
