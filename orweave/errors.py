"""What the engine raises."""


class QueryError(Exception):
    """A query that can't be parsed or bound."""


class UnsupportedQuery(QueryError):
    """A query outside the supported class: select-project-join-aggregate with an AND/OR filter."""
