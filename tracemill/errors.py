"""What can go wrong with a query, by the step at which it does."""


class QueryError(Exception):
    """Any error of the query language."""


class LexError(QueryError):
    """A character or string that is no token."""


class ParseError(QueryError):
    """Tokens that are no statement."""


class BindError(QueryError):
    """A name, function or use that the tables at hand don't allow."""
