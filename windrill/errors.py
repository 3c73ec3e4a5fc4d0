"""Errors of the query language."""


class QuerySyntaxError(ValueError):
    """The text isn't a query; says where."""

    def __init__(self, message: str, line: int, column: int):
        super().__init__(f"{line}:{column}: {message}")
        self.line, self.column = line, column


class AnalysisError(ValueError):
    """The query doesn't fit its table: an unknown name, a type that doesn't match, a missing order."""
