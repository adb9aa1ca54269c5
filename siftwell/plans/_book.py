"""A book of queries with their SQL, and small inline tables that both sides build from the same rows."""

from collections.abc import Callable


class Book:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def put(f: Callable) -> Callable:
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return put


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return f"CAST({x} AS DOUBLE)"
    if isinstance(x, int):
        return str(x)
    if isinstance(x, list):
        return f"[{', '.join(map(literal, x))}]"
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in str(x).split("\n"))


class Inline:
    """A table of a few rows: df(spark) for Spark, sql for DuckDB."""

    def __init__(self, schema: str, rows: list[tuple]) -> None:
        self.schema, self.rows = schema, rows
        self.columns = [c.split(" ")[0] for c in schema.split(", ")]

    def df(self, spark):
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(f'"{c}"' for c in self.columns)}))"
