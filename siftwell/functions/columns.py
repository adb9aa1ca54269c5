"""Column helpers."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))
