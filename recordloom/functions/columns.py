"""Small column helpers shared by the function modules.

Longer expressions over arrays and records are written as SQL text: one call builds the
whole expression, where the same expression made of Python column operations would need
hundreds of round trips to the JVM before the query even starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def over(body: Callable[..., str], **values: Column | str) -> Column:
    """Expression given as SQL text over columns.

    `body` gets the SQL names of the columns in `values` and returns the text. Each column
    is evaluated once, however often the text names it.
    """
    bound = F.struct(*[as_column(value).alias(name) for name, value in values.items()])
    text = body(**{name: f"arg.{name}" for name in values})
    nothing = F.array().cast("array<int>")
    return F.call_function("aggregate", nothing, bound, F.expr("(held, _) -> held"), F.expr(f"arg -> {text}"))


def let(value: str, name: str, body: str) -> str:
    """SQL text that binds `value` to `name` inside `body`.

    Inside a lambda an expression that is written twice is evaluated twice, so every
    expensive intermediate result goes through here. A fold over nothing binds it: `transform` would
    copy the result of the body, with all that is nested in it, at every binding.
    """
    return f"aggregate(CAST(array() AS array<int>), {value}, (held, _) -> held, {name} -> {body})"


def literal(value: str) -> str:
    """Quote `value` as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
