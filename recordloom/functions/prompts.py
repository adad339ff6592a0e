"""Prompt and training-text rendering."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.columns import as_column

# The three layouts must be reproduced to the character.
INSTRUCT_MARK = "instruct"
INSTRUCT_PROMPT = (
    "\n            [INST]"
    "\n            Populate a JSON in the JSON_SCHEMA format from the provided TEXT_DATA."
    "\n            ---"
    "\n            JSON_SCHEMA: {schema}"
    "\n            ---"
    "\n            TEXT_DATA: {input}"
    "\n            [\\INST]"
    "\n        "
)
PLAIN_PROMPT = (
    "\n            Populate a JSON in the JSON_SCHEMA format from the provided TEXT_DATA."
    "\n            ---"
    "\n            JSON_SCHEMA: {schema}"
    "\n            ---"
    "\n            TEXT_DATA: {input}"
    "\n            ---"
    "\n            OUTPUT:"
    "\n        "
)
TRAINING_TEXT = "\n            {prompt}\n            {output}\n            "


def _fill(layout: str, **values: Column) -> Column:
    """Concatenate the literal parts of a layout with the columns named in braces."""
    parts = re.split(r"\{(\w+)\}", layout)
    pieces = [F.lit(p) if i % 2 == 0 else values[p] for i, p in enumerate(parts)]
    return F.concat(*pieces)


def render_prompt(schema: Column | str, text: Column | str, model_name: Column | str = "") -> Column:
    """Prompt for one row; the layout depends on whether the model name marks an instruct model.

    `model_name` may be a plain string, which picks the layout while planning, or a column.
    """
    schema = F.coalesce(as_column(schema), F.lit(""))
    text = F.coalesce(as_column(text), F.lit(""))
    instruct = _fill(INSTRUCT_PROMPT, schema=schema, input=text)
    plain = _fill(PLAIN_PROMPT, schema=schema, input=text)
    if isinstance(model_name, str):
        return instruct if INSTRUCT_MARK in model_name.lower() else plain
    return F.when(F.contains(F.lower(model_name), F.lit(INSTRUCT_MARK)), instruct).otherwise(plain)


def render_training_text(prompt: Column | str, output: Column | str) -> Column:
    return _fill(TRAINING_TEXT, prompt=as_column(prompt), output=as_column(output))


def field_text(path: Column | str, value: Column | str) -> Column:
    """A field as ``key: value``."""
    return F.concat(as_column(path), F.lit(": "), as_column(value))
