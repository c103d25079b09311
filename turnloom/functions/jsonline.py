"""Strict reading of one JSON value per line into VARIANT.

A lenient reader would accept ``{...}]``, two values on one line, or a number where text is
expected; the log rules reject such lines, so the helpers below check the JSON type of every
field they hand out. Everything is SQL text: the decoders are long, and one parsed text costs the
driver far less than thousands of column calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

_END = "~end of line~"

_OPTIONS = (
    "map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false', "
    "'maxStringLen', '2147483647', 'maxNestingDepth', '10000')"
)


def compute_once(df: DataFrame, *steps: dict[str, str], keep: str = "*") -> DataFrame:
    """Add columns through a one-row generator.

    A plain projection would be copied into every filter pushed below it, which parses a line once
    per predicate. A generated column is an attribute, so it is evaluated exactly once. Each step is
    evaluated once too and sees the previous one as ``_``; the last step names the new columns. One
    generator for many steps also means one row copy instead of one per step.
    """

    def struct(fields: dict[str, str]) -> str:
        return "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in fields.items()) + ")"

    rows = f"array({struct(steps[0])})"
    for fields in steps[1:]:
        rows = f"transform({rows}, _ -> {struct(fields)})"
    return df.selectExpr(keep, f"inline({rows})")


def strict_steps(line: str) -> list[dict[str, str]]:
    """Steps that read the line's only JSON value as ``_.doc``, NULL when the line is anything else.

    The value is read as the first of two array elements; leftovers on the line would displace the
    second one.
    """
    pair = f"""from_json(concat('[', make_valid_utf8({line}), ',"{_END}"]'), 'array<variant>', {_OPTIONS})"""
    value = f"if(try_variant_get(get(_.pair, 1), '$', 'string') = '{_END}', get(_.pair, 0), null)"
    return [{"pair": pair}, {"doc": value}]


def fields_of(value: str, *names: str) -> str:
    """Struct of the named members as VARIANT; NULL when the value is not an object."""
    ddl = ", ".join(f"{n}: variant" for n in names)
    return f"try_variant_get({value}, '$', 'struct<{ddl}>')"


def absent(value: str) -> str:
    return f"({value} is null or is_variant_null({value}))"


def json_type(value: str) -> str:
    return f"schema_of_variant({value})"


def of_type(value: str, *types: str) -> str:
    """The field is missing, or has one of the JSON types."""
    names = ", ".join(f"'{t}'" for t in types)
    return f"({value} is null or {json_type(value)} in ({names}))"


def is_text_or_absent(value: str) -> str:
    return of_type(value, "STRING", "VOID")


def text_of(value: str) -> str:
    """Text of a field already known to be text; missing and null read as ''."""
    return f"coalesce(try_variant_get({value}, '$', 'string'), '')"


def text_if_string(value: str) -> str:
    """Text when the field is a JSON string, else NULL."""
    return f"if({json_type(value)} = 'STRING', try_variant_get({value}, '$', 'string'), null)"
