"""Arithmetic formulas over columns.

Python's own parser reads the text; only the node kinds listed here are turned into column
expressions, so a formula cannot call anything.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.text import col


def _modulo(left: Column, right: Column) -> Column:
    # result takes the sign of the divisor
    return F.try_mod(F.try_mod(left, right) + right, right)


_BINARY: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)),
    ast.Mod: _modulo,
    ast.Pow: F.power,
}
_COMPARE: dict[type, Callable[[Column, Column], Column]] = {
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}


def formula(df: DataFrame, text: str) -> Column:
    """Column for ``text``: column names (back-quoted when not plain words), numbers,
    ``+ - * / // % **``, comparisons and brackets. Division by zero gives NULL."""
    quoted: dict[str, str] = {}

    def stand_in(match: re.Match) -> str:
        name = f"_quoted_{len(quoted)}"
        quoted[name] = match.group(1)
        return name

    source = re.sub(r"`([^`]+)`", stand_in, text.strip())
    try:
        tree = ast.parse(source, mode="eval").body
    except SyntaxError as error:
        raise ValueError(f"formula {text!r} cannot be read: {error.msg}") from None

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=bool() | int() | float() as value):
                return F.lit(value)
            case ast.Name(id=name):
                column = quoted.get(name, name)
                if column not in df.columns:
                    raise ValueError(f"formula {text!r}: no column {column!r}")
                return col(column)
            case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
                return _BINARY[type(op)](build(left), build(right))
            case ast.UnaryOp(op=ast.USub(), operand=operand):
                return -build(operand)
            case ast.UnaryOp(op=ast.UAdd(), operand=operand):
                return build(operand)
            case ast.Compare(left=left, ops=[op], comparators=[right]) if type(op) in _COMPARE:
                return _COMPARE[type(op)](build(left), build(right))
        raise ValueError(f"formula {text!r}: {type(node).__name__} is not allowed")

    return build(tree)
