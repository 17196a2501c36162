"""A small condition language, translated to Column expressions.

Comparisons (chained too), ``in`` lists, and/or/not, ``& | ~``, arithmetic,
unary minus, ``abs`` and ``sqrt`` over columns and literals; nothing else is let
through.  NULL counts as false.
"""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORBIDDEN = ("__", "import", "exec", "eval", "os.", "sys.", "open(", "lambda", ".pipe", ".apply", ".to_")


class UnsafeConditionError(ValueError):
    """The text holds something that no condition needs."""


_ARITHMETIC = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b), ast.Mod: lambda a, b: F.try_mod(a, b)}
_BITS = {ast.BitAnd: lambda a, b: a & b, ast.BitOr: lambda a, b: a | b}
_COMPARE = {
    ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b,
}


def check_text(text: str) -> None:
    found = [t for t in FORBIDDEN if t in text.lower()]
    if found:
        raise UnsafeConditionError(f"not allowed in a condition: {found}")


def condition(text: str, columns) -> Column:
    """``text`` as a boolean column that is never NULL; ValueError if it isn't a condition over ``columns``."""
    check_text(text)
    known = set(columns)

    def of(node: ast.AST) -> Column:
        match node:
            case ast.BoolOp(op=op, values=values):
                return reduce(lambda a, b: a & b if isinstance(op, ast.And) else a | b, map(truth, values))
            case ast.UnaryOp(op=ast.Not() | ast.Invert(), operand=x):
                return ~truth(x)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -of(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BITS:
                return _BITS[type(op)](truth(a), truth(b))
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _ARITHMETIC:
                return _ARITHMETIC[type(op)](of(a), of(b))
            case ast.Compare(left=first, ops=ops, comparators=rest):
                sides = [first, *rest]
                return reduce(lambda a, b: a & b, [compare(a, op, b) for a, op, b in zip(sides, ops, rest)])
            case ast.Call(func=ast.Name(id="abs" | "sqrt" as f), args=[x], keywords=[]):
                return F.abs(of(x)) if f == "abs" else F.sqrt(of(x))
            case ast.Name(id=name):
                if name not in known:
                    raise ValueError(f"unknown column {name!r}")
                return F.col(name)
            case ast.Constant(value=value) if isinstance(value, (bool, int, float, str)):
                return F.lit(value)
        raise ValueError(f"not a condition: {ast.dump(node)[:80]}")

    def compare(a: ast.AST, op: ast.cmpop, b: ast.AST) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)) and isinstance(b, (ast.List, ast.Tuple)):
            # any element may be a column or an expression; an empty list holds nothing
            inside = reduce(lambda x, y: x | y, [F.coalesce(of(a) == of(c), F.lit(False)) for c in b.elts], F.lit(False))
            return inside if isinstance(op, ast.In) else ~inside
        if type(op) not in _COMPARE:
            raise ValueError(f"not a comparison: {ast.dump(op)}")
        return _COMPARE[type(op)](of(a), of(b))

    def truth(node: ast.AST) -> Column:
        return F.coalesce(of(node), F.lit(False))

    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as e:
        raise ValueError(f"not a condition: {text!r}") from e
    return truth(tree.body)


def matching(rows: DataFrame, text: str) -> DataFrame:
    return rows.filter(condition(text, rows.columns))
