"""Conditions on rows, written as Python expressions, compiled to Spark columns.

The text is parsed, not substituted: column names inside string literals are literals. Allowed are
and/or/not, chained comparisons, in / not in, arithmetic, unary minus, conditional expressions, the
functions below, text methods startswith, endswith, upper, lower, strip, indexing of text, COLS[i] (the
i-th column as text) and functions registered by the caller. Anything else raises ConditionError.

A null condition counts as false, for the selection and for its complement alike (the row goes to the rest).
"""

from __future__ import annotations

import ast
import fnmatch
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConditionError(ValueError):
    """The condition uses something that is not supported."""


def csv_match(x: Column, csv: str) -> Column:
    """Membership in a comma-separated list."""
    return x.isin([v.strip() for v in csv.split(",")])


def wildcard_match(x: Column, pattern: str) -> Column:
    """Shell-style wildcards, whole value."""
    body = fnmatch.translate(pattern)
    body = re.sub(r"^\(\?s:(.*)\)\\[Zz]$", r"\1", body, flags=re.S)
    return x.rlike(f"^(?s:{body})$(?!\\n)")


def regex_match(x: Column, pattern: str) -> Column:
    """Regular expression, whole value."""
    _portable(pattern)
    return x.rlike(f"^(?:{pattern})\\z")


def region_match(chrom: Column, pos: Column, region_chrom, start=None, end=None) -> Column:
    """Chromosome equal and start <= pos <= end; a missing or negative bound is open."""
    out = chrom == region_chrom
    for bound, test in ((start, lambda b: pos >= b), (end, lambda b: pos <= b)):
        if bound is not None and not (isinstance(bound, (int, float)) and bound < 0):
            out = out & test(bound)
    return out


def _portable(pattern: str) -> None:
    """Raise for constructs that Python and Java read differently."""
    re.compile(pattern)
    if re.search(r"\(\?P[<=>]|\\[AZ]|\(\?\(", pattern):
        raise ConditionError(f"not supported in a pattern: {pattern}")


FUNCTIONS: dict[str, Callable] = {
    "csv_match": csv_match,
    "wildcard_match": wildcard_match,
    "regex_match": regex_match,
    "region_match": region_match,
    "abs": lambda x: F.abs(_column(x)),
    "int": lambda x: _column(x).cast("long"),
    "float": lambda x: _column(x).cast("double"),
    "str": lambda x: _column(x).cast("string"),
    "len": lambda x: F.length(_column(x)),
    "min": lambda *x: F.least(*map(_column, x)),
    "max": lambda *x: F.greatest(*map(_column, x)),
    "round": lambda x, n=0: F.bround(_column(x), n),
}
METHODS: dict[str, Callable] = {
    "startswith": lambda x, y: x.startswith(y),
    "endswith": lambda x, y: x.endswith(y),
    "upper": F.upper,
    "lower": F.lower,
    "strip": lambda x, chars=None: F.trim(x) if chars is None else F.btrim(x, F.lit(chars)),
    "replace": lambda x, old, new: F.replace(x, F.lit(old), F.lit(new)),
    "split": lambda x, sep: F.split(x, re.escape(sep), -1),
}
#: columns and calls that give texts, for which + joins
TEXTS = {"readID", "chrom1", "chrom2", "strand1", "strand2", "pair_type", "sam1", "sam2"}
TEXT_CALLS = {"str", "upper", "lower", "strip", "replace"}
_COMPARE = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}
_ARITHMETIC = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: a.cast("double") / b,
    ast.FloorDiv: lambda a, b: F.floor(a.cast("double") / b),
    ast.Mod: lambda a, b: F.pmod(a, b),
    ast.Pow: lambda a, b: F.pow(a, b),
}


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


class _Compiler:
    def __init__(self, columns: list[str], types: Mapping[str, str], functions: Mapping[str, Callable]) -> None:
        self.columns, self.types = columns, types
        self.functions = {**FUNCTIONS, **functions}

    def fail(self, node: ast.AST, why: str) -> ConditionError:
        return ConditionError(f"{why}: {ast.unparse(node)}")

    def name(self, name: str) -> Column:
        c = F.col(f"`{name}`")
        return c.cast(self.types[name]) if name in self.types else c

    def value(self, node: ast.AST):
        """A Column, or a plain Python value where the expression is constant."""
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
            return [self.value(e) for e in node.elts]
        if isinstance(node, ast.Name):
            if node.id in self.columns:
                return self.name(node.id)
            raise self.fail(node, "no such column")
        if isinstance(node, ast.Subscript):
            return self.subscript(node)
        if isinstance(node, ast.UnaryOp):
            if isinstance(node.op, ast.Not):
                return ~self.truth(node.operand)
            inner = self.value(node.operand)
            if isinstance(node.op, ast.USub):
                return -inner
            if isinstance(node.op, ast.UAdd):
                return inner
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add) and self.is_text(node):
            return F.concat(_column(self.value(node.left)), _column(self.value(node.right)))
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            return _ARITHMETIC[type(node.op)](_column(self.value(node.left)), _column(self.value(node.right)))
        if isinstance(node, ast.BoolOp):
            parts = [self.truth(v) for v in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(node.op, ast.And) else out | p
            return out
        if isinstance(node, ast.Compare):
            return self.compare(node)
        if isinstance(node, ast.IfExp):
            return F.when(self.truth(node.test), _column(self.value(node.body))).otherwise(_column(self.value(node.orelse)))
        if isinstance(node, ast.Call):
            return self.call(node)
        raise self.fail(node, "not supported")

    def truth(self, node: ast.AST) -> Column:
        """A boolean; only comparisons, calls, boolean operators and True/False qualify."""
        if isinstance(node, ast.Constant) and isinstance(node.value, bool):
            return F.lit(node.value)
        if isinstance(node, (ast.Compare, ast.BoolOp, ast.Call)) or isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return _column(self.value(node))
        raise self.fail(node, "not a condition")

    def compare(self, node: ast.Compare) -> Column:
        out, left = None, node.left
        for op, right in zip(node.ops, node.comparators, strict=True):
            one = self.one(node, left, op, right)
            out, left = one if out is None else out & one, right
        return out

    def one(self, node: ast.AST, left: ast.AST, op: ast.cmpop, right: ast.AST) -> Column:
        a, b = self.value(left), self.value(right)
        if isinstance(op, (ast.In, ast.NotIn)):
            if isinstance(b, list):
                if any(isinstance(v, Column) for v in b):
                    found = _column(a) == b[0] if b else F.lit(False)
                    for v in b[1:]:
                        found = found | (_column(a) == v)
                else:
                    found = _column(a).isin(b)
            else:
                found = F.contains(_column(b), _column(a))
            return found if isinstance(op, ast.In) else ~found
        if type(op) not in _COMPARE:
            raise self.fail(node, "not supported")
        return getattr(_column(a), _COMPARE[type(op)])(b)

    def is_text(self, node: ast.AST) -> bool:
        if isinstance(node, ast.Constant):
            return isinstance(node.value, str)
        if isinstance(node, ast.Name):
            return self.types.get(node.id, "string") == "string" and node.id in TEXTS
        if isinstance(node, ast.BinOp):
            return isinstance(node.op, ast.Add) and (self.is_text(node.left) or self.is_text(node.right))
        if isinstance(node, ast.Call):
            return getattr(node.func, "id", getattr(node.func, "attr", None)) in TEXT_CALLS
        return isinstance(node, ast.Subscript)  # COLS, letters, slices and split parts alike

    def part(self, node: ast.Subscript) -> Column:
        """text[a:b]"""
        ends = [None if e is None else ast.literal_eval(e) for e in (node.slice.lower, node.slice.upper)]
        if node.slice.step is not None or not all(e is None or type(e) is int for e in ends):
            raise self.fail(node, "a slice has whole numbers and no step")
        text = _column(self.value(node.value))
        place = lambda e: F.lit(e) if e >= 0 else F.greatest(F.length(text) + e, F.lit(0))
        first = place(ends[0] or 0)
        last = F.length(text) if ends[1] is None else place(ends[1])
        return F.substring(text, first + 1, F.greatest(last - first, F.lit(0)))

    def subscript(self, node: ast.Subscript) -> Column:
        if isinstance(node.slice, ast.Slice):
            return self.part(node)
        if not isinstance(node.slice, (ast.Constant, ast.UnaryOp)) or not isinstance(i := ast.literal_eval(node.slice), int):
            raise self.fail(node, "index must be a number")
        if isinstance(node.value, ast.Name) and node.value.id == "COLS":
            try:
                return F.col(f"`{self.columns[i]}`").cast("string")
            except IndexError:
                raise self.fail(node, "no such column") from None
        if isinstance(node.value, ast.Call) and getattr(node.value.func, "attr", None) == "split":
            return F.try_element_at(self.value(node.value), F.lit(i + 1 if i >= 0 else i))
        return F.substring(_column(self.value(node.value)), i + 1 if i >= 0 else i, 1)

    def call(self, node: ast.Call):
        if node.keywords and not (isinstance(node.func, ast.Name) and node.func.id == "region_match"):
            raise self.fail(node, "named arguments are not supported")
        args = [self.value(a) for a in node.args]
        named = {k.arg: self.value(k.value) for k in node.keywords}
        if isinstance(node.func, ast.Name) and node.func.id in self.functions:
            return self.functions[node.func.id](*args, **named)
        if isinstance(node.func, ast.Attribute) and node.func.attr in METHODS:
            return METHODS[node.func.attr](_column(self.value(node.func.value)), *args)
        raise self.fail(node, "no such function")


def compile_condition(condition: str, columns: list[str], types: Mapping[str, str] | None = None, functions: Mapping[str, Callable] | None = None, total: bool = True) -> Column:
    """The condition as a boolean column; never null if ``total``. A filter needs no such guard, which would keep it from the scan."""
    try:
        tree = ast.parse(condition.strip(), mode="eval").body
    except SyntaxError as error:
        raise ConditionError(f"cannot be read: {condition}") from error
    test = _Compiler(list(columns), types or {}, functions or {}).truth(tree)
    return F.coalesce(test, F.lit(False)) if total else test


def compile_value(expression: str, columns: list[str], types: Mapping[str, str] | None = None, functions: Mapping[str, Callable] | None = None) -> Column:
    """An expression such as ``readID[:-2] + '_x'`` as a column."""
    try:
        tree = ast.parse(expression.strip(), mode="eval").body
    except SyntaxError as error:
        raise ConditionError(f"cannot be read: {expression}") from error
    return _column(_Compiler(list(columns), types or {}, functions or {}).value(tree))


def select(df: DataFrame, condition: str, types: Mapping[str, str] | None = None, functions: Mapping[str, Callable] | None = None) -> DataFrame:
    return df.where(compile_condition(condition, df.columns, types, functions, total=False))


def split_by(df: DataFrame, condition: str, types: Mapping[str, str] | None = None, functions: Mapping[str, Callable] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that meet the condition, all others)."""
    test = compile_condition(condition, df.columns, types, functions)
    return select(df, condition, types, functions), df.where(~test)
