"""Exact checking of calculation annotations such as 3*(4+5)=27."""

from __future__ import annotations

import ast
import re
from decimal import Decimal
from fractions import Fraction

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The form of a number, and the limits.
NUMBER = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
MOST_TOKENS, MOST_DEPTH, MOST_DIGITS, MOST_RESULT_DIGITS = 63, 3, 18, 24
_TOKEN = re.compile(rf"\s*({NUMBER}|[-+*/()])")
_OPERATORS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b}


class BadCalculation(ValueError):
    """The annotation is no calculation within the limits."""


def _value(node: ast.AST, numbers: list[Fraction]) -> Fraction:
    if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
        left, right = _value(node.left, numbers), _value(node.right, numbers)
        if isinstance(node.op, ast.Div) and right == 0:
            raise BadCalculation("division by zero")
        return _OPERATORS[type(node.op)](left, right)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
        value = _value(node.operand, numbers)
        return value if isinstance(node.op, ast.UAdd) else -value
    if isinstance(node, ast.Name):
        return numbers[int(node.id[1:])]
    raise BadCalculation("unsupported form")


def evaluate(expression: str) -> tuple[str, Fraction]:
    """The expression in canonical spacing and its exact value. Numbers stand in the syntax tree as names, so none is ever a float."""
    tokens, at, expression = [], 0, expression.rstrip()
    while at < len(expression):
        found = _TOKEN.match(expression, at)
        if not found:
            raise BadCalculation("unsupported token")
        tokens.append(found[1])
        at = found.end()
    if not 0 < len(tokens) <= MOST_TOKENS:
        raise BadCalculation("number of tokens")
    numbers: list[Fraction] = []
    parts, depth = [], 0
    for token in tokens:
        depth += (token == "(") - (token == ")")
        if depth > MOST_DEPTH:
            raise BadCalculation("nesting")
        if token[0].isdigit():
            number = Decimal(token.replace(",", ""))
            if len(number.as_tuple().digits) > MOST_DIGITS:
                raise BadCalculation("digits")
            parts.append(f"n{len(numbers)}")
            numbers.append(Fraction(number))
        else:
            parts.append(token)
    try:
        tree = ast.parse(" ".join(parts), mode="eval")
    except SyntaxError as error:
        raise BadCalculation("syntax") from error
    return " ".join(tokens).replace("( ", "(").replace(" )", ")"), _value(tree.body, numbers)


def plain(value: Fraction) -> str:
    """A finite decimal in plain form."""
    rest = value.denominator
    twos = (rest & -rest).bit_length() - 1
    rest >>= twos
    fives = 0
    while rest % 5 == 0:
        rest, fives = rest // 5, fives + 1
    if rest != 1:
        raise BadCalculation("no finite decimal")
    places = max(twos, fives)
    digits = str(abs(value.numerator) * 10**places // value.denominator).rjust(places + 1, "0")
    text = f"{digits[:-places]}.{digits[-places:]}" if places else digits
    if len(digits.lstrip("0")) > MOST_RESULT_DIGITS:
        raise BadCalculation("digits")
    return "-" * (value < 0) + text


def verify(annotation: str) -> tuple[str, str]:
    """Canonical expression and result of an annotation whose result is right; BadCalculation otherwise."""
    if annotation.count("=") != 1:
        raise BadCalculation("one equals sign")
    left, right = (x.strip() for x in annotation.split("="))
    if not re.fullmatch(rf"[+-]?{NUMBER}", right):
        raise BadCalculation("result")
    expression, value = evaluate(left)
    result = plain(value)
    if Fraction(Decimal(right.replace(",", ""))) != value:
        raise BadCalculation("wrong result")
    return expression, result


@F.arrow_udf(StructType().add("expression", "string").add("result", "string").add("error", "string"))
def verified(annotations: pa.Array) -> pa.Array:
    """For each annotation its canonical expression and result, or the error. Null: error."""
    coded = annotations.dictionary_encode()  # each distinct annotation of a batch is checked once
    rows = []
    for text in coded.dictionary.to_pylist():
        try:
            rows.append((*verify(text), None))
        except BadCalculation as error:
            rows.append((None, None, str(error)))
    columns = [pa.array([r[i] for r in rows] + [None if i < 2 else "one equals sign"], pa.string()) for i in range(3)]
    found = pa.StructArray.from_arrays(columns, ["expression", "result", "error"])
    return found.take(pa.compute.fill_null(coded.indices, len(rows)))
