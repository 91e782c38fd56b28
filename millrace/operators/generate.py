"""Arithmetic problems from counters: each row's numbers follow from its own counter, so any partition makes the same rows.

A route is a kind of problem with a quota. Candidates are numbered from 0; the first ones whose family is new and
not frozen fill the quota. Frozen families are taken out by anti-joins, round by round, until each route has
its quota, so nothing of the frozen table is collected and no candidate is drawn in vain twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import plain_decimal, seeded, stable_id
from millrace.sources.readers import GateError
from millrace.sources.staging import settle

#: Kinds of problems.
ROUTES = ("integer", "decimal", "nested")
#: Rounds before a route is given up.
ROUNDS = 20


def family(expression: Column) -> Column:
    """The family of an expression."""
    return stable_id("arith", F.to_json(F.struct(expression.alias("expression"))), 20)


def _applied(a: Column, sign: Column, b: Column) -> Column:
    """Exact for the operands made here: sums, differences, products, and quotients of multiples."""
    return F.when(sign == "+", a + b).when(sign == "-", a - b).when(sign == "*", a * b).otherwise(F.try_divide(a, b)).cast("decimal(30,6)")


def example(route: Column, counter: Column, seed: str) -> Column:
    """The problem of a route and counter: struct<left, operator, right, outer_operator, outer_right, expression, answer, worked>.

    integer: two whole numbers, one of four operators, quotients that are whole. decimal: numbers of up to two digits
    behind the point, and + - *. nested: (a op b) op c of whole numbers. Numbers come from the seeded hash
    of route:counter, eight hexadecimal digits each.
    """
    digest = seeded(seed, F.concat_ws(":", route, counter))
    draw = lambda i, n: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") % n
    sign = lambda i, n: F.element_at(F.array(*map(F.lit, "+-*/"[:n])), (draw(i, n) + 1).cast("int"))
    whole = route != "decimal"
    operator = F.when(route == "integer", sign(0, 4)).otherwise(sign(0, 3))
    quotient = (route == "integer") & (operator == "/")
    b = F.when(quotient, draw(2, 99) + 1).otherwise(draw(2, 1000))
    a = F.when(quotient, (draw(1, 99) + 1) * b).otherwise(draw(1, 1000))
    number = lambda x: F.when(whole, x.cast("decimal(12,2)")).otherwise((x.cast("decimal(12,2)") / 100).cast("decimal(12,2)"))
    nested = route == "nested"
    outer, c = F.when(nested, sign(3, 3)), F.when(nested, draw(4, 100).cast("decimal(12,2)"))
    return F.struct(number(a).alias("a"), operator.alias("operator"), number(b).alias("b"), outer.alias("outer_operator"), c.alias("c"))


def _told(e: str) -> list[Column]:
    """Text and answers of an example."""
    a, b, c = (plain_decimal(F.col(f"{e}.{x}")) for x in "abc")
    sign, outer = F.col(f"{e}.operator"), F.col(f"{e}.outer_operator")
    inner = _applied(F.col(f"{e}.a"), sign, F.col(f"{e}.b"))
    text = F.concat_ws(" ", a, sign, b)
    result = F.when(outer.isNull(), inner).otherwise(_applied(inner, outer, F.col(f"{e}.c")))
    first, last = plain_decimal(inner), plain_decimal(result)
    expression = F.when(outer.isNull(), text).otherwise(F.concat(F.lit("("), text, F.lit(") "), outer, F.lit(" "), c))
    steps = F.concat(text, F.lit(" = "), first, F.lit("."))
    worked = F.when(outer.isNull(), steps).otherwise(F.concat(steps, F.lit(" "), F.concat_ws(" ", first, outer, c), F.lit(" = "), last, F.lit(".")))
    return [expression.alias("expression"), last.alias("answer"), worked.alias("worked")]


def problems(quotas: DataFrame, frozen: DataFrame, seed: str) -> DataFrame:
    """route, counter, expression, answer, worked, family_id: for each route of quotas (route, quota) so many problems.

    They are the first by counter whose family no earlier candidate of any route before it has and which is not in frozen
    (family_id). A family that two routes draw belongs to the route whose name comes first. Routes that
    do not fill after all rounds are an error.
    """
    spark = quotas.sparkSession
    if unknown := [r[0] for r in quotas.select("route").distinct().limit(10).collect() if r[0] not in ROUTES]:
        raise GateError(f"unknown routes {unknown}")
    quotas = quotas.groupBy("route").agg(F.max("quota").alias("quota"))  # no more rows than there are routes
    known = frozen.select("family_id").distinct()
    largest = quotas.agg(F.max("quota")).first()[0] or 0
    pool, start, size = None, 0, max(64, 2 * largest)
    for _ in range(ROUNDS):
        drawn = spark.range(start, start + size).select(F.col("id").alias("counter")).join(F.broadcast(quotas.where("quota > 0").select("route")))
        made = drawn.select("route", "counter", example(F.col("route"), F.col("counter"), seed).alias("e")).select("route", "counter", *_told("e"))
        made = made.withColumn("family_id", family(F.col("expression"))).join(known, "family_id", "left_anti")
        pool = made if pool is None else pool.unionByName(made)
        # Of a family's candidates the first stays.
        first = F.min_by(F.struct("route", "counter", "expression", "answer", "worked"), F.struct("route", "counter"))
        pool = settle(pool.groupBy("family_id").agg(first.alias("r")).select("r.*", "family_id"))
        counts = pool.groupBy("route").agg(F.count(F.lit(1)).alias("n"))
        if quotas.join(counts, "route", "left").where("quota > coalesce(n, 0)").isEmpty():
            return _first(pool, quotas)
        start, size = start + size, 2 * size
    raise GateError("routes without enough new families")


def _first(pool: DataFrame, quotas: DataFrame) -> DataFrame:
    """The first by counter of each route, by ranks from prefix counts."""
    from millrace.operators.selection import running_offset

    ranks = running_offset(pool.select("route", "counter"), "counter", F.lit(1), ["route"])
    chosen = ranks.join(F.broadcast(quotas), "route").where("offset < quota").select("route", "counter")
    return pool.join(chosen, ["route", "counter"], "left_semi").select("route", "counter", "expression", "answer", "worked", "family_id")
