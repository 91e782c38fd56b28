"""How far the words of sources lie apart, language by language.

A group is a source within a language. Its smoothed share of a term is a whole number of billionths, and
two groups differ in a term by f(p, q) = (p - q)**2 div (p + q). The sum over all V kept terms of a
language is not taken term by term:

1. Each pair of groups starts at V times f of the two shares of a term that occurs in neither.
2. The postings of each term then emit corrections, and only those that are not zero. That a group
   holds the term, against a group without it, depends on its count alone, so these are first
   counted by (group, count). That two groups hold the term is emitted from the term's posting list.
3. The terms that a group uses more than its language are ranked in a window, the best ten kept.

Everything is built of DataFrame functions, in whole numbers (decimals of 38 digits where a product
might pass 64 bits), so results do not depend on the order of rows or partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.scratch import Written, small, write

#: Terms are kept if so many documents of the language have them.
LEAST_DOCS = 10
#: Added to each count.
PRIOR = 2
#: Terms that a group is reported with.
TOP = 10

# What stands between terms, and the letters that are lowered.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_GROUP = ["lang", "source"]


def lowered(text: Column) -> Column:
    """text with A to Z as small letters and nothing else changed."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), d (documents): a row for each term of a group, and one with a null term for groups without any.

    A document's distinct terms follow its terms in one array, so both counts come from one pass, combined on the
    map side: a hot source or term reaches the shuffle once for each task.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), F.array_remove(F.split(lowered(blank(text)), BETWEEN), "").alias("terms"))
    rows = rows.select(*_GROUP, F.size("terms").alias("size"), F.posexplode_outer(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    once = lambda which: F.sum(F.when(which, 1).otherwise(0)).cast("long")
    return rows.groupBy(*_GROUP, "term").agg(once(F.col("at") < F.col("size")).alias("n"), once(F.col("at") >= F.col("size")).alias("d"))


def _share(n: Column | str, total: str, kept: str) -> Column:
    """One more than the billionths of a term of count n, where the counts of kept terms sum up to total."""
    n = n.cast("decimal(20,0)") if isinstance(n, Column) else F.col(n).cast("decimal(20,0)")
    part = (n + F.lit(PRIOR).cast("decimal(20,0)")) * F.lit(1_000_000_000).cast("decimal(10,0)")
    whole = F.col(total).cast("decimal(20,0)") + F.col(kept).cast("decimal(20,0)") * F.lit(PRIOR).cast("decimal(2,0)")
    return F.call_function("div", part, whole) + 1


def distance(p: Column, q: Column) -> Column:
    """f of two shares, which are at most 10**9 + 1, so nothing here passes 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class _Tables:
    """postings: lang, term, groups (source, n). groups: lang, source, total, kept, zero. Both written."""

    def __init__(self, counts: DataFrame, least_docs: int):
        counts = write(counts, "term_counts").df
        kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("groups"))
        # A group has one row for each term, so a list is as long as the language has sources.
        self.postings: Written = write(kept.where(F.col("d") >= least_docs).select("lang", "term", "n", F.array_sort("groups").alias("groups")), "postings")
        self.terms = small(write(self.postings.df.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("total")), "languages"))
        self.used: Written = write(self.postings.df.select("lang", "term", F.explode("groups").alias("g")).select("lang", "term", "g.*"), "used")
        sums = self.used.df.groupBy(*_GROUP).agg(F.sum("n").alias("total"))
        every = counts.select(*_GROUP).distinct().join(sums, _GROUP, "left").join(self.terms.select("lang", "kept"), "lang", "left")
        every = every.select(*_GROUP, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))
        zero = F.when(F.col("kept") > 0, _share(F.lit(0), "total", "kept")).otherwise(0)
        self.groups: Written = write(every.withColumn("zero", zero), "groups")


def _pairs(tables: _Tables) -> DataFrame:
    """lang, a, b, value for each two groups of a language, a before b."""
    groups = tables.groups.df
    other = small(Written(groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"), F.col("total").alias("other_total")), "", tables.groups.bytes))
    # Each pair starts with all terms in neither group; zero shares of no terms give nothing.
    start = groups.where("kept > 0").join(other, "lang").where("source < other")
    start = start.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), (F.col("kept") * distance(F.col("zero"), F.col("other_zero"))).alias("value"))
    none = groups.where("kept = 0").join(other, "lang").where("source < other").select("lang", F.col("source").alias("a"), F.col("other").alias("b"), F.lit(0).cast("long").alias("value"))
    # A term that one group holds so often, against every group, as if that had it not.
    often = tables.used.df.groupBy(*_GROUP, "n").agg(F.count(F.lit(1)).alias("terms"))
    sizes = small(Written(groups, "", tables.groups.bytes))
    lone = often.join(sizes, _GROUP).withColumn("p", _share("n", "total", "kept")).join(other, "lang").where("source <> other")
    change = distance(F.col("p"), F.col("other_zero")) - distance(F.col("zero"), F.col("other_zero"))
    lone = lone.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (F.col("terms") * change).alias("value")).where("value <> 0")
    # A term that both groups hold: what its list says beyond the two rows before.
    shares = tables.used.df.join(sizes, _GROUP).select("lang", "term", "source", _share("n", "total", "kept").alias("p"), "zero")
    lists = shares.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "zero"))).alias("list"))
    first = lists.select("lang", "list", F.posexplode("list").alias("at", "x"))
    both = first.select("lang", "x", F.explode(F.slice("list", F.col("at") + 2, F.size("list"))).alias("y"))
    p, q, p0, q0 = F.col("x.p"), F.col("y.p"), F.col("x.zero"), F.col("y.zero")
    change = distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0)
    both = both.select("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), change.alias("value")).where("value <> 0")
    parts = start.unionByName(none).unionByName(lone).unionByName(both)
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _terms(tables: _Tables) -> DataFrame:
    """lang, source, item, value: the terms that a group uses more than its language."""
    n = tables.postings.df.select("lang", "term", F.col("n").alias("all_n"), F.explode("groups").alias("g")).select("lang", "term", "all_n", "g.*")
    sizes = small(Written(tables.groups.df.select(*_GROUP, "total", "kept"), "", tables.groups.bytes))
    rows = n.join(sizes, _GROUP).join(tables.terms.select("lang", F.col("total").alias("all_total")), "lang")
    rows = rows.select("lang", "source", F.col("term").alias("item"), _share("n", "total", "kept").alias("p"), _share("all_n", "all_total", "kept").alias("q"))
    return rows.where("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of each group, ranks from 1, by value (descending) and item.

    part pair: item is each other source of the language. part term: item is a term, only the best top.
    Null text, lang and source count as empty. Equal rows count as often as they occur. A group whose
    texts have no terms, and a language that keeps none, have pairs (of value 0 if V is 0). Other columns,
    whatever their names, are not read. An empty table gives an empty frame. A language's pairs are as
    many as the square of its sources, and so is the work for a term that all of them hold.
    """
    tables = _Tables(counted(docs, text, lang, source), least_docs)
    pairs = write(_pairs(tables), "pairs").df
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")
    order = W.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select(*_GROUP, F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(_terms(tables), "term").where(F.col("rank") <= top))
