"""Readers that say why a line is refused, and gates that stop a build."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T

# Policies, and the fields of a registry.
POLICIES = ["eligible", "excluded", "row-filtered"]
REGISTRY = "source_id string, name string, url string, revision string, subset string, license_id string, policy string, notes string, exclusion_reason string, stages array<string>, allowed_row_licenses array<string>"


class GateError(ValueError):
    """A gate has rows against it."""


def first_reason(rules: list[tuple[str, Column]], passed: str = "accepted") -> Column:
    """The name of the first rule that holds (null counts as not), or passed."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        reason = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(reason)
    return F.coalesce(reason, F.lit(passed))


def counted(rows: DataFrame, reason: Column) -> DataFrame:
    """reason, n_rows: the account of what was accepted and refused."""
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def demand_none(rows: DataFrame, what: str) -> None:
    """Stop if the gate has found anything."""
    if not rows.isEmpty():
        raise GateError(f"{what}: {rows.limit(3).collect()}")


def word_problems(spark: SparkSession, path: str, context: int = 256) -> DataFrame:
    """JSON lines with question and answer (ending in #### number): question, answer, final, reason."""
    return parsed_problems(spark.read.text(path).where(F.trim("value") != ""), context)


def parsed_problems(lines: DataFrame, context: int = 256) -> DataFrame:
    """From lines (value) to question, answer, final, reason: accepted, or the first rule against the line."""
    row = F.from_json("value", "question string, answer string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    read = lines.select(row.alias("r")).select("r.*")
    final = F.regexp_extract("answer", r"####\s*([-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)\s*\z", 1)
    read = read.withColumn("final", F.when(final != "", F.replace(final, F.lit(","), F.lit(""))))
    rules = [
        ("invalid_json", F.col("_bad").isNotNull()),
        ("missing_field", F.coalesce(F.trim("question"), F.lit("")).eqNullSafe("") | F.coalesce(F.trim("answer"), F.lit("")).eqNullSafe("")),
        ("no_final_answer", F.col("final").isNull()),
        ("too_long", F.octet_length("question") + F.octet_length("answer") + 5 > context),
    ]
    return read.select("question", "answer", "final", first_reason(rules).alias("reason"))


def strict_lines(spark: SparkSession, path: str, schema: str, required: list[str], key: str | None = None) -> DataFrame:
    """Rows of JSON lines; the first line that is no JSON, of other types or with a missing or unknown field stops the whole read.

    Fields of schema that are not required may be null or absent. key, if given, names each row once.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    kinds = spark.createDataFrame([], schema).schema
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    unknown = F.size(F.array_except(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), F.array(*map(F.lit, kinds.names)))) > 0
    demand_none(lines.where(F.json_object_keys("value").isNull() | unknown).select("value"), "lines with unknown fields, or no objects")
    rows = lines.select(row.alias("r")).select("r.*")
    demand_none(rows.where(F.exists(F.array(*[F.col(c).isNull() for c in required]), lambda x: x)), "lines without required fields")
    if key:
        demand_none(rows.groupBy(key).count().where("count > 1"), "repeated keys")
    return rows


def evaluation_set(spark: SparkSession, path: str, tasks: list[str]) -> DataFrame:
    """Evaluation rows; stops unless every row has its fields, a known task and a family of its own."""
    schema = "task string, prompt string, expected_answer string, expected_unit string, family_id string, source_id string"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return gated_evaluation(rows, tasks)


def gated_evaluation(rows: DataFrame, tasks: list[str]) -> DataFrame:
    """The rows of an evaluation set; stops unless every row has its fields, a known task and a family of its own."""
    needed = ["task", "prompt", "expected_answer", "family_id", "source_id"]
    empty = F.exists(F.array(*needed), lambda x: F.coalesce(F.trim(x), F.lit("")) == "")
    demand_none(rows.where(empty | ~F.col("task").isin(tasks)), "incomplete or unknown rows")
    demand_none(rows.groupBy("family_id").count().where("count > 1"), "repeated families")
    return rows


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a registry file {schema_version, sources: [...]}.

    Stops at secrets, other versions, missing or unknown keys, unclear policies, licences and repeated ids.
    """
    whole = spark.read.text(path, wholetext=True)
    keys = lambda c: F.array_sort(F.json_object_keys(c))
    names = sorted(f.split()[0] for f in REGISTRY.split(", "))
    optional = F.array(F.lit("exclusion_reason"))
    sources = whole.select(F.explode(F.from_json(F.get_json_object("value", "$.sources"), "array<string>")).alias("s"))
    known = [F.lit(n) for n in names if n != "exclusion_reason"]
    demand_none(whole.where(T.has_secret(F.col("value"))).select(F.lit("secret")), "a secret in the registry")
    demand_none(whole.where(~keys("value").eqNullSafe(F.array(F.lit("schema_version"), F.lit("sources"))) | ~F.get_json_object("value", "$.schema_version").eqNullSafe("1")), "keys or version of the registry")
    demand_none(sources.where(~F.array_except(keys("s"), optional).eqNullSafe(F.array(*known))), "missing or unknown keys of a source")
    rows = spark.read.schema(f"schema_version int, sources array<struct<{REGISTRY.replace(' ', ': ').replace(',: ', ', ')}>>").option("multiLine", True).json(path)
    found = rows.select(F.explode("sources").alias("s")).select("s.*")
    rules = [
        ("policy", ~F.col("policy").isin(POLICIES)),
        ("text", F.exists(F.array("source_id", "name", "url", "revision", "license_id"), lambda x: F.coalesce(F.trim(x), F.lit("")) == "")),
        ("exclusion", (F.col("policy") == "excluded") != F.col("exclusion_reason").isNotNull()),
        ("row_licenses", (F.col("policy") == "row-filtered") != (F.coalesce(F.size("allowed_row_licenses"), F.lit(0)) > 0)),
        ("stages", F.coalesce(F.size("stages"), F.lit(0)) == 0),
    ]
    demand_none(found.withColumn("reason", first_reason(rules)).where("reason <> 'accepted'"), "sources against the rules")
    demand_none(found.groupBy("source_id").count().where("count > 1"), "repeated sources")
    return found


def snapshot_errors(snapshot: dict) -> list[str]:
    """What is wrong with the pin of a Parquet snapshot: revision (40 hexadecimal digits), path (relative, no ..), row groups (in order, none twice)."""
    errors = []
    if not re.fullmatch(r"[0-9a-f]{40}", str(snapshot.get("revision", ""))):
        errors.append("revision")
    path = str(snapshot.get("path", ""))
    if not path.endswith(".parquet") or path.startswith("/") or ".." in path.split("/"):
        errors.append("path")
    groups = snapshot.get("row_groups")
    if not isinstance(groups, list) or not groups or any(isinstance(g, bool) or not isinstance(g, int) or g < 0 for g in groups) or sorted(set(groups)) != groups:
        errors.append("row_groups")
    return errors


def licence_gate(records: DataFrame, sources: DataFrame, eligible_only: bool = False) -> DataFrame:
    """records (source_id, license_id) with reason: what the registry says of each row. eligible_only: row-filtered sources are refused."""
    known = sources.select("source_id", F.col("license_id").alias("_l"), F.col("policy").alias("_p"), F.col("allowed_row_licenses").alias("_a"))
    joined = records.join(known, "source_id", "left")
    rules = [
        ("unknown_source", F.col("_p").isNull()),
        ("excluded_source", F.col("_p") == "excluded"),
        ("not_eligible", F.lit(eligible_only) & (F.col("_p") != "eligible")),
        ("licence_mismatch", (F.col("_p") == "eligible") & ~F.col("license_id").eqNullSafe(F.col("_l"))),
        ("row_licence", (F.col("_p") == "row-filtered") & ~F.coalesce(F.array_contains("_a", F.col("license_id")), F.lit(False))),
    ]
    return joined.withColumn("reason", first_reason(rules)).drop("_l", "_p", "_a")
