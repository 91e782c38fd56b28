"""Balanced schedules: each update takes as many prompts of each task and each mode, every family once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import seeded
from millrace.operators.selection import running_offset
from millrace.sources.readers import GateError
from millrace.sources.staging import settle

# The tasks and modes of an update.
TASKS, MODES = ("arithmetic", "physics_numeric"), ("direct", "think")


def prompt_schedule(problems: DataFrame, seed: str, updates: int, tasks: tuple[str, ...] = TASKS, modes: tuple[str, ...] = MODES) -> DataFrame:
    """update (from 1), slot (from 0), schedule_id, task, mode, family_id: problems (family_id, task) dealt to updates.

    The families of a task are taken in the order of their seeded hashes, as many in an update as there are modes; which
    of them has which mode turns by one from task to task and from update to update. Ranks come from prefix counts
    over ranges of the hash order, so no task holds a stratum. Slots are in the order of another hash. A
    task with too few families is an error; two rows of one family are one.
    """
    per_task = len(modes)
    pool = problems.where(F.col("task").isin(*tasks)).select("family_id", "task").distinct().withColumn("hash", seeded(seed, F.col("family_id")))
    ranked = settle(running_offset(pool, "hash", F.lit(1), ["task"]).where(F.col("offset") < updates * per_task))
    counts = {r.task: r.n for r in ranked.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each task
    if short := [t for t in tasks if counts.get(t, 0) < updates * per_task]:
        raise GateError(f"too few families of {short}")
    at = F.coalesce(*[F.when(F.col("task") == t, i) for i, t in enumerate(tasks)])
    update = F.floor(F.col("offset") / per_task).cast("int") + 1
    turn = (F.col("offset") + update + at + 1) % per_task
    mode = F.coalesce(*[F.when(turn == i, m) for i, m in enumerate(modes)])
    rows = ranked.select(update.alias("update"), "task", mode.alias("mode"), "family_id")
    order = W.partitionBy("update").orderBy(seeded(f"{seed}:slots", F.col("family_id")), "task")
    rows = rows.withColumn("slot", F.row_number().over(order) - 1)
    return rows.select("update", "slot", schedule_id(seed, F.col("update"), F.col("slot")).alias("schedule_id"), "task", "mode", "family_id")


def schedule_id(seed: str, update: Column, slot: Column) -> Column:
    return F.concat(F.lit(f"policy-{seed}:update-"), F.lpad(update.cast("string"), F.greatest(F.length(update.cast("string")), F.lit(2)), F.lit("0")), F.lit(":slot-"), slot)


def schedule_errors(schedule: DataFrame, updates: int, tasks: tuple[str, ...] = TASKS, modes: tuple[str, ...] = MODES) -> DataFrame:
    """reason, n: what is wrong with a schedule, no row if nothing is.

    size: not as many prompts as all updates take. repeated_id, repeated_family: names in several rows. update_size,
    mode_balance, task_balance: updates without their number of prompts, of each mode, of each task; an
    update beyond the last, or one that is missing, has no right size.
    """
    size = len(tasks) * len(modes)
    total = schedule.agg(F.count(F.lit(1)).alias("n")).select(F.lit("size").alias("reason"), F.abs(F.col("n") - updates * size).alias("n"))
    twice = lambda c: schedule.groupBy(c).count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
    names = {"schedule_id": "repeated_id", "family_id": "repeated_family"}
    repeated = [twice(c).select(F.lit(reason).alias("reason"), "n") for c, reason in names.items()]
    of = lambda c, values, n: ~F.forall(F.array(*[F.count_if(F.col(c) == v) for v in values]), lambda x: x == n)
    each = schedule.groupBy("update").agg(
        (F.count(F.lit(1)) != size).alias("update_size"), of("mode", modes, len(tasks)).alias("mode_balance"), of("task", tasks, len(modes)).alias("task_balance")
    )
    inside = F.col("update").between(1, updates)
    wrong = each.agg(
        (F.count_if(F.col("update_size") | ~F.coalesce(inside, F.lit(False))) + F.lit(updates) - F.count_if(inside)).alias("update_size"),
        F.count_if("mode_balance").alias("mode_balance"), F.count_if("task_balance").alias("task_balance"),
    )
    names = ["update_size", "mode_balance", "task_balance"]
    listed = wrong.select(F.explode(F.array(*[F.struct(F.lit(x).alias("reason"), F.col(x).cast("long").alias("n")) for x in names])).alias("e")).select("e.*")
    found = total.unionByName(repeated[0]).unionByName(repeated[1]).unionByName(listed)
    return found.where("n > 0")
