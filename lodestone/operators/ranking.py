"""Tournaments, dependency graphs and rule-based risk scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranks import placed
from lodestone.sources.shared import written


def rounds_for(n: int) -> int:
    """Rounds of a tournament of n players."""
    return next((r for most, r in ((4, 4), (8, 5), (16, 6)) if n <= most), 7)


def paired(free: DataFrame, met: DataFrame, tries: int = 3) -> DataFrame:
    """(a, b): pairs of players (id, score) that are next to each other in score order and haven't met (a, b).

    The first, third ... are paired with the one after them; who has met that
    one stays for the next try, where the leftovers are ranked anew and the
    second, fourth ... go first, and so on. Who is left after ``tries`` sits out.
    """
    pairs = None
    for k in range(tries):
        pos = placed(free, [F.desc("score"), F.asc("id")])
        side_by_side = pos.groupBy(F.floor((F.col("pos") + (k + 1) % 2) / 2).alias("k")).agg(F.min_by("id", "pos").alias("a"), F.max_by("id", "pos").alias("b"), F.count("*").alias("n"))
        found = side_by_side.where("n = 2").select("a", "b")
        both = met.select("a", "b").unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
        found = written(found.join(both, ["a", "b"], "left_anti"))
        pairs = found if pairs is None else pairs.unionByName(found)
        free = written(free.join(found.select(F.explode(F.array("a", "b")).alias("id")), "id", "left_anti"))
        if len(free.take(2)) < 2:
            break
    return pairs


def tournament(players: DataFrame, judge: Callable[[DataFrame], DataFrame], id_col: str = "id", rounds: int | None = None) -> DataFrame:
    """(id, score, rank) after a Swiss tournament of any size; nobody meets anyone twice.

    ``judge`` turns pairs (round, a, b) into (round, a, b, winner): a win is one
    point, a tie or another winner half a point each. Players without an id
    don't take part. Ranking, pairing and judging are Spark jobs; every round is
    a table, so lost executors cost no more than the round.
    """
    standing = written(players.select(F.col(id_col).cast("string").alias("id")).where("id is not null").distinct().withColumn("score", F.lit(0.0)))
    met = standing.select(F.col("id").alias("a"), F.col("id").alias("b")).where(F.lit(False))
    for r in range(rounds if rounds is not None else rounds_for(standing.count())):
        judged = written(judge(paired(standing, met).select(F.lit(r).alias("round"), "a", "b")))
        if judged.isEmpty():
            break
        met = written(met.unionByName(judged.select("a", "b")))
        won = points(judged).withColumnRenamed("score", "won")
        standing = written(standing.join(won, "id", "left").select("id", (F.col("score") + F.coalesce("won", F.lit(0.0))).alias("score")))
    return placed(standing, [F.desc("score"), F.asc("id")], "rank")


def points(results: DataFrame) -> DataFrame:
    """(id, score) of results (a, b, winner): 1 for a win, 0.5 each for a tie or an invalid result."""
    side = lambda me, other: F.when(F.col("winner") == F.col(me), 1.0).when(F.col("winner") == F.col(other), 0.0).otherwise(0.5)
    both = results.select(F.explode(F.array(F.struct(F.col("a").alias("id"), side("a", "b").alias("p")), F.struct(F.col("b").alias("id"), side("b", "a").alias("p")))).alias("x"))
    return both.groupBy("x.id").agg(F.sum("x.p").alias("score"))


def ranked(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Ranks by score, the highest first, ties by id; of each group of ``by``, or of all rows by ranges."""
    if not by:
        return placed(scores, [F.desc("score"), F.asc("id")], "rank")
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id")))


def levels(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level) of tasks (id) with edges (task, needs): 0 without dependencies, else one more than the deepest; unknown dependencies don't count.

    Each round drops the tasks whose dependencies are all done, and is a table
    of its own; a cycle raises ValueError.
    """
    known = tasks.select("id").distinct()
    open_edges = edges.join(known.select(F.col("id").alias("task")), "task").join(known.select(F.col("id").alias("needs")), "needs").select("task", "needs").distinct()
    waiting, done, level = known, None, 0
    while True:
        ready = waiting.join(open_edges.select(F.col("task").alias("id")), "id", "left_anti").select("id", F.lit(level).alias("level"))
        ready = written(ready)
        if ready.isEmpty():
            if not waiting.isEmpty():
                raise ValueError("the dependencies hold a cycle")
            return done if done is not None else ready
        done = ready if done is None else done.unionByName(ready)
        waiting = written(waiting.join(ready.select("id"), "id", "left_anti"))
        open_edges = written(open_edges.join(ready.select(F.col("id").alias("needs")), "needs", "left_anti"))
        level += 1


def ready_tasks(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending tasks whose dependencies are all completed."""
    incomplete = edges.join(tasks.where("status != 'completed'").select(F.col("id").alias("needs")), "needs").select(F.col("task").alias("id"))
    return tasks.where("status = 'pending'").join(incomplete, "id", "left_anti")


def risk_score(base: Column, age: Column, heart_rate: Column, temperature: Column, creatinine: Column, lactate: Column) -> Column:
    """Base risk plus age, vital signs and laboratory values, cut to 10 ... 95 and to a whole number."""
    extra = lambda c, limit, points: F.when(c > limit, points).otherwise(0)
    raised = base + extra(heart_rate, 100, 10) + extra(temperature, 38, 15) + extra(creatinine, 1.5, 20) + extra(lactate, 2.0, 15)
    return F.least(F.greatest(raised + (age - 50) / 30 * 20, F.lit(10)), F.lit(95)).cast("int")


def risk_level(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")
