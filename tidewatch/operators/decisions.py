"""Rules that turn a flag into a class, and the dealing of agents to classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("detector", "specialist", "benign_only")


def agent_assignment(n_agents: int, classes: list[str], benign: str = "BENIGN", other: str = "Other") -> list[tuple[int, str, int]]:
    """(agent, name, focus): agents take the named attack classes in turn; a class taken again gets a numbered name.

    focus is the class's place in ``classes``; where no class is named, all agents take place 1.
    """
    pool = [i for i, c in enumerate(classes) if c not in (benign, other)] or [1]
    out = []
    for agent in range(n_agents):
        turn, at = divmod(agent, len(pool))
        name = f"agent_{classes[pool[at]] if pool[at] < len(classes) else other}"
        out.append((agent, name if turn == 0 else f"{name}_{turn + 1}", pool[at]))
    return out


def assigned_agents(classes: DataFrame, n_agents: int, benign: str = "BENIGN", other: str = "Other") -> DataFrame:
    """(agent, name, focus) as of agent_assignment, for a table of classes (class, idx), as class_vocabulary gives it; any number of agents.

    Rows without a class or idx are no classes; without a named attack class all agents take place 1.
    """
    named = classes.where(F.col("class").isNotNull() & F.col("idx").isNotNull())
    pool = named.where(~F.col("class").isin(benign, other)).agg(F.sort_array(F.collect_list(F.struct("idx", "class"))).alias("pool"))  # a row for each class
    first = named.where("idx = 1").agg(F.min("class").alias("class"))
    none = F.array(F.struct(F.lit(1).cast(classes.schema["idx"].dataType).alias("idx"), F.coalesce("class", F.lit(other)).alias("class")))
    team = pool.crossJoin(first).select(F.when(F.size("pool") > 0, F.col("pool")).otherwise(none).alias("pool"))  # one row and one row
    each = classes.sparkSession.range(n_agents).withColumnRenamed("id", "agent").crossJoin(F.broadcast(team))
    each = each.withColumn("turn", F.expr("agent div size(pool)")).withColumn("own", F.get("pool", F.expr("cast(agent % size(pool) as int)")))
    again = F.when(F.col("turn") > 0, F.concat(F.lit("_"), (F.col("turn") + 1).cast("string"))).otherwise("")
    return each.select("agent", F.concat(F.lit("agent_"), F.col("own.class"), again).alias("name"), F.col("own.idx").alias("focus"))


def decision_rules(scored: DataFrame, prior: DataFrame, agents: list[tuple[int, str, int]], flag: str = "flag", cls: str = "cls") -> DataFrame:
    """scored's rows for each agent, with agent and one column for each rule.

    A flagged row is, by ``detector``, the most frequent attack class of prior (the smallest on ties, 0 without
    attacks), by ``specialist`` the agent's focus; ``benign_only`` and rows without a flag are 0. The agents are
    few and given, so rows are multiplied where they lie; a null flag is no flag.
    """
    mode = prior.where(F.col(cls) > 0).groupBy(cls).count().orderBy(F.desc("count"), cls).first()
    team = F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(focus).alias("focus")) for a, _, focus in agents])
    flagged = F.coalesce(F.col(flag) > 0, F.lit(False))
    each = scored.withColumn("_a", F.explode(team))
    picks = {"detector": F.lit(int(mode[0]) if mode else 0), "specialist": F.col("_a.focus"), "benign_only": F.lit(0)}
    return each.withColumns({"agent": F.col("_a.agent")} | {k: F.when(flagged, x).otherwise(0) for k, x in picks.items()}).drop("_a")
