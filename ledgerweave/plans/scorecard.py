"""From scores to a comparison of two agents, and the checks that guard it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.plans.scoring import AGENTS

# How the card names the agents and the absence of a result.
TITLES = {"naked": "Naked", "ontology": "Ontology"}
NONE = "-"
CLEAN = "all correct"


def scorecard(scores: DataFrame, scenarios: DataFrame | None = None) -> DataFrame:
    """One row per scenario: both results, the winner, the notes, the domain.

    Two answers of one agent to a scenario stop the job.
    A scenario with one agent only keeps its row, without a winner. Totals stay
    numbers next to the printed ``a/b`` texts.
    """
    columns = []
    for agent in AGENTS:
        here = F.col("agent_type") == agent
        result = F.max(F.when(here, F.struct("total_score", "max_score", "notes")))
        columns.append(result.alias(agent))
    first, second = AGENTS
    wide = scores.groupBy("scenario_id").agg(
        *columns, *[F.count_if(F.col("agent_type") == agent).alias(f"__{agent}") for agent in AGENTS]
    )
    twice = F.greatest(*[F.col(f"__{agent}") for agent in AGENTS]) > 1
    if scenarios is None:
        wide = wide.withColumn("domain", F.lit(""))
    else:
        wide = wide.join(scenarios.select("scenario_id", "domain"), "scenario_id", "left")
    both = F.col(first).isNotNull() & F.col(second).isNotNull()
    ours, theirs = F.col(first)["total_score"], F.col(second)["total_score"]
    winner = (
        F.when(twice, F.raise_error(F.concat(F.lit("two answers of one agent to "), F.col("scenario_id").cast("string"))))
        .when(~both, NONE)
        .when(ours > theirs, TITLES[first])
        .when(theirs > ours, TITLES[second])
        .otherwise("tie")
    )

    def printed(agent: str) -> Column:
        got = F.col(agent)
        return F.coalesce(F.concat_ws("/", got["total_score"], got["max_score"]), F.lit(NONE))

    def remark(agent: str) -> Column:
        notes = F.col(agent)["notes"]
        return F.when(notes != CLEAN, F.concat(F.lit(f"{TITLES[agent][0]}: "), notes))

    return wide.select(
        "scenario_id",
        F.coalesce("domain", F.lit("")).alias("domain"),
        *[
            F.when(F.col(a).isNull(), NONE).otherwise(printed(a)).alias(f"{a}_result")
            for a in AGENTS
        ],
        winner.alias("winner"),
        F.concat_ws(" | ", *[remark(a) for a in AGENTS]).alias("notes"),
        *[F.col(a)["total_score"].alias(f"{a}_total") for a in AGENTS],
        *[F.col(a)["max_score"].alias(f"{a}_max") for a in AGENTS],
    )


def scorecard_totals(card: DataFrame) -> DataFrame:
    """(agent, score, max_score, accuracy) over the scenarios both agents answered.

    The percentage is rounded half to even; without any point to win it is ``-``.
    """
    both = card.where(F.col("winner") != NONE)
    sums = both.agg(
        *[
            F.coalesce(F.sum(f"{a}_{c}"), F.lit(0)).alias(f"{a}_{c}")
            for a in AGENTS
            for c in ("total", "max")
        ]
    )

    def row(agent: str) -> Column:
        score, most = F.col(f"{agent}_total"), F.col(f"{agent}_max")
        pct = F.bround(F.lit(100.0) * score / F.nullif(most, F.lit(0)), 0).cast("long")
        return F.struct(
            F.lit(TITLES[agent]).alias("agent"),
            score.alias("score"),
            most.alias("max_score"),
            F.coalesce(F.concat(pct.cast("string"), F.lit("%")), F.lit(NONE)).alias("accuracy"),
        )

    return sums.select(F.explode(F.array(*[row(a) for a in AGENTS])).alias("r")).select("r.*")


def agent_accuracy(verdicts: DataFrame, agent: str, verdict: str) -> DataFrame:
    """Right, scored, not applicable and all verdicts per agent, and the percentage
    of right ones among the scored to one decimal (0.0 when none is scored)."""
    counts = verdicts.groupBy(agent).agg(
        F.count(F.when(F.col(verdict), True)).alias("correct"),
        F.count(verdict).alias("scored"),
        F.count("*").alias("total"),
    )
    pct = F.bround(F.lit(100.0) * F.col("correct") / F.nullif("scored", F.lit(0)), 1)
    return counts.select(
        agent,
        "correct",
        "scored",
        (F.col("total") - F.col("scored")).alias("na"),
        "total",
        F.coalesce(pct, F.lit(0.0)).alias("accuracy_pct"),
    )


# -- Integrity of ids and payloads ---------------------------------------------


def id_anomalies(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """(anomaly, n): rows without an id, ids that occur again, ids nobody knows, and
    known ids without a row. Rows are counted per id before anything is joined."""
    has_id = F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    per_id = rows.where(has_id).groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
    there = known.select(F.col(known_key).alias("id")).distinct()

    def named(anomaly: str, found: DataFrame) -> DataFrame:
        return found.agg(F.count("*").alias("n")).select(F.lit(anomaly).alias("anomaly"), "n")

    return (
        named("missing_id", rows.where(~has_id | F.col(key).isNull()))
        .unionByName(named("duplicate_id", per_id.where(F.col("n") > 1)))
        .unionByName(named("unknown_id", per_id.join(there, "id", "left_anti")))
        .unionByName(named("unanswered_id", there.join(per_id, "id", "left_anti")))
    )


FATAL = ("missing_id", "duplicate_id", "unknown_id")


def require_sound_ids(anomalies: DataFrame) -> None:
    """Missing, repeated and unknown ids stop the job; unanswered ones do not."""
    found = {r.anomaly: r.n for r in anomalies.collect()}  # four rows
    bad = {name: found[name] for name in FATAL if found.get(name)}
    if bad:
        raise ValueError("scenario ids are not sound: " + str(bad))


LANES = 4
LANE_DIGITS = 16


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of one row as compact JSON, its keys in alphabetical order; NULLs are left out,
    so a value that moves to another column moves the digest."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def fingerprint(rows: DataFrame, digest: Column | None = None) -> DataFrame:
    """(n_rows, lane_1..lane_4): one row that two equal payloads share.

    Neither the order of rows nor that of keys matters. The lanes are sums over
    slices of the row digests, all of their digits, so partial results add up and nothing is sorted;
    a row that is added, lost, doubled or changed moves them.
    """
    digest = row_digest(rows.columns) if digest is None else digest
    lanes = []
    for lane in range(LANES):
        part = F.substring("digest", 1 + lane * LANE_DIGITS, LANE_DIGITS)
        number = F.conv(part, 16, 10).cast("decimal(20,0)")
        lanes.append(F.sum(number).cast("decimal(38,0)").alias(f"lane_{lane + 1}"))
    return rows.select(digest.alias("digest")).agg(F.count("*").alias("n_rows"), *lanes)


def require_same_payload(
    expected: DataFrame, actual: DataFrame, override: bool = False
) -> str | None:
    """Compare two fingerprints. A difference stops the job, or with ``override``
    comes back as a note."""
    old, new = expected.first(), actual.first()
    if old == new:
        return None
    note = f"payload {tuple(new)} does not match {tuple(old)}"
    if not override:
        raise ValueError(note)
    return note + "; accepted on request"


def file_digests(spark, path: str) -> DataFrame:
    """(path, sha256) of whole small files, byte by byte."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))
