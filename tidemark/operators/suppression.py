"""The live suppression rule: a score by solar elevation, quiet gap and burst position, and a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import solar
from tidemark.functions.binding import let
from tidemark.operators import sequence

#: The lower edges of the bands, the most that a burst position counts, the shipped threshold.
ELEVATION_EDGES = (0.0, 5.0, 10.0, 20.0, 30.0, 40.0, 50.0)
GAP_EDGES = (15.0, 60.0, 300.0, 1800.0, 7200.0)
BURST_MOST = 3
N_GAP, N_BURST = len(GAP_EDGES) + 1, BURST_MOST + 1
THRESHOLD = 40
ALWAYS = 255
#: The shipped scores, by elevation band, gap band and burst position (8 x 6 x 4).
SCORES = (
    13, 7, 17, 17, 89, 83, 103, 103, 106, 96, 109, 109, 26, 23, 30, 30, 53, 50, 56, 56, 86, 76, 93, 93,
    66, 66, 73, 73, 242, 242, 252, 252, 212, 212, 229, 229, 129, 129, 136, 136, 172, 172, 176, 176, 219, 219, 232, 232,
    99, 99, 113, 113, 238, 238, 245, 245, 209, 209, 222, 222, 152, 152, 156, 156, 225, 225, 235, 235, 248, 248, 255, 255,
    60, 60, 63, 63, 195, 195, 199, 199, 179, 179, 185, 185, 132, 132, 139, 139, 182, 182, 189, 189, 202, 202, 205, 205,
    43, 43, 43, 43, 159, 159, 159, 159, 169, 169, 169, 169, 119, 119, 119, 119, 162, 162, 162, 162, 166, 166, 166, 166,
    33, 33, 33, 33, 126, 126, 126, 126, 142, 142, 142, 142, 149, 149, 149, 149, 192, 192, 192, 192, 215, 215, 215, 215,
    3, 3, 3, 3, 36, 36, 36, 36, 40, 40, 40, 40, 70, 70, 70, 70, 123, 123, 123, 123, 146, 146, 146, 146,
    0, 0, 0, 0, 10, 10, 10, 10, 20, 20, 20, 20, 46, 46, 46, 46, 79, 79, 79, 79, 116, 116, 116, 116,
)


def band(value: Column, edges: tuple[float, ...]) -> Column:
    """How many of the ascending edges the value reaches."""
    return let(value, lambda v: sum(((v >= e).cast("int") for e in edges[1:]), (v >= edges[0]).cast("int")))


def cell(elevation: Column, gap: Column, burst: Column) -> Column:
    return (band(elevation, ELEVATION_EDGES) * N_GAP + band(gap, GAP_EDGES)) * N_BURST + F.least(burst, F.lit(BURST_MOST))


def score_table(spark: SparkSession, scores: tuple[int, ...] = SCORES) -> DataFrame:
    """(cell, score); 192 rows, so joins on it broadcast."""
    return spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "cell int, score int")


def score_of(cell_index: Column, scores: tuple[int, ...] = SCORES) -> Column:
    """The score of a cell out of a constant array; ALWAYS outside of the table."""
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, scores)), cell_index + 1), F.lit(ALWAYS))


def decide(events: DataFrame, threshold: int = THRESHOLD, within: float = 60.0) -> DataFrame:
    """The decision for each event (id, device, us, captured_at, source), in order: no clock and timer events always go
    through with score 255; motion events are suppressed below the threshold. Only motion events advance bursts."""
    motion = sequence.with_burst_position(events.where("source = 'pir' AND us > 0"), within)
    other = events.where("NOT (source <=> 'pir') OR us <= 0 OR us IS NULL").withColumn("quiet_gap", F.lit(-1.0)).withColumn("burst_pos", F.lit(0))
    elevation = solar.elevation(F.col("captured_at"))
    scored = motion.withColumn("elevation", elevation).withColumn("cell", cell(F.col("elevation"), F.col("quiet_gap"), F.col("burst_pos")))
    scored = scored.withColumn("score", score_of(F.col("cell"))).withColumn("why", F.when(F.col("score") < threshold, "SCORE").otherwise("PROCEED"))
    clock = F.col("us") > 0
    passed = other.withColumn("elevation", F.when(clock, elevation)).withColumn("cell", F.lit(None).cast("int")).withColumn("score", F.lit(ALWAYS))
    passed = passed.withColumn("why", F.when(clock, "RTC").otherwise("NO_TIME"))
    return scored.unionByName(passed).withColumn("suppress", F.col("why") == "SCORE")
