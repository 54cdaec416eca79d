"""Health rules over time: windowed rates, held gauges, and rules that fire after a hold time.

Time is a grid of evaluations. Events are counted per step of the grid before anything else, so
windows run over steps and not over events, and a series has as many rows as the grid has steps
for each of its labels. ``minute`` is what a minute of a rule means in the data's own time.

    pending    the condition holds since this evaluation
    firing     it has held for the rule's hold time
    resolved   it holds no longer, after it fired
    dropped    it holds no longer, and never fired
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rule, severity, minutes that its condition must hold.
RULES = [
    ("TelemetryNotProduced", "critical", 1),
    ("DLQRateHigh", "warning", 2),
    ("StreamStalled", "critical", 2),
    ("StreamLagHigh", "warning", 2),
    ("ExpenseFileLate", "warning", 1),
    ("BatchRunFailed", "critical", 1),
    ("BatchNotRunRecently", "warning", 2),
    ("SpeedBatchDriftHigh", "warning", 2),
    ("IdleVehiclesHigh", "warning", 2),
]
# Thresholds, and windows in minutes.
DLQ_RATE, LEAST_RATE, LAG, DRIFT, IDLE = 0.02, 0.001, 5000, 0.05, 8
PRODUCED_MIN, DLQ_MIN, STALLED_MIN, RUN_MIN = 1, 5, 2, 45


@dataclass(frozen=True)
class Grid:
    """Evaluations every ``step`` minutes of the data's time, the first at ``start``."""

    spark: SparkSession
    start: str
    end: str
    step: int = 15
    minute: int = 60

    @property
    def last(self) -> Column:
        return F.expr(f"timestampdiff(MINUTE, timestamp_ntz'{self.start}', timestamp_ntz'{self.end}') div {self.step}")

    def steps(self, minutes: float) -> int:
        """Steps of so many minutes of a rule."""
        return round(minutes * self.minute / self.step)

    def at(self, n: Column) -> Column:
        return F.timestamp_add("MINUTE", (n * self.step).cast("int"), F.expr(f"timestamp_ntz'{self.start}'"))

    def of(self, time: Column) -> Column:
        """The first evaluation that sees this time."""
        us = F.timestamp_diff("MICROSECOND", F.expr(f"timestamp_ntz'{self.start}'"), time)
        return F.greatest(F.ceil(us / F.lit(self.step * 60_000_000)), F.lit(0)).cast("long")

    def dense(self, labels: DataFrame | None = None) -> DataFrame:
        """(label, n) for every label (of a table of them, or the empty one)."""
        labels = self.spark.range(1).select(F.lit("").alias("label")) if labels is None else labels.select("label").distinct()
        return labels.select("label", F.explode(F.sequence(F.lit(0).cast("long"), self.last)).alias("n"))


def _time() -> Window:
    return Window.partitionBy("label").orderBy("n")


def counted(grid: Grid, events: DataFrame, time: str, label: Column | None = None) -> DataFrame:
    """(label, n, value): events per step, with every step of every label."""
    own = events.where(F.col(time).isNotNull()).select((F.lit("") if label is None else label).alias("label"), grid.of(F.col(time)).alias("n"))
    per = own.groupBy("label", "n").agg(F.count("*").alias("value"))
    return grid.dense(None if label is None else per).join(per, ["label", "n"], "left").fillna(0, ["value"])


def increase(counts: DataFrame, steps: int) -> DataFrame:
    """What came in the last ``steps`` steps."""
    return counts.withColumn("value", F.sum("value").over(_time().rowsBetween(1 - steps, 0)))


def held(grid: Grid, samples: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """A gauge: the newest of its samples (label, at, value) at each evaluation, null before any."""
    per = samples.groupBy("label", grid.of(F.col("at")).alias("n")).agg(F.max_by("value", "at").alias("value"))
    dense = grid.dense(labels).join(per, ["label", "n"], "left")
    return dense.withColumn("value", F.last("value", ignorenulls=True).over(_time().rowsBetween(Window.unboundedPreceding, 0)))


def backlog(arrivals: DataFrame, most: int) -> DataFrame:
    """Rows that a stream of bounded triggers has not read, a trigger a step, ``most`` rows each.

    With the prefix sums A of what came, what lies unread is A(n) - most * n less the least
    value that this difference ever had; ``read`` is what the step's trigger takes.
    """
    upto = _time().rowsBetween(Window.unboundedPreceding, 0)
    # The trigger of a step sees what came by it; before the first, nothing had come.
    over = F.sum("value").over(upto) - (F.col("n") + 1) * most
    a = arrivals.withColumn("over", over)
    a = a.withColumn("behind", F.col("over") - F.least(F.min("over").over(upto), F.lit(0)))
    return a.withColumn("read", F.col("value") + F.lag("behind", 1, 0).over(_time()) - F.col("behind")).drop("over")


def conditions(grid: Grid, produced: DataFrame, rejected: DataFrame, arrivals: DataFrame, late: DataFrame, failed: DataFrame, success: DataFrame, drift: DataFrame, idle: DataFrame, most: int = 20_000, lag: int = LAG) -> DataFrame:
    """(rule, label, n, value, holds) of the nine rules at every evaluation.

    ``produced`` and ``rejected`` are events with ``at``; ``arrivals`` are rows of the stream's
    source with ``at`` and ``label``, its partition. The others are samples (label, at, value)
    of gauges: late and failed are flags of the last run, success the step of the last good
    run (made here), drift a ratio and idle the change in the number of open alerts.
    A gauge without a sample doesn't hold, but a batch that has never run well does.
    """
    made = counted(grid, produced, "at")
    bad = counted(grid, rejected, "at")
    seconds = DLQ_MIN * 60
    share = increase(bad, grid.steps(DLQ_MIN)).withColumnRenamed("value", "bad").join(increase(made, grid.steps(DLQ_MIN)), ["label", "n"])
    share = share.withColumn("value", (F.col("bad") / seconds) / F.greatest(F.col("value") / seconds, F.lit(LEAST_RATE)))
    came = counted(grid, arrivals, "at", F.col("label"))
    queue = backlog(came, most)
    recent = increase(made, grid.steps(STALLED_MIN)).select("n", (F.col("value") > 0).alias("coming"))
    upto = _time().rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("read") > 0, F.col("n")), ignorenulls=True).over(upto)
    work = F.sum("read").over(_time().rowsBetween(1 - grid.steps(STALLED_MIN), 0))
    stall = queue.withColumn("value", (F.col("n") - F.coalesce(seen, F.lit(0))).cast("double")).withColumn("work", work).join(recent, "n")
    good = held(grid, success.withColumn("value", grid.of(F.col("at")).cast("double")))
    open_ = counted(grid, idle.where("value > 0"), "at").withColumnRenamed("value", "up").join(counted(grid, idle.where("value < 0"), "at"), ["label", "n"])
    open_ = open_.withColumn("value", F.sum(F.col("up") - F.col("value")).over(upto))
    since = F.col("n") - F.col("value")
    parts = [
        ("TelemetryNotProduced", increase(made, grid.steps(PRODUCED_MIN)), F.col("value"), F.col("value") == 0),
        ("DLQRateHigh", share, F.col("value"), F.col("value") > DLQ_RATE),
        ("StreamStalled", stall, F.col("value"), (F.col("value") > grid.steps(STALLED_MIN)) | ((F.col("work") == 0) & F.col("coming"))),
        ("StreamLagHigh", queue.withColumn("value", F.col("behind")), F.col("value"), F.col("value") > lag),
        ("ExpenseFileLate", held(grid, late), F.col("value"), F.col("value") > 0),
        ("BatchRunFailed", held(grid, failed), F.col("value"), F.col("value") > 0),
        ("BatchNotRunRecently", good, since, F.coalesce(since > grid.steps(RUN_MIN), F.lit(True))),
        ("SpeedBatchDriftHigh", held(grid, drift), F.col("value"), F.abs("value") > DRIFT),
        ("IdleVehiclesHigh", open_, F.col("value"), F.col("value") > IDLE),
    ]
    rows = [df.select(F.lit(rule).alias("rule"), "label", "n", value.cast("double").alias("value"), F.coalesce(when, F.lit(False)).alias("holds")) for rule, df, value, when in parts]
    return reduce(DataFrame.unionByName, rows)


def states(grid: Grid, found: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """``found`` with severity, ``at`` and the state at each evaluation: inactive, pending or firing."""
    table = F.broadcast(found.sparkSession.createDataFrame([(r, s, grid.steps(m)) for r, s, m in rules], "rule string, severity string, hold int"))
    w = Window.partitionBy("rule", "label").orderBy("n")
    begins = F.col("holds") & ~F.coalesce(F.lag("holds").over(w), F.lit(False))
    e = found.join(table, "rule").withColumn("begin", F.when(begins, F.col("n")))
    e = e.withColumn("since", F.last("begin", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    state = F.when(~F.col("holds"), "inactive").when(F.col("n") - F.col("since") >= F.col("hold"), "firing").otherwise("pending")
    return e.select("rule", "severity", "label", "n", grid.at(F.col("n")).alias("at"), "value", state.alias("state"))


def transitions(found: DataFrame) -> DataFrame:
    """Rows of ``states`` at which a rule changes, under the names above."""
    w = Window.partitionBy("rule", "label").orderBy("n")
    e = found.withColumn("before", F.coalesce(F.lag("state").over(w), F.lit("inactive"))).where("state != before")
    name = F.when(F.col("state") != "inactive", F.col("state")).when(F.col("before") == "firing", "resolved").otherwise("dropped")
    return e.select("rule", "severity", "label", "at", name.alias("change"), "value")


def now(found: DataFrame) -> DataFrame:
    """(rule, severity, firing, value) at the last evaluation: a rule fires if any label does."""
    last = F.max_by(F.struct("state", "value"), "n").alias("s")
    per = found.groupBy("rule", "severity", "label").agg(last)
    return per.groupBy("rule", "severity").agg(F.max(F.col("s.state") == "firing").alias("firing"), F.round(F.max("s.value"), 6).alias("value"))
