"""Scores of a detector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

THRESHOLDS = (0.25, 0.4, 0.5, 0.6, 0.7, 0.8)


def _thresholds(df: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Each row once per threshold that its confidence reaches (six rows at most, made in place)."""
    reached = F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("conf"))
    return df.withColumn("threshold", F.explode(reached))


def _list(df: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))


def detection_metrics(matched: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1, accuracy of an exclusive match; 0 where a denominator is 0."""
    counts = _thresholds(matched, thresholds).groupBy("threshold").agg(F.count_if("correct").alias("tp"), F.count_if(~F.col("correct")).alias("fp"))
    total = truth.agg(F.count("*").alias("n"))
    rows = _list(matched, thresholds).join(counts, "threshold", "left").join(F.broadcast(total)).na.fill(0, ["tp", "fp"])
    rows = rows.withColumn("fn", F.col("n") - F.col("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rows = rows.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return rows.select("threshold", "tp", "fp", "fn", "precision", "recall", ratio(2 * p * r, p + r).alias("f1"), ratio(tp, tp + fp + fn).alias("accuracy"))


def roc_auc(scores: DataFrame, score: str = "conf", positive: str = "correct") -> DataFrame:
    """One row: auc (ties count half; null if a class is empty). Scores are grouped first, so only distinct scores are ordered,
    range by range."""
    s = scores.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    # a running sum in two steps: inside value ranges, and over the few ranges
    s = s.withColumn("r", F.floor(F.log2(F.abs(F.col("s").cast("double")) + 1) * 64) * F.signum(F.col("s").cast("double")))
    below_range = s.groupBy("r").agg(F.sum("n").alias("rn"))
    below_range = below_range.select("r", (F.sum("rn").over(W.orderBy("r")) - F.col("rn")).alias("before"))
    inside = F.sum("n").over(W.partitionBy("r").orderBy("s")) - F.col("n")
    s = s.withColumn("inside", inside).join(below_range, "r")
    wins = F.sum(F.col("p") * (F.col("before") + F.col("inside") + F.col("n") / 2))
    return s.agg(F.try_divide(wins, F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def metrics_per_photo(photos: DataFrame, truth: DataFrame, matched: DataFrame, conf: float = 0.5) -> DataFrame:
    """site_id, photo, truth, found, false: every photo, also those without boxes."""
    keys = ["site_id", "photo"]
    t = truth.groupBy(*keys).agg(F.count("*").alias("truth"))
    m = matched.filter(F.col("conf") >= conf).groupBy(*keys).agg(F.count_if("correct").alias("found"), F.count_if(~F.col("correct")).alias("false"))
    return photos.select(*keys).join(t, keys, "left").join(m, keys, "left").na.fill(0, ["truth", "found", "false"])


def confidence_sweep(matched: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """threshold, found, clear_found, false_alarms, total, clear_total of a loose match; an appearance found twice counts once.

    `truth` has difficulty; a truth box is clear if that is 'clear'."""
    clear = truth.select("site_id", "photo", "truth_id", (F.col("difficulty") == "clear").alias("clear"))
    # per appearance only its strongest detection matters
    best = matched.filter("truth_id is not null").groupBy("site_id", "photo", "truth_id").agg(F.max("conf").alias("conf")).join(clear, ["site_id", "photo", "truth_id"])
    f = _thresholds(best, thresholds).groupBy("threshold").agg(F.count("*").alias("found"), F.count_if("clear").alias("clear_found"))
    a = _thresholds(matched.filter("false_alarm"), thresholds).groupBy("threshold").agg(F.count("*").alias("false_alarms"))
    total = clear.agg(F.count("*").alias("total"), F.count_if("clear").alias("clear_total"))
    out = _list(matched, thresholds).join(f, "threshold", "left").join(a, "threshold", "left").join(F.broadcast(total))
    return out.na.fill(0, ["found", "clear_found", "false_alarms"])


def recall_per_object(matched: DataFrame, truth: DataFrame, conf: float = 0.8) -> DataFrame:
    """object_id (null: all), found, total, clear_found, clear_total, objects_found: one pass by grouping sets."""
    hit = matched.filter(F.col("conf") >= conf).filter("truth_id is not null").select("site_id", "photo", "truth_id").distinct().withColumn("hit", F.lit(1))
    rows = truth.join(hit, ["site_id", "photo", "truth_id"], "left").withColumn("clear", (F.col("difficulty") == "clear").cast("int"))
    return rows.rollup("object_id").agg(
        F.count("hit").alias("found"),
        F.count("*").alias("total"),
        F.sum(F.col("clear") * F.coalesce("hit", F.lit(0))).alias("clear_found"),
        F.sum("clear").alias("clear_total"),
        F.count_distinct(F.when(F.col("hit") == 1, F.col("object_id"))).alias("objects_found"),
    )


def false_alarm_summary(matched: DataFrame, conf: float = 0.8) -> DataFrame:
    rows = matched.filter(F.col("conf") >= conf).filter("false_alarm")
    return rows.agg(F.count("*").alias("false_alarms"), F.count_distinct("site_id", "photo").alias("photos"))


def top_false_alarms(matched: DataFrame, k: int = 15) -> DataFrame:
    """The strongest false alarms, boxes in whole pixels."""
    rows = matched.filter("false_alarm").orderBy(F.desc("conf"), "site_id", "photo", "det_id").limit(k)
    return rows.select("site_id", "photo", "det_id", "conf", *(F.bround(c, 0).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")))
