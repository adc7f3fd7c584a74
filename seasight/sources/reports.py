"""Evaluation tables and detections as files: Markdown, CSV, JSON and GeoJSON sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasight.operators.curves import class_report, overall
from seasight.sources.documents import features


def _cell(df: DataFrame, c: str, decimals: int) -> Column:
    is_float = df.schema[c].dataType.simpleString() in ("double", "float")
    text = F.format_string(f"%.{decimals}f", F.col(c)) if is_float else F.col(c).cast("string")
    shown = F.when(F.isnan(F.col(c).cast("double")), "n/a").otherwise(text) if is_float else text
    return F.coalesce(F.when(F.col(c).isNotNull(), shown), F.lit("n/a"))


def markdown_rows(df: DataFrame, columns: list[str] | None = None, decimals: int = 2) -> DataFrame:
    """``df`` with line: its row in a Markdown table; no data reads n/a."""
    cells = [_cell(df, c, decimals) for c in columns or df.columns]
    return df.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))


def markdown_head(columns: list[str]) -> str:
    return f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"


def write_report(scores: DataFrame, path: str) -> None:
    """A table of a row per class under ``path``: as csv, json (no NaN) and md; it is small, so that each is one file."""
    floats = [f.name for f in scores.schema.fields if f.dataType.simpleString() in ("double", "float")]
    one = scores.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats}).coalesce(1)
    one.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    one.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/json")
    head = scores.sparkSession.createDataFrame([(markdown_head(scores.columns),)], "value string")
    head.union(markdown_rows(one).select("line")).coalesce(1).write.mode("overwrite").text(f"{path}/md")


def _numbered(parts: list[DataFrame]) -> DataFrame:
    """no, line: the lines of the parts, one after the other; parts are a row per class at most."""
    out = None
    for i, p in enumerate(parts):
        own = p.select(F.lit(i).alias("part"), F.col("at").cast("double").alias("at"), "line")
        out = own if out is None else out.union(own)
    return out.orderBy("part", "at").select("part", "at", "line")


def _text(spark, *lines: str) -> DataFrame:
    return spark.createDataFrame([(float(i), x) for i, x in enumerate(lines)], "at double, line string")


def training_markdown(counts: DataFrame, n_train: int, importance: list[tuple[str, float]] = (), target: str = "Marine Debris") -> DataFrame:
    """part, at, line: a training report in order: sizes, accuracy, macro F1, the target's scores, a table of classes by falling support, the eight most informative features."""
    spark, c = counts.sparkSession, F.col
    f = lambda x, d=3: F.format_string(f"%.{d}f", x)
    whole = F.format_number
    o = overall(counts)
    n_classes = counts.select(c("truth").alias("l")).union(counts.select("pred")).distinct().count()
    head = o.select(F.explode(F.array(
        F.concat(F.lit(f"Trained on {n_train:,} pixels, tested on "), whole("n", 0), F.lit(" held-out pixels.")), F.lit(""),
        F.concat(F.lit("- overall accuracy: **"), f(c("accuracy")), F.lit("**")), F.concat(F.lit(f"- macro F1 across {n_classes} classes: **"), f(c("macro_f1")), F.lit("**")),
    )).alias("line")).withColumn("at", F.monotonically_increasing_id())
    per = class_report(counts)
    own = per.filter(c("label") == target).select(F.lit(0).alias("at"), F.concat(F.lit(f"- {target}: precision **"), f(c("precision")), F.lit("**, recall **"), f(c("recall")), F.lit("**, F1 **"), f(c("f1")), F.lit("** on "), whole("support", 0), F.lit(" pixels")).alias("line"))
    table = per.select((-c("support")).alias("at"), F.concat(F.lit("| "), F.concat_ws(" | ", c("label").cast("string"), f(c("precision")), f(c("recall")), f(c("f1")), whole("support", 0)), F.lit(" |")).alias("line"))
    parts = [head, own, _text(spark, "", "| class | precision | recall | F1 | support |", "|---|---|---|---|---|"), table]
    if importance:
        parts.append(_text(spark, "", "Most informative features:", "", *(f"- `{k}` {v:.4f}" for k, v in list(importance)[:8])))
    return _numbered(parts)


def evaluation_markdown(scores: DataFrame, confusion: DataFrame, labels: list[str], iou: float = 0.5, scene_id: str | None = None, decimals: int = 2) -> DataFrame:
    """part, at, line: an evaluation in order: confusion matrix (rows are truth, none is background), counts, scores per class, mean AP.

    ``scores`` is what ``detections.evaluate`` gives, ``confusion`` what
    ``detections.confusion`` does; both have a row per class, or pair of them.
    """
    spark, c = scores.sparkSession, F.col
    names = [*labels, "background"]
    show = lambda x: "none" if x == "background" else x
    order = lambda col: F.array_position(F.array(*[F.lit(n) for n in names]), col)
    rows = confusion.groupBy("truth").pivot("predicted", names).agg(F.sum("n")).na.fill(0)
    every = spark.createDataFrame([(n,) for n in names], "truth string").join(rows, "truth", "left").na.fill(0)
    shown = F.when(c("truth") == "background", "none").otherwise(c("truth"))
    matrix = every.select(order(c("truth")).alias("at"), F.concat(F.lit("| **True "), shown, F.lit("** | "), F.concat_ws(" | ", *[c(f"`{n}`").cast("string") for n in names]), F.lit(" |")).alias("line"))
    micro = scores.filter("label = 'all'").select(F.lit(0).alias("at"), F.concat(F.lit("| "), F.concat_ws(" | ", c("tp").cast("string"), c("fp").cast("string"), c("fn").cast("string")), F.lit(" |")).alias("line"))
    per = markdown_rows(scores.filter("label <> 'all'").select("label", "precision", "recall", "f1", "ap"), decimals=decimals).select(order(c("label")).alias("at"), "line")
    mean = scores.filter("label = 'all'").select(F.lit(0).alias("at"), F.concat(F.lit(f"Mean AP at IoU {iou:g}: "), F.coalesce(F.format_string(f"%.{decimals}f", c("ap")), F.lit("n/a"))).alias("line"))
    title = ["# Detection evaluation", ""] + ([f"Scene: `{scene_id}`", ""] if scene_id else []) + ["## Confusion matrix", "", markdown_head(["", *(f"Predicted {show(n)}" for n in names)])]
    parts = [
        _text(spark, *title), matrix, _text(spark, "", "## Counts", "", markdown_head(["True Positive", "False Positive", "False Negative"])), micro,
        _text(spark, "", "## Per-category scores", "", markdown_head(["category", "precision", "recall", "F1", "AP"])), per, _text(spark, ""), mean,
    ]
    return _numbered(parts)


def write_features(dets: DataFrame, path: str) -> None:
    """A feature per line, as many files as ``dets`` has partitions."""
    features(dets).select("feature").write.mode("overwrite").text(path)
