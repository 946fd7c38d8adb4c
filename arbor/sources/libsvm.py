"""Text in the libsvm format, and tables, as labelled points; sinks for predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """``(label double, features map<int,double>)`` of lines ``label fid:v fid:v ...`` with ids from 1; ids come out from 0.

    Any white space separates; blank lines are left out. A token without a number, or an id that occurs twice, is an error.
    """
    parts = lines.select("*", F.split(F.trim(F.regexp_replace(F.col(line), r"\s+", " ")), " ").alias("_t")).where("_t[0] <> ''")
    rest = F.slice("_t", F.lit(2), F.size("_t") - 1)
    ids = F.transform(rest, lambda x: F.substring_index(x, ":", 1).cast("int") - 1)
    values = F.transform(rest, lambda x: F.substring_index(x, ":", -1).cast("double"))
    kept = [c for c in lines.columns if c != line]
    return parts.select(*kept, F.get("_t", F.lit(0)).cast("double").alias("label"), F.map_from_arrays(ids, values).alias("features"))


def normalise_labels(points: DataFrame, is_class: bool, compat_clamp: bool = True) -> DataFrame:
    """Labels of more than two kinds count from 0 instead of 1 (is_class); otherwise negative labels become 0.

    The clamp also takes negative regression targets, as the format's usual reader does; compat_clamp=False keeps them.
    """
    many = points.select("label").distinct().limit(3).count() > 2
    if is_class and many:
        label = F.col("label") - 1
    elif is_class or compat_clamp:
        label = F.when(F.col("label") < 0, 0.0).otherwise(F.col("label"))
    else:
        label = F.col("label")
    return points.withColumn("label", label)


def feature_width(points: DataFrame, features: str = "features") -> int:
    """Largest feature id and 1; 0 for rows without features."""
    return points.agg(F.coalesce(F.max(F.array_max(F.map_keys(features))), F.lit(-1)) + 1).first()[0]


def line_ids(lines: DataFrame) -> DataFrame:
    """``lines`` of text files with ``id``: the position of a line in its files as text, gapless, files in order of their paths.

    Lines are counted by the piece of a file (path and first byte) that a task reads, in one pass of cheap columns, so no task
    sees all lines. A row for each piece, a small part of the files' size, comes to the driver.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at")]
    part = lines.select("*", *place, F.monotonically_increasing_id().alias("_m"))
    counts = part.groupBy("_file", "_at").agg(F.count("*").alias("n"), F.min("_m").alias("m0")).orderBy("_file", "_at").collect()
    base, total = [], 0
    for r in counts:
        base.append((r["_file"], r["_at"], total - r["m0"]))
        total += r["n"]
    shift = lines.sparkSession.createDataFrame(base, "_file string, _at long, _shift long")
    return part.join(F.broadcast(shift), ["_file", "_at"]).withColumn("id", (F.col("_m") + F.col("_shift")).cast("string")).drop("_file", "_at", "_m", "_shift")


def read_libsvm(spark: SparkSession, path: str, is_class: bool = False, with_ids: bool = True, compat_clamp: bool = True) -> DataFrame:
    """``(id, label, features map<int,double>)`` of text files."""
    lines = spark.read.text(path)
    return normalise_labels(parse_lines(line_ids(lines) if with_ids else lines), is_class, compat_clamp)


def parse_points(lines: DataFrame, line: str = "value") -> DataFrame:
    """``(label double, features array<double>)`` of labelled points as text, in the forms that MLlib writes and reads:
    ``(label,[v,v,...])``, ``(label,(size,[ids],[values]))`` with ids from 0, and ``label,v v ...``.

    White space around the parts doesn't count, blank lines are left out, and a number that can't be read is an error.
    """
    t = F.regexp_replace(F.col(line), r"\s+", " ")
    numbers = lambda s, sep: F.transform(F.filter(F.split(s, sep), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("double"))
    group = lambda k: F.regexp_extract(t, r"^ ?\( ?([^,]+), ?\( ?(\d+) ?, ?\[([^\]]*)\] ?, ?\[([^\]]*)\]", k)
    ids, values = F.transform(numbers(group(3), ","), lambda x: x.cast("int")), numbers(group(4), ",")
    pairs = F.map_from_arrays(ids, values)
    size = group(2).cast("int")
    sparse = F.when(size == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), lambda i: F.coalesce(F.try_element_at(pairs, i), F.lit(0.0))))
    bracket = F.regexp_extract(t, r"\[([^\]]*)\]", 1)
    label = F.trim(F.regexp_replace(F.substring_index(t, ",", 1), r"^ ?\(", "")).cast("double")
    features = F.when(t.rlike(r"^ ?\([^\[]*\("), sparse).when(t.contains("["), numbers(bracket, ",")).otherwise(numbers(F.regexp_extract(t, ",(.*)$", 1), " "))
    kept = [c for c in lines.columns if c != line]
    return lines.where(F.trim(t) != "").select(*kept, label.alias("label"), features.alias("features"))


def to_points(points: DataFrame) -> DataFrame:
    """``value``: ``(label,[v,v,...])`` of each point, which :func:`parse_points` reads back."""
    values = F.array_join(F.transform("features", lambda v: v.cast("string")), ",")
    return points.select(F.concat(F.lit("("), F.col("label").cast("string"), F.lit(",["), values, F.lit("])")).alias("value"))


def dense(points: DataFrame, width: int) -> DataFrame:
    """``features`` as array<double> of ``width``, 0 where a map has nothing."""
    return points.withColumn("features", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("features", i), F.lit(0.0)))) if width else points.withColumn(
        "features", F.array().cast("array<double>")
    )


def assemble(df: DataFrame, label: Column | str, features: list[Column | str], key: Column | str | None = None) -> DataFrame:
    """``(id?, label, features array<double>)`` from columns of a table; a null feature reads as 0."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    ids = [as_col(key).alias("id")] if key is not None else []
    return df.select(*ids, as_col(label).cast("double").alias("label"), F.array(*(F.coalesce(as_col(c).cast("double"), F.lit(0.0)) for c in features)).alias("features"))


def line_of(label: Column, features: Column) -> Column:
    """A point as a line, ids from 1 in ascending order; zeros of a dense array are left out."""
    pairs = F.transform(features, lambda v, i: F.when(v != 0, F.concat((i + 1).cast("string"), F.lit(":"), v.cast("string"))))
    return F.concat_ws(" ", label.cast("string"), F.filter(pairs, lambda x: x.isNotNull()))


def to_libsvm(points: DataFrame) -> DataFrame:
    """``value``: a line for each point."""
    return points.select(line_of(F.col("label"), F.col("features")).alias("value"))


def write_predictions(scored: DataFrame, path: str, dialect: str = "distributed") -> None:
    """Tab-separated text over what is there: id, label, prediction; in the local dialect the prediction, then the point."""
    if dialect == "distributed":
        scored.select("id", "label", "prediction").write.mode("overwrite").option("sep", "\t").csv(path)
    else:
        scored.select(F.concat_ws("\t", F.col("prediction").cast("string"), line_of(F.col("label"), F.col("features"))).alias("value")).write.mode("overwrite").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id long, text)``, a document per line, ids in the order of lines."""
    return line_ids(spark.read.text(path)).select(F.col("id").cast("long").alias("doc_id"), F.col("value").alias("text"))
