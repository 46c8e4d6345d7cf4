"""Run statistics, report records and the report store (A1, RPT, S9-S12).

Reports are kept normalised: one record per run (question, stats, text)
and one row per cited source, so no run's source list is ever gathered
into one value.  ``nest_sources`` builds the nested list of the original
JSON layout when a caller needs it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.functions.arrays import ordered_values
from citeline.session import written

# Report metadata written with every report.
METHODOLOGY = "MSDR+STORM+GPTResearcher (v0.2)"
CATALOGUE_SIZE = 20
QUESTION_SHOWN = 100

STATS = ["personas", "dialogues", "sections", "total_sources", "total_findings"]

REPORT_SCHEMA = (
    "research_id string, question string, generated_at string, methodology string, model_used string, "
    "stats struct<personas:bigint,dialogues:bigint,sections:bigint,total_sources:bigint,"
    "total_findings:bigint,time_seconds:double>, report string, bucket int, _corrupt_record string")
FILE_SCHEMA = (
    "question string, generated_at string, methodology string, model_used string, "
    "stats struct<personas:bigint,dialogues:bigint,sections:bigint,total_sources:bigint,"
    "total_findings:bigint,time_seconds:double>, "
    "sources array<struct<index:bigint,url:string,title:string,description:string>>, report string, _corrupt_record string")
BUCKETS = 64        # partitions of the store, by run


def run_stats(runs: DataFrame, run: str, **facts: DataFrame) -> DataFrame:
    """A1: one count per fact table (rows per run), zero where a run has none.

    ``facts`` maps a stat name to a DataFrame with one row per counted item
    and the ``run`` column; each count is a partial aggregation."""
    out = runs.select(run).distinct()
    for name, df in facts.items():
        out = out.join(df.groupBy(run).agg(F.count(F.lit(1)).alias(name)), run, "left")
    return out.select(run, *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in facts])


def report_records(stats: DataFrame, questions: DataFrame, texts: DataFrame, run: str = "research_id",
                   generated_at: str | Column = "1970-01-01T00:00:00Z", model_used: str = "",
                   time_seconds: DataFrame | None = None, methodology: str = METHODOLOGY) -> DataFrame:
    """RPT: one report per run (``stats`` with all STATS columns, ``questions``
    (run, question), ``texts`` (run, report))."""
    df = stats.join(questions, run, "left").join(texts, run, "left")
    secs = F.lit(None).cast("double")
    if time_seconds is not None:
        df = df.join(time_seconds, run, "left")
        secs = F.round(F.col("time_seconds"), 1)
    return df.select(
        F.col(run).cast("string").alias("research_id"),
        F.coalesce("question", F.lit("")).alias("question"),
        F.lit(generated_at).alias("generated_at"), F.lit(methodology).alias("methodology"),
        F.lit(model_used).alias("model_used"),
        F.struct(*[F.col(s) for s in STATS], secs.alias("time_seconds")).alias("stats"),
        F.coalesce("report", F.lit("")).alias("report"))


def nest_sources(sources: DataFrame, run: str = "research_id") -> DataFrame:
    """The nested ``sources`` list of the original report layout (per run)."""
    item = F.struct("index", "url", "title", "description")
    return sources.groupBy(run).agg(
        ordered_values(F.collect_list(F.struct(F.col("index"), item.alias("s"))), "s").alias("sources"))


def _readable(records: DataFrame) -> DataFrame:
    """Records that parsed.  Spark refuses plans that read nothing but the mark of
    corrupt records (as a count would), so the test names a real column too."""
    parsed = F.col("_corrupt_record").isNull() & (F.length(F.coalesce("question", F.lit(""))) >= 0)
    return records.where(parsed).drop("_corrupt_record")


def bucket_of(run: str = "research_id") -> Column:
    return F.pmod(F.xxhash64(F.col(run).cast("string")), F.lit(BUCKETS)).cast("int").alias("bucket")


def _replace_runs(new: DataFrame, kept: DataFrame | None, run: str):
    """``new`` rows and the stored rows of other runs in the same buckets, written as the buckets' new content."""
    new = written(new.withColumn("bucket", bucket_of(run)), "reports-new")
    if kept is not None:
        touched = F.broadcast(new.select("bucket").distinct())      # at most BUCKETS rows
        others = kept.join(touched, "bucket", "left_semi").join(new.select(run).distinct(), run, "left_anti")
        new = written(new.unionByName(others.select(*new.columns)), "reports-merged")
    return new.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket")


def _stored(reader, path: str, kind: str) -> DataFrame | None:
    try:
        return getattr(reader, kind)(path)
    except AnalysisException:       # nothing stored yet
        return None


def write_reports(reports: DataFrame, path: str, sources: DataFrame | None = None, run: str = "research_id") -> None:
    """Put reports (JSON lines) and their sources (Parquet) into the store, in buckets by run.

    A run that is there already is replaced, so running again changes nothing.  Only the
    buckets of the written runs are rewritten (unreadable lines in them go); one writer at a time."""
    spark = reports.sparkSession
    old = _stored(spark.read.schema(REPORT_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record"), f"{path}/reports", "json")
    old = _readable(old) if old is not None else None
    _replace_runs(reports, old, "research_id").json(f"{path}/reports")
    if sources is not None:
        _replace_runs(sources, _stored(spark.read, f"{path}/sources", "parquet"), run).parquet(f"{path}/sources")


def read_report_files(spark: SparkSession, path: str) -> DataFrame:
    """Reports as single indented JSON files ``report_*.json``, each read whole,
    with its file name; unreadable files are skipped."""
    df = (spark.read.schema(FILE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", "report_*.json").json(path))
    named = df.select("*", F.col("_metadata.file_name").alias("file"))
    return _readable(named)


def file_catalogue(spark: SparkSession, path: str, limit: int = CATALOGUE_SIZE) -> DataFrame:
    """S10 + K1 over ``read_report_files``: the last ``limit`` files by name, which holds their time."""
    return _catalogue(read_report_files(spark, path)).orderBy(F.desc("file")).limit(limit)


def file_lookup(spark: SparkSession, path: str, name: str) -> DataFrame:
    """S11 by file name: only that file is opened."""
    df = (spark.read.schema(FILE_SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return _readable(df.where(F.col("_metadata.file_name") == name))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """All readable report records; unreadable lines are skipped."""
    df = (spark.read.schema(REPORT_SCHEMA).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{path}/reports"))
    return _readable(df)


def _catalogue(reports: DataFrame) -> DataFrame:
    return reports.select("file", F.left(F.coalesce("question", F.lit("")), F.lit(QUESTION_SHOWN)).alias("question"),
                          F.coalesce("generated_at", F.lit("")).alias("date"),
                          F.coalesce(F.col("stats.total_findings"), F.lit(0)).cast("long").alias("findings"))


def report_catalogue(spark: SparkSession, path: str, limit: int = CATALOGUE_SIZE) -> DataFrame:
    """S10 + K1: newest ``limit`` reports (file = run id, question cut to 100,
    date, findings defaulting to 0).  Planned as TakeOrderedAndProject."""
    listed = _catalogue(read_reports(spark, path).withColumn("file", F.col("research_id")))
    return listed.orderBy(F.col("date").desc(), F.col("file").desc()).limit(limit)


def report_lookup(spark: SparkSession, path: str, research_id: str) -> DataFrame:
    """One report by id, from its bucket alone; an empty result means not found."""
    bucket = spark.range(1).select(F.lit(research_id).alias("research_id")).select(bucket_of()).first()[0]
    return read_reports(spark, path).where((F.col("bucket") == bucket) & (F.col("research_id") == research_id))


def report_response(reports: DataFrame) -> DataFrame:
    """The fields returned to a caller."""
    return reports.select("question", "report", "stats")
