"""Take in new texts as their files arrive, and keep a quality report of each kind and origin of text.

    python -m jobs.text_intake --input TABLES --output OUT --checkpoint CP --config jobs/text_intake.json

A study's texts (decks, run notes, reports) arrive as files of the table `documents`: lang is the kind of text, source where
it comes from. The job runs a file stream until all files that are there are taken, and ends; files it has taken before are
not read again. Output, in Parquet:

    OUT/measures/batch_id=N     a row for each new text: its words, characters, lines, numbers and a digest
    OUT/report/lang=L           a row for each source: texts, empty ones, copies, words, quantiles of words, and how those
                                compare with all texts of the kind

A batch that is run again after a failure replaces its own folder. The report of a kind names the last batch in it; kinds
with a later batch among the measures, and only these, are made anew from the measures. So a run that failed between the
two is made up for by the next one, and a run without new files changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import log, main, replace_partitions
from tidewell.functions.columns import ratio
from tidewell.operators import series

DEFAULTS = {"files_a_batch": 0, "narrow": 0.1, "wide": 1.5, "most_copies": 0.5}
MEASURES = "doc_id LONG, lang STRING, source STRING, n_words LONG, n_chars LONG, n_lines LONG, n_numbers LONG, sha256 STRING, batch_id LONG"
REPORT = (
    "source STRING, n_texts LONG, n_empty LONG, n_copies LONG, n_words LONG, n_numbers LONG, words_mean DOUBLE, words_p10 DOUBLE, words_p50 DOUBLE, "
    "words_p90 DOUBLE, width_ratio DOUBLE, median_shift DOUBLE, verdict STRING, last_batch LONG, lang STRING"
)
QUANTILES = (0.1, 0.5, 0.9)


def measures(docs: DataFrame) -> DataFrame:
    """A row for each text. Words are runs of other characters than U+0020 and U+0009 to U+000D, numbers are words of digits with
    at most one point; the digest is of the text with each such run as one space. Null counts as empty: no words, lines or numbers."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.expr(r"regexp_count(_text, '[^\\x20\\x09-\\x0D]+')")
    numbers = F.expr(r"regexp_count(_text, '(?<![^\\x20\\x09-\\x0D])[0-9]+([.][0-9]+)?(?![^\\x20\\x09-\\x0D])')")
    lines = F.when(F.col("_text") == "", 0).otherwise(F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("\n"), F.lit(""))) + 1)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("_text")
    ).select(
        "doc_id", "lang", "source", words.cast("long").alias("n_words"), F.length("_text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"),
        numbers.cast("long").alias("n_numbers"), F.sha2(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", " "), 256).alias("sha256")
    )


def _copies(rows: DataFrame) -> DataFrame:
    """(lang, source, n_copies): texts that equal another of their kind, all but the one with the smallest doc_id (then source).

    Equal texts of a source are counted before they meet those of other sources,
    so a text on a third of all rows is a row for each source.
    """
    held = rows.groupBy("lang", "source", "sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    order = Window.partitionBy("lang", "sha256").orderBy(F.asc_nulls_last("least"), F.asc_nulls_last("source"))
    first = F.when(F.row_number().over(order) == 1, 1).otherwise(0)
    return held.select("lang", "source", (F.col("n") - first).alias("n")).groupBy("lang", "source").agg(F.sum("n").alias("n_copies"))


def report(rows: DataFrame, narrow: float, wide: float, most_copies: float) -> DataFrame:
    """A row for each (lang, source) of measures; nulls are a kind and a source of their own.

    Quantiles are of words; the width ratio is the distance of the outer ones
    over that of all texts of the kind (0 counts as 1). The verdict names the
    first that holds: COPIES (more than most_copies of the texts), NARROW or
    WIDE (ratio under narrow, over wide), SHIFTED (median outside the kind's
    outer quantiles), else OK.
    """
    # a row for each number of words: from here on no text of a frequent kind meets the others one by one
    counted = rows.groupBy("lang", "source", F.col("n_words").alias("value")).agg(
        F.count("*").alias("weight"), F.sum("n_numbers").alias("n_numbers"), F.max("batch_id").alias("last_batch")
    )
    names = {f"p{round(100 * q)}": f"words_p{round(100 * q)}" for q in QUANTILES}
    own = series.column_quantiles(counted, QUANTILES, ["lang", "source"], "weight").withColumnsRenamed(names)
    kind = series.column_quantiles(counted, QUANTILES, ["lang"], "weight")
    last = counted.groupBy("lang").agg(F.max("last_batch").alias("last_batch"))
    sums = counted.groupBy("lang", "source").agg(
        F.sum("weight").alias("n_texts"), F.coalesce(F.sum(F.when(F.col("value") == 0, F.col("weight"))), F.lit(0)).alias("n_empty"),
        F.sum(F.col("value") * F.col("weight")).alias("n_words"), F.sum("n_numbers").alias("n_numbers")
    )
    joined = sums
    for part, keys in ((own, ["lang", "source"]), (_copies(rows), ["lang", "source"]), (kind, ["lang"]), (last, ["lang"])):
        part = part.withColumnsRenamed({k: f"_{k}" for k in keys})
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        joined = joined.join(part, same).drop(*(f"_{k}" for k in keys))
    width = F.col("p90") - F.col("p10")
    joined = joined.withColumns({
        "words_mean": ratio("n_words", "n_texts"), "width_ratio": (F.col("words_p90") - F.col("words_p10")) / F.when(width != 0, width).otherwise(1.0),
        "median_shift": F.col("words_p50") - F.col("p50"),
    })
    verdict = F.when(F.col("n_copies") > most_copies * F.col("n_texts"), "COPIES").when(F.col("width_ratio") < narrow, "NARROW").when(
        F.col("width_ratio") > wide, "WIDE"
    ).when(~F.col("words_p50").between(F.col("p10"), F.col("p90")), "SHIFTED").otherwise("OK")
    return joined.withColumn("verdict", verdict).select(*(c.split()[0] for c in REPORT.split(", ")))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or one without rows if nothing was ever written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def take_new(spark: SparkSession, input: str, output: str, checkpoint: str, files_a_batch: int = 0) -> list[int]:
    """Measure the texts of files that the checkpoint doesn't know yet; return the batches written."""
    # a pattern, as a stream takes a table of one file by a pattern only; it also fits a folder of files
    path, done = f"{input}/[d]ocuments.parquet", []
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_a_batch:
        stream = stream.option("maxFilesPerTrigger", files_a_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        replace_partitions(measures(batch).withColumn("batch_id", F.lit(batch_id).cast("long")), f"{output}/measures", "batch_id")
        done.append(batch_id)
        log.info("batch %d written to %s/measures", batch_id, output)

    stream.parquet(path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return done


def bring_up_to_date(spark: SparkSession, output: str, cfg: dict) -> list:
    """Make the report of those kinds anew that have measures of a later batch than it names; return the kinds."""
    rows = _read(spark, f"{output}/measures", MEASURES)
    has = rows.groupBy("lang").agg(F.max("batch_id").alias("has"))
    knows = _read(spark, f"{output}/report", REPORT).groupBy(F.col("lang").alias("_lang")).agg(F.max("last_batch").alias("knows"))
    stale = has.join(knows, F.col("lang").eqNullSafe(F.col("_lang")), "left").where("knows is null or knows < has").select("lang")
    kinds = [r[0] for r in stale.collect()]  # a name for each kind of text
    if kinds:
        mine = F.coalesce(F.col("lang").isin([k for k in kinds if k is not None]), F.lit(None in kinds))
        out = report(rows.where(mine), cfg["narrow"], cfg["wide"], cfg["most_copies"])
        replace_partitions(out.repartition("lang").sortWithinPartitions("lang", "source"), f"{output}/report", "lang")
    return kinds


def run(spark: SparkSession, input: str, output: str, checkpoint: str, config: dict | None = None) -> dict:
    """Take what is new and bring the report up to date; return what was read and written."""
    cfg = DEFAULTS | (config or {})
    batches = take_new(spark, input, output, checkpoint, cfg["files_a_batch"])
    rows = _read(spark, f"{output}/measures", MEASURES)
    new = rows.where(F.col("batch_id").isin(batches)).count() if batches else 0
    kinds = bring_up_to_date(spark, output, cfg)
    done = {"new_texts": new, "texts": rows.count(), "kinds": kinds, "report": read_report(spark, output).count()}
    log.info("%d new texts of %s taken, %d held; report of kinds %s made anew, %d rows in %s/report", new, input, done["texts"], kinds, done["report"], output)
    return done


def read_report(spark: SparkSession, output: str) -> DataFrame:
    """The whole report as it stands."""
    return _read(spark, f"{output}/report", REPORT)


run.defaults = DEFAULTS

if __name__ == "__main__":
    raise SystemExit(main(__doc__.splitlines()[0], run, checkpoint=True))
