"""Review dumps: line-oriented text with one prefixed field a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The dump's field marks.
PRODUCT, USER, HELP, SCORE, TIME, TEXT = "product/productId: ", "review/userId: ", "review/helpfulness: ", "review/score: ", "review/time: ", "review/text:"
FORM = rf"(?s)\A(.*?)\n{USER}.*?\n{HELP}(.*?)\n{SCORE}(.*?)\n{TIME}.*?\n{TEXT}(.*)\z"


#: Records of a task are numbered in stretches of two to this power.
STRETCH = 12


def fields(record: Column) -> dict[str, Column]:
    """Columns of a record, which starts just after its product mark; nulls where it is malformed.

    A value that runs over several lines is joined up, but for the text, which keeps its line
    breaks.  A field's own mark inside its value is dropped.
    """

    def part(group: int, mark: str) -> Column:
        return F.replace(F.regexp_extract(record, FORM, group), F.lit(mark), F.lit(""))

    def line(group: int, mark: str) -> Column:
        return F.replace(part(group, mark), F.lit("\n"), F.lit(""))

    helpful = F.split(line(2, HELP), "/", 2)
    return {
        "product_id": F.when(record.rlike(FORM), line(1, PRODUCT)),
        "help_num": F.get(helpful, F.lit(0)).try_cast("smallint"),
        "help_den": F.get(helpful, F.lit(1)).try_cast("smallint"),
        "score": line(3, SCORE).try_cast("double").try_cast("tinyint"),
        "text": F.when(record.rlike(FORM), part(4, TEXT)),
    }


def parse_records(records: DataFrame) -> DataFrame:
    """Add the parsed fields to ``records(record, ...)``, and ``ok``: whether all are there."""
    parsed = records.withColumns(fields(F.col("record")))
    return parsed.withColumn("ok", F.col("product_id").isNotNull() & F.col("help_num").isNotNull() & F.col("help_den").isNotNull() & F.col("score").isNotNull())


def read_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(reviews, rejects) of a dump file or folder.

    reviews: review_id from 1 in file order without holes, product_id, help_num, help_den, score,
    text.  rejects: the malformed records and what precedes a file's first one.  Files are split
    at record marks and read in parallel.  Ids come from the place within a short stretch of records and the
    number of good records before it, a small table, so texts are not sorted to be numbered.
    """
    raw = spark.read.option("lineSep", f"\n{PRODUCT}").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r\n|\r$", "\n").alias("value"))
    # Only the first piece of a file still has its mark, or is what stands before the first record.
    head = F.col("value").startswith(PRODUCT)
    record = F.when(head, F.substring("value", len(PRODUCT) + 1, 2147483647)).otherwise(F.col("value"))
    parsed = parse_records(raw.select("file", "block", "at", head.alias("head"), record.alias("record")))
    at = F.col("at")
    parsed = parsed.withColumn("stretch", F.shiftright("at", STRETCH))  # rows of a task that follow each other
    # What stands before a file's first mark is no record, whatever it holds.
    first = parsed.groupBy("file", "block").agg(F.min_by("head", "at").alias("headed"), F.min("at").alias("start"))
    junk = first.filter("block = 0 and not headed").select(F.col("file").alias("_file"), F.col("start").alias("_junk"))
    parsed = parsed.join(junk, F.col("file") == F.col("_file"), "left").withColumn("ok", F.col("ok") & ~F.coalesce(at == F.col("_junk"), F.lit(False))).drop("_file", "_junk")
    # A row for each stretch: its good records, and which places hold bad ones, at most 2**STRETCH.
    parts = parsed.groupBy("file", "block", "stretch").agg(F.min("at").alias("start"), F.count_if("ok").alias("good"), F.collect_list(F.when(~F.col("ok"), at)).alias("bad"))
    blocks = parts.groupBy("file", "block").agg(F.sum("good").alias("good"))
    blocks = blocks.select("file", "block", F.coalesce(F.sum("good").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row for each block of the dump
    inside = F.coalesce(F.sum("good").over(Window.partitionBy("file", "block").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("inside", inside).join(blocks, ["file", "block"])
    placed = parsed.join(parts.select("file", "block", "stretch", "start", "bad", "inside", "ahead"), ["file", "block", "stretch"])
    number = F.col("ahead") + F.col("inside") + at - F.col("start") + 1 - F.size(F.filter("bad", lambda x: x < at))
    reviews = placed.filter("ok").select(number.cast("int").alias("review_id"), "product_id", "help_num", "help_den", "score", "text")
    return reviews, parsed.filter("not ok").select("file", "record")


def as_record(product: Column, helpful: tuple[Column, Column], score: Column, text: Column) -> Column:
    """A review written in the dump's form, without its product mark."""
    return F.concat(product, F.lit(f"\n{USER}u\nreview/profileName: p\n{HELP}"), helpful[0].cast("string"), F.lit("/"), helpful[1].cast("string"), F.lit(f"\n{SCORE}"), score.cast("double").cast("string"), F.lit(f"\n{TIME}0\nreview/summary: s\n{TEXT} "), text)
