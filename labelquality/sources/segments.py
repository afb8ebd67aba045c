"""Files cut at a separator, and sums that run over a whole file although many tasks read it.

What a separator means in CSV or JSON depends on all that comes before it in the file: the number of quotes, the depth of
brackets. Such a state is a running sum. Inside a block (a stretch of a file that one task reads) a window adds it up;
one row per block says what the blocks before it add. So no task sees more than one block, and a quoted text or
an element may lie across any number of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import stored

PLACE = ("file", "block", "seq")


def segments(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, seq, value): what lies between separators, in order of block and seq within a file. Files are split among tasks."""
    lines = spark.read.option("lineSep", separator).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def running(df: DataFrame, **sums: Column) -> DataFrame:
    """Add, for each name, the sum of its column over all rows of the file before this one. The result is stored.

    ``df`` must not change when computed again: pass ``segments``' rows through ``stored`` first.
    """
    valued = df.withColumns({f"_{n}": c.cast("long") for n, c in sums.items()})
    per_block = valued.groupBy("file", "block").agg(*[F.sum(f"_{n}").alias(f"_all_{n}") for n in sums])
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    bases = per_block.select("file", "block", *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_base_{n}") for n in sums])
    before = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = valued.withColumns({n: F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)) for n in sums})
    joined = inside.join(bases, ["file", "block"]).withColumns({n: F.col(n) + F.col(f"_base_{n}") for n in sums})
    return stored(joined.drop(*[f"{p}{n}" for n in sums for p in ("_", "_base_")]), "segments")


def joined_values(df: DataFrame, separator: str, *keys: str) -> DataFrame:
    """(keys..., value): the segments of each group, in order, with the separator between them again."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("block", "seq", "value"))), lambda s: s["value"])
    return df.groupBy(*keys).agg(F.array_join(parts, separator).alias("value"))


def csv_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(file, record, value): the text of every CSV record, header lines included, numbered from 0 in each file.

    A line feed ends a record where the quotes so far are even in number, as in files in which quotes stand around whole
    fields and are doubled inside them. Records of one line do not move again; blank lines are no records.
    """
    lines = stored(segments(spark, path, "\n"), "lines")
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit(quote), F.lit("")))
    lines = running(lines.withColumn("quotes", quotes), seen=F.col("quotes"))
    inside, ends = F.col("seen") % 2 != 0, (F.col("seen") + F.col("quotes")) % 2 == 0
    lines = lines.withColumn("whole", ~inside & ends)
    filled = ~(F.col("whole") & (F.rtrim(F.replace(F.col("value"), F.lit("\r"), F.lit(""))) == ""))
    lines = running(lines.withColumn("ends", ends).filter(filled), record=F.col("ends").cast("int"))
    alone = lines.filter("whole").select("file", "record", "value")
    several = joined_values(lines.filter("NOT whole"), "\n", "file", "record")
    return alone.unionByName(several).withColumn("value", F.regexp_replace("value", "\r$", ""))


def _outside(value: Column) -> tuple[Column, Column, Column]:
    """(quotes, bracket depth if the segment begins outside a string, the same if inside) of a JSON segment."""
    plain = F.regexp_replace(value, r"\\.", "")  # escapes; a separator is never one
    depth = lambda text: F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]}]", ""))
    closed = F.regexp_replace(plain, r'"[^"]*("|$)', "")
    opened = F.regexp_replace(F.regexp_replace(plain, r'^[^"]*("|$)', ""), r'"[^"]*("|$)', "")
    return F.length(F.regexp_replace(plain, '[^"]', "")), depth(closed), depth(opened)


def list_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, field, at, value): the elements of the lists in files that are one JSON object of lists, as JSON text.

    Cut at commas; those outside strings end an element inside a list and a field between lists. No task holds a list.
    """
    parts = stored(segments(spark, path, ","), "parts")
    quotes, outside, inside = _outside(F.col("value"))
    parts = running(parts.withColumns({"quotes": quotes, "outside": outside, "inside": inside}), seen=F.col("quotes"))
    change = F.when(F.col("seen") % 2 == 0, F.col("outside")).otherwise(F.col("inside"))
    parts = running(parts.withColumn("change", change).drop("outside", "inside"), depth=F.col("change"))
    ends = (F.col("seen") + F.col("quotes")) % 2 == 0
    after = F.col("depth") + F.col("change")
    parts = parts.withColumns({"of_element": (ends & (after <= 2)).cast("int"), "of_field": (ends & (after <= 1)).cast("int")})
    parts = running(parts, element=F.col("of_element"), number=F.col("of_field"))
    elements = joined_values(parts, ",", "file", "number", "element")
    # the first element of a field carries its name, the last one the end of the list
    heads = elements.groupBy("file", "number").agg(F.min("element").alias("first"), F.max("element").alias("last"), F.min_by("value", "element").alias("head"))
    heads = heads.withColumn("lead", F.regexp_extract("head", r'^\s*\{?\s*("(?:[^"\\]|\\.)*"\s*:\s*\[)', 0))
    heads = heads.withColumn("field", F.from_json(F.regexp_replace(F.regexp_replace("lead", r"^\s*\{?\s*", "["), r"\s*:\s*\[$", "]"), "array<string>")[0])
    joined = elements.join(F.broadcast(heads.drop("head")), ["file", "number"])  # a row per list; dealt by list, a task would get a whole one
    value = F.when(F.col("element") == F.col("first"), F.substr("value", F.length("lead") + 1)).otherwise(F.col("value"))
    joined = joined.withColumn("value", value)
    end = F.when(F.col("element") == F.col("last"), F.regexp_replace("value", r"\]\s*(\}\s*)?$", "")).otherwise(F.col("value"))
    found = joined.withColumn("value", F.trim(F.regexp_replace(end, r"^\s+|\s+$", "")))
    return found.filter(~((F.col("first") == F.col("last")) & (F.col("value") == ""))).select("file", "field", (F.col("element") - F.col("first")).alias("at"), "value")
