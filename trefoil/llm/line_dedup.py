"""Lines that other documents hold already: range-partitioned keys, first occurrences by streaming, keep bitmaps.

Every line becomes a row of two 64-bit hashes of its key, its document and its place; these rows are written once, without
text. They are dealt by range of the hashes and sorted within each range by document and place, so that the first row of a key
is its first occurrence and every row is judged as it streams by. What a document loses comes back as its *keep bitmap*,
run-length encoded: ``keep`` lists ``(first, lines)`` for each run of kept lines. Texts meet their bitmaps once, at the end.

A key that would fill a range by itself is dealt over blocks: a sample of the rows (``SAMPLE`` for each range) says which keys are so
common, at most ``SAMPLE / HOT`` of them for each range; the first document of these is aggregated over all rows beforehand and carried into every block.
The sample decides where rows go, never what becomes of them.

Defined results: a null or empty text is one empty line. A document is its ``doc_id``: rows of one id never take lines from each other, and
rows without an id are one document that comes after all others. Repeated rows get the same verdict. Keys are equal if both
hashes are (128 bits). An empty table gives no rows. Only named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trefoil.session import materialize

#: What is stripped at both ends of a line, the letters that fold, the shortest key in code points.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_KEY = 10
#: Rows sampled for each range partition, and how many of them make a key so common that it is split.
SAMPLE, HOT = 256, 32


def _row() -> F.Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def line_keys(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """``(h1, h2, doc_id, row, place, n_lines, salt)`` of every line whose key has ``min_key`` code points or more."""
    lines = F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), "\n")
    placed = docs.select("doc_id", _row().alias("row"), lines.alias("lines")).select("doc_id", "row", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("place", "line"))
    keyed = placed.withColumn("key", F.trim("line", F.lit(SPACE))).where(F.length("key") >= min_key)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "row", "place", "n_lines", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).cast("int").alias("salt"))


def _hot_keys(keys: DataFrame, ranges: int) -> DataFrame:
    """``(h1, h2, carried)``: keys too common for one range, with their first document among all rows."""
    fraction = min(1.0, SAMPLE * ranges / max(keys.count(), 1))
    common = keys.sample(fraction, seed=11).groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).select("h1", "h2")
    return keys.join(F.broadcast(common), ["h1", "h2"]).groupBy("h1", "h2").agg(F.min("doc_id").alias("carried"))


def lost_lines(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """``(doc_id, row, n_lines, place)`` of every line whose key an earlier document holds."""
    keys = materialize(line_keys(docs, min_key), "line-keys")
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(_hot_keys(keys, ranges).withColumn("hot", F.lit(True)))
    block = F.when(F.col("hot"), F.pmod("salt", F.lit(ranges))).otherwise(F.lit(0)).alias("block")
    dealt = keys.join(hot, ["h1", "h2"], "left").select("h1", "h2", block, "doc_id", "row", "place", "n_lines", "hot", "carried").repartitionByRange("h1", "h2", "block")
    stream = Window.partitionBy("h1", "h2", "block").orderBy(F.col("doc_id").asc_nulls_last(), "row", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = dealt.withColumn("first", F.when(F.col("hot"), F.col("carried")).otherwise(F.first("doc_id").over(stream)))
    return judged.where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "row", "n_lines", "place")


def keep_bitmaps(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """``(doc_id, row, n_lines, n_dropped, keep)`` of each document that loses a line; ``keep`` holds its runs of kept lines."""
    lost = lost_lines(docs, min_key).groupBy("doc_id", "row").agg(F.first("n_lines").alias("n_lines"), F.array_sort(F.collect_set("place")).alias("lost"))
    before, after = F.concat(F.array(F.lit(-1)), "lost"), F.concat("lost", F.array("n_lines"))
    runs = F.zip_with(before, after, lambda a, b: F.struct((a + 1).alias("first"), (b - a - 1).alias("lines")))
    return lost.select("doc_id", "row", "n_lines", F.size("lost").alias("n_dropped"), F.filter(runs, lambda r: r["lines"] > 0).alias("keep"))


def deduplicate(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), min_key: int = MIN_KEY) -> DataFrame:
    """``columns``, ``n_lines`` before dropping, ``n_dropped`` and ``kept_text``, one row for each row of ``docs``."""
    own = docs.select(*[F.col(c).alias(f"__{c}") for c in columns], F.col("doc_id").alias("__id"), _row().alias("__row"), F.coalesce("text", F.lit("")).alias("__text"))
    maps = keep_bitmaps(docs, min_key).select(F.col("doc_id").alias("__of"), F.col("row").alias("__of_row"), "n_dropped", "keep")
    met = own.join(maps, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__row") == F.col("__of_row")), "left")
    lines = F.split("__text", "\n")
    kept = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice(lines, r["first"] + 1, r["lines"]))), "\n")
    return met.select(
        *[F.col(f"__{c}").alias(c) for c in columns], F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("__text")).otherwise(kept).alias("kept_text"),
    )
