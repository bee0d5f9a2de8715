"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Archives are written and read by Spark's text source, so they can be in any store that Spark reaches, are split
over tasks by block, and are committed or redone with their task. Written files hold uncompressed records.

Reading: the text between two occurrences of the magic line is a candidate record, which with its position says
where its successor must start. A candidate counts only if the chain of successors from the file's start reaches it, so
magic inside payloads is rejected. Positions come from summed lengths. Within a block, candidates whose successor is
the next candidate are one run with one exit; the chain over runs is found by pointer jumping in logarithmically many joins.
Payloads that contain magic are put together from their pieces. Built-in functions only.

Defined results: a null payload is an empty one; null ids and addresses are written empty and read back as null;
repeated rows are a record each, and all of them are responses if their id is the smallest; very long payloads are one
record; an empty table gives no records; only the named columns are read. Trailing bytes that are no record end a
file's chain there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trefoil.session import materialize, scratch

# The format's marks.
MAGIC, BREAK = "WARC/1.1\r\n", "\r\n"
#: Payload bytes from which equal payloads are stored once.
MIN_REVISIT = 100
RECORDS_PER_FILE = 50_000
#: Copies up to which their list is broadcast (16 bytes each and overhead); beyond it pages are shuffled by id.
BROADCAST_COPIES = 300_000


def _hashed(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload.cast("binary"), 256).alias("digest"))


def revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """``(page_id, digest, refers_to)`` of pages whose payload a page with a smaller id has too."""
    small = _hashed(pages).where(F.col("bytes") >= least).select("page_id", "digest")
    first = small.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return small.join(first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, least: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages(page_id, url, html)`` into archives under ``path``."""
    copies = materialize(revisits(pages, least), "revisits")
    few = copies.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES
    joined = _hashed(pages).join(F.broadcast(copies) if few else copies, ["page_id", "digest"], "left")
    first = F.col("refers_to").isNull()
    text = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\r\n]", ""), F.lit(""))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(first, "response").otherwise("revisit"), F.lit(f"{BREAK}WARC-Record-ID: <urn:page:"), text("page_id"), F.lit(f">{BREAK}WARC-Date: {date}{BREAK}WARC-Target-URI: "), text("url"),
        F.lit(f"{BREAK}WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(f"{BREAK}WARC-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(first, "").otherwise(F.concat(F.lit(f"{BREAK}WARC-Refers-To: <urn:page:"), text("refers_to"), F.lit(">"))), F.lit(f"{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        F.when(first, F.col("bytes")).otherwise(F.lit(0)).cast("string"), F.lit(BREAK * 2),
    )
    record = F.concat(head, F.when(first, F.col("payload")).otherwise(""), F.lit(BREAK))
    joined.select(record.alias("value")).write.option("lineSep", BREAK).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magic lines: ``(file, block, at, value)``, ``at`` rising within a block."""
    rows = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _placed(pieces: DataFrame) -> DataFrame:
    """Pieces with ``size`` by their ``offset``, where the magic line before them starts; the piece before a file's first magic has -1 times the magic's length."""
    span = F.col("size") + len(MAGIC)
    before = F.sum(span).over(Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    blocks = pieces.groupBy("file", "block").agg(F.sum(span).alias("span"))
    start = blocks.select("file", "block", F.coalesce(F.sum("span").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return pieces.withColumn("before", F.coalesce(before, F.lit(0))).join(start, ["file", "block"]).withColumn("offset", F.col("start") + F.col("before") - len(MAGIC)).drop("before", "start", "at")


def _payload(body, head_bytes, length):
    return F.substring(body.cast("binary"), head_bytes.cast("int") + 5, length.cast("int"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece that follows a magic line, read as a record, with the offset at which its successor must start."""
    head = F.substring_index("value", BREAK * 2, 1)
    one = _pieces(spark, path).select("file", "block", "at", "value", F.octet_length("value").cast("long").alias("size"), head.alias("head"))
    field = lambda name, pattern: F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}: *{pattern}", 1)
    one = one.select(
        "file", "block", "at", "value", "size", F.octet_length("head").cast("long").alias("head_bytes"), field("WARC-Type", r"([a-z]+)").alias("record_type"),
        F.nullif(field("WARC-Record-ID", r"<urn:page:([^>\r]*)>"), F.lit("")).alias("record_id"), F.nullif(field("WARC-Target-URI", r"([^\r]*)"), F.lit("")).alias("uri"),
        F.nullif(field("WARC-Refers-To", r"<urn:page:([^>\r]*)>"), F.lit("")).alias("refers_to"), field("WARC-Payload-Digest", r"sha256:([0-9a-f]+)").alias("declared_digest"),
        field("WARC-Payload-Length", r"([0-9]{1,18})").try_cast("bigint").alias("declared_bytes"), field("Content-Length", r"([0-9]{1,18})").try_cast("bigint").alias("length"),
    )
    valid = (F.col("size") > F.col("head_bytes")) & F.col("length").isNotNull() & (F.col("record_type") != "")
    whole = valid & (F.col("size") >= F.col("head_bytes") + 4 + F.col("length"))
    one = one.select(*[c for c in one.columns if c != "value"], F.when(whole, F.sha2(_payload(F.col("value"), F.col("head_bytes"), F.col("length")), 256)).alias("payload_digest"), valid.alias("valid"))
    after = F.when(F.col("valid"), F.col("offset") + len(MAGIC) + F.col("head_bytes") + F.col("length") + 4 * len(BREAK))
    return _placed(one).where("offset >= 0").withColumn("successor", after)


def _reached(cand: DataFrame) -> DataFrame:
    """``(file, run, entry)``: runs that the chain from the file's start enters, and where."""
    runs = cand.groupBy("file", "run").agg(F.max_by("successor", "offset").alias("exit"))
    target = cand.select("file", F.col("offset").alias("exit"), F.col("run").alias("next"))
    step = materialize(runs.join(target, ["file", "exit"]).select("file", "run", "next", F.col("exit").alias("entry")), "steps")
    reach = materialize(cand.where("offset = 0").select("file", "run").distinct(), "reach")
    jump, many = step.select("file", "run", "next"), reach.count()
    while True:
        ahead = reach.join(jump, ["file", "run"]).select("file", F.col("next").alias("run"))
        grown = materialize(reach.unionByName(ahead).distinct(), "reach")
        if (now := grown.count()) == many:
            break
        reach, many = grown, now
        twice = jump.join(jump.select("file", F.col("run").alias("next"), F.col("next").alias("far")), ["file", "next"])
        jump = materialize(twice.select("file", "run", F.col("far").alias("next")), "jumps")
    entries = step.join(reach, ["file", "run"], "left_semi").select("file", F.col("next").alias("run"), "entry")
    roots = cand.where("offset = 0").select("file", "run", F.lit(0).cast("bigint").alias("entry"))
    return roots.unionByName(entries)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(file, offset, record_type, record_id, uri, refers_to, declared_digest, declared_bytes, length, payload_digest)`` of every reachable record; the digest is computed from the payload read."""
    order = Window.partitionBy("file", "block").orderBy("offset")
    cand = candidates(spark, path)
    cand = cand.withColumn("new", (F.coalesce(F.lag("successor").over(order), F.lit(-1)) != F.col("offset")).cast("int"))
    # a run is named by its first offset
    cand = materialize(cand.withColumn("run", F.max(F.when(F.col("new") == 1, F.col("offset"))).over(order)).drop("new"), "candidates")
    good = cand.join(_reached(cand), ["file", "run"]).where("valid and offset >= entry").drop("entry")
    columns = ["file", "offset", "record_type", "record_id", "uri", "refers_to", "declared_digest", "declared_bytes", "length"]
    if cand.where("valid and payload_digest is null").isEmpty():
        return good.select(*columns, "payload_digest")
    good = materialize(good, "records")
    return good.where("payload_digest is not null").select(*columns, "payload_digest").unionByName(_put_together(spark, path, cand, good).select(*columns, "payload_digest"))


def _put_together(spark: SparkSession, path: str, cand: DataFrame, good: DataFrame) -> DataFrame:
    """Records whose payload holds magic, digested over all their pieces. Only files that have some are read again."""
    broken = good.where("payload_digest is null")
    marked = cand.select("file", "block", "offset").join(good.select("file", "offset", F.lit(True).alias("real")), ["file", "offset"], "left")
    inside = F.last(F.when(F.col("real"), F.col("offset")), ignorenulls=True)
    blocks = marked.groupBy("file", "block").agg(F.max(F.when(F.col("real"), F.col("offset"))).alias("last"))
    carried = blocks.select("file", "block", F.max("last").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    owned = marked.withColumn("own", inside.over(Window.partitionBy("file", "block").orderBy("offset"))).join(carried, ["file", "block"]).select("file", "offset", F.coalesce("own", "carried").alias("owner"))
    owned = owned.join(broken.select("file", F.col("offset").alias("owner")), ["file", "owner"], "left_semi")
    again = _pieces(spark, path).join(broken.select("file").distinct(), "file", "left_semi").withColumn("size", F.octet_length("value").cast("long"))
    parts = _placed(again).join(owned, ["file", "offset"]).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: p.value), MAGIC)
    whole = broken.drop("payload_digest").join(parts.withColumnRenamed("owner", "offset"), ["file", "offset"])
    return whole.withColumn("payload_digest", F.sha2(_payload(body, F.col("head_bytes"), F.col("length")), 256))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives, read them back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to, uri)``. A stored payload that isn't what its record declares is an error."""
    path = path or scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    found = read_archives(pages.sparkSession, path)
    stored = F.col("record_type") == "response"
    digest = F.when(stored & (F.col("payload_digest") != F.col("declared_digest")), F.raise_error(F.concat(F.lit("damaged record "), "record_id"))).when(stored, F.col("payload_digest")).otherwise(F.col("declared_digest"))
    kind = dict(pages.dtypes)["page_id"]
    return found.select(
        F.col("record_id").cast(kind).alias("page_id"), F.when(stored, F.col("length")).otherwise(F.col("declared_bytes")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "uri"
    )
