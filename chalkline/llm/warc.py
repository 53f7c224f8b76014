"""WARC archives: written as text files, read back by following record boundaries.

The magic line that opens a record may also occur inside a payload, so a scan
can only find candidates. Each candidate states where its record ends, hence
its successor. Tasks emit (offset, successor) pairs, pointer jumping from the
start of each file keeps the candidates that a chain of true records reaches,
and every other one is payload.

Spark's text reader, with the magic as line separator, cuts files of any size
into splits and returns raw bytes. A separator belongs to one segment, so
lengths summed over splits give exact offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.llm.scratch import Scratch

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: A record states fewer bytes than this; a larger number is payload that looks like a header, and would overflow.
LARGEST = 1 << 60
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(hexed: Column) -> Column:
    """Upper-case base32 of a digest of 40 hexadecimal digits: 20 bytes are 32 letters without padding."""
    bits = F.lpad(F.conv(F.substring(hexed, 1, 10), 16, 2), 40, "0")
    for part in (11, 21, 31):
        bits = F.concat(bits, F.lpad(F.conv(F.substring(hexed, part, 10), 16, 2), 40, "0"))
    letters = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda i: F.substring(F.lit(BASE32), F.conv(F.substring(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1)),
    )
    return F.array_join(letters, "")


def _clean(x: Column) -> Column:
    """A header value: no line breaks."""
    return F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"[\r\n]+", " ")


def write_warc(pages: DataFrame, path: str, id_col: str, url: str, payload: str) -> None:
    """Writes a record for each row of ``pages`` into uncompressed WARC files under ``path``.

    Of rows with equal payloads (null counts as empty) those with the smallest
    id are response records, the others revisit records that carry the HTTP
    header alone and name the id they refer to. Null ids are the largest. Rows
    that repeat a smallest id are all responses. Extra columns are ignored.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("_id"), F.col(url).alias("_url"), body.alias("_body"), F.sha1(body.cast("binary")).alias("_sha")
    )
    # One row for each digest that repeats. As a table its size is known, so payloads are shuffled only where it is
    # too large to broadcast; the hot digest of the other side is then split by the skew join.
    first = rows.groupBy("_sha").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    first = Scratch(pages.sparkSession, "digests").keep(first, "first")
    told = rows.join(first, "_sha", "left")
    revisit = F.col("_first").isNotNull() & (F.col("_id").isNull() | (F.col("_id") > F.col("_first")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("_body").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("_body")))
    urn = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("none")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        urn(F.col("_id")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        _clean(F.col("_url")),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT}\r\nWARC-Refers-To: "), urn(F.col("_first")))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        base32_sha1(F.col("_sha")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
    )
    told.select(record.alias("value")).write.option("lineSep", END).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The stretches between magics: file, split, place in the split, bytes."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("_at"),
        F.octet_length("value").cast("long").alias("_len"),
        "value",
    )


def _header(value: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(F.substring_index(value, END, 1), rf"(?im)^{name}: *([^\r\n]*)", 1), F.lit(""))


def _candidates(segments: DataFrame) -> DataFrame:
    """Header fields of each segment and, where the segment is the whole of its record, the digest of the payload."""
    head = F.octet_length(F.substring_index("value", END, 1)).cast("long")
    length = F.expr("try_cast(_length AS BIGINT)")
    text = lambda x: x.cast("string")
    inner = F.expr("substring(CAST(value AS BINARY), int(_head + 5), int(_content))")  # the HTTP message
    http = F.expr("substring_index(CAST(_inner AS STRING), '\r\n\r\n', 1)")
    return (
        segments.withColumn("_head", head)
        .withColumn("_length", _header(F.col("value"), "Content-Length"))
        .withColumn("_content", F.when((F.col("_head") < F.col("_len")) & length.between(0, LARGEST), length))
        .withColumn("whole", F.coalesce(F.col("_head") + 4 + F.col("_content") + 4 == F.col("_len"), F.lit(False)))
        .withColumn("_inner", F.when(F.col("whole"), inner))
        .withColumn("_http", text(http))
        .withColumn("_body", F.expr("substring(_inner, int(octet_length(_http) + 5))"))
        .select(
            "file",
            "split",
            "_at",
            "_len",
            (F.col("_head") + 4 + F.col("_content") + 4 + len(MAGIC)).alias("_reach"),
            "whole",
            F.regexp_extract(_header(F.col("value"), "WARC-Record-ID"), "^<urn:page:(.*)>$", 1).alias("record_id"),
            _header(F.col("value"), "WARC-Type").alias("record_type"),
            F.regexp_extract(_header(F.col("value"), "WARC-Refers-To"), "^<urn:page:(.*)>$", 1).alias("refers_to"),
            _header(F.col("value"), "WARC-Payload-Digest").alias("stated_digest"),
            F.regexp_extract("_http", r"(?im)^Content-Length: *(\d+)", 1).alias("stated_bytes"),
            F.octet_length("_body").cast("long").alias("body_bytes"),
            F.sha1("_body").alias("body_sha1"),
        )
    )


def _placed(candidates: DataFrame) -> DataFrame:
    """Adds ``ord`` (place in the split) and ``start``, the byte at which the segment's magic begins."""
    step = F.col("_len") + len(MAGIC)
    upto = W.partitionBy("file", "split").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = candidates.withColumn("ord", F.row_number().over(upto)).withColumn("_in", F.sum(step).over(upto) - step)
    splits = candidates.groupBy("file", "split").agg(F.sum(step).alias("_bytes"))
    before = splits.select("file", "split", (F.sum("_bytes").over(W.partitionBy("file").orderBy("split")) - F.col("_bytes")).alias("_before"))
    # What precedes the first magic of a file is a segment without one; it takes the place -len(MAGIC).
    return inside.join(before, ["file", "split"]).withColumn("start", F.col("_before") + F.col("_in") - len(MAGIC)).drop("_in", "_before", "_at")


def _reached(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, start) of the candidates that the chain from byte 0 reaches, by pointer jumping.

    In round k a pointer spans 2^k records. Both the set reached and the
    pointers double, so a file of n records takes log2(n) rounds.
    """
    links = placed.where("_reach IS NOT NULL AND start >= 0").select("file", "start", (F.col("start") + F.col("_reach")).alias("to"))
    starts = links.select("file", F.col("start").alias("to"))
    jumps = scratch.keep(links.join(starts, ["file", "to"], "left_semi").select("file", "start", "to"), "jumps")
    found = scratch.keep(placed.where("start = 0 AND _reach IS NOT NULL").select("file", "start"), "reached")
    while not jumps.isEmpty():
        onward = jumps.join(found, ["file", "start"], "left_semi").select("file", F.col("to").alias("start"))
        grown = scratch.keep(found.unionByName(onward), "reached")
        far = jumps.select("file", F.col("start").alias("to"), F.col("to").alias("far"))
        doubled = scratch.keep(jumps.join(far, ["file", "to"]).select("file", "start", F.col("far").alias("to")), "jumps")
        for old in (jumps, found):
            scratch.drop(old)
        jumps, found = doubled, grown
    return found


def _payload_of_open(spark: SparkSession, path: str, placed: DataFrame, records: DataFrame) -> DataFrame:
    """(file, start, _whole) of reached records whose payload holds the magic: their segments, put together again."""
    opened = records.where("NOT whole").select("file", F.col("start").alias("_from"), (F.col("start") + F.col("_reach")).alias("_to"), F.col("_reach").alias("_reach0"))
    # Segments up to the next reached record belong to this one: the last start inside the split, else the last of the splits before.
    marked = placed.join(records.select("file", "start", F.lit(True).alias("_true")), ["file", "start"], "left")
    marked = marked.join(opened.select("file").distinct(), "file", "left_semi").withColumn("_begins", F.when(F.col("_true"), F.col("start")))
    inside = F.last("_begins", ignorenulls=True).over(W.partitionBy("file", "split").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow))
    earlier = F.max("_last").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    carried = marked.groupBy("file", "split").agg(F.max("_begins").alias("_last")).select("file", "split", earlier.alias("_carried"))
    wanted = (
        marked.withColumn("_inside", inside)
        .join(carried, ["file", "split"])
        .withColumn("_from", F.coalesce("_inside", "_carried"))
        .join(opened, ["file", "_from"])
        .select("file", "split", "ord", "start", "_from", "_reach0")
    )
    rows = _segments(spark, path)
    ordinal = F.row_number().over(W.partitionBy("file", "split").orderBy("_at"))
    texts = (
        rows.join(wanted.select("file", "split").distinct(), ["file", "split"], "left_semi")
        .withColumn("ord", ordinal)
        .select("file", "split", "ord", "value")
    )
    parts = F.array_sort(F.collect_list(F.struct("start", "value")))
    return (
        wanted.join(texts, ["file", "split", "ord"])
        .groupBy("file", "_from", "_reach0")
        .agg(F.array_join(F.transform(parts, lambda x: x["value"]), MAGIC).alias("value"))
        .select("file", F.col("_from").alias("start"), "value", F.octet_length("value").cast("long").alias("_len"))
    )


FIELDS = ["file", "start", "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "stated_digest"]


def _fields(records: DataFrame) -> DataFrame:
    revisit = F.col("record_type") == "revisit"
    return records.select(
        "file",
        "start",
        "record_id",
        "record_type",
        F.nullif("refers_to", F.lit("")).alias("refers_to"),
        F.when(revisit, F.expr("try_cast(stated_bytes AS BIGINT)")).otherwise(F.col("body_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("stated_digest", "^sha1:", "")).otherwise(base32_sha1(F.col("body_sha1"))).alias("payload_digest"),
        F.regexp_replace("stated_digest", "^sha1:", "").alias("stated_digest"),
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``: FIELDS.

    ``payload_digest`` of a response is computed from the bytes read; a revisit
    has that of its header. Empty files give no records; a file whose first
    bytes are no record gives none either; a chain that breaks ends there.
    """
    scratch = Scratch(spark, "warc")
    placed = scratch.keep(_placed(_candidates(_segments(spark, path))), "candidates")
    records = scratch.keep(placed.join(_reached(placed, scratch), ["file", "start"], "left_semi"), "records")
    found = _fields(records.where("whole"))
    if records.where("NOT whole").isEmpty():
        return found
    joined = _payload_of_open(spark, path, placed, records).select(
        "file", F.lit(0).cast("long").alias("split"), F.col("start").alias("_at"), "_len", "value"
    )
    again = _candidates(joined).withColumn("start", F.col("_at")).where("whole")
    return found.unionByName(_fields(again))
