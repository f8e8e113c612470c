"""WARC archives: written and read back by Spark.

Writing: one record for each page. Of pages with equal payloads (of at least
``min_bytes``) the one with the largest page_id is a response; the others are
revisits that refer to it and carry no payload. A record is one string, and
the text writer ends each with the record separator, so every part file is an
archive.

Reading: Spark splits the files at every occurrence of the version line, also
those inside payloads. A piece's offset is the sum of the sizes before it, first
inside blocks of ``PIECES`` pieces and then over blocks, so that no task needs a
whole file. Each piece that parses as a header is a candidate record and names
the offset of its successor. Candidates of a block that follow one another are
a run; pointer jumping over the runs' exits, from the start of each file, finds
where the chain enters runs, and what comes after an entry is reachable. Every
other piece is payload, also one that looks like a whole record, and is joined
to the record before it.

Edge cases: null html is an empty payload. Null page_ids and urls are written
as empty and come back null. Repeated rows each get a record; rows that tie in
payload and largest page_id are all responses. Empty tables give no records.
A very long payload is one string, as a record is one row; it is never cut.
Columns of the input other than page_id, url and html are not read, whatever
their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsflow.llm.common import bounded_broadcast, shared_dir, stage, table

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: RFC 4648 base 32, and the digits that Spark's conv() uses.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: A date of our own: archives of equal pages are equal.
DATE = "2024-01-01T00:00:00Z"
#: Repeated digests, and pieces of payloads, up to this many rows (under 100 MB) are broadcast.
BROADCAST_ROWS = 1_000_000
#: Pieces of a block inside an archive.
PIECES = 1024


def sha1_base32(data: Column) -> Column:
    """The bare upper-case base-32 SHA-1: 40 hex digits, five at a time."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with payload_bytes, payload_digest, record_type and refers_to.

    Only digests that occur again are joined to the pages. They are broadcast
    while they are few; beyond that Spark joins by shuffle.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", sha1_base32(F.col("html").cast("binary")))
    again = rows.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("_d")).agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    again = stage(again.where("_n > 1"), "warc-again")
    again = bounded_broadcast(again, again.count(), BROADCAST_ROWS)
    rows = rows.join(again, (F.col("payload_digest") == F.col("_d")) & (F.col("payload_bytes") >= min_bytes), "left")
    revisit = F.col("_d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def record_text(rows: DataFrame) -> Column:
    """A whole record but for the separator at its end."""
    header = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")
    revisit = F.col("record_type") == "revisit"
    url = F.regexp_replace("url", r"[\r\n]", " ")
    return F.concat(
        F.lit(VERSION), F.lit("WARC-Type: "), F.col("record_type"), F.lit("\r\n"),
        header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        F.lit(f"WARC-Date: {DATE}\r\n"), header("WARC-Target-URI", url),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        header("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.coalesce(F.col("refers_to").cast("string"), F.lit("")), F.lit(">")))),
        header("X-Payload-Length", F.col("payload_bytes")),
        header("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))),
        F.lit("\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "gzip") -> None:
    """Write an archive for each partition of the pages below ``path``.

    ``compression`` is that of Spark's text writer; archives with ``none`` can
    be read in splits.
    """
    rows = plan_records(pages, min_bytes)
    rows.select(record_text(rows).alias("value")).write.options(lineSep=END, compression=compression).text(path)


def _header(name: str) -> Column:
    return F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)$", 1)


def _pieces(spark: SparkSession, path: str, of_payload: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The archives cut at every version line: a row for each piece, with its text.

    file, split and nth name the piece; ``block`` is its group of PIECES pieces.
    ``head`` is null if no header follows; ``span`` is how far the header says
    that the record reaches. Where the piece holds exactly that it is ``whole``
    and has what ``of_payload`` makes of its payload.
    """
    raw = spark.read.option("lineSep", VERSION).text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"))
    ends = F.instr("value", END)
    raw = raw.withColumn("head", F.when(ends > 0, F.substring("value", F.lit(1), ends + 1)))
    length = F.regexp_extract("head", r"(?m)^Content-Length: ([0-9]{1,18})$", 1)
    raw = raw.withColumn("body", F.when(length != "", length.cast("long")))
    raw = raw.withColumn("size", F.octet_length("value").cast("long")).withColumn("span", F.octet_length("head") + 2 + F.col("body") + len(END))
    raw = raw.withColumn("whole", F.coalesce((F.col("size") == F.col("span")) & F.col("value").endswith(END), F.lit(False)))
    made = [F.when(F.col("whole"), f(_payload())).alias(name) for name, f in of_payload.items()]
    return stage(raw.select("file", "split", "nth", F.expr(f"nth div {PIECES}").alias("block"), "size", "span", "head", "whole", "value", *made), "warc-pieces")


def _payload() -> Column:
    """What follows the header in ``value``, without the separator."""
    return F.substring("value", F.length("head") + 3, F.length("value") - F.length("head") - 2 - len(END))


def _before(blocks: DataFrame, value: Column, name: str) -> DataFrame:
    """Blocks (file, split, block, ...) with an aggregate over the blocks before each in its file."""
    return blocks.withColumn(name, value.over(W.partitionBy("file").orderBy("split", "block").rowsBetween(W.unboundedPreceding, -1)))


_BLOCK = ["file", "split", "block"]


def _offsets(pieces: DataFrame) -> DataFrame:
    """file, split, block, nth, offset, successor (null for what is no candidate) and whole of every piece."""
    step = F.col("size") + len(VERSION)
    blocks = _before(pieces.groupBy(*_BLOCK).agg(F.sum(step).alias("n")), F.sum("n"), "before").select(*_BLOCK, F.coalesce("before", F.lit(0)).alias("before"))
    inside = W.partitionBy(*_BLOCK).orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    # A file begins with the version line: its first piece is empty and stands at minus the line's length.
    rows = pieces.select(*_BLOCK, "nth", "size", "span", "whole").join(blocks, _BLOCK)
    rows = rows.withColumn("offset", F.col("before") + F.sum(step).over(inside) - step - len(VERSION)).where("offset >= 0")
    return stage(rows.select(*_BLOCK, "nth", "offset", (F.col("offset") + len(VERSION) + F.col("span")).alias("successor"), "whole"), "warc-index")


def reachable(candidates: DataFrame) -> DataFrame:
    """The rows of ``candidates`` that the chain from offset 0 of each file reaches.

    ``candidates`` has file, split, block, offset and successor. Candidates of a
    block that follow one another make a run; from any of them the chain leaves
    by the run's exit. Only entries, which are exits of other runs or a file's
    start, need pointers: in each round every pointer is replaced by the pointer
    of what it points to, and what known entries point to becomes known. So the
    rounds are the logarithm of the number of runs in a file.
    """
    order = W.partitionBy(*_BLOCK).orderBy("offset")
    follows = F.coalesce(F.lag("successor").over(order) == F.col("offset"), F.lit(False))
    runs = candidates.withColumn("run", F.sum((~follows).cast("int")).over(order))
    runs = stage(runs.withColumn("exit", F.max("successor").over(W.partitionBy(*_BLOCK, "run"))), "warc-runs")
    targets = runs.select("file", F.col("exit").alias("offset")).union(runs.select("file", F.lit(0).cast("long").alias("offset"))).distinct()
    entries = stage(runs.join(targets, ["file", "offset"], "left_semi").select(*_BLOCK, "run", "offset", "exit"), "warc-entries")
    jump = entries.select("file", "offset", "exit")
    known = entries.where("offset = 0").select("file", "offset")
    size = known.count()
    while size:
        ahead = known.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        known = stage(known.union(ahead.join(entries.select("file", "offset"), ["file", "offset"])).distinct(), "warc-known")
        grown = known.count()
        if grown == size:
            break
        size = grown
        onward = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("next"))
        jump = stage(jump.join(onward, ["file", "exit"]).select("file", "offset", F.col("next").alias("exit")), "warc-jump")
    first = known.join(entries, ["file", "offset"]).groupBy(*_BLOCK, "run").agg(F.min("offset").alias("entry"))
    return runs.join(first, [*_BLOCK, "run"]).where("offset >= entry").select(*candidates.columns)


def read_archives(spark: SparkSession, path: str, of_payload: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """The records of all archives below ``path``: header values, and a column for each entry of ``of_payload``.

    By default that is the payload itself.
    """
    of_payload = of_payload or {"payload": lambda p: p}
    pieces = _pieces(spark, path, of_payload)
    index = _offsets(pieces)
    reached = stage(reachable(index.where("successor is not null")).select(*_BLOCK, "nth", "offset", "whole"), "warc-reached")
    name = ["file", "split", "nth"]
    sound = pieces.join(reached.where("whole").select(*name), name, "left_semi").select("head", *of_payload)
    # The others are in pieces: a version line stood inside the payload. Each goes to the last record that begins before it.
    begins = reached.select(*name, F.lit(True).alias("begins"))
    last = _before(reached.groupBy(*_BLOCK).agg(F.max("offset").alias("last")).join(index.select(*_BLOCK).distinct(), _BLOCK, "right"), F.max("last"), "carried").select(*_BLOCK, "carried")
    inside = W.partitionBy(*_BLOCK).orderBy("offset").rowsBetween(W.unboundedPreceding, 0)
    parts = index.join(begins, name, "left").join(last, _BLOCK, "left")
    parts = parts.withColumn("record", F.coalesce(F.max(F.when(F.col("begins"), F.col("offset"))).over(inside), F.col("carried")))
    parts = stage(parts.where("record is not null and not coalesce(begins and whole, false)").select(*name, "offset", "record"), "warc-parts")
    n = parts.count()
    rows = sound
    if n:
        broken = pieces.select(*name, "value").join(bounded_broadcast(parts, n, BROADCAST_ROWS), name)
        broken = broken.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))
        broken = broken.select(F.array_join(F.transform("parts", lambda x: x["value"]), VERSION).alias("value"))
        broken = broken.withColumn("head", F.substring("value", F.lit(1), F.instr("value", END) + 1))
        rows = sound.union(broken.select("head", *(f(_payload()).alias(name) for name, f in of_payload.items())))
    page = lambda name: F.regexp_extract(_header(name), "^<urn:page:(-?[0-9]*)>$", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    return rows.select(
        number(page("WARC-Record-ID")).alias("page_id"), _header("WARC-Target-URI").alias("url"), _header("WARC-Type").alias("record_type"),
        number(page("WARC-Refers-To")).alias("refers_to"), F.substring(_header("WARC-Payload-Digest"), 6, 32).alias("declared_digest"),
        _header("X-Payload-Length").cast("long").alias("declared_bytes"), *of_payload,
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/obsflow/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    rows = read_archives(spark, path, {"bytes": lambda p: F.octet_length(p).cast("long"), "digest": lambda p: sha1_base32(p.cast("binary"))})
    revisit = F.col("record_type") == "revisit"
    size = F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes"))
    digest = F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest"))
    return rows.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
