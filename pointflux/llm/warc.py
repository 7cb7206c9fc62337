"""A content-addressed WARC archive.

``write_archive`` makes one WARC/1.1 record per page and stores it in two
tables: ``headers`` holds every record's exact header block and the digest of
its payload, ``payloads`` every payload once under that digest. ``read_archive``
verifies each stored payload against its address and joins the two back to the
original records.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

#: RFC 4648 base 32 against the digits of number bases.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
#: Payloads, those that repeat most bytes, whose copies are found by a broadcast: 10,000 rows of 40 bytes or so.
HOT = 10_000
#: Stands for a page without an id where ids are compared.
NO_PAGE = -(1 << 63)
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base 32 SHA-1 of a binary column: 40 hex digits, five to four letters."""
    return _base32(F.sha1(payload))


def _base32(hex40: Column) -> Column:
    fives = [F.lpad(F.conv(F.substr(hex40, F.lit(5 * i + 1), F.lit(5)), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fives), DIGITS, BASE32)


def _record_id(page_id: Column, digest: Column) -> Column:
    """A urn:uuid from page and payload, the same on every run."""
    h = F.sha1(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\r\n"))


def _bare(text: Column) -> Column:
    """A header value: line ends would start another header, so they are percent-encoded."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> None:
    """Archive ``pages`` below ``path``.

    A payload is the html in UTF-8, null: empty. Among records whose payloads are
    equal and hold ``min_bytes`` bytes or more, the one with the smallest page_id
    is the response and the others revisit it; shorter payloads are responses
    each. A null page_id sorts after every other and is written empty; rows that
    repeat the smallest page_id of their payload are responses all; null urls are
    empty, line ends in urls are percent-encoded. Payloads are addressed by
    SHA-256, and equal addresses must agree in SHA-1 and length, else writing
    fails. Other columns are ignored; an empty table gives an empty archive.

    Digests are made where the pages are read, and digests, ids and urls are
    shuffled alone. Copies of the HOT payloads that repeat most bytes are dropped
    where they are read; the payloads left cross the network once, and what other
    copies are among them is dropped after. HOT bounds what is broadcast, nothing else.
    """
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    named = rows.select("page_id", "url", F.sha2("payload", 256).alias("address"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    named = stage(named, "digests")
    firsts = named.groupBy("address").agg(F.min("page_id").alias("first"), F.min("sha1").alias("s0"), F.max("sha1").alias("s1"), F.min("bytes").alias("n0"), F.max("bytes").alias("n1"), F.count(F.lit(1)).alias("pages"))
    sound = F.when((F.col("s0") != F.col("s1")) | (F.col("n0") != F.col("n1")), F.raise_error(F.lit("two payloads share an address"))).otherwise(F.lit(True))
    firsts = stage(firsts.where(sound).select("address", "first", "pages", F.col("n0").alias("bytes")), "firsts")
    # HOT rows at most: their copies meet them by a broadcast, all other pages by a shuffle without hot keys.
    hot = stage(firsts.where("pages > 1").orderBy(F.desc(F.col("pages") * (F.col("bytes") + 256)), "address").limit(HOT).select("address", "first", F.lit(True).alias("hot")), "hot")
    firsts = firsts.select("address", "first")
    revisit = (F.col("bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    digest = _base32(F.col("sha1"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    stored = F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), digest)),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", _bare(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _record_id(F.col("first"), digest)), _line("X-Refers-To-Page", F.col("first")))).otherwise(F.lit("")),
        _line("X-Page", F.col("page_id")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(http) + stored),
        F.lit("\r\n"),
    )
    known = named.join(F.broadcast(hot), "address", "left")
    met = known.where("hot is null").drop("first", "hot").join(firsts, "address").unionByName(known.where("hot").drop("hot"))
    headers = met.select("address", F.encode(header, "UTF-8").alias("header"), F.encode(http, "UTF-8").alias("http"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")
    # The one page that brings an address its bytes; joining and removing repeated rows share one shuffle.
    own = lambda c: F.coalesce(F.col(c), F.lit(NO_PAGE)).alias("key")
    keep = firsts.select(own("first"), "address")
    held = rows.select(own("page_id"), F.sha2("payload", 256).alias("address"), "payload")
    held = held.join(F.broadcast(hot.select("address", own("first").alias("_first"))), "address", "left").where("_first is null or key = _first").drop("_first")
    held = held.join(keep, ["key", "address"], "left_semi")
    held.dropDuplicates(["key", "address"]).select("address", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: headers parsed, payloads verified, bytes put together on demand.

    Returns ``page_id, url, record_type, refers_to, payload_bytes, payload_digest,
    record``. ``payload_digest`` (base 32 SHA-1) and ``payload_bytes`` are made
    from the stored bytes; a payload that doesn't match its address, or differs
    from the digest in a record's header, fails the read. ``record`` is the
    original record, header block, HTTP header and, for a response, payload; a
    query that leaves it out moves no payload through the join.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) != F.col("address"), F.raise_error(F.lit("a stored payload does not match its address"))).otherwise(F.col("address"))
    payloads = payloads.select(sound.alias("address"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    text = F.decode("header", "UTF-8")
    value = lambda name: F.nullif(F.regexp_extract(text, rf"\r\n{re.escape(name)}: ([^\r]*)\r\n", 1), F.lit(""))
    headers = spark.read.parquet(f"{path}/headers").select(
        "address", "header", "http",
        value("X-Page").cast("long").alias("page_id"), F.coalesce(value("WARC-Target-URI"), F.lit("")).alias("url"),
        value("WARC-Type").alias("record_type"), value("X-Refers-To-Page").cast("long").alias("refers_to"), value("WARC-Payload-Digest").alias("said"),
    )
    digest = F.when(F.concat(F.lit("sha1:"), F.col("payload_digest")) != F.col("said"), F.raise_error(F.lit("a payload differs from its record's digest"))).otherwise(F.col("payload_digest"))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    record = F.concat("header", "http", body, F.encode(F.lit(END), "UTF-8"))
    return headers.join(payloads, "address").select("page_id", "url", "record_type", "refers_to", "payload_bytes", digest.alias("payload_digest"), record.alias("record"))
