"""WARC archives with revisit records, written by Spark and read back by their Content-Length."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_HEX, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FILE_BYTES = 16 << 20
END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four times 40 bits become 8 digits of base 32 each."""
    hexed = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.upper(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32)), 8, "0") for i in range(4)])
    return F.translate(digits, BASE32_HEX, BASE32)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def resolve_revisits(headers: DataFrame) -> DataFrame:
    """Headers (record_id, page_id, url, payload_digest, payload_bytes) with record_type, and of a revisit the original's id and URL.

    Of the records with one digest and length, that with the largest page_id (then record_id) is the response. Digests
    are partial-aggregated, then joined back; a digest that very many records share is split by the adaptive join.
    """
    first = cut(
        headers.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "record_id", "url")).alias("o")), "originals"
    )
    both = headers.join(first, ["payload_digest", "payload_bytes"])
    own = F.col("o.record_id") == F.col("record_id")
    return both.select(
        *headers.columns,
        F.when(own, "response").otherwise("revisit").alias("record_type"),
        F.when(~own, F.col("o.record_id")).alias("refers_to_record"),
        F.when(~own, F.col("o.url")).alias("refers_to_url"),
    )


def _warcinfo(date: str, about: str) -> str:
    """The record that tells of the archives, to which all others refer by its id, whatever file they lie in."""
    block = f"software: mosaique{END}format: WARC File Format 1.1{END}"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {about}", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return END.join([*head, "", block])


def _record(date: str, about: str) -> Column:
    """One record without the two line ends after it, as a string of its bytes."""
    clean = lambda c: F.regexp_replace(F.col(c), r"[\r\n]+", "%0A")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=UTF-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    block = F.when(F.col("record_type") == "response", F.concat(http, F.coalesce("html", F.lit("")))).otherwise(http)
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(F.col("record_type") == "revisit", PROFILE)),
        line("WARC-Refers-To", F.col("refers_to_record")),
        line("WARC-Refers-To-Target-URI", clean("refers_to_url")),
        line("WARC-Refers-To-Date", F.when(F.col("record_type") == "revisit", date)),
        line("WARC-Warcinfo-ID", F.lit(about)),
        line("X-Page-ID", F.col("page_id").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.length(http) + F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)).cast("string")),
        F.lit(END),
        block,
    )


def write_warcs(pages: DataFrame, path: str, date: str | None = None) -> None:
    """Writes one record per row of ``pages`` (page_id, url, html) to gzip archives under ``path``, and one that tells of them.

    Rows with a payload that a row of larger page_id has as well become revisit records without a payload. Headers are
    fresh: ``date`` is that of the call unless given. A null html is an empty payload, one of any length is written whole; a
    null url leaves out the target. Rows that are equal in page_id, url and html are told apart by a count, so that each gets
    its record. An empty table writes no archive. Payloads are shuffled once, to the rows' resolved headers, by a digest of
    what tells rows apart; digests travel as headers alone. Spark's text sink compresses a file as one gzip member.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    h = hashlib.md5(f"{path} {date}".encode()).hexdigest()
    about = f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"
    html = F.coalesce("html", F.lit(""))
    body = pages.select("page_id", "url", html.alias("html"), base32_sha1(F.encode(html, "UTF-8")).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "payload_digest", F.coalesce(F.concat(F.lit("u"), "url"), F.lit("-"))))
    headers = cut(
        body.withColumn("k", key).groupBy("k", "page_id", "url", "payload_digest", "payload_bytes").agg(F.count(F.lit(1)).alias("copies")), "headers"
    )
    total = headers.agg(F.sum(F.col("payload_bytes") * F.col("copies")), F.count(F.lit(1))).first()
    if not total[1]:
        return
    spread = headers.select("k", "page_id", "url", "payload_digest", "payload_bytes", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    spread = spread.withColumn("record_id", _uuid(F.lit(date), F.col("k"), F.col("copy").cast("string")))
    solved = resolve_revisits(spread)
    bodies = body.withColumn("k", key).select("k", "html")
    plain = solved.where("record_type = 'revisit'").withColumn("html", F.lit(""))
    # A response's payload is any of the rows with its key, as the key holds the digest.
    payloads = bodies.join(solved.where("record_type = 'response'").select("k").distinct(), "k", "left_semi").dropDuplicates(["k"])
    full = solved.where("record_type = 'response'").join(payloads, "k")
    files = max(1, -(-int(total[0] or 0) // FILE_BYTES))
    rows = full.select(*plain.columns).union(plain).select(_record(date, about).alias("value"))
    rows = rows.union(pages.sparkSession.createDataFrame([(_warcinfo(date, about),)], "value string"))
    rows.coalesce(files).write.option("lineSep", END + END).option("compression", "gzip").text(path)


def parse_warc(parts: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record of an uncompressed archive that comes in parts; lengths, not separators, bound the
    blocks. No more than a record and a part are held."""
    held, ended = bytearray(), False
    parts = iter(parts)

    def fill(n: int) -> bool:
        nonlocal ended
        while len(held) < n and not ended:
            more = next(parts, None)
            ended = more is None
            held.extend(more or b"")
        return len(held) >= n

    while True:
        while fill(2) and held.startswith(b"\r\n"):
            del held[:2]
        if not held:
            return
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                raise ValueError("an archive ends within a record's headers")
        lines = held[:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        length = int(head["Content-Length"])
        if not fill(end + 4 + length):
            raise ValueError(f"{head.get('WARC-Record-ID')} ends early")
        yield head, bytes(held[end + 4 : end + 4 + length])
        del held[: end + 4 + length]


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """Every record of a page under ``path``: ids, type, target, digest and length of the payload it holds (checked against its header).

    Spark's text reader decompresses an archive as a stream and parts it at blank lines; each task puts the parts of its
    files together again, record by record, so that it holds one record at a time and files can be of any size.
    """
    columns = ["record_id", "page_id", "url", "record_type", "payload_digest", "held_bytes", "refers_to_record"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        frame = lambda: pd.DataFrame(out, columns=columns).astype({"page_id": "Int64", "held_bytes": "int64"})
        for head, block in parse_warc(part + b"\r\n\r\n" for batch in batches for part in batch["value"]):
            digest, kind = head.get("WARC-Payload-Digest", "").removeprefix("sha1:"), head["WARC-Type"]
            if kind not in ("response", "revisit"):
                continue
            payload = block.partition(b"\r\n\r\n")[2]
            if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"digest of {head['WARC-Record-ID']} is wrong")
            page = head.get("X-Page-ID")
            out.append((head["WARC-Record-ID"], None if page is None else int(page), head.get("WARC-Target-URI"), kind, digest, len(payload), head.get("WARC-Refers-To")))
            if len(out) >= 10_000:
                yield frame()
                out.clear()
        yield frame()

    lines = spark.read.option("lineSep", END + END).option("pathGlobFilter", "*.gz").text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInPandas(parse, "record_id string, page_id long, url string, record_type string, payload_digest string, held_bytes long, refers_to_record string")


def resolved_records(records: DataFrame) -> DataFrame:
    """Read records with the payload's full length and the page a revisit refers to, by a join with the responses."""
    responses = cut(records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("held_bytes").alias("original_bytes")), "responses")
    revisits = records.where("record_type = 'revisit'").drop("held_bytes").join(responses, "refers_to_record")
    own = records.where("record_type = 'response'").select("page_id", "url", F.col("held_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.union(revisits.select("page_id", "url", F.col("original_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives ``pages`` in the shared folder and gives what a reader finds there, one row per page."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warcs(pages, path)
    if not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return resolved_records(cut(read_warcs(spark, path), "records"))
