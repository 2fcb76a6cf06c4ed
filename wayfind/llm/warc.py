"""WARC archives with revisit records for repeated payloads.

Headers alone are shuffled by payload digest; the record with the smallest id of equal
payloads of at least ``MIN_REVISIT_BYTES`` is the response, the others revisit it. The
decisions are joined back to the captures, and the archives are written with fresh
headers through Spark's own text writer: a record without its closing blank lines is one
value and these lines are the separator, so the files are plain WARC, gzipped as a whole,
in whatever store the path is in, and a lost task's file is written again by the committer.
They are read back as a stream of such pieces, which records are cut from by
their stated lengths, so that no task holds more than one record of an archive.
"""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.llm.batches import map_texts
from wayfind.storage import materialize

MIN_REVISIT_BYTES = 100
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archives are cut after as many records as hold this many payload bytes on average, as
#: each is read by one task.
ARCHIVE_BYTES = 16 << 20
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def decide(captures: DataFrame) -> DataFrame:
    """(page_id, payload_digest, record_type, refers_to, refers_url) for each distinct capture.

    ``captures`` has page_id, url, payload_bytes and payload_digest. Rows of one id and payload
    are one capture. A null id sorts last and is a response only among nulls.
    """
    large = captures.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    first = large.groupBy("payload_digest").agg(least).select(F.col("payload_digest").alias("_digest"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    each = captures.select("page_id", "payload_bytes", "payload_digest").distinct()
    key = F.when(F.col("payload_bytes") >= MIN_REVISIT_BYTES, F.col("payload_digest")).otherwise(F.concat(F.lit("small "), F.col("payload_digest")))
    joined = each.withColumn("_key", key).join(first, F.col("_key") == F.col("_digest"), "left")
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    of_revisit = [F.when(revisits, F.col(c)).alias(name) for c, name in (("first_id", "refers_to"), ("first_url", "refers_url"))]
    return joined.select("page_id", "payload_digest", F.when(revisits, "revisit").otherwise("response").alias("record_type"), *of_revisit)


def _header_safe(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\p{Cc}]", " ")


def records(pages: DataFrame, decisions: DataFrame, date: str) -> DataFrame:
    """(record string): one WARC record for each page, without its closing blank lines.

    ``pages`` has page_id, url, payload, payload_bytes and payload_digest; ``date`` is the
    records' WARC-Date. Ids stand percent-encoded in the records' names.
    """
    on = [pages["page_id"].eqNullSafe(decisions["page_id"]), pages["payload_digest"] == decisions["payload_digest"]]
    both = pages.join(decisions, on, "inner").select(
        pages["page_id"], "url", "payload", "payload_bytes", pages["payload_digest"], "record_type", "refers_to", "refers_url"
    )
    response = F.col("record_type") == "response"
    name = lambda c: F.concat(F.lit("<urn:page"), F.coalesce(F.concat(F.lit(":"), F.url_encode(c.cast("string"))), F.lit("")), F.lit(">"))
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value, F.lit("\r\n"))
    block = F.when(response, F.concat(F.lit(_HTTP), F.col("payload"))).otherwise(F.lit(_HTTP))
    revisit = F.concat(
        line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(F.col("refers_to"))),
        line("WARC-Refers-To-Target-URI", _header_safe(F.col("refers_url"))), line("WARC-Refers-To-Date", F.lit(date)),
    )
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _header_safe(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(response, F.lit("")).otherwise(revisit),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    return both.select(record.alias("record"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str | None = None) -> None:
    """Write a deduplicated archive of ``pages`` under ``path``.

    A null payload is empty; ids may be of any type that a string can be cast to. ``date`` is
    that of the headers (None: now). An empty table leaves a folder without records.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    headers = materialize(own.select("page_id", "url", "payload_bytes", "payload_digest"), "headers")
    total, n = headers.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    decisions = materialize(decide(headers), "decisions")
    per_file = max(1, ARCHIVE_BYTES * n // max(total, 1))
    records(own, decisions, date).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


# --- reading ------------------------------------------------------------------------------


class RecordStream:
    """Records of an archive that comes in pieces; their stated lengths are trusted, not separators."""

    def __init__(self) -> None:
        self.held, self.headers, self.size = bytearray(), None, 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """(headers, block) of each record that the piece completes."""
        self.held += piece
        while True:
            if self.headers is None:
                end = self.held.find(b"\r\n\r\n")
                if end < 0 or self.held == END.encode():
                    return
                first, *lines = self.held[:end].decode("utf-8").split("\r\n")
                if not first.startswith("WARC/"):
                    raise ValueError("no record where one should begin")
                self.headers = dict(x.split(": ", 1) for x in lines)
                self.size = int(self.headers["Content-Length"])
                del self.held[: end + 4]
            if len(self.held) < self.size + 4:
                return
            headers, block = self.headers, bytes(self.held[: self.size])
            self.headers = None
            del self.held[: self.size + 4]
            yield headers, block

    def close(self) -> None:
        """The end of an archive; only the separator after an unended last piece may be left."""
        if self.headers is not None or self.held not in (b"", END.encode()):
            raise ValueError("an archive ends within a record")
        self.held.clear()


def _id_of(urn: str | None) -> str | None:
    return unquote_plus(urn[len("<urn:page:") : -1]) if urn not in (None, "<urn:page>") else None


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(page_id, url, record_type, stated_digest, payload_bytes, payload_digest, refers_to, payload).

    Size and digest of a response are those of the payload that was read; a revisit has
    neither here, nor a payload (see ``resolve``). Ids are cast to ``id_type``.
    """
    schema = "page_id string, url string, record_type string, stated_digest string, payload_bytes bigint, payload_digest string, refers_to string, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def row(headers: dict[str, str], block: bytes) -> tuple:
        payload = block.partition(b"\r\n\r\n")[2]
        response = headers["WARC-Type"] == "response"
        return (
            _id_of(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:"),
            len(payload) if response else None, hashlib.sha256(payload).hexdigest() if response else None, _id_of(headers.get("WARC-Refers-To")), payload if response else None,
        )

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, file = RecordStream(), None
        for batch in batches:  # pieces of one file come in order, one file after another
            made = []
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if name != file:
                    stream.close()
                    file = name
                made += [row(*record) for record in stream.feed(piece.as_py() + END.encode())]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names)
        stream.close()

    pieces = spark.read.option("lineSep", END).text(path)
    read = map_texts(pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")), each, schema)
    return read.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def resolve(read: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) with revisits looked up.

    A revisit takes size and digest from the response that it refers to; one whose response
    is missing, or has another digest than it states, has null for both.
    """
    read = read.select("page_id", "record_type", "stated_digest", "payload_bytes", "payload_digest", "refers_to")
    original = read.where("record_type = 'response' and page_id is not null").select(
        F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")
    ).distinct()
    on = (F.col("refers_to") == F.col("_id")) & (F.col("stated_digest") == F.col("_digest"))
    found = read.join(original, on, "left")
    return found.select(
        "page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "_digest").alias("payload_digest"), "record_type", "refers_to"
    )
