"""WARC archives written from pages, and read back as a table of chunks.

Writing is a Spark text write: a record is a header block, an HTTP head and the payload,
and the separator of rows is the pair of line breaks that ends a WARC record, so the files
are plain WARC and are committed as any Spark output.

Reading streams: a task walks its file through a buffer of fixed size and gives rows of
record identifier and chunk number.  Each carries the number of payload bytes and the digest
up to its end, so the last chunk of a record holds those of the whole payload and no record
is ever held in memory at once.
"""

import hashlib
import sys

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspan.operators.sizing import lookup_side

CHUNK_BYTES = 1 << 20
LEAST_REVISIT_BYTES = 1000
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = b"\r\n\r\n"
CHUNKS = (
    "page_id long, record_type string, refers_to long, declared_digest string, declared_bytes long, "
    "chunk_no long, chunk binary, payload_bytes long, payload_digest string, last boolean"
)


def with_record_types(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Payload, digest, record type and target of revisits for every page.

    Of pages with equal payloads of `least` bytes or more that with the largest page_id is
    the response and the others revisit it.  A null page_id counts as smaller than any; a
    group of nulls only, and rows that repeat the largest page_id, are all responses.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload.cast("binary")).alias("digest"),
    )
    large = pages.where(F.col("bytes") >= least).groupBy("digest", "bytes")
    groups = large.agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1").drop("n")
    typed = pages.join(lookup_side(groups, "responses"), ["digest", "bytes"], "left")
    revisit = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    return typed.select(
        "page_id", "url", "payload", "bytes", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("target")).alias("refers_to"),
    )


def _line(name: str, value) -> F.Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def write_archives(typed: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """A WARC file per task below `folder`, with a record per row of `with_record_types`.

    Line breaks in a url are percent-encoded; a null url has no header line, a null page_id
    the identifier urn:page:null.  An empty table gives archives without records.
    """
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    urn = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))
    is_response = F.col("record_type") == "response"
    length = F.lit(len(_HTTP)) + F.when(is_response, F.col("bytes")).otherwise(0)
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", urn(F.col("page_id"))),
        _line("WARC-Target-URI", url), _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Payload-Length", F.col("bytes").cast("string")),
        _line("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), urn(F.col("refers_to")))),
        F.when(is_response, F.lit("")).otherwise(
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
        ),
        F.lit("Content-Type: application/http;msgtype=response\r\n"), _line("Content-Length", length.cast("string")),
    )
    record = F.concat(header, F.lit("\r\n" + _HTTP), F.when(is_response, F.col("payload")).otherwise(""))
    typed.select(record.alias("value")).write.option("lineSep", _END.decode()).text(folder)


class Buffered:
    """A stream read by delimiter and by amount, through a buffer of one chunk."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.held = stream, size, b""

    def _more(self) -> bool:
        found = self.stream.read(self.size)
        self.held += found
        return bool(found)

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the mark, None at the end of the stream."""
        at = self.held.find(mark)
        while at < 0:
            known = max(len(self.held) - len(mark), 0)
            if not self._more():
                if self.held:
                    raise ValueError("a record is cut off")
                return None
            at = self.held.find(mark, known)
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def take(self, amount: int):
        """The next bytes, in parts of a buffer at most."""
        while amount:
            if not self.held and not self._more():
                raise ValueError("a record is cut off")
            part, self.held = self.held[:amount], self.held[amount:]
            amount -= len(part)
            yield part


def _number(urn: str | None):
    value = urn.strip("<>").rpartition(":")[2] if urn else "null"
    return None if value == "null" else int(value)


def _records(stream, size: int):
    """Rows of chunks of every record of an open archive."""
    source = Buffered(stream, size)
    while (head := source.until(_END)) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:80]}")
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        block = int(fields["content-length"])
        http = source.until(_END)
        digest, seen, number, left = hashlib.sha1(), 0, 0, block - len(http) - len(_END)
        about = {
            "page_id": _number(fields["warc-record-id"]), "record_type": fields["warc-type"],
            "refers_to": _number(fields.get("warc-refers-to")),
            "declared_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
            "declared_bytes": int(fields["warc-payload-length"]),
        }
        for part in source.take(left) if left else [b""]:
            digest.update(part)
            seen += len(part)
            yield about | {"chunk_no": number, "chunk": part, "payload_bytes": seen,
                           "payload_digest": digest.copy().hexdigest(), "last": seen == left}
            number += 1
        if b"".join(source.take(len(_END))) != _END:
            raise ValueError("a record does not end where its length says")


def _reading(size: int, with_payload: bool):
    def read(batches):
        schema = pa.schema([
            ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared_digest", pa.string()),
            ("declared_bytes", pa.int64()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()), ("last", pa.bool_()),
        ])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inner = fs.FileSystem.from_uri(path)
                with system.open_input_stream(inner) as stream:
                    rows, held = [], 0
                    for row in _records(stream, size):
                        held += len(row["chunk"])
                        rows.append(row if with_payload else row | {"chunk": None})
                        if held >= 4 * size or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return read


def read_chunks(spark: SparkSession, folder: str, size: int = CHUNK_BYTES, with_payload: bool = True) -> DataFrame:
    """The chunk table of all archives of a folder; an archive is read by one task.

    `chunk` is null without payloads.  A record has at least one chunk, empty if it has no
    payload; records that end early or disagree with their length are errors.
    """
    files = spark.read.format("binaryFile").load(folder).select("path").where("length > 0")
    # Names only are dealt out, one to a task as far as there are tasks.
    names = files.repartition(max(1, len(files.inputFiles())))
    return names.mapInArrow(_reading(size, with_payload), CHUNKS)


def stored_records(chunks: DataFrame) -> DataFrame:
    """One row per record: length and digest of its full payload, for revisits as declared."""
    revisit = F.col("record_type") == "revisit"
    return chunks.where("last").select(
        "page_id", F.when(revisit, F.col("declared_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to",
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
