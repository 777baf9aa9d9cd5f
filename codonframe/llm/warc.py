"""WARC archives: written with an index, read back through coalesced byte ranges.

Every record is a gzip member of its own. While a task writes its archive it
notes, for each record, offset, length, URL and payload digest; these rows are
the index. Reading selects records from the index first, deals them to tasks by
file and offset, and fetches neighbouring records with one sequential read.

Payloads of at least ``MIN_SHARED`` bytes that occur more than once are written
once, in the record with the smallest id; the others are revisit records, whose
HTTP header still states the payload's length. Archives and index lie in the
shared folder. A task that is run again writes a new file under a new name; the
index holds the rows of the run that was kept, so files of lost runs are never read.

Null payloads are empty. Rows with a null id never hold the shared payload,
unless all ids of that payload are null: then each is a response. Rows that
repeat the smallest id are responses, too. A null URL leaves its header out;
control characters in a URL are percent-encoded in the header and kept in the index.
Payloads of any length are written whole, each in one record. An empty table
gives an empty index and no archive. Columns beyond id, URL and html are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, stored

MIN_SHARED = 100
#: One read takes records whose gaps are at most ``MAX_GAP`` bytes, up to ``MAX_READ`` bytes; a task reads about ``TASK_BYTES``.
MAX_GAP, MAX_READ, TASK_BYTES = 1 << 16, 8 << 20, 32 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record, not yet compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    named = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {named}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: quote(m[0]), url))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), the payload that is there, and the full payload's length."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode("utf-8").split("\r\n")[1:])}
    http, _, payload = rest[: int(headers["content-length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"(?mi)^Content-Length: (\d+)\r?$", http)[1])
    return headers, payload, size


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def shared_payloads(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """digest and first id of the payloads that more than one row holds; ids only, no payload moves."""
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    thin = pages.select(F.sha2(body, 256).alias("_digest"), F.octet_length(body).alias("_n"), F.col(id_col).alias("_first")).where(F.col("_n") >= MIN_SHARED)
    return thin.groupBy("_digest").agg(F.min("_first").alias("_first"), F.count("*").alias("_rows")).where((F.col("_rows") > 1) & F.col("_first").isNotNull()).drop("_rows")


def write_archives(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Writes a record for each row; returns the index: page_id, url, payload_digest, record_type, refers_to, file, offset, length."""
    spark = pages.sparkSession
    to = shared_dir(spark)
    first = stored(shared_payloads(pages, id_col, html_col))
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("_html"), F.sha2(html.cast("binary"), 256).alias("_digest"))
    rows = rows.join(first, "_digest", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    rows = rows.select("page_id", "url", "_html", "_digest", revisit.alias("_revisit"), F.when(revisit, F.col("_first")).alias("refers_to"))
    key = rows.schema["page_id"].dataType.simpleString()
    names = ["page_id", "url", "payload_digest", "record_type", "refers_to", "file", "offset", "length"]

    def write(batches):
        files, base = _open(to)
        out = path = None
        at = 0
        try:
            for batch in batches:
                found = []
                for page_id, url, html, digest, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        files.create_dir(base, recursive=True)
                        path = f"{uuid.uuid4().hex}.warc.gz"
                        out = files.open_output_stream(f"{base}/{path}", compression=None)
                    kind = "revisit" if revisit else "response"
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = pack.compress(record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), digest, kind, refers_to)) + pack.flush()
                    out.write(member)
                    found.append((kind, at, len(member)))
                    at += len(member)
                n = len(found)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), batch.column(3), pa.array([x[0] for x in found], pa.string()), batch.column(5),
                    pa.array([f"{to}/{path}"] * n, pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()),
                ], names)
        finally:
            if out is not None:
                out.close()

    schema = f"page_id {key}, url string, payload_digest string, record_type string, refers_to {key}, file string, offset long, length long"
    return stored(rows.mapInArrow(write, schema))


def _ranges(places: list[tuple[str, int, int]]):
    """(file, begin, end, records) of each read; ``places`` are sorted by file and offset."""
    file, begin, end, held = None, 0, 0, []
    for i, (f, offset, length) in enumerate(places):
        if held and (f != file or offset - end > MAX_GAP or offset + length - begin > MAX_READ):
            yield file, begin, end, held
            held = []
        if not held:
            file, begin, end = f, offset, offset
        held.append(i)
        end = max(end, offset + length)
    if held:
        yield file, begin, end, held


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that rows of an index name: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    All columns but the ids and the URL come from the archives. Payloads are
    held against their digests. ``with_payload`` adds the payload a record itself holds.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // TASK_BYTES), index.sparkSession.sparkContext.defaultParallelism)
    rows = index.select("file", "offset", "length", "page_id", "url", "refers_to").repartitionByRange(int(tasks), "file", "offset").sortWithinPartitions("file", "offset")
    key = index.schema["page_id"].dataType.simpleString()
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    def read(batches):
        opened = (None, None)
        for batch in batches:
            places = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            found = [None] * len(places)
            for file, begin, end, held in _ranges(places):
                if opened[0] != file:
                    files, path = _open(file)
                    opened = (file, files.open_input_file(path))
                opened[1].seek(begin)
                data = opened[1].read(end - begin)
                for i in held:
                    _, offset, length = places[i]
                    headers, payload, size = parse_record(data[offset - begin : offset - begin + length])
                    digest, kind = headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"record at {offset} of {file} does not match its digest")
                    found[i] = (size, digest, kind) + ((payload,) if with_payload else ())
            kinds = [pa.int64(), pa.string(), pa.string(), pa.binary()]
            got = [pa.array([x[i] for x in found], kinds[i]) for i in range(4 if with_payload else 3)]
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4), *got[:3], batch.column(5), *got[3:]], names)

    schema = f"page_id {key}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {key}" + ", payload binary" * with_payload
    return rows.mapInArrow(read, schema)


def resolved(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where the payload of each of ``wanted``'s rows lies: a revisit gets file, offset and length of the response it refers to."""
    held = index.where(F.col("record_type") == "response").groupBy("payload_digest").agg(F.min_by(F.struct("file", "offset", "length"), F.struct("file", "offset")).alias("_at"))
    return wanted.drop("file", "offset", "length").join(held, "payload_digest").select("*", "_at.file", "_at.offset", "_at.length").drop("_at")
