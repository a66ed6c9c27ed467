"""WARC archives of pages: one gzip member per record, and a sequential reader that verifies digests.

Of pages with equal payloads of at least `revisit_bytes` bytes, the one with the largest id
is stored as a response and the others as revisits that refer to it; a revisit keeps the
HTTP header (which has the payload's length) and the payload's digest, but no payload.

The reader takes archives of other writers as well: records of all types, ids that are not
those of pages, header fields in any case and folded, digests of any known algorithm in
base 16 or 32, and records without digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwalk.llm import store

MANIFEST = "part int, path string, n_records long, n_bytes long"
RECORDS = "{id} long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean, payload binary, record_id string"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Says that a target URI, which had line breaks or outer white space, is written in percent codes.
CODED = "X-Target-URI-Coded"
#: Archives hold no clock of the run that wrote them.
DATE = "1970-01-01T00:00:00Z"
CHUNK = 1 << 16
#: Bytes of payload in one Arrow batch that the reader hands to Spark.
BATCH_BYTES = 4 << 20
#: Parts into which the rows of one payload are dealt when they look up their response.
SALTS = 32


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    """The page's id in a record id of this writer; null in any other."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def _digest(text: str | None) -> tuple[str, bytes] | None:
    """(algorithm, value) of a digest field, whose value is in base 16 or 32; null for one that cannot be read."""
    name, _, value = (text or "").strip().partition(":")
    name = name.lower().replace("-", "")
    if name not in hashlib.algorithms_available or not (size := hashlib.new(name).digest_size):
        return None
    try:
        return name, bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return None


def _holds(digest: tuple[str, bytes] | None, data: bytes) -> bool:
    """Whether data has the digest; one that is absent or unknown is not held against it."""
    return digest is None or hashlib.new(digest[0], data).digest() == digest[1]


def _header(raw: bytes) -> dict[str, str]:
    """Fields by lower-case name; a line that starts with white space carries the one before on, of repeated fields the first counts."""
    fields: list[list[str]] = []
    for line in raw.decode("utf-8", "surrogateescape").split("\r\n"):
        if line[:1] in (" ", "\t") and fields:
            fields[-1][1] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append([name.strip().lower(), value.strip()])
    return {name: value for name, value in reversed(fields)}


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, level: int = 6) -> bytes:
    """One record as a gzip member; refers_to makes it a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        coded = url != url.strip() or "\r" in url or "\n" in url
        fields.append(("WARC-Target-URI", urllib.parse.quote(url, safe="") if coded else url))
        if coded:
            fields.append((CODED, "1"))
    if refers_to is not None:
        fields += [("WARC-Refers-To", _record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def members(source) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a byte stream, inflated as its bytes arrive."""
    inflate, content, offset, read = zlib.decompressobj(31), [], 0, 0
    started = False
    chunk = source.read(CHUNK)
    while chunk:
        read += len(chunk)
        while chunk:
            started = True
            content.append(inflate.decompress(chunk))
            if not inflate.eof:
                break
            chunk = inflate.unused_data
            yield offset, b"".join(content)
            offset, started = read - len(chunk), False
            inflate, content = zlib.decompressobj(31), []
        chunk = source.read(CHUNK)
    if started:
        raise ValueError(f"the member at byte {offset} is cut short")


def parse(raw: bytes) -> dict:
    """The record in a member: header fields, and what content-length framing and the digests say.

    The payload of an HTTP message is what follows its header, that of any other record its
    block; a revisit has none, and its size and digest are those it declares, if any.
    """
    head, mark, rest = raw.partition(b"\r\n\r\n")
    version, _, head = head.partition(b"\r\n")
    if not mark or not version.startswith(b"WARC/"):
        raise ValueError("no WARC header")
    fields = _header(head)
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"content-length {length} does not frame {len(rest)} bytes")
    block, kind = rest[:length], fields["warc-type"].lower()
    http, payload = {}, block
    if fields.get("content-type", "").lower().startswith("application/http"):
        first, _, payload = block.partition(b"\r\n\r\n")
        http = _header(first.partition(b"\r\n")[2])
    declared = http.get("content-length", "")
    declared = int(declared) if declared.isdigit() and "transfer-encoding" not in http and "warc-truncated" not in fields else None
    revisit = kind == "revisit"
    digest = _digest(fields.get("warc-payload-digest"))
    ok = _holds(_digest(fields.get("warc-block-digest")), block) and (revisit or (_holds(digest, payload) and declared in (None, len(payload))))
    found = digest[1].hex() if digest and digest[0] == "sha1" else None if revisit else hashlib.sha1(payload).hexdigest()
    url = fields.get("warc-target-uri")
    return {
        "page_id": _page_id(fields.get("warc-record-id")),
        "url": urllib.parse.unquote(url) if url is not None and CODED.lower() in fields else url,
        "payload_bytes": declared if revisit else len(payload) if declared is None else declared,
        "payload_digest": found,
        "record_type": kind,
        "refers_to": _page_id(fields.get("warc-refers-to")),
        "digest_ok": ok,
        "payload": None if revisit else payload,
        "record_id": fields.get("warc-record-id"),
    }


def revisits(pages: DataFrame, revisit_bytes: int, id_col: str, html_col: str) -> DataFrame:
    """(id_col, digest, refers_to) of the pages to be stored as revisits; ids and digests move, payloads do not."""
    narrow = pages.where(F.octet_length(html_col) >= revisit_bytes).select(id_col, F.sha1(html_col).alias("digest"))
    groups = narrow.groupBy("digest").agg(F.max(id_col).alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = groups.select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = narrow.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
    return dealt.join(groups, ["digest", "salt"]).where(F.col(id_col) < F.col("refers_to")).select(id_col, "digest", "refers_to").distinct()


def write(pages: DataFrame, out: str, revisit_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes one record per row into archives under the URI `out`; returns their manifest, one row per archive.

    A null payload is an empty one, a null url leaves its field out, a null id is never
    referred to.  Rows that share the largest id of an equal payload are all responses.
    An archive is named after the task attempt that wrote it, and the manifest names those
    that Spark committed.
    """
    rows = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("_html"))
    again = revisits(rows, revisit_bytes, id_col, "_html")
    rows = rows.withColumn("digest", F.sha1("_html")).join(again, [id_col, "digest"], "left").select(id_col, "_url", "_html", "refers_to")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        uri = f"{out}/pages-{part:06d}-{context.taskAttemptId()}.warc.gz"
        sink, n_records, n_bytes = None, 0, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(k) for k in range(4)), strict=True):
                if sink is None:
                    fs, path = store.file_system(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    # the name ends in .gz, but the members are gzip as they are
                    sink = fs.open_output_stream(path, compression=None)
                raw = record(page_id.as_py(), url.as_py(), html.as_py(), refers_to.as_py())
                sink.write(raw)
                n_records, n_bytes = n_records + 1, n_bytes + len(raw)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [uri], "n_records": [n_records], "n_bytes": [n_bytes]})

    rows.mapInArrow(task, MANIFEST).write.parquet(f"{out}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{out}/manifest")


def read(spark: SparkSession, out: str, payloads: bool = True, id_col: str = "page_id") -> DataFrame:
    """All records of the archives that write() left under `out`: those of its manifest, as read_archives() gives them."""
    return read_archives(spark.read.schema(MANIFEST).parquet(f"{out}/manifest"), payloads, id_col)


def read_archives(archives: DataFrame, payloads: bool = True, id_col: str = "page_id", path_col: str = "path") -> DataFrame:
    """All records of the archives whose URIs stand in path_col, any writer's, in the columns of RECORDS; payload is null for revisits and unless asked for.

    Each archive is one sequential pass, and one that is named twice is read twice.  A record
    whose digest does not hold comes with digest_ok false; a broken header, frame or member
    fails with the archive's name and the place of the member.
    """
    schema = RECORDS.format(id=id_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                yield from _archive(uri, payloads, id_col)

    paths = archives.where(F.col(path_col).isNotNull()).select(F.col(path_col).alias("path"))
    n = max(1, paths.count())
    return paths.repartitionByRange(n, "path").mapInArrow(task, schema)


def _records(uri: str) -> Iterator[dict]:
    """The records of an archive; whatever is wrong with one is told with the archive's name and the member's place."""
    fs, path = store.file_system(uri)
    # bytes as they are: the members are inflated one by one here
    with fs.open_input_stream(path, compression=None) as source:
        found, offset = members(source), 0
        while True:
            try:
                offset, raw = next(found)
                row = parse(raw)
            except StopIteration:
                return
            except (ValueError, KeyError, zlib.error) as e:
                raise ValueError(f"{uri}, member at or after byte {offset}: {e}") from e
            yield row


def _archive(uri: str, payloads: bool, id_col: str) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.string()]
    rows: list[dict] = []
    held = 0

    def batch() -> pa.RecordBatch:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok", "payload", "record_id"]
        columns = [pa.array([r[name] for r in rows], kind) for name, kind in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, *names[1:]])

    for row in _records(uri):
        if not payloads:
            row["payload"] = None
        rows.append(row)
        held += 256 + len(row["payload"] or b"")
        if held >= BATCH_BYTES:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()
