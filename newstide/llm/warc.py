"""WARC archives: written by tasks, read back by tasks that each scan a range of bytes.

An archive is a file of gzip members, one a record. Writers are tasks; each
names its file anew, and a table of what the finished tasks wrote says which
files count, so a task that is lost or run twice leaves nothing that is read.
Readers need no index: a task looks in its range for the gzip magic, takes what
decodes to a whole record with sound headers, and owns the records that start
inside its range, however far they reach beyond it. Files are opened through
``pyarrow.fs``, which knows local, HDFS, S3 and GCS addresses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import salted_join
from .cluster import checkpoint_dir, materialise, parquet

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range, and bytes read from a file at once.
RANGE_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
#: Bytes after which a writer begins a new file.
FILE_BYTES = 256 << 20
#: Fixed value: the profile of revisits that equal payload digests make.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
WRITTEN = "path string, records long, bytes long"
READ = "path string, start long, size long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, payload_digest string, payload_bytes long, payload binary, sound boolean"


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of an address; ``file:/x`` is understood too."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", address) if ":" in address.split("/")[0] else "file://" + address)


def record(kind: str, record_id: str, uri: str | None, date: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP headers of its payload, and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {quote(uri, safe=_VISIBLE)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(["WARC/1.1", *lines, "", ""]).encode()) + squeeze.compress(block + b"\r\n\r\n") + squeeze.flush()


#: Signs of an address that stand as they are; spaces and control signs would end or split a header.
_VISIBLE = "".join(map(chr, range(0x21, 0x7F)))


def fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-cased name, the first line left out; the first of equal names stays."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


class Window:
    """A file's bytes from where its reader stands, read block by block."""

    def __init__(self, file, start: int, size: int, block: int = BLOCK_BYTES):
        self.file, self.begin, self.size, self.block = file, start, size, block
        self.held, self.used = bytearray(), 0

    @property
    def at(self) -> int:
        return self.begin + self.used

    def more(self) -> bool:
        """Another block; false at the file's end."""
        del self.held[: self.used]
        self.begin, self.used = self.at, 0
        far = self.begin + len(self.held)
        if far >= self.size:
            return False
        self.file.seek(far)
        self.held += self.file.read(min(self.block, self.size - far))
        return True

    def peek(self, a: int, b: int) -> bytes:
        """Bytes a to b from here, fewer at the file's end."""
        while len(self.held) - self.used < b and self.more():
            pass
        return bytes(self.held[self.used + a : self.used + b])

    def find(self, what: bytes) -> bool:
        """Move on to the next ``what``; false if there is none in what is held, and all but what may be its beginning is passed."""
        place = self.held.find(what, self.used)
        self.used = place if place >= 0 else max(self.used, len(self.held) - len(what) + 1)
        return place >= 0


#: Bytes given to the decoder at once.
PIECE = 1 << 14


def member(window: Window) -> tuple[int, bytes] | None:
    """Size and content of the gzip member that begins where the window stands; None if none does, or if it isn't a WARC record.

    What decodes to something else than a version line is given up at once. A
    record must have the fields that every record needs, be as long as its
    Content-Length says, and be followed by the file's end or another member.
    """
    inflate, whole, fed = zlib.decompressobj(31), bytearray(), 0
    try:
        while not inflate.eof:
            piece = window.peek(fed, fed + PIECE)
            if not piece:
                return None
            fed += len(piece)
            whole += inflate.decompress(piece)
            if len(whole) >= 5 and not whole.startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    used, whole = fed - len(inflate.unused_data), bytes(whole)
    head, found, rest = whole.partition(b"\r\n\r\n")
    own = fields(head) if found and whole.startswith(b"WARC/") else {}
    if any(n not in own for n in NEEDED) or not own["content-length"].isdigit() or len(rest) != int(own["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        return None
    return (used, whole) if MAGIC.startswith(window.peek(used, used + len(MAGIC))) else None


def scan(file, start: int, end: int, size: int, block: int = BLOCK_BYTES) -> Iterator[tuple[int, int, bytes]]:
    """(start, size, content) of every record whose member starts at ``start`` or later and before ``end``."""
    window = Window(file, start, size, block)
    while window.at < end:
        if not window.find(MAGIC):
            if not window.more():
                return
        elif window.at < end:
            found = member(window)
            if found is None:
                window.used += 1
            else:
                yield window.at, *found
                window.used += found[0]


def parsed(whole: bytes) -> dict:
    """What a record says. The payload of a response is what follows its HTTP headers, and digest and length are the payload's
    own; of a revisit they are what its headers say. ``sound``: the payload has the SHA-1 that the header says (null if it can't be told)."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    own, payload = fields(head), rest[:-4]
    algorithm, _, said = own.get("warc-payload-digest", "").partition(":")
    said = base64.b32decode(said, True).hex() if algorithm.lower() == "sha1" and re.fullmatch("[A-Za-z2-7]{32}", said) else None
    length = None
    if own.get("content-type", "").replace(" ", "").startswith("application/http"):
        http, _, payload = payload.partition(b"\r\n\r\n")
        length = fields(http).get("content-length")
    if own["warc-type"] == "revisit":
        facts = {"payload_digest": said, "payload_bytes": int(length) if length and length.isdigit() else None, "payload": None, "sound": None}
    else:
        digest = hashlib.sha1(payload).hexdigest()
        facts = {"payload_digest": digest, "payload_bytes": len(payload), "payload": payload, "sound": None if said is None else digest == said}
    named = {"record_type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri", "warc_date": "warc-date"}
    return {k: own[v].strip("<>") if v in own else None for k, v in named.items()} | facts


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(path, records, bytes) of the files that hold ``records``: record_type, record_id, refers_to, target_uri, warc_date and payload (binary; null: empty).

    Each partition is one file, or more where it is longer than ``file_bytes``.
    The answer is evaluated here, once, and only files that it names count.
    """

    def run(batches):
        out, place, held = None, None, [0, 0]

        def close():
            out.close()
            return pa.RecordBatch.from_pylist([{"path": place, "records": held[0], "bytes": held[1]}])

        for batch in batches:
            for cells in zip(*batch.columns, strict=True):  # row by row: payloads may be long
                row = dict(zip(batch.schema.names, (c.as_py() for c in cells), strict=True))
                if out is None:
                    place, held = f"{folder}/{uuid.uuid4().hex}.warc.gz", [0, 0]
                    system, path = opened(place)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                made = record(row["record_type"], row["record_id"], row["target_uri"], row["warc_date"], row["payload"] or b"", row["refers_to"])
                out.write(made)
                held = [held[0] + 1, held[1] + len(made)]
                if held[1] >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialise(records.select("record_type", "record_id", "refers_to", "target_uri", "warc_date", "payload").mapInArrow(run, WRITTEN))


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES, block: int = BLOCK_BYTES) -> DataFrame:
    """Every record of ``files`` (path, bytes), as the columns of ``READ``.

    Ranges of ``range_bytes`` are dealt to tasks. A record belongs to the range
    that its member starts in; what isn't a record is passed over. A task holds
    one record and a block at a time, so a record may be longer than a range.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, path = opened(row["path"])
                rows, held = [], 0
                with system.open_input_file(path) as file:
                    for start, size, whole in scan(file, row["begin"], row["begin"] + range_bytes, row["bytes"], block):
                        rows.append({"path": row["path"], "start": start, "size": size} | parsed(whole))
                        held += len(whole)
                        if held > range_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(READ))
    width = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("begin"))
    return ranges.repartition(width, "path", "begin").mapInArrow(run, READ)


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``pages`` with payload (the html in UTF-8; null: empty) and refers_to: the largest page_id with an equal payload of
    ``least`` bytes or more, where that is another's; else null.

    Payloads are equal if their SHA-256 and length are. Only payloads that more
    than one row has are joined, dealt over copies of their row, so a payload of
    very many pages is no one task's.
    """
    p = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("spread", F.xxhash64("page_id", "url"))
    long = F.octet_length("payload") >= least
    keyed = p.withColumn("key", F.when(long, F.concat_ws("-", F.sha2("payload", 256), F.octet_length("payload").cast("string"))).otherwise(F.col("spread").cast("string")))
    lead = keyed.where(long).groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("lead")).where("n > 1").select("key", "lead")
    joined = salted_join(keyed, lead, "key", "spread", "left")
    return joined.select("page_id", "url", "payload", F.when(F.coalesce(F.col("page_id") != F.col("lead"), F.col("lead").isNotNull()), F.col("lead")).alias("refers_to"))


def archived(pages: DataFrame, folder: str | None = None, least: int = 1000, date: str = "2024-01-01T00:00:00Z", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) written as WARC records and read back: page_id and the columns of ``READ``, refers_to a page_id.

    Every row gets a record, rows that repeat a page_id or have none too. Of rows
    with an equal payload of ``least`` bytes or more, those with the largest
    page_id are responses and the others revisit it; where none of them has a
    page_id all are responses. An empty table gives no rows. Only the three
    columns are read. The files go into ``folder``, which the driver and all
    executors must share; by default a new one in the session's shared folder,
    where they stay as long as the result is to be read.
    """
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = with_revisits(pages, least)
    records = rows.select(
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), name("page_id").alias("record_id"), F.when(F.col("refers_to").isNotNull(), name("refers_to")).alias("refers_to"),
        F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), F.when(F.octet_length("payload") > 0, F.col("payload")).alias("payload"),
    )
    number = lambda c: F.nullif(F.regexp_replace(c, "^urn:page:", ""), F.lit("")).cast("long")
    back = read_archives(write_archives(records, folder), range_bytes)
    return back.withColumns({"page_id": number("record_id"), "refers_to": number("refers_to")})


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(parquet(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages), l AS (SELECT h, max(page_id) AS lead FROM p WHERE n >= 1000 GROUP BY h)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN lead IS NULL OR page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead THEN lead END AS refers_to
    FROM p LEFT JOIN l USING (h)"""
