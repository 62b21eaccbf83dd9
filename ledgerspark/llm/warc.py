"""WARC archives: writing with revisits and segments, reading with reassembly.

Writing: every row is one record, with an id of its own. Of rows with equal payloads
that of the smallest page_id is a response, those of other page_ids revisit it. The block of a response is an HTTP message in chunked
transfer framing; a block over SEGMENT_BYTES is split into a first record and
continuation records that name the first as their origin. Each task writes one
file of gzip members.

Reading: each file is one stream of records. Whole records are decoded where they
are read; segments are dealt by their origin, ordered by number within it, joined,
checked against the total length that the last one states, and decoded.

Null pages count as empty. Repeated rows are records of their own: those of the smallest
page_id of a payload are all responses, and revisits refer to the first of them; rows
without page_id are never the smallest, and all responses where no row of the payload
has one. Very long pages are written and joined whole, one at a time; a page of
several segments is the only thing that a task gathers. An empty table gives no
archive. Only the three named columns are read, whatever else the table holds."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.common import written

#: Bytes of a record's block above which it is split; bytes of one transfer chunk.
SEGMENT_BYTES, CHUNK_BYTES = 1 << 12, 1 << 10
#: Payloads under these bytes are never revisited.
LEAST_REVISIT = 100

_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

RECORD = T.StructType(
    [
        T.StructField("origin_id", T.StringType(), False),
        T.StructField("segment", T.LongType(), False),
        T.StructField("total_bytes", T.LongType()),
        T.StructField("record_type", T.StringType(), False),
        T.StructField("page_id", T.LongType()),
        T.StructField("refers_to_id", T.StringType()),
        T.StructField("stated_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("block", T.BinaryType()),
    ]
)
_RECORD_ARROW = pa.schema(
    [("origin_id", pa.string()), ("segment", pa.int64()), ("total_bytes", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()),
     ("refers_to_id", pa.string()), ("stated_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary())]
)


def record_id(page_id: int | None, digest: str, copy: str = "") -> str:
    """The id of a row's record. Rows of one page_id and payload are told apart by
    ``copy``; revisits refer to the one where it is empty."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page_id}:{digest}{copy}')}>"


def chunked(payload: bytes) -> bytes:
    """The payload in chunked transfer framing."""
    out = []
    for at in range(0, len(payload), CHUNK_BYTES):
        part = payload[at : at + CHUNK_BYTES]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + n


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, copy: str, when: str) -> Iterator[bytes]:
    """The records of one page: a revisit, a response, or a response in segments."""
    mine = record_id(page_id, digest, copy)
    common = [("WARC-Date", when), ("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "about:blank"))]
    common += [("WARC-Payload-Digest", f"sha256:{digest}")] + ([("X-Page-ID", str(page_id))] if page_id is not None else [])
    http = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield record_bytes([("WARC-Type", "revisit"), ("WARC-Record-ID", mine), *common, ("WARC-Refers-To", record_id(refers_to, digest)), profile, http], b"")
        return
    block = _HTTP + chunked(payload)
    parts = [block[at : at + SEGMENT_BYTES] for at in range(0, len(block), SEGMENT_BYTES)]
    if len(parts) == 1:
        yield record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", mine), *common, http], block)
        return
    yield record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", mine), *common, ("WARC-Segment-Number", "1"), http], parts[0])
    for k, part in enumerate(parts[1:], 2):
        own = f"<urn:uuid:{uuid.uuid5(_NAMES, f'{mine}:{k}')}>"
        headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", when), ("WARC-Segment-Origin-ID", mine), ("WARC-Segment-Number", str(k))]
        yield record_bytes(headers + ([("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []), part)


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an open archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record is cut short")
        yield headers, block


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows that share page_id and payload, counted by their url and made anew with
    what tells them apart: nothing for one of each page_id and payload."""
    key = ["page_id", "digest"]
    counted = rows.groupBy(*key, "url", "first_id").agg(F.min("html").alias("html"), F.count("*").alias("n"))
    order = F.struct(F.col("url").isNull().alias("none"), "url")
    lead = counted.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.min(order).alias("lead"))
    both = counted.join(lead, F.col("page_id").eqNullSafe(F.col("_page_id")) & (F.col("digest") == F.col("_digest")))
    both = both.select(*key, "url", "html", "first_id", F.col("url").eqNullSafe(F.col("lead.url")).alias("lead"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    told = F.concat(F.lit(":"), F.col("k").cast("string"), F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit(":"), "url")))
    return both.repartition("digest", "k").select("page_id", "url", "html", "digest", "first_id", F.when(F.col("lead") & (F.col("k") == 1), "").otherwise(told).alias("copy"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> list[str]:
    """Writes the archives; returns the paths, one entry a file."""
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha2("html", 256))
    # What is told about pages that share their payload or their id: a row for each
    # (page_id, payload), so that neither copies nor repeated rows meet in one task.
    each = rows.select("page_id", "digest", F.octet_length("html").alias("n")).groupBy("page_id", "digest").agg(F.first("n").alias("n"), F.count("*").alias("rows"))
    each = written(each, "warc-pages")
    firsts = each.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("ids"), F.first("n").alias("n"))
    firsts = written(firsts.where((F.col("n") >= LEAST_REVISIT) & (F.col("ids") > 1) & F.col("first_id").isNotNull()).select("digest", "first_id"), "warc-firsts")
    told = each.join(firsts, "digest", "left").withColumn("first_id", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))
    told = written(told.where("first_id IS NOT NULL OR rows > 1").select("page_id", "digest", "first_id", "rows"), "warc-told")
    same = F.col("r.page_id").eqNullSafe(F.col("a.page_id")) & (F.col("r.digest") == F.col("a.digest"))
    own = ["r.page_id", "r.url", "r.html", "r.digest", "a.first_id"]
    joined = rows.alias("r").join(told.alias("a"), same, "left").where("a.rows IS NULL OR a.rows = 1").select(*own, F.lit("").alias("copy"))
    repeated = told.where("rows > 1")
    if repeated.limit(1).count():
        joined = joined.unionByName(_repeated(rows.alias("r").join(repeated.alias("a"), same).select(*own)))
    when = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        draft, n = f"{at}/.{name}.{uuid.uuid4().hex[:8]}", 0
        with fs.open_output_stream(draft) as sink:
            for batch in batches:
                columns = [batch.column(i) for i in range(6)]
                for page_id, url, html, digest, first, copy in zip(*columns):
                    for data in page_records(page_id.as_py(), url.as_py(), html.as_py().encode("utf-8", "surrogatepass"), digest.as_py(), first.as_py(), copy.as_py(), when):
                        sink.write(data)
                        n += 1
        if n:
            fs.move(draft, f"{at}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})
        else:
            fs.delete_file(draft)

    return sorted(r.path for r in joined.mapInArrow(run, "path string").collect())


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per record: whole ones decoded, segments with their block."""
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                size = 0
                with fs.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw)) as f:
                    for headers, block in records(f):
                        rows.append(_row(headers, block))
                        size += len(rows[-1][-1] or b"")
                        if len(rows) >= 1000 or size > 1 << 24:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD_ARROW)], schema=_RECORD_ARROW)


def _row(headers: dict[str, str], block: bytes) -> tuple:
    number = headers.get("warc-segment-number")
    total = headers.get("warc-segment-total-length")
    stated = (headers.get("warc-payload-digest") or "").removeprefix("sha256:") or None
    page = headers.get("x-page-id")
    kept = (
        headers.get("warc-segment-origin-id") or headers["warc-record-id"], int(number or 1), int(total) if total else None, headers["warc-type"],
        int(page) if page is not None else None, headers.get("warc-refers-to"), stated,
    )
    if number or headers["warc-type"] != "response":
        return *kept, None, None, block if number else None
    payload = payload_of(block)
    return *kept, len(payload), hashlib.sha256(payload).hexdigest(), None


def reassembled(found: DataFrame) -> DataFrame:
    """One row per record, segments joined. Rows of a record come together, in
    order of their number, and pass as a stream: a task holds one record."""
    dealt = found.repartition("origin_id").sortWithinPartitions("origin_id", "segment")

    def finish(parts: list[dict]) -> tuple:
        first = parts[0]
        if first["segment"] != 1 or first["record_type"] == "continuation":
            raise ValueError(f"{first['origin_id']} lacks its first segment")
        blocks = {p["segment"]: p for p in parts if p["block"] is not None}
        if not blocks:
            return tuple(first.values())
        numbers = sorted(blocks)
        block = b"".join(blocks[k]["block"] for k in numbers)
        if numbers != list(range(1, len(numbers) + 1)) or blocks[numbers[-1]]["total_bytes"] != len(block):
            raise ValueError(f"{first['origin_id']} isn't whole")
        payload = payload_of(block)
        done = first | {"total_bytes": len(block), "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "block": None}
        return tuple(done.values())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and held[0]["origin_id"] != row["origin_id"]:
                    out.append(finish(held))
                    held = []
                held.append(row)
            if out:
                yield _batch(out)
        if held:
            yield _batch([finish(held)])

    return dealt.mapInArrow(run, RECORD)


def read_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type and
    refers_to; a revisit takes its payload's size from the record it refers to."""
    whole = written(reassembled(read_records(spark, paths)).drop("block", "segment"), "warc-records")
    bad = F.raise_error(F.concat(F.lit("payload digest differs in "), F.col("origin_id")))
    whole = whole.withColumn("payload_digest", F.when((F.col("record_type") == "response") & (F.col("payload_digest") != F.col("stated_digest")), bad).otherwise(F.col("payload_digest")))
    responses = whole.where("record_type = 'response'")
    revisits = whole.where("record_type = 'revisit'").select("page_id", "refers_to_id")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    referred = responses.select(F.col("origin_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    joined = revisits.join(referred, "refers_to_id", "left").withColumn("record_type", F.lit("revisit"))
    return responses.select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(joined.select(*columns, "refers_to"))
