"""WARC archives: writing captures, reading records, and assembling transactions."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, written
from .components import components

#: The profile named by a revisit record whose payload equals another's (WARC 1.1).
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2020-01-01T00:00:00Z"
SALTS = 64
RECORDS_A_FILE = 30_000  # a multiple of three, so that a capture's records stay together
LONGEST_FILE = (1 << 31) - (1 << 20)  # bytes of a file that one row of Spark can hold

RECORDS = (
    "record_id string, record_type string, concurrent_to array<string>, target_uri string, refers_to_id string, profile string, "
    "page_id long, block_bytes long, payload_bytes long, payload_digest string, http_status string, fields array<struct<name: string, value: string>>, payload binary, error string"
)


def deduplicated(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, top (the largest page_id of its payload, null for a small one), lone (whether
    one row only has it).

    Payloads of `least` bytes or more are equal if their SHA-1 and length are. The row with the largest page_id is the response that others
    revisit; rows that share it are all responses. A group of copies may hold a third of all rows: ids are first reduced by (digest, salt),
    and rows meet their leader by (digest, salt) too."""
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url].cast("string").alias("url"),
        F.coalesce(pages[html], F.lit("")).cast("binary").alias("payload")
    )
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    # two rows of one largest page_id differ in their random number, so its greatest and least are unequal
    keys = rows.where(F.col("payload_bytes") >= least).select("payload_digest", "payload_bytes", "salt", "page_id", F.rand(7).alias("r"))
    keys = keys.groupBy("payload_digest", "payload_bytes", "salt").agg(
        F.max(F.struct("page_id", "r")).alias("high"), F.max(F.struct("page_id", (-F.col("r")).alias("r"))).alias("low")
    )
    keys = keys.select(
        "payload_digest", "payload_bytes", "salt",
        F.struct(F.col("high.page_id").alias("page_id"), (F.col("high.r") == -F.col("low.r")).alias("lone")).alias("top")
    )
    # at most SALTS entries a group
    groups = keys.groupBy("payload_digest", "payload_bytes").agg(F.max("top").alias("top"), F.collect_list("salt").alias("salts"))
    leaders = groups.select(
        "payload_digest", "payload_bytes", F.explode("salts").alias("salt"), F.col("top.page_id").alias("top"),
        F.col("top.lone").alias("lone")
    )
    return rows.join(leaders, ["payload_digest", "payload_bytes", "salt"], "left")


def _record_id(role: str, capture: str = "capture") -> F.Column:
    h = F.md5(F.concat_ws("\n", F.lit(role), F.col(capture)))
    return F.concat(
        F.lit("<urn:uuid:"),
        *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]],
        F.lit(">")
    )


def write_captures(pages: DataFrame, path: str, least: int = 1000, **columns) -> None:
    """Writes request, response or revisit, and metadata records of every page as gzip-compressed WARC 1.1 files under `path`.

    Spark's own writer commits the files, so a lost task leaves none. All three records of a capture come from one row, so they
    lie in one file, of RECORDS_A_FILE records at most. A null html is an empty payload, a null url an empty target. Repeated page_ids are captures of
    their own. A revisit names its response by WARC-Refers-To, whose id follows from payload and page_id; where several rows share that page_id and
    payload it only names the page, by X-Refers-To-Page."""
    rows = deduplicated(pages, least, **columns).withColumn("is_revisit", F.coalesce(F.col("top") > F.col("page_id"), F.lit(False)))
    first = F.when(F.col("lone"), F.concat_ws("\n", "payload_digest", "payload_bytes", F.col("top").cast("string")))
    capture = F.when(F.col("top") == F.col("page_id"), F.col("first"))
    rows = rows.withColumn("first", first).withColumns({
        "capture": F.coalesce(capture, F.expr("uuid()")), "uri": F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20")
    })
    eol = "\r\n"

    def record(kind: F.Column | str, role: str, more: list, block: F.Column) -> F.Column:
        """Bytes of a record, without the two line ends after its block, which are the writer's row ends."""
        kind = F.lit(kind) if isinstance(kind, str) else kind
        lines = [
            F.lit("WARC/1.1"),
            F.concat(F.lit("WARC-Type: "), kind),
            F.concat(F.lit("WARC-Record-ID: "), _record_id(role)),
            F.lit(f"WARC-Date: {_DATE}"),
            F.concat(F.lit("WARC-Target-URI: "), F.col("uri")),
            F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string"))),
            *more,
            F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        ]
        return F.concat(F.concat_ws(eol, *lines), F.lit(eol * 2), block)

    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.upper("payload_digest"))
    http = F.concat_ws(
        eol, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=UTF-8"),
        F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string")), F.lit(""), F.lit("")
    )
    answer = record(
        F.when(F.col("is_revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        "response",
        [
            F.lit("Content-Type: application/http; msgtype=response"),
            digest,
            F.when(F.col("is_revisit"), F.lit(f"WARC-Profile: {SAME_PAYLOAD}")),
            F.when(F.col("is_revisit") & F.col("lone"), F.concat(F.lit("WARC-Refers-To: "), _record_id("response", "first"))),
            F.when(F.col("is_revisit"), F.concat(F.lit("X-Refers-To-Page: "), F.col("top").cast("string"))),
        ],
        F.when(F.col("is_revisit"), http).otherwise(F.concat(http, F.col("payload").cast("string"))),
    )
    along = F.concat(F.lit("WARC-Concurrent-To: "), _record_id("response"))
    request = record(
        "request", "request", [along, F.lit("Content-Type: application/http; msgtype=request")],
        F.concat(F.lit("GET "), F.col("uri"), F.lit(f" HTTP/1.1{eol}Accept: text/html{eol}{eol}"))
    )
    about = record(
        "metadata", "metadata", [along, F.lit("Content-Type: application/warc-fields")],
        F.concat(F.lit("payloadBytes: "), F.col("payload_bytes").cast("string"), F.lit(eol))
    )
    # a cast from binary keeps the bytes as they are, and the text writer writes them so
    rows.select(
        F.explode(F.array(request, answer, about)).alias("value")
    ).write.option("lineSep", eol * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def parse_records(data: bytes):
    """The records of one archive file, gzip-compressed or not: header fields (name, value) in order, and the block. ValueError at what
    isn't a whole WARC record, after those before it."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    try:
        while True:
            line = stream.readline()
            while line in (b"\r\n", b"\n"):
                line = stream.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            fields: list[list[str]] = []
            while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                if line[:1] in b" \t" and fields:
                    fields[-1][1] = f"{fields[-1][1]} {line.strip().decode('utf-8', 'replace')}".strip()
                    continue
                name, _, value = line.decode("utf-8", "replace").partition(":")
                fields.append([name.strip().lower(), value.strip()])
            declared = dict(fields).get("content-length", "")
            if not re.fullmatch("[0-9]+", declared):
                raise ValueError("a record without a length")
            block = stream.read(int(declared))
            if len(block) != int(declared):
                raise ValueError("a record is cut off")
            yield fields, block
    except (EOFError, OSError, zlib.error) as e:  # of the compressed stream
        raise ValueError(f"unreadable: {e}") from e


_TYPES = pa.schema(
    [
        ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()),
        ("refers_to_id", pa.string()), ("profile", pa.string())
    ]
    + [("page_id", pa.int64()), ("block_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("http_status", pa.string())]
    + [("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("payload", pa.binary()), ("error", pa.string())]
)
#: Header fields that have columns of their own.
_KNOWN = ("warc-record-id", "warc-type", "warc-concurrent-to", "warc-target-uri", "warc-refers-to", "warc-profile", "content-length")


def _long(text: str) -> int | None:
    """The number that a header field spells, if a long can hold it."""
    value = int(text) if re.fullmatch("-?[0-9]{1,19}", text) else None
    return value if value is not None and -(1 << 63) <= value < 1 << 63 else None


def _reader(payloads: bool):
    def row(pairs: list, block: bytes) -> dict:
        fields = dict(reversed(pairs))  # of a repeated field the first
        kind, http = fields.get("warc-type"), fields.get("content-type", "").startswith("application/http")
        head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        lines = head.decode("latin-1").split("\r\n")
        declared = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
        own = kind != "revisit"  # a revisit tells its payload's size and digest, and has none of its own
        digest = hashlib.sha1(payload).hexdigest() if own else fields.get("warc-payload-digest", "").rpartition(":")[2].lower() or None
        size = len(payload) if own else _long(declared.get("content-length", ""))
        return {
            "record_id": fields.get("warc-record-id"), "record_type": kind, "concurrent_to": [
                v for k, v in pairs if k == "warc-concurrent-to"
            ], "target_uri": fields.get("warc-target-uri"),
            "refers_to_id": fields.get("warc-refers-to"), "profile": fields.get("warc-profile"), "page_id": _long(fields.get("x-page-id", "")), "block_bytes": len(block),
            "payload_bytes": size, "payload_digest": digest, "http_status": lines[0] if http else None,
            "fields": [{"name": k, "value": v} for k, v in pairs if k not in _KNOWN], "payload": payload if payloads and own else None, "error": None,
        }

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                try:
                    for pairs, block in parse_records(data.as_buffer().to_pybytes()):
                        rows.append(row(pairs, block))
                        size += len(block) if payloads else 500
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _TYPES)
                            rows, size = [], 0
                except ValueError as e:
                    rows.append(dict.fromkeys(_TYPES.names) | {"concurrent_to": [], "fields": [], "error": f"{path}: {e}"})
                yield pa.RecordBatch.from_pylist(rows, _TYPES)

    return run


def read_records(spark, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under `path`, with the digest of the payload that was read (a revisit's: as it says).

    A file is one row of Spark's binaryFile source, read by one task; write_captures bounds its files. Where a file goes on with what isn't a whole
    record, and for a file of more than LONGEST_FILE bytes, which isn't opened, there is a row with `error` and nothing else."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path)
    records = files.where(F.col("length") <= LONGEST_FILE).select("path", "content").mapInArrow(_reader(payloads), RECORDS)
    fields = {f.name: f.dataType for f in records.schema.fields}
    empty = {
        "concurrent_to": F.array().cast(fields["concurrent_to"]), "fields": F.array().cast(fields["fields"]),
        "error": F.concat("path", F.lit(": too long to read"))
    }
    long_ = files.where(F.col("length") > LONGEST_FILE).select(*[empty.get(n, F.lit(None).cast(t)).alias(n) for n, t in fields.items()])
    return records.unionByName(long_)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id (the answer's record id, where there is an answer), answer (the response or revisit record),
    request, metadata (an array), others (an array).

    Records belong together if WARC-Concurrent-To fields connect them, in either direction and over any number of hops: a capture is a
    connected component of those links. Of several records of a role the one with the least values is taken as answer or request; the rest
    are in `others`, none is lost. A record that names nobody and is named by nobody is a capture of its own. Records without an id (bad
    ones among them) can't be named; they join what they name, or stand alone.

    Records go with the least id they name, or with themselves. Only where that doesn't settle a capture (a named record names others, or a
    record names several) are there links between such ids; their components are found on ids alone. Whole records are shuffled once, by
    capture."""
    named = lambda: F.array_sort(F.array_distinct(F.filter("concurrent_to", lambda c: c.isNotNull() & ~c.eqNullSafe(F.col("record_id")))))
    ids = records.select("record_id", named().alias("names")).where(F.size("names") > 0)
    edges = written(ids, "concurrent")
    hops = edges.where("record_id IS NOT NULL").join(
        edges.select(F.explode("names").alias("name")).distinct(), F.col("record_id") == F.col("name"), "left_semi"
    )
    hops = hops.select(F.col("record_id").alias("a"), F.col("names")[0].alias("b"))
    several = edges.where(F.size("names") > 1).select(F.col("names")[0].alias("a"), F.explode(F.slice("names", 2, 1 << 30)).alias("b"))
    links = written(hops.unionByName(several), "links")
    rows = records.select(F.coalesce(F.get(named(), F.lit(0)), "record_id", F.expr("uuid()")).alias("key"), F.struct(*records.columns).alias("rec"))
    if not links.isEmpty():
        roots = components(links)
        rows = rows.join(roots, rows["key"] == roots["node"], "left").select(F.coalesce("root", "key").alias("key"), "rec")
    kind = F.col("rec.record_type")
    role = F.when(kind.isin("response", "revisit"), "answer").when(kind == "request", "request").when(kind == "metadata", "metadata").otherwise("other")
    grouped = rows.groupBy("key").agg(*[F.sort_array(F.collect_list(F.when(role == r, F.col("rec")))).alias(r) for r in (
        "answer", "request", "metadata", "other"
    )])
    return grouped.select(
        F.coalesce(
            F.get("answer", F.lit(0))["record_id"], "key"
        ).alias("capture_id"), F.get("answer", F.lit(0)).alias("answer"), F.get("request", F.lit(0)).alias("request"), "metadata",
        F.concat(F.slice("answer", 2, 1 << 30), F.slice("request", 2, 1 << 30), "other").alias("others"),
    )


def archive_pages(pages: DataFrame, least: int = 1000, payloads: bool = True, path: str | None = None, **columns) -> DataFrame:
    """Writes the pages' captures under `path` (a new folder in the shared one by default), reads the archives back and gives one nested row per capture.

    Empty table: no rows. Null page_id: no X-Page-ID; it can't be a leader unless no other page of its payload has an id. Other columns are not read."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_captures(pages, path, least, **columns)
    return assemble(read_records(spark, path, payloads))
