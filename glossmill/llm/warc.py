"""Deterministic sharded WARC archives, written and read by Spark tasks."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import partitions, written
from .skew import heavy_keys, spread_join

#: About how many keys, those with the least hashes, the borders of the shards come from.
SAMPLE = 20_000
#: Compressed bytes after which a file is rolled.
ROLL_BYTES = 32 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 14
MANIFEST = "name string, temp string, shard int, seq int, records long, bytes long, sha1 string"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _digest(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _record_id(key: int | None, sha: str, place: int) -> str:
    """The same record has the same id in every run."""
    made = hashlib.sha1(f"{'' if key is None else key}\n{sha}\n{place}".encode()).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=made, version=5)}>"


def _header_safe(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # its header has no time
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _page(key: int | None, sha: str, place: int, url: str | None, payload: bytes, again: bool, first: int | None, date: str) -> bytes:
    """A response, or a revisit (``again``) of page ``first``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if again else http + payload
    fields = [
        ("WARC-Type", "revisit" if again else "response"),
        ("WARC-Record-ID", _record_id(key, sha, place)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _header_safe(url) if url else f"urn:page:{'' if key is None else key}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{_digest(sha)}"),
        ("WARC-Block-Digest", f"sha1:{_digest(hashlib.sha1(block).hexdigest())}"),
    ]
    fields += [] if key is None else [("X-Page-Id", str(key))]
    if again:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _record_id(first, sha, 0))]
        fields += [] if first is None else [("X-Refers-To-Page-Id", str(first))]
    return _member(fields, block)


def _place(cuts: list, key: Column) -> Column:
    """How many of the ascending ``cuts`` are not above ``key``: first by blocks of them, then inside one."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) or 1
    lits = lambda rows: F.array(*[F.struct(F.lit(bool(u)).alias("unnamed"), F.lit(int(k)).cast("long").alias("key"), F.lit(s).alias("sha")) for u, k, s in rows])
    upto = lambda some: F.size(F.filter(some, lambda c: c <= key))
    block = upto(lits(cuts[step - 1 :: step]))
    return (block * step + upto(F.slice(lits(cuts), block * step + 1, F.lit(step)))).cast("int")


def write_warc(pages: DataFrame, out: str, min_payload: int = 0, roll_bytes: int = ROLL_BYTES, date: str = "2000-01-01T00:00:00Z", shards: int | None = None) -> DataFrame:
    """A WARC record per row of ``pages`` (page_id, url, html) in the new folder ``out``; returns the manifest.

    Records are sorted by page_id, then digest of the payload, over ``shards`` ranges (as many
    as shuffle partitions, unless given) whose borders come from about ``SAMPLE`` keys, those with
    the least hashes, so the same rows give the same bytes. Each range is a run of files, rolled
    after ``roll_bytes`` compressed bytes, a gzip member for each record. Headers and digests are
    made anew from the payload. Of equal payloads of ``min_payload`` bytes or more, that of the
    smallest page_id is a response and others are revisits of it.

    Tasks write under temporary names of their own; Spark commits the list of those that count;
    a second job moves these to their names, again if it is run again, and the manifest follows
    last. What lost tasks leave is never read, and removed at the end.

    ``out`` must be a folder that all executors share, in a file system that pyarrow opens.
    A null html is an empty payload; an empty one is a record too. A null url becomes
    ``urn:page:``. A null page_id counts as larger than all others and is left out of the headers
    (a revisit of one has a null reference). Rows that repeat page_id and payload are revisits of
    the first of them. An empty table gives an empty manifest. Further columns are ignored.
    """
    spark = pages.sparkSession
    n = shards or partitions(spark)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").isNull().alias("unnamed"), F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("key"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    slim = written(rows.select("unnamed", "key", "sha", F.octet_length("payload").alias("size")))

    total = slim.count()
    share = min(1.0, SAMPLE / max(1, total))
    some = slim.select("unnamed", "key", "sha").where(F.pmod(F.xxhash64("unnamed", "key", "sha"), F.lit(1 << 40)) < int(share * (1 << 40))).distinct().collect()
    some = sorted((r.unnamed, r.key, r.sha) for r in some)
    cuts = sorted({some[i * len(some) // n] for i in range(1, n)} if some else set())
    shard = _place(cuts, F.struct("unnamed", "key", "sha")).alias("shard")

    # who is a revisit is decided on keys and digests; the rows say it just before the pages they are about
    place = F.struct("unnamed", "key")
    first = slim.where(F.col("size") >= min_payload).groupBy("sha").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    known = spread_join(slim.drop("size"), first, "sha", heavy_keys(slim, "sha", total, n)).where(place > F.col("first")).select("unnamed", "key", "sha", "first").distinct()
    none = lambda c: F.lit(None).cast(c)
    known = known.select(shard, "unnamed", "key", "sha", F.lit(0).alias("kind"), none("string").alias("url"), none("binary").alias("payload"), F.when(~F.col("first.unnamed"), F.col("first.key")).alias("first"))
    both = rows.select(shard, "unnamed", "key", "sha", F.lit(1).alias("kind"), "url", "payload", none("long").alias("first")).unionByName(known)
    both = both.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "unnamed", "key", "sha", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(out)
        store.create_dir(f"{root}/_temporary", recursive=True)
        stream, entry, sha1 = None, None, None
        same, place, told, first, shard, seq = None, 0, False, None, None, 0

        def close() -> pa.RecordBatch:
            stream.close()
            return pa.RecordBatch.from_pylist([entry | {"sha1": sha1.hexdigest()}], schema=pa.schema([("name", pa.string()), ("temp", pa.string()), ("shard", pa.int32()), ("seq", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

        def put(data: bytes, records: int) -> None:
            stream.write(data)
            sha1.update(data)
            entry["bytes"] += len(data)
            entry["records"] += records

        for batch in batches:
            cols = [batch.column(c) for c in ("shard", "unnamed", "key", "sha", "kind", "url", "payload", "first")]
            for i in range(batch.num_rows):
                s, unnamed, key, sha, kind, url, payload, of = (c[i].as_py() for c in cols)
                key = None if unnamed else key
                if (key, sha) != same:
                    same, place, told, first = (key, sha), 0, False, None
                if not kind:
                    told, first = True, of
                    continue
                if stream is not None and (s != shard or entry["bytes"] >= roll_bytes):
                    yield close()
                    stream = None
                if stream is None:
                    shard, seq = s, (0 if s != shard else seq + 1)
                    name = f"part-{s:06d}-{seq:05d}.warc.gz"
                    entry = {"name": name, "temp": f"{uuid.uuid4().hex}-{name}", "shard": s, "seq": seq, "records": 0, "bytes": 0}
                    stream, sha1 = store.open_output_stream(f"{root}/_temporary/{entry['temp']}", compression=None), hashlib.sha1()
                    info = f"format: WARC File Format 1.1\r\nisPartOf: shard {s}\r\n".encode()
                    put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(s, "info", seq)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info), 0)
                repeated = place > 0 and len(payload) >= min_payload and not told
                put(_page(key, sha, place, url, payload, told or repeated, key if repeated else first, date), 1)
                place += 1
        if stream is not None:
            yield close()

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(out)
        store.create_dir(f"{root}/data", recursive=True)
        for batch in batches:
            for r in batch.to_pylist():
                there = store.get_file_info(f"{root}/data/{r['name']}")
                if there.type != fs.FileType.File or there.size != r["bytes"]:
                    store.move(f"{root}/_temporary/{r['temp']}", f"{root}/data/{r['name']}")
            yield batch

    store, root = _store(out)
    store.create_dir(f"{root}/data", recursive=True)
    both.mapInArrow(write, MANIFEST).write.parquet(f"{out}/_staging")
    spark.read.schema(MANIFEST).parquet(f"{out}/_staging").mapInArrow(commit, MANIFEST).drop("temp").write.parquet(f"{out}/manifest")
    if store.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
        store.delete_dir(f"{root}/_temporary")
    return spark.read.parquet(f"{out}/manifest")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a file of gzip members."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof and at < len(view):
            parts.append(unpack.decompress(view[at : at + _CHUNK]))
            at = min(at + _CHUNK, len(view))
        at -= len(unpack.unused_data)
        if not unpack.eof:
            raise ValueError("a record is cut off")
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        size = int(fields["content-length"])
        if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        yield fields, rest[:size]


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """The records of an archive that ``write_warc`` committed.

    ``page_id, url, record_type, payload`` (null for revisits), ``payload_bytes``,
    ``payload_digest`` and ``refers_to``. Digests are recomputed on the way; a difference, or files
    that the manifest doesn't have as they are, raise an error. A task holds one file at a time.
    """
    manifest = spark.read.parquet(f"{out}/manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{out}/data")
    said = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if tuple(said) != tuple(files.select("path", "length").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()):
        raise ValueError(f"{out}: its files are not those of the manifest")
    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found, size = [], 0
                for fields, block in records(batch.column("content")[i].as_py()):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    response, digest = fields["warc-type"] == "response", fields["warc-payload-digest"].removeprefix("sha1:")
                    if f"sha1:{_digest(hashlib.sha1(block).hexdigest())}" != fields["warc-block-digest"] or response and _digest(hashlib.sha1(payload).hexdigest()) != digest:
                        raise ValueError(f"{fields['warc-record-id']}: its digest differs")
                    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                    to_int = lambda name: int(fields[name]) if name in fields else None  # noqa: B023, E731
                    found.append({"page_id": to_int("x-page-id"), "url": fields["warc-target-uri"], "record_type": fields["warc-type"], "payload": payload if response else None, "payload_bytes": length, "payload_digest": digest, "refers_to": to_int("x-refers-to-page-id")})
                    size += len(payload)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(found, schema=kinds)
                        found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=kinds)

    return files.select("content").mapInArrow(parse, schema)
