"""Deterministic sharded WARC writer and reader.

Records are range-sorted by (page_id, payload digest), so the bytes of every
archive depend on the rows alone. A task writes gzip members to a temporary
name, rolls to the next file once the compressed size is reached, and reports
its files; the driver renames the reported files of the successful attempts and
commits ``MANIFEST.json`` the same way, by a temporary name and a rename. Files
of lost or repeated attempts are never listed and go with the temporary folder.

Of records with equal payloads (of at least ``min_payload`` bytes) the largest
page_id is a ``response``; the others are ``revisit`` records that refer to it.
The groups are found on (page_id, SHA-1) alone: partial aggregation, then a
narrow join. The few resulting references travel to the writer through the same
range partitioning as the records (a union, merged by the sort), so payloads
are shuffled once.

Defined cases: null html is an empty payload; null url is written as
``urn:page:<id>``; a record without page_id is always a response and is read
back with null page_id; repeated rows that share the largest page_id are all
responses; an empty table gives a manifest without files; a folder that holds a
manifest or archives already is refused before anything is written. Extra columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from adagium.llm.common import shared_dir

NAMESPACE = uuid.UUID("6b1f4a52-5d0e-5c52-9a3c-3f4f8b6f2d10")
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "file string, temp string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
TARGET_BYTES = 32 << 20


def open_shared(path: str, mode: str):
    """A stream on the shared folder: any file system that Arrow knows by its scheme (file, hdfs, viewfs, s3, gs)."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    if mode == "rb":
        return system.open_input_stream(inner)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>"


def _clean(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def record_bytes(page_id, url, payload: bytes, sha1: bytes, refers_to) -> bytes:
    """One WARC/1.1 record with regenerated headers and digests."""
    digest = b32(sha1)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url) if url is not None else f'urn:page:{page_id}'}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    body = b"software: adagium\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, name)}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(out: str, run: str, target: int):
    def write(batches):
        import pandas as pd
        from pyspark import TaskContext

        ctx = TaskContext.get()
        shard, attempt, seq = ctx.partitionId(), ctx.taskAttemptId(), 0
        stream = None
        done: list[tuple] = []

        def close():
            nonlocal stream
            stream.close()
            done.append((name, temp, n, size, sha.hexdigest()))
            stream = None

        key, target_id = None, None
        for pdf in batches:
            for pid, url, payload, sha1, kind, ref in zip(pdf["__id"], pdf["url"], pdf["payload"], pdf["__sha1"], pdf["__kind"], pdf["__ref"]):
                pid = None if pd.isna(pid) else int(pid)
                if kind == 0:
                    key, target_id = (pid, sha1), int(ref)
                    continue
                refers = target_id if key == (pid, sha1) else None
                if stream is None:
                    name = f"part-{shard:06d}-{seq:05d}.warc.gz"
                    temp = f"{out}/_temporary/{run}/{attempt}-{name}"
                    stream, n, size, sha, seq = open_shared(temp, "wb"), 0, 0, hashlib.sha256(), seq + 1
                    data = gzip_member(_info(name))
                else:
                    data = b""
                data += gzip_member(record_bytes(pid, url, payload, bytes.fromhex(sha1), refers))
                stream.write(data)
                sha.update(data)
                n, size = n + 1, size + len(data)
                if size >= target:
                    close()
        if stream is not None:
            close()
        yield pd.DataFrame(done, columns=["file", "temp", "records", "bytes", "sha256"])

    return write


def write_warc(pages: DataFrame, out: str, target_bytes: int = TARGET_BYTES, min_payload: int = 0) -> list[dict]:
    """Write pages(page_id, url, html) as WARC files below ``out``; returns the manifest (one entry a file)."""
    spark = pages.sparkSession
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    system = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(path(f"{out}/MANIFEST.json")) or system.globStatus(path(f"{out}/part-*.warc.gz")):
        raise FileExistsError(f"{out} holds archives already")
    base = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("__sha1", F.sha1("payload"))
    ids = base.filter(F.length("payload") >= min_payload).select("page_id", "__sha1")
    groups = ids.groupBy("__sha1").agg(F.max("page_id").alias("__ref"), F.count("*").alias("__n")).filter("__n > 1")
    refs = ids.join(groups, "__sha1").filter("page_id < __ref").select("page_id", "__sha1", "__ref").distinct()
    rows = base.select(F.col("page_id").alias("__id"), "__sha1", F.lit(1).alias("__kind"), "url", "payload", F.lit(None).cast("long").alias("__ref")).unionByName(
        refs.select(F.col("page_id").alias("__id"), "__sha1", F.lit(0).alias("__kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "__ref")
    )
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The url and, for rows alike in all else, nothing more breaks ties: their records are equal bytes.
    ranged = rows.repartitionByRange(shards, "__id", "__sha1").sortWithinPartitions("__id", "__sha1", "__kind", "url")
    run = uuid.uuid4().hex
    files = [r.asDict() for r in ranged.mapInPandas(_writer(out, run, target_bytes), FILES).collect()]  # one row a file
    files.sort(key=lambda r: r["file"])
    system.mkdirs(path(out))
    for f in files:
        if not system.rename(path(f["temp"]), path(f"{out}/{f['file']}")):
            raise OSError(f"commit of {f['file']} failed")
        del f["temp"]
    stream = system.create(path(f"{out}/_temporary/{run}/MANIFEST.json"), True)
    stream.write(bytearray(json.dumps({"files": files}, indent=1).encode()))
    stream.close()
    if not system.rename(path(f"{out}/_temporary/{run}/MANIFEST.json"), path(f"{out}/MANIFEST.json")):
        raise OSError("commit of the manifest failed")
    system.delete(path(f"{out}/_temporary"), True)
    return files


def members(data: bytes):
    """The gzip members of an archive, one after the other."""
    while data:
        z = zlib.decompressobj(31)
        yield z.decompress(data)
        data = z.unused_data


def parse_record(raw: bytes, with_payload: bool = False):
    """A row of RECORDS from one record's bytes, None for warcinfo; digests are verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind = fields["WARC-Type"]
    if kind == "warcinfo":
        return None
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != "sha1:" + b32(hashlib.sha1(block).digest()):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = fields["WARC-Payload-Digest"][5:]
    if kind == "response" and (len(payload) != size or b32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} differs")
    page, ref = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")
    return (page and int(page), fields["WARC-Target-URI"], size, digest, kind, ref and int(ref), payload if with_payload and kind == "response" else None)


def read_warc(spark: SparkSession, out: str, payloads: bool = False) -> DataFrame:
    """Records of a committed archive folder, in the columns of RECORDS (payload only if asked for)."""
    import pandas as pd

    names = [x.split(":")[0] for x in RECORDS.split(", ")]
    names = [x.split(" ")[0] for x in names]

    def parse(batches):
        for pdf in batches:
            for data in pdf["content"]:
                rows, held = [], 0
                size = len(data)
                view = data
                pos = 0
                while pos < size:
                    z = zlib.decompressobj(31)
                    raw = bytearray()
                    while not z.eof:
                        piece = view[pos : pos + 65536]
                        if not piece:
                            raise EOFError("an archive ends inside a record")
                        raw += z.decompress(piece)
                        pos += len(piece)
                    pos -= len(z.unused_data)
                    row = parse_record(bytes(raw), payloads)
                    if row:
                        rows.append(row)
                        held += len(row[-1] or b"") + 200
                    if held > 16 << 20:
                        yield frame(rows)
                        rows, held = [], 0
                yield frame(rows)

    def frame(rows):
        pdf = pd.DataFrame(rows, columns=names)
        return pdf.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(out).select("content")
    return found.mapInPandas(parse, RECORDS)


def archive(pages: DataFrame, target_bytes: int = TARGET_BYTES, min_payload: int = 0) -> DataFrame:
    """Write pages to a fresh folder of the shared file system, and read the archives back."""
    spark = pages.sparkSession
    out = f"{shared_dir(spark)}/adagium-warc-{uuid.uuid4().hex}"
    files = write_warc(pages, out, target_bytes, min_payload)
    columns = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return (read_warc(spark, out) if files else spark.createDataFrame([], RECORDS)).select(*columns)
