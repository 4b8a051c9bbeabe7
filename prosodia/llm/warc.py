"""WARC archives: a deterministic sharded writer and a reader.

Writing. Records are ordered by page_id over contiguous id ranges (shards), whose bounds come from the ids of least hash,
so that the same table gives the same shards however it is partitioned. A task writes its shards in order,
one gzip member to a record, and rolls to a new file once the compressed size passes ROLL_BYTES. Headers (ids, lengths,
payload and block digests) are made anew from the payload. A file is written under a name of the task's attempt and then
moved to its final name; the list of files is written likewise and moved last, and is the commit: readers open only files it names, so
what a lost executor left behind is never read, and an attempt that runs again writes the same bytes.

Revisits. Of equal payloads of at least MIN_REVISIT bytes the record with the least page_id is the response, the others
are revisits. Digests are summed up apart from the payloads; only markers of revisits travel, and meet their rows in
the sorted stream of the writer, so each payload is shuffled once, by id.

Files are opened through pyarrow's file systems, by the scheme of the shared folder's address.

Defined results: a null html is an empty payload; rows with null page_id are responses and nothing refers to them; of rows with the
same page_id and payload the first is the response (or all revisit a lesser id); null urls have no target; control characters
of urls are percent-encoded; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, publish, remove

MIN_REVISIT = 100
ROLL_BYTES, SHARD_BYTES, MAX_SHARDS = 64 << 20, 16 << 20, 10_000
#: Ids of least hash that bounds are taken from, for each shard.
PER_SHARD = 50
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, parts)))}>"


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record, uncompressed."""
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, nth: int, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", _id("page", page_id, digest, nth)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _clean(url)))
    if page_id is not None:
        headers.append(("Page-Id", str(page_id)))
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", "sha256:" + digest)]
    if refers_to is None:
        return record("response", headers, http + payload)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id("page", refers_to, digest, 0)), ("Refers-To-Page-Id", str(refers_to))]
    return record("revisit", headers, http)


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream; digests are checked."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(": ")
            headers[k] = v
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        if headers["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
            raise ValueError("a block does not match its digest")
        yield headers, block


def _bounds(pages: DataFrame, shard_bytes: int) -> np.ndarray:
    """Ascending first ids of all shards but the first."""
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    shards = min(MAX_SHARDS, max(1, -(-total // shard_bytes)))
    if shards == 1:
        return np.array([], np.int64)
    ids = pages.where("page_id is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(PER_SHARD * shards).collect()
    ids = np.sort(np.array([r[0] for r in ids], np.int64))
    return np.unique(ids[np.arange(1, shards) * len(ids) // shards]) if len(ids) else ids


def write_archive(pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, date: str = DATE) -> str:
    """Write pages(page_id, url, html) under path; returns the address of the committed list of files."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html")).withColumn("digest", F.sha2("html", 256))
    bounds = _bounds(rows, shard_bytes)
    narrow = rows.where((F.octet_length("html") >= MIN_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    marks = narrow.join(first, "digest").where("page_id <> refers_to").distinct()

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), side="right")).astype("int32"))

    both = rows.withColumn("refers_to", F.lit(None).cast("bigint")).withColumn("mark", F.lit(1)).unionByName(marks.withColumns({"url": F.lit(None).cast("string"), "html": F.lit(None).cast("binary"), "mark": F.lit(0)}))
    both = both.withColumn("shard", F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("digest", "url"), F.lit(len(bounds) + 1)).cast("int")).otherwise(shard("page_id"))).repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", "page_id", "digest", "mark", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(f"{root}/_tmp", recursive=True)
        attempt, out, done = TaskContext.get().taskAttemptId(), None, []
        name, seq, now, size, count, digest_of = "", 0, None, 0, 0, None

        def finish() -> None:
            nonlocal out
            if out is not None:
                out.close()
                # an earlier attempt may have made it; some file systems do not move onto a file
                if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:
                    fs.delete_file(f"{root}/{name}")
                fs.move(f"{root}/_tmp/{name}.{attempt}", f"{root}/{name}")
                done.append((name, count, size, digest_of.hexdigest()))
                out = None

        def put(raw: bytes) -> None:
            nonlocal size, count
            member = zlib.compressobj(6, zlib.DEFLATED, 31)
            packed = member.compress(raw) + member.flush()
            out.write(packed)
            digest_of.update(packed)
            size += len(packed)
            count += 1

        mark, last, nth = None, None, 0
        for b in batches:
            for i in range(b.num_rows):
                sh, pid, digest, is_row = (b.column(k)[i].as_py() for k in ("shard", "page_id", "digest", "mark"))
                if not is_row:
                    mark = (pid, digest, b.column("refers_to")[i].as_py())
                    continue
                if sh != now or out is None or size >= roll_bytes:
                    finish()
                    seq = seq + 1 if sh == now else 0
                    now, name, size, count, digest_of = sh, f"pages-{sh:05d}-{seq:05d}.warc.gz", 0, 0, hashlib.sha256()
                    out = fs.open_output_stream(f"{root}/_tmp/{name}.{attempt}")
                    put(record("warcinfo", [("WARC-Record-ID", _id("info", name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                payload = b.column("html")[i].as_py()
                nth = nth + 1 if last == (pid, digest) else 0
                last = (pid, digest)
                refers = mark[2] if mark and mark[:2] == last else pid if nth and len(payload) >= MIN_REVISIT else None
                put(page_record(pid, b.column("url")[i].as_py(), payload, digest, refers, nth, date))
        finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done]) for k in range(4)], names=["file", "records", "bytes", "sha256"])

    files = both.mapInArrow(write, "file string, records bigint, bytes bigint, sha256 string")
    files.write.json(f"{path}/_tmp/manifest")
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(f"{path}/_tmp/manifest"), jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target):
        raise RuntimeError(f"{path} has a list of files already")
    return f"{path}/manifest"


READ = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The page records of an archive (READ; payload is null for revisits and if payloads is False). Payload digests are
    checked against the payloads."""
    files = spark.read.schema("file string, records bigint, bytes bigint, sha256 string").json(f"{path}/manifest").select("file")
    files = files.repartition(max(1, min(files.count(), 10_000)), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        number = lambda x: None if x is None else int(x)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in READ.split(", ")])

        for b in batches:
            for file in b.column("file").to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{root}/{file}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain:
                    for h, block in read_records(io.BufferedReader(plain)):
                        if h["WARC-Type"] not in ("response", "revisit"):
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                        digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        full = h["WARC-Type"] == "response"
                        if full and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"a payload of {file} does not match its digest")
                        rows.append((number(h.get("Page-Id")), h.get("WARC-Target-URI"), h["WARC-Type"], length, digest, number(h.get("Refers-To-Page-Id")), payload if full and payloads else None))
                        if len(rows) >= 500:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    return files.mapInArrow(read, READ)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    rows = publish(read_archive(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    remove(spark, path)
    return rows


def oracle() -> str:
    return f"""with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h))::bigint as payload_bytes, sha256(h) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as least from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= {MIN_REVISIT} and page_id <> least then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {MIN_REVISIT} and page_id <> least then least end as refers_to from f"""
