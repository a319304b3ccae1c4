"""Operator 5: WARC files by way of a chunked record table.

Writing: payloads travel as rows (record id, chunk number, bytes) of at most CHUNK_BYTES; a writer task streams its rows into one
gzip member per record and never holds a whole payload. Records are sorted by id and chunk number inside a partition, and dealt
by id, so a partition is one archive file; it is written under a temporary name and moved, so a task that runs again after an
executor is lost just replaces its file, and only files named in the returned manifest are ever read.

Reading: a task streams the archives of its manifest rows, carries SHA-1 and length from chunk to chunk, and emits either chunk rows
(`read_chunks`) or one row per record with the digest it computed (`read_records`).

Of records with equal payloads of at least min_bytes, that with the smallest id is the response and the others revisit it
(profile identical-payload-digest), without a payload of their own.

Defined results: a null payload is empty; rows with a null id are not written; a repeated row (same id and payload) is written
once; of rows with one id and different payloads, that with the smallest digest is written; an empty table gives an empty archive.
Other columns are ignored; a null URL becomes urn:record:ID.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import scratch_path

CHUNK_BYTES = 64 * 1024
#: Bytes of an archive read or written at once.
BLOCK = 256 * 1024
MIN_BYTES = 0
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def plan_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(record_id, url, payload, payload_bytes, sha1, refers_to). The digests are compared in a narrow table; payloads of one digest
    are never grouped, and a digest that many records share is pre-aggregated before it moves."""
    own = pages.where(F.col("page_id").isNotNull()).select(F.col("page_id").alias("record_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    firsts = own.groupBy("sha1", "payload_bytes").agg(F.min("record_id").alias("first_id")).where(F.col("payload_bytes") >= min_bytes)
    ids = own.groupBy("record_id").agg(F.min("sha1").alias("sha1"), F.min_by("payload_bytes", "sha1").alias("payload_bytes"))
    # only ids that revisit carry on; every other record is a response
    revisits = ids.join(firsts, ["sha1", "payload_bytes"]).where(F.col("first_id") < F.col("record_id")).select("record_id", F.col("sha1").alias("__sha1"), "first_id")
    joined = own.join(revisits.hint("shuffle_hash"), "record_id", "left")
    return joined.select("record_id", "url", F.when(F.col("first_id").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "payload_bytes", "sha1", F.col("first_id").alias("refers_to"))


def chunk_rows(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per record and chunk; url, digest, length and refers_to are on chunk 0 only."""
    n = F.greatest(F.ceil(F.octet_length("payload") / chunk_bytes), F.lit(1)).cast("int")
    df = records.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    head = lambda c: F.when(F.col("chunk") == 0, F.col(c)).alias(c)
    return df.select("record_id", "chunk", F.substring("payload", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"), head("url"), head("payload_bytes"), head("refers_to"), "sha1")


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def _header(record_id: int, url: str | None, sha1: str, length: int, refers_to: int | None, content: int) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:record:{record_id}>",
        f"WARC-Target-URI: {' '.join((url or f'urn:record:{record_id}').split())}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base32_of_hex(sha1)}",
        f"X-Payload-Length: {length}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:record:{refers_to}>"]
    return "\r\n".join([*lines, f"Content-Length: {content}", "", ""]).encode()


def write_archives(chunks: DataFrame, path: str) -> DataFrame:
    """Writes the archives under path and returns the manifest (file, n_records)."""
    spark = chunks.sparkSession
    dealt = chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "record_id").sortWithinPartitions("record_id", "sha1", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = _store(path)
        name, temporary = f"{root}/part-{context.partitionId():05d}.warc.gz", f"{root}/.part-{context.partitionId():05d}-{context.taskAttemptId()}"
        out, n, last, member = None, 0, None, None
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["record_id"], row["sha1"])
                if last is not None and key[0] == last[0] and (key[1] != last[1] or (row["chunk"] <= last[2])):
                    continue  # a repeated row, or another payload under an id that is written already
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(temporary, compression=None, buffer_size=BLOCK)
                if row["chunk"] == 0:
                    if member:
                        out.write(member.compress(b"\r\n\r\n") + member.flush())
                    member, n = zlib.compressobj(6, zlib.DEFLATED, 31), n + 1
                    content = row["payload_bytes"] if row["refers_to"] is None else 0
                    out.write(member.compress(_header(row["record_id"], row["url"], row["sha1"], row["payload_bytes"], row["refers_to"], content)))
                out.write(member.compress(row["data"]))
                last = (*key, row["chunk"])
        if out is not None:
            out.write(member.compress(b"\r\n\r\n") + member.flush())
            out.close()
            store.move(temporary, name)
            yield pa.RecordBatch.from_pydict({"file": [f"{path}/{os.path.basename(name)}"], "n_records": [n]})

    manifest = dealt.mapInArrow(run, "file string, n_records long")
    listed = f"{path}-manifest"
    manifest.write.parquet(listed)
    return spark.read.schema("file string, n_records long").parquet(listed)


def _members(store: fs.FileSystem, name: str) -> Iterator[tuple[bytes, bool]]:
    """Unpacked blocks of an archive, and whether a block ends its record."""
    with store.open_input_stream(name, compression=None, buffer_size=BLOCK) as f:
        member, data = zlib.decompressobj(31), b""
        while True:
            data = data or f.read(BLOCK)
            part = member.decompress(data, CHUNK_BYTES)
            ended = member.eof
            if part or ended:
                yield part, ended
            elif not data:
                return
            data = member.unused_data if ended else member.unconsumed_tail
            if ended:
                member = zlib.decompressobj(31)


def stream_records(store: fs.FileSystem, name: str) -> Iterator[tuple[dict[str, str], int, bytes, bool]]:
    """(headers, chunk number, bytes, last) for each record of a file, a block at a time."""
    fields: dict[str, str] | None = None
    held, left, chunk = b"", 0, 0
    for part, ended in _members(store, name):
        held += part
        if fields is None:
            at = held.find(b"\r\n\r\n")
            if at < 0:
                continue
            lines = held[:at].decode().split("\r\n")[1:]
            fields = dict(x.split(": ", 1) for x in lines)
            held, left, chunk = held[at + 4 :], int(fields["Content-Length"]), 0
        take, held = held[:left], held[len(held[:left]) :]
        left -= len(take)
        if take or ended:
            yield fields, chunk, take, ended
            chunk += 1
        if ended:
            if left or held != b"\r\n\r\n":
                raise ValueError(f"{name}: a record is cut short")
            fields, held = None, b""
    if fields is not None or held:
        raise ValueError(f"{name}: the archive is cut short")


def read_chunks(manifest: DataFrame) -> DataFrame:
    """The chunked record table of the archives: record_id, chunk, data, and the digest and length of all up to here."""
    schema = "record_id long, chunk int, data binary, sha1_so_far string, bytes_so_far long"

    def run(batches):
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                store, name = _store(uri)
                digest, n = hashlib.sha1(), 0
                for fields, chunk, data, ended in stream_records(store, name):
                    digest.update(data)
                    n += len(data)
                    key = int(fields["WARC-Record-ID"].rsplit(":", 1)[1][:-1])
                    yield pa.RecordBatch.from_pydict({"record_id": pa.array([key], pa.int64()), "chunk": pa.array([chunk], pa.int32()), "data": pa.array([data], pa.binary()), "sha1_so_far": [base64.b32encode(digest.digest()).decode()], "bytes_so_far": pa.array([n], pa.int64())})
                    if ended:
                        digest, n = hashlib.sha1(), 0

    return manifest.select("file").mapInArrow(run, schema)


def read_records(manifest: DataFrame) -> DataFrame:
    """One row per record; a response's digest and length are computed from its chunks and checked against its header."""
    schema = "record_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"

    def run(batches):
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                store, name = _store(uri)
                digest, n, rows = hashlib.sha1(), 0, []
                for fields, _, data, ended in stream_records(store, name):
                    digest.update(data)
                    n += len(data)
                    if not ended:
                        continue
                    said, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response" and (base64.b32encode(digest.digest()).decode(), n) != (said, int(fields["X-Payload-Length"])):
                        raise ValueError(f"{name}: the digest of {fields['WARC-Record-ID']} is wrong")
                    refers = fields.get("WARC-Refers-To")
                    rows.append((int(fields["WARC-Record-ID"].rsplit(":", 1)[1][:-1]), kind, int(fields["X-Payload-Length"]), said, int(refers.rsplit(":", 1)[1][:-1]) if refers else None))
                    digest, n = hashlib.sha1(), 0
                    if len(rows) == 5000:
                        yield _record_batch(rows)
                        rows = []
                if rows:
                    yield _record_batch(rows)

    return manifest.select("file").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, schema)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["record_id", "record_type", "payload_bytes", "payload_digest", "refers_to"])


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    manifest = write_archives(chunk_rows(plan_records(pages)), scratch_path(spark, "warc"))
    return read_records(manifest).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = r"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
b as (select page_id, html, (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31 as int) + 1, 1), '' order by i)
      from range(32) t(i)) as payload_digest from p),
f as (select html, min(page_id) as first_id from p group by html)
select b.page_id, strlen(b.html) as payload_bytes, payload_digest, case when first_id = page_id then 'response' else 'revisit' end as record_type,
  case when first_id <> page_id then first_id end as refers_to from b join f on b.html = f.html
"""
