"""WARC archives: write, normalise a monolithic gzip stream, read by offset.

Three steps, each lazy over a manifest of files in the shared folder:

* ``write_archives``: one gzip stream per file, as a careless crawler leaves it.
* ``normalise_archives``: inflates a file's stream once, writes every record as
  a gzip member of its own and a sidecar index of offsets beside it.
* ``read_archives``: seeks to the indexed members and parses them.

Files go through ``pyarrow.fs``, so the folder may be any URI that it knows. A
retried task writes under a new name; only names in a written manifest are
read, so lost executors and speculative attempts leave harmless orphans.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.workdir import new_path, removed, written

CHUNK = 1 << 20
MANIFEST = "path string, records long, n_bytes long"
NORMAL = "path string, index_path string, records long, n_bytes long"
RECORD = "record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def _filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def encode_record(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """Serialise one response, or a revisit (no payload) where ``refers_to`` is given."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_line(uri)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def split_records(chunks):
    """Cut an iterator of inflated bytes into whole records; holds one record at a time."""
    buf, need = bytearray(), 0
    for chunk in chunks:
        buf += chunk
        while True:
            if not need:
                end = buf.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 8 + int(re.search(rb"(?im)^Content-Length:\s*(\d+)", bytes(buf[:end]))[1])
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need = 0
    if buf.strip():
        raise ValueError("archive ends inside a record")


def parse_record(raw: bytes) -> dict:
    """Parse one record; a response's digest is recomputed and must agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    urn = lambda v: v[len("<urn:x-page:") : -1] if v else None
    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['warc-record-id']}: payload does not match its digest")
    return {"record_id": urn(fields["warc-record-id"]), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "refers_to": urn(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None}


def write_archives(records: DataFrame, folder: str, max_bytes: int = 32 << 20, level: int = 1) -> DataFrame:
    """Write ``record_id, uri, payload, digest, refers_to`` rows as monolithic .warc.gz files.

    Returns the manifest. A file is closed once ``max_bytes`` went into it.
    """

    def run(batches):
        fsys, root = _filesystem(folder)
        fsys.create_dir(root, recursive=True)
        out = None
        for batch in batches:
            for i in range(batch.num_rows):
                rid, uri, payload, digest, ref = (batch.column(k)[i].as_py() for k in range(5))
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, packer, n, total = fsys.open_output_stream(path, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                raw = encode_record(rid, uri, payload, digest, ref)
                out.write(packer.compress(raw))
                n, total = n + 1, total + len(raw)
                if total >= max_bytes:
                    out.write(packer.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "n_bytes": [total]})
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "n_bytes": [total]})

    return records.select("record_id", "uri", "payload", "digest", "refers_to").mapInArrow(run, MANIFEST)


def _inflated(stream):
    """Inflate one or many concatenated gzip members."""
    unpack = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            yield unpack.decompress(data)
            data = unpack.unused_data
            if unpack.eof and data:
                unpack = zlib.decompressobj(31)
            elif unpack.eof:
                break
        if unpack.eof:
            unpack = zlib.decompressobj(31)


def normalise_archives(manifest: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Rewrite each archive of ``manifest`` (column ``path``) record by record, with an index.

    The index has a line ``offset length type record-id`` for each member.
    Memory: one record and one chunk. An archive without records gives an empty
    file and an empty index.
    """

    def run(batches):
        fsys, root = _filesystem(folder)
        fsys.create_dir(root, recursive=True)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                at = n = 0
                with fsys.open_input_stream(source, compression=None) as src, fsys.open_output_stream(path, compression=None) as out, fsys.open_output_stream(f"{path}.idx", compression=None) as idx:
                    for raw in split_records(_inflated(src)):
                        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = packer.compress(raw) + packer.flush()
                        head = raw[: raw.find(b"\r\n\r\n")].decode()
                        kind, rid = re.search(r"WARC-Type: (\S+)", head)[1], re.search(r"WARC-Record-ID: <(\S+)>", head)[1]
                        out.write(member)
                        idx.write(f"{at} {len(member)} {kind} {rid}\n".encode())
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_pydict({"path": [path], "index_path": [f"{path}.idx"], "records": [n], "n_bytes": [at]})

    return manifest.select("path").mapInArrow(run, NORMAL)


def read_archives(normal: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Read every indexed record of normalised archives; checks each payload's digest."""
    kept = [x.split()[0] for x in RECORD.split(", ") if with_payload or not x.startswith("payload ")]
    schema = pa.schema([(k, pa.binary() if k == "payload" else pa.int64() if k == "payload_bytes" else pa.string()) for k in kept])

    def run(batches):
        fsys, _ = _filesystem(folder)
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                with fsys.open_input_stream(index, compression=None) as f:
                    entries = f.read().decode().splitlines()
                with fsys.open_input_file(path) as f:
                    for offset, length in (map(int, x.split()[:2]) for x in entries):
                        rec = parse_record(zlib.decompress(f.read_at(length, offset), 31))
                        rows.append({k: rec[k] for k in kept})
                        held += rec["payload_bytes"] if with_payload else 200
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return normal.select("path", "index_path").mapInArrow(run, ", ".join(x for x in RECORD.split(", ") if x.split()[0] in kept))


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 100) -> DataFrame:
    """Decide which records are responses and which revisit another.

    Of the rows with equal payloads of at least ``min_bytes`` bytes, those with
    the smallest id are responses; the others refer to it. A null payload is
    empty, a null id comes last (a group with null ids alone is all responses),
    rows repeated with the same id and payload share one decision. Only digests
    cross the first shuffles; the payloads cross one, keyed by page, so that a
    payload which many pages share spreads over all partitions.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("uri"), F.coalesce(F.encode(html, "UTF-8"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    ids = rows.where(F.length("payload") >= min_bytes).select("page_id", "digest")
    groups = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    again = ids.join(groups, "digest").where("not (page_id <=> first)").select(F.col("page_id").alias("pid"), F.col("digest").alias("dig"), "first").distinct()
    both = rows.join(again, F.expr("page_id <=> pid and digest = dig"), "left")
    return both.select(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("record_id"), "uri", "payload", "digest", F.col("first").cast("string").alias("refers_to"))


def archive_pages(pages: DataFrame, with_payload: bool = True, files: int | None = None) -> DataFrame:
    """Write pages as monolithic archives, normalise them, and read the records back."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    raw = written(write_archives(plan_records(pages), f"{folder}/raw"), "warc-manifest")
    # A file name is a small row: deal the names out so that each task inflates a few files.
    n = files or max(1, raw.count())
    normal = written(normalise_archives(raw.repartition(n, "path"), f"{folder}/normal"), "warc-manifest", drops=(raw,))
    removed(spark, f"{folder}/raw")  # every record now stands in the normalised archives
    return read_archives(normal.repartition(n, "path"), folder, with_payload)


def op1_digest(pages: DataFrame) -> DataFrame:
    """The contract's columns for every page, from the records read back."""
    rec = archive_pages(pages, with_payload=False)
    return rec.select(F.expr("try_cast(record_id as bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers_to as bigint)").alias("refers_to"))
