"""WARC archives: write, normalise a monolithic gzip file into one member a record, index and read back.

A crawler's archive is often one gzip stream, so no record can be opened without inflating all before it. The
normaliser inflates such a file once, from front to back, with one record in memory at a time, and rewrites every
record as a gzip member of its own, with a sidecar index of (record, offset, length). Duplicates of a payload become
``revisit`` records on the way; which record of equal payloads stays a ``response`` is decided beforehand by a
distributed aggregate over digests. Payloads never pass through a shuffle: only digests and decisions do.

Files are named by task attempt and listed in a manifest table that only successful attempts reach, so a lost executor
or a speculative copy leaves unlisted files, never a half-written archive that is read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.common import new_path, stage_table, table

#: An archive file is closed once it holds so many payload bytes or records, so that one file is a bounded piece of work.
ROLL_BYTES, ROLL_RECORDS = 32 << 20, 20_000
#: Tasks that normalise files, at most; fewer files have a task each.
TASKS = 100_000
#: Records with a payload of at least so many bytes may become revisits.
MIN_REVISIT_BYTES = 0
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORDS = "file string, seq long, page_id long, payload_bytes long, payload_digest string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, offset long, length long"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(value: str) -> str:
    """A header is one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, full: int, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record. ``full`` is the payload's length, which a revisit's own block no longer shows."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:pagequarry:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_value(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {full}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:pagequarry:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def page_number(urn: str) -> int | None:
    digits = urn.rstrip(">").rpartition(":")[2]
    return int(digits) if digits else None


class Inflated(io.RawIOBase):
    """The bytes of a gzip file, whether it holds one member or many, inflated in bounded steps."""

    def __init__(self, raw, step: int = 1 << 18):
        self.raw, self.step, self.z, self.rest = raw, step, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while True:
            data = self.rest or self.raw.read(self.step)
            self.rest = b""
            if not data:
                if not self.z.eof and self.z.unconsumed_tail:
                    data = b""
                else:
                    return 0
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(data, len(out))
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                out[: len(got)] = got
                return len(got)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an inflated archive, one at a time."""
    stream = io.BufferedReader(stream, 1 << 18)
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        head = [line]
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line)
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in head[1:])}
        yield headers, stream.read(int(headers["content-length"]))


def filesystem(uri: str):
    """The file system of a shared folder and the path in it; pyarrow opens file, hdfs, s3 and gs addresses alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_monolithic(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, roll_records: int = ROLL_RECORDS) -> DataFrame:
    """Writes each partition of ``pages`` (page_id, url, html) as monolithic gzip archives of ``response`` records.

    Returns a row a record: file, seq (its place), page_id, payload_bytes, payload_digest. A null html is an empty
    payload; a null url an empty header. Columns besides the three are not read.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        out, size, name, rows = None, 0, "", []

        def close() -> pd.DataFrame:
            out.write(z.flush())
            out.close()
            done = pd.DataFrame(rows, columns=["file", "seq", "page_id", "payload_bytes", "payload_digest"])
            done["page_id"] = done["page_id"].astype("Int64")
            return done

        for batch in batches:
            for page_id, url, html in zip(batch["page_id"].astype(object), batch["url"], batch["html"], strict=True):
                page_id = None if pd.isna(page_id) else int(page_id)
                if out is None:
                    name, size, rows, z = f"{uuid.uuid4().hex}.warc.gz", 0, [], zlib.compressobj(6, zlib.DEFLATED, 31)
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                payload = (html or "").encode()
                digest = payload_digest(payload)
                out.write(z.compress(record("response", page_id, url, payload, digest, len(payload))))
                rows.append((name, len(rows), page_id, len(payload), digest))
                size += len(payload)
                if size >= roll_bytes or len(rows) >= roll_records:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInPandas(write, RECORDS)


def decide(rows: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """The records that become revisits: (of, seq, refers_to), ``of`` being the file. Of equal payloads, the largest page_id responds.

    The aggregate over digests has one partial row a task and digest, so a payload that fills a third of the table
    costs no more than any other. Its result is joined back only where a digest occurs twice, with the digest's rows
    dealt over ``salt`` keys, as many as its count asks for. Rows that tie in page_id (repeated rows) are told apart
    by file and place; a null page_id is the smallest.
    """
    order = F.struct("page_id", "file", "seq")
    repeated = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    salts = 64
    repeated = repeated.withColumn("salt", F.explode(F.when(F.col("n") > 256, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1)))))
    # a record does not know its digest's count, so it asks under both keys; one of them exists
    asked = rows.where(F.col("payload_bytes") >= min_bytes).withColumn("salt", F.explode(F.array(F.lit(-1), F.pmod(F.xxhash64("file", "seq"), F.lit(salts)).cast("int"))))
    return asked.join(repeated, ["payload_digest", "salt"]).where((F.col("first.file") != F.col("file")) | (F.col("first.seq") != F.col("seq"))).select(F.col("file").alias("of"), "seq", F.col("first.page_id").alias("refers_to"))


def normalise(files: DataFrame, revisits: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites each monolithic file record by record and writes its sidecar index.

    ``files`` (file) and ``revisits`` (of, seq, refers_to) meet by file: a file is bounded by the writer's roll
    sizes, so a group is too. Their rows are few and small but each stands for a file, so they are dealt to as many tasks
    as there are files. Returns (file, index, n_records).
    """
    tasks = max(1, min(TASKS, files.count()))

    def rewrite(key, _: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
        system, root = filesystem(source)
        _, out_root = filesystem(target)
        system.create_dir(out_root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        refers = {int(s): (None if pd.isna(r) else int(r)) for s, r in zip(changes["seq"], changes["refers_to"].astype(object), strict=True)}
        index, offset = [], 0
        with system.open_input_stream(f"{root}/{key[0]}", compression=None) as raw, system.open_output_stream(f"{out_root}/{name}", compression=None) as out:
            for seq, (head, block) in enumerate(records(Inflated(raw))):
                page_id, url, full = page_number(head["warc-record-id"]), head["warc-target-uri"], int(head["x-payload-length"])
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if payload_digest(block) != digest:
                    raise ValueError(f"record {seq} of {key[0]} does not match its digest")
                kind = "revisit" if seq in refers else head["warc-type"]
                data = record(kind, page_id, url, b"" if seq in refers else block, digest, full, refers.get(seq))
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = z.compress(data) + z.flush()
                out.write(member)
                index.append({"page_id": page_id, "type": kind, "offset": offset, "length": len(member), "digest": digest})
                offset += len(member)
        with system.open_output_stream(f"{out_root}/{name}.idx.jsonl", compression=None) as side:
            side.write("".join(json.dumps(x) + "\n" for x in index).encode())
        return pd.DataFrame({"file": [name], "index": [f"{name}.idx.jsonl"], "n_records": [len(index)]})

    return files.repartition(tasks, "file").groupBy("file").cogroup(revisits.repartition(tasks, "of").groupBy("of")).applyInPandas(rewrite, "file string, index string, n_records long")


def read_indexed(manifest: DataFrame, folder: str) -> DataFrame:
    """Opens every record of normalised archives at its indexed offset, one member at a time.

    A ``response`` payload is checked against its digest. Returns READ, a row a record.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = filesystem(folder)
        for batch in batches:
            for name, side in zip(batch["file"], batch["index"], strict=True):
                with system.open_input_stream(f"{root}/{side}", compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                rows = []
                with system.open_input_file(f"{root}/{name}") as f:
                    for e in entries:
                        f.seek(e["offset"])
                        head, block = parse(zlib.decompress(f.read(e["length"]), 31))
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        kind = head["warc-type"]
                        full = int(head["x-payload-length"])
                        if kind == "response" and (payload_digest(block) != digest or len(block) != full):
                            raise ValueError(f"record at {e['offset']} of {name} does not match its digest")
                        refers = page_number(head["warc-refers-to"]) if kind == "revisit" else None
                        rows.append((page_number(head["warc-record-id"]), full, digest, kind, refers, head["warc-target-uri"], name, e["offset"], e["length"]))
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in READ.split(", ")])
                out["page_id"], out["refers_to"] = out["page_id"].astype("Int64"), out["refers_to"].astype("Int64")
                yield out

    return manifest.select("file", "index").mapInPandas(read, READ)


def archive(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes, deduplicates and normalises ``pages`` under ``folder``; returns the manifest (file, index, n_records).

    An empty table gives an empty manifest. Null and repeated page_ids are records like others. The monolithic files stay
    beside the normalised ones.
    """
    rows = stage_table(write_monolithic(pages, f"{folder}/mono", roll_bytes), "warc-records")
    files = stage_table(rows.select("file").distinct(), "warc-files")
    return stage_table(normalise(files, decide(rows, min_bytes), f"{folder}/mono", f"{folder}/records"), "warc-manifest")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    manifest = archive(table(spark, sf_dir, "pages"), folder)
    # a file is a task's work: deal the manifest's few rows out
    dealt = manifest.repartition(max(1, min(TASKS, manifest.count())), "file")
    return read_indexed(dealt, f"{folder}/records").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, unhex(sha1(html))::BIT::VARCHAR AS bits FROM p),
e AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + 16 * substr(bits, 5*i+1, 1)::INT + 8 * substr(bits, 5*i+2, 1)::INT + 4 * substr(bits, 5*i+3, 1)::INT
  + 2 * substr(bits, 5*i+4, 1)::INT + substr(bits, 5*i+5, 1)::INT, 1)), '') AS payload_digest FROM d),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM e)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM f
"""
