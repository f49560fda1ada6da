"""WARC archives, index first: records are written with an index row each (file, offset, length, URL, digest), and read back by coalescing
the sorted byte ranges of the index rows selected.

Each task writes gzip members, one per record, into files of its own under the shared folder; names are unique per attempt, so a task that runs
again leaves at most a file that no index row names. Files are opened through pyarrow's file systems, so the folder may be in any store it knows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, new_path, ship

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset bigint, length bigint, url string, digest string, page_id bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """(one gzip member, the payload's digest). Control characters and spaces of a URL are percent-encoded in the header."""
    sha = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = quote(url or "", safe="".join(map(chr, range(33, 127))))
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    raw = b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush(), sha


def parse(member: bytes) -> tuple:
    """A row of RECORD from one gzip member. A response's digest is checked against its payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    sha, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != sha):
        raise ValueError(f"damaged record {h['WARC-Record-ID']}")
    number = lambda urn: int(n) if (n := urn[len("<urn:x-page:") : -1]) else None
    refers = number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
    return number(h["WARC-Record-ID"]), h["WARC-Target-URI"], kind, refers, sha, size, payload if kind == "response" else None


def repeated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(top_key, top_id): a row per payload (of least_bytes or more) that several pages have, with their largest id. Payloads are told apart by SHA-256; only those digests and ids are shuffled,
    pre-aggregated."""
    keyed = pages.where(F.octet_length("body") >= least_bytes).select("page_id", "key")
    top = keyed.groupBy("key").agg(F.max("page_id").alias("top_id"), F.count("*").alias("n")).where("n > 1 and top_id is not null")
    return materialize(top.select(F.col("key").alias("top_key"), "top_id"), "repeated")


def write(pages: DataFrame, least_bytes: int = 0, file_bytes: int = 1 << 30, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row of pages and return the index, written too: one row (INDEX) per record.

    The payload is the html in UTF-8; null: empty. Of rows with equal payloads of least_bytes or more, those with the largest id are responses, the others revisits of it;
    null ids revisit any id. Repeated rows are records each. Other columns are not read. Empty table: an empty index.

    The index has the URL as it was, null too; in a record's header it is percent-encoded. Pages look up their payload among the repeated ones: while those (44 bytes each) are within
    Spark's limit for a broadcast, no body is shuffled; beyond it bodies are, once, and a payload that very many pages have is split by adaptive execution.
    """
    ship(pages.sparkSession)
    folder = new_path(pages.sparkSession, "warc")
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), body.alias("body")).withColumn("key", F.unhex(F.sha2("body", 256)))
    revisit = F.col("page_id").isNull() | (F.col("page_id") != F.col("top_id"))
    rows = rows.join(repeated(rows, least_bytes), F.col("key") == F.col("top_key"), "left").select("page_id", "url", "body", F.when(revisit, F.col("top_id")).alias("refers_to"))

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task, out, name, at = TaskContext.get(), None, "", 0
        for pdf in batches:
            index = []
            for i, url, payload, ref in zip(pdf["page_id"], pdf["url"], pdf["body"], pdf["refers_to"], strict=True):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                page, to = None if pd.isna(i) else int(i), None if pd.isna(ref) else int(ref)
                member, sha = record(page, url, bytes(payload), to, to is not None)
                out.write(member)
                index.append((f"{folder}/{name}", at, len(member), url, sha, page))
                at += len(member)
            if len(index):
                df = pd.DataFrame(index, columns=["file", "offset", "length", "url", "digest", "page_id"])
                yield df.astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    return materialize(rows.mapInPandas(run, INDEX), "index")


def read(selected: DataFrame, gap: int = 1 << 16, most: int = 1 << 23, chunk: int = 1 << 25, payloads: bool = True) -> DataFrame:
    """The records (RECORD) of the selected index rows; url is the record's, percent-encoded. Rows are dealt by file and ranges of it, into as many tasks as hold about `chunk` bytes of archive each (the
    index rows themselves say nothing of that), and sorted; records at most `gap` apart are read at once, up to `most` bytes. payload is null for revisits, and for all if not payloads.
    No selected row: an empty result."""
    spark = selected.sparkSession
    ship(spark)
    names = [c.split()[0] for c in RECORD.split(", ")]
    rows, size = selected.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, -(-size // chunk), min(rows, 2 * spark.sparkContext.defaultParallelism))
    at = F.floor(F.col("offset") / max(most // 8, -(-size // tasks)))
    dealt = selected.select("file", "offset", "length").repartition(tasks, "file", at).sortWithinPartitions("file", "offset")

    def run(batches):
        opened, handle = None, None
        for pdf in batches:
            rows = list(zip(pdf["file"], pdf["offset"].tolist(), pdf["length"].tolist(), strict=True))
            i = 0
            while i < len(rows):
                j, (file, start, length) = i + 1, rows[i]
                end = start + length
                while j < len(rows) and rows[j][0] == file and rows[j][1] - end <= gap and rows[j][1] + rows[j][2] - start <= most:
                    end = max(end, rows[j][1] + rows[j][2])
                    j += 1
                if file != opened:
                    store, path = fs.FileSystem.from_uri(file)
                    opened, handle = file, store.open_input_file(path)
                data = handle.read_at(end - start, start)
                got = [parse(data[o - start : o - start + n]) for _, o, n in rows[i:j]]
                df = pd.DataFrame(got, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                if not payloads:
                    df["payload"] = np.array([None] * len(df), object)
                yield df
                i = j

    return dealt.mapInPandas(run, RECORD)
