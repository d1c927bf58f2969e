"""WARC archives of pages, and their capture history by an external merge of locally sorted index runs.

Each task writes its records, one gzip member each, into archives of a few MB, with a run: the archive's captures sorted
by URL key and time. Archives are kept as bytes in a table in the scratch folder, which any file system can hold;
``export`` puts them into .warc.gz files. Reading back follows the runs, takes each record out of its archive by offset,
checks its digest, and merges the runs of each range of keys with a loser tree, so that the result is one history in
order of key and time.

Of pages with equal payloads of at least min_bytes, the one with the largest page_id is a response and the others
revisit it; rows that repeat that page_id with the same payload are responses too. Null html is an empty payload, a null
url an empty target, and a page with a null page_id a response that nothing refers to if any other has its payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.shared import materialize, settings, shuffle_partitions, table

ARCHIVE_BYTES = 4 << 20
MERGED = 100_000  # records that a task merges
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = T.StructType([T.StructField(n, t) for n, t in (("url_key", T.StringType()), ("captured_at", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()))])
_ARCHIVE = T.StructType([T.StructField("archive", T.StringType()), T.StructField("data", T.BinaryType()), T.StructField("run", T.ArrayType(_CAPTURE))])
_RECORD = T.StructType([T.StructField(n, t) for n, t in (("archive", T.StringType()), ("place", T.IntegerType()), ("url_key", T.StringType()), ("captured_at", T.StringType()), ("offset", T.LongType()), ("page_id", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()))])


def url_key(url: str | None) -> str:
    """Host parts from the top-level one down, then the path, in lower case, without scheme, leading www, port and fragment."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", (url or "").strip().lower(), re.S)
    host = re.sub(r"^www\d*\.", "", m[1]).strip(".")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, when: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has the response's HTTP header and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {when}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 3, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], int, bytes]:
    """Header fields, the payload's length and the payload (empty for a revisit) of a record, with its digest checked."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response" and (len(payload) != size or f"sha1:{digest(payload)}" != fields["WARC-Payload-Digest"]):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields, size, payload


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Rows (archive, data, run) of pages (page_id, url, html), written to the scratch folder."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({"sha": F.sha1("html"), "size": F.octet_length("html")})
    first = rows.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").select("sha", "size", "first")
    told = rows.join(first, ["sha", "size"], "left").select("page_id", "url", "html", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, data, run = TaskContext.get().partitionId(), 0, bytearray(), []

        def out() -> pa.RecordBatch:
            keys = sorted(run)
            entries = pa.array([{"url_key": k, "captured_at": t, "offset": o, "length": n} for k, t, o, n in keys], pa.struct([("url_key", pa.string()), ("captured_at", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{made:06d}.warc.gz"]), pa.array([bytes(data)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), entries)], names=_ARCHIVE.names)

        for batch in batches:
            for page_id, url, page, first in zip(*(c.to_pylist() for c in batch.columns)):
                when = (FIRST_CAPTURE + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
                member = record(page_id, url, when, page.encode(), first, first is not None and first != page_id)
                run.append((url_key(url), when, len(data), len(member)))
                data += member
                if len(data) >= archive_bytes:
                    yield out()
                    data, run, made = bytearray(), [], made + 1
        if run:
            yield out()

    with settings(pages.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="512"):
        return materialize(told.mapInArrow(write, _ARCHIVE))


class LoserTree:
    """Merges k sorted lists: each inner node keeps the loser of its match, so a step replays one path to the root."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.tree = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._play(leaf, True)

    def _less(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        return self.at[b] >= len(self.runs[b]) or (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def _play(self, winner: int, building: bool = False) -> None:
        node = (winner + self.k) // 2
        while node:
            if building and self.tree[node] < 0:
                self.tree[node] = winner
                return
            if self._less(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            w = self.tree[0]
            if self.at[w] >= len(self.runs[w]):
                return
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self._play(w)


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of all archives, each archive's in the order of its run."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda s: int(s[10:-1]) if s and s != "<urn:page:>" else None
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column("archive")[i].as_py(), memoryview(batch.column("data")[i].as_buffer())
                rows = []
                for place, e in enumerate(batch.column("run")[i].as_py()):
                    fields, size, _ = parse(bytes(data[e["offset"] : e["offset"] + e["length"]]))
                    rows.append((name, place, e["url_key"], e["captured_at"], e["offset"], number(fields["WARC-Record-ID"]), size, fields["WARC-Payload-Digest"][5:], fields["WARC-Type"], number(fields.get("WARC-Refers-To"))))
                kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=_RECORD.names)

    with settings(archives.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="4", spark__sql__parquet__columnarReaderBatchSize="4"):
        return materialize(archives.mapInArrow(read, _RECORD))


def history(records: DataFrame, most: int = MERGED) -> DataFrame:
    """Records in order of URL key and time: runs are dealt by ranges of both, and each range's runs are merged.

    There are as many ranges as keep about ``most`` records in each, whatever one URL's share is, for archive and place
    tell its captures apart; a range's records come sorted by run, so what a task holds doesn't grow with the data.
    """
    ranges = max(shuffle_partitions(records.sparkSession), -(-records.count() // most))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        kinds = None
        for batch in batches:
            kinds = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                runs.setdefault(row[0], []).append((row[2], row[3], row[0], row[1], row))
        held = []
        for *_, row in LoserTree([runs[k] for k in sorted(runs)]):
            held.append(row)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)

    return records.repartitionByRange(ranges, "url_key", "captured_at", "archive", "place").sortWithinPartitions("archive", "place").mapInArrow(merge, _RECORD)


def export(archives: DataFrame, folder: str) -> int:
    """Writes each archive to a file in a folder that the driver can reach, one at a time; how many."""
    n = 0
    for n, row in enumerate(archives.select("archive", "data").toLocalIterator(), start=1):
        with open(f"{folder}/{row['archive']}", "wb") as f:
            f.write(row["data"])
    return n


def op9_warc_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return history(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "archive", "offset")
