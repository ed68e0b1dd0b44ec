"""Web archives: write captures as WARC records, read them back, and merge the archives' indexes.

Every archive file leaves one index run, sorted by URL key and time. An external merge puts
the runs together: index rows are dealt out by ranges of (URL key, time, id), and inside a
range a loser tree merges the runs' sorted pieces. Ranges in order are the global capture history. The number of
ranges follows the number of captures, so a task holds about `range_rows` index rows of a history of any length.

Cases: a null payload is empty; a null or unparseable URL has the key of an empty host; null
times sort first (14 zeros); a null id is written as "-" and reads back null. Repeated rows give
repeated records. An empty table writes no archive and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsubo.llm.common import stored
from tsubo.session import work_dir

ARCHIVE_BYTES = 64 << 20
RANGE_ROWS = 100_000  # index rows merged in one task
LEAST_REVISIT_BYTES = 1000
INDEX = ("run string, url_key string, capture_time string, page_id bigint, file string, offset bigint, length bigint, "
         "payload_digest string, record_type string")
RECORD = ("page_id bigint, file string, offset bigint, payload_bytes bigint, payload_digest string, "
          "record_type string, refers_to bigint")


def url_key(url):
    """Sort-friendly URL form: reversed lower-case host, then path and query."""
    host = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@|:\d*$", ""), r"^www\d*\.", "")
    rest = F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.lower(rest))
    return F.coalesce(key, F.lit(")"))


def with_revisits(captures: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of at least `least` bytes the largest id is the response; the rest
    revisit it. Rows that repeat this id are responses too.
    """
    rows = captures.select("*", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
                           F.sha1("payload").alias("payload_digest"))
    many = (rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
            .agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    again = F.col("_first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("_first")))
    return rows.join(many, "payload_digest", "left").select(
        *captures.columns, "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first")).alias("refers_to"))


def _files(folder: str):
    """File system and path of the shared folder, whatever its scheme."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def _record(row: dict) -> bytes:
    """One WARC 1.1 record as its own gzip member."""
    name = "-" if row["page_id"] is None else str(row["page_id"])
    head = [
        b"WARC/1.1", b"WARC-Type: " + row["record_type"].encode(),
        f"WARC-Record-ID: <urn:page:{name}>".encode(),
        b"WARC-Target-URI: " + (row["url"] or "").replace("\r", " ").replace("\n", " ").encode(),
        b"WARC-Date: " + row["capture_time"].encode(), f"WARC-Payload-Digest: sha1:{row['payload_digest']}".encode(),
        f"X-Payload-Length: {row['payload_bytes']}".encode(), b"Content-Type: application/http; msgtype=response",
    ]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if row["record_type"] == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{row['refers_to']}>".encode()]
    else:
        block += row["payload"]
    head.append(f"Content-Length: {len(block)}".encode())
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(captures: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes captures(page_id, url, capture_time, payload, ...revisit columns); returns the index runs.

    Each task writes files of its own name, so a repeated attempt leaves files that no index
    names instead of touching others. One file's index is one run, sorted when the file closes.
    """
    def write(batches):
        system, base = _files(folder)
        system.create_dir(base, recursive=True)
        schema = pa.schema([(n, pa.string()) if t == "string" else (n, pa.int64())
                            for n, t in (c.split() for c in INDEX.split(", "))])
        run, out, at, index = "", None, 0, []

        def closed():
            out.close()
            index.sort(key=lambda x: (x["url_key"], x["capture_time"], x["page_id"] is not None, x["page_id"] or 0))
            return pa.RecordBatch.from_pylist(index, schema)

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    run = uuid.uuid4().hex
                    out, at, index = system.open_output_stream(f"{base}/{run}.warc.gz", compression=None), 0, []
                data = _record(row)
                out.write(data)
                index.append({"run": run, "file": f"{run}.warc.gz", "offset": at, "length": len(data),
                              **{k: row[k] for k in ("url_key", "capture_time", "page_id", "payload_digest",
                                                     "record_type")}})
                at += len(data)
                if at >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    rows = captures.select("page_id", F.col("url").cast("string").alias("url"), url_key(F.col("url")).alias("url_key"),
                           F.coalesce("capture_time", F.lit("0" * 14)).alias("capture_time"),
                           F.coalesce(F.col("payload"), F.lit("")).cast("binary").alias("payload"),
                           "payload_bytes", "payload_digest", "record_type", "refers_to")
    return rows.mapInArrow(write, INDEX)


class LoserTree:
    """Merges sorted lists: inner nodes keep the loser of a match, so each step replays one path."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.at = runs, key, [0] * len(runs)
        self.size = 1
        while self.size < max(len(runs), 1):
            self.size *= 2
        self.heads = [self._head(i) for i in range(self.size)]
        self.losers = [-1] * self.size
        winners = list(range(self.size))
        level = self.size
        while level > 1:
            level //= 2
            for i in range(level):
                a, b = winners[2 * i], winners[2 * i + 1]
                a, b = (a, b) if self.heads[a] <= self.heads[b] else (b, a)
                winners[i], self.losers[level + i] = a, b
        self.winner = winners[0]

    def _head(self, i: int):
        """Smaller for what comes first; runs at their end come last, ties go by run."""
        if i < len(self.runs) and self.at[i] < len(self.runs[i]):
            return (0, self.key(self.runs[i][self.at[i]]), i)
        return (1, (), i)

    def __iter__(self):
        while self.heads[self.winner][0] == 0:
            i = self.winner
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self.heads[i] = self._head(i)
            node = (self.size + i) // 2
            while node:
                if self.heads[self.losers[node]] < self.heads[i]:
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i


def merged_history(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Index rows in global order of URL key, time and id: history_range, then history_place."""
    order = ["url_key", "capture_time", "page_id"]
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), index.count() // range_rows + 1)
    # order holds a unique address too, so that one capture repeated very often still splits
    dealt = index.repartitionByRange(parts, *order, "file", "offset").withColumn("history_range", F.spark_partition_id())

    def merge(batches):
        runs: dict[str, list] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for row in batch.to_pylist():
                runs.setdefault(row["run"], []).append(row)

        def key(x):
            return (x["url_key"], x["capture_time"], x["page_id"] is not None, x["page_id"] or 0, x["file"], x["offset"])

        for rows in runs.values():  # pieces of a run arrive in order; a sort of sorted rows is one pass
            rows.sort(key=key)
        place, out = 0, []
        for row in LoserTree(list(runs.values()), key):
            out.append(row | {"history_place": place})
            place += 1
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist(out, schema.append(pa.field("history_place", pa.int64())))
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema.append(pa.field("history_place", pa.int64())))

    return dealt.mapInArrow(merge, f"{INDEX}, history_range int, history_place bigint")


def _members(stream, start: int = 0):
    """(offset, content) of each gzip member; one member is in memory at a time."""
    offset, pending = start, b""
    while True:
        pending = pending or stream.read(1 << 20)
        if not pending:
            return
        unpacker, parts, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not pending:
                pending = stream.read(1 << 20)
                if not pending:
                    raise ValueError("an archive ends inside a record")
            used += len(pending)
            parts.append(unpacker.decompress(pending))
            pending = unpacker.unused_data
        used -= len(pending)
        yield offset, b"".join(parts)
        offset += used


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Records of every archive that the index names; payload facts come from the stored bytes,
    for revisits (which hold no payload) from their headers."""
    def read(batches):
        system, base = _files(folder)
        schema = pa.schema([(n, pa.string()) if t == "string" else (n, pa.int64())
                            for n, t in (c.split() for c in RECORD.split(", "))])
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for offset, content in _members(stream):
                        head, _, rest = content.partition(b"\r\n\r\n")
                        fields = dict(line.partition(b": ")[::2] for line in head.split(b"\r\n")[1:])
                        block = rest[:int(fields[b"Content-Length"])]
                        payload = block.partition(b"\r\n\r\n")[2]
                        kind = fields[b"WARC-Type"].decode()
                        whole = kind == "response"
                        digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                        if whole and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{name} at {offset}: the payload is not the one written")
                        page = fields[b"WARC-Record-ID"].decode()[10:-1]
                        refers = fields.get(b"WARC-Refers-To")
                        rows.append({
                            "page_id": None if page == "-" else int(page), "file": name, "offset": offset,
                            "payload_bytes": len(payload) if whole else int(fields[b"X-Payload-Length"]),
                            "payload_digest": digest, "record_type": kind,
                            "refers_to": int(refers.decode()[10:-1]) if refers else None})
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.select("file").distinct().repartition(parts).mapInArrow(read, RECORD)


def positions(history: DataFrame) -> DataFrame:
    """Adds history_position, the place (from 0) in the whole history: the place in the range plus the rows of earlier ranges."""
    sizes = history.groupBy("history_range").agg(F.count("*").alias("n")).collect()  # a row per range
    starts, start = [], 0
    for r in sorted(sizes, key=lambda r: r["history_range"]):
        starts.append((r["history_range"], start))
        start += r["n"]
    before = history.sparkSession.createDataFrame(starts, "history_range int, _start bigint")
    return history.join(before, "history_range").withColumn("history_position", F.col("_start") + F.col("history_place")).drop("_start")


def archive_round_trip(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """captures(page_id, url, capture_time, payload): written, merged by index, and read back."""
    spark = captures.sparkSession
    folder = work_dir(spark, "warc")
    rows = with_revisits(captures.withColumn("payload", F.coalesce("payload", F.lit(""))))
    index = stored(write_archives(rows, folder), "warc-index")
    history = positions(stored(merged_history(index, range_rows).select(
        "file", "offset", "url_key", "capture_time", "history_range", "history_place"), "warc-history"))
    # the list of files under the records is small, so their size would be estimated far too low for a broadcast
    return read_archives(index, folder).hint("merge").join(history.hint("merge"), ["file", "offset"])
