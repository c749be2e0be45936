"""WARC archives and their two-level capture index.

Records are written in archives of one gzip member each, so that any record can
be read alone by offset and length. The index is sorted by capture key: the
reversed host of the URL, its path and query, and the capture's number. Sorted
entries are cut into compressed blocks; the sparse directory holds the first key
of each block. A look-up bisects the directory, unpacks one block, bisects its
keys, and then reads just the record's range of bytes.

The index is spread over shards by key range. There are at most ``SHARDS`` of
them, so the list of their first keys can go to every task; a shard's directory
and blocks stay with the shard.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpweave.llm.frames import map_partition, open_input, open_output
from dumpweave.plans.session import store, work_dir

LEAST_SHARED = 1000
BLOCK_ENTRIES = 1000
SHARD_ENTRIES = 10_000
SHARDS = 4096
# payload bytes after which an archive is closed
ARCHIVE_BYTES = 256 << 20
CRLF = b"\r\n"
DATE = "1970-01-01T00:00:00Z"
ENTRY = "key string, file string, offset long, length long"


# --- records ----------------------------------------------------------------------------


def capture_key(url: str | None, number: int | None) -> str:
    """Reversed host, path and query of a URL, then the capture's number in a fixed width.

    Scheme, user, port, a leading ``www.`` and the fragment are left out, and
    the host is in lower case. A null URL has an empty first part.
    """
    try:
        parts = urlsplit((url or "").strip())
        host = parts.hostname or ""
    except ValueError:  # not a URL: kept as it is
        return f"{url} {_number(number)}"
    host = host.removeprefix("www.")
    turned = ",".join(reversed(host.split("."))) + ")" if host else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{turned}{parts.path or '/'}{query} {_number(number)}"


def _number(number: int | None) -> str:
    # sorts as the number does; a null comes first
    return "-" if number is None else f"{number + 2**63:020d}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no block; it names the response it repeats."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    block = b"" if revisit else payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by name in lower case, and the block; its length is that of Content-Length."""
    head, found, rest = raw.partition(CRLF * 2)
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        headers[name.lower()] = value.strip()
    length = int(headers["content-length"])
    if rest[length:] != CRLF * 2:
        raise ValueError("a record's length does not match its header")
    return headers, rest[:length]


def gzip_member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _urn(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


# --- writing ----------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, digest and, for revisits, ``refers_to``.

    Only ids and digests are grouped. A payload that a third of the pages share
    is counted in the map tasks.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    large = pages.where(F.octet_length("payload") >= least).select("digest", "page_id")
    newest = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    repeats = (
        large.join(newest.where("n > 1 and refers_to is not null"), "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
        .distinct()
    )
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    return pages.join(repeats, same, "left").drop("_id", "_digest")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write records to archives; returns their index entries (key, file, offset, length).

    Each attempt of a task writes files of its own; entries of the attempt that
    counted point to its files, others are left unread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out, path, offset = None, "", 0
        try:
            for batch in batches:
                entries: dict[str, list] = {c: [] for c in ("key", "file", "offset", "length")}
                for row in range(batch.num_rows):
                    if out is None or offset > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        path, offset = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        out = open_output(path)
                    page_id, url, digest, refers_to = (
                        batch.column(c)[row].as_py() for c in ("page_id", "url", "digest", "refers_to")
                    )
                    payload = batch.column("payload")[row].as_py()
                    member = gzip_member(record(page_id, url, payload, digest, refers_to))
                    out.write(member)
                    for c, v in zip(entries, (capture_key(url, page_id), path, offset, len(member)), strict=True):
                        entries[c].append(v)
                    offset += len(member)
                yield entries
        finally:
            if out is not None:
                out.close()

    return map_partition(records, run, ENTRY)


# --- index ------------------------------------------------------------------------------


def build_index(entries: DataFrame) -> tuple[DataFrame, list[str]]:
    """Sorted blocks (shard, block, first_key, data), and the first key of each shard.

    The bounds of the shards come from sorting; equal keys stay in one shard.
    """
    rows = entries.count()
    shards = int(min(max(-(-rows // SHARD_ENTRIES), 1), SHARDS))
    ranged = entries.repartitionByRange(shards, "key").sortWithinPartitions("key", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        waiting: list[tuple] = []
        number = 0
        for batch in batches:
            waiting.extend(zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True))
            # a block ends between two keys, so that one block has all entries of a key
            while len(waiting) > BLOCK_ENTRIES:
                cut = next((i for i in range(BLOCK_ENTRIES, len(waiting)) if waiting[i][0] != waiting[i - 1][0]), None)
                if cut is None:
                    break
                yield _block(number, waiting[:cut])
                waiting, number = waiting[cut:], number + 1
        if waiting:
            yield _block(number, waiting)

    blocks = map_partition(ranged, run, "block int, first_key string, data binary")
    blocks = store(blocks.withColumn("part", F.spark_partition_id()))
    firsts = blocks.groupBy("part").agg(F.min("first_key").alias("first_key")).orderBy("first_key").collect()
    numbers = blocks.sparkSession.createDataFrame(
        [(r["part"], i) for i, r in enumerate(firsts)], "part int, shard int"
    )
    # at most ``SHARDS`` rows
    blocks = blocks.join(F.broadcast(numbers), "part").select("shard", "block", "first_key", "data")
    return blocks, [r["first_key"] for r in firsts]


def _block(number: int, entries: list[tuple]) -> dict:
    lines = "\n".join(f"{key}\t{file}\t{offset}\t{length}" for key, file, offset, length in map(_escaped, entries))
    return {"block": [number], "first_key": [entries[0][0]], "data": [zlib.compress(lines.encode(), 6)]}


def _escaped(entry: tuple) -> tuple:
    return entry[0].replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n"), *entry[1:]


def _unescaped(key: str) -> str:
    if "\\" not in key:
        return key
    return key.replace("\\\\", "\0").replace("\\t", "\t").replace("\\n", "\n").replace("\0", "\\")


class BlockReader:
    """Look-ups in one shard: the directory is bisected, then the block; the last block stays unpacked."""

    def __init__(self, first_keys: list[str], blocks: list[bytes]):
        self.first_keys, self.blocks, self.at = first_keys, blocks, -1

    def find(self, key: str) -> list[tuple[str, int, int]]:
        place = bisect.bisect_right(self.first_keys, key) - 1
        if place < 0:
            return []
        if place != self.at:
            lines = [x.split("\t") for x in zlib.decompress(self.blocks[place]).decode().split("\n")]
            self.keys = [_unescaped(x[0]) for x in lines]
            self.rest = [(x[1], int(x[2]), int(x[3])) for x in lines]
            self.at = place
        lo = bisect.bisect_left(self.keys, key)
        return self.rest[lo : bisect.bisect_right(self.keys, key, lo)]


def look_up(wanted: DataFrame, blocks: DataFrame, first_keys: list[str]) -> DataFrame:
    """(file, offset, length) of the captures with the keys in ``wanted`` (key), each once."""
    spark = wanted.sparkSession
    sent = spark.sparkContext.broadcast(first_keys)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            yield {
                "shard": [max(bisect.bisect_right(sent.value, k) - 1, 0) for k in keys],
                "key": keys,
            }

    def search(key: tuple, queries, index) -> object:
        import pandas as pd

        index = index.sort_values("block")
        reader = BlockReader(index["first_key"].tolist(), index["data"].tolist())
        found = [entry for k in sorted(set(queries["key"])) for entry in reader.find(k)]
        return pd.DataFrame(found, columns=["file", "offset", "length"])

    dealt = map_partition(wanted.select("key").distinct(), shard, "shard int, key string")
    return dealt.groupBy("shard").cogroup(blocks.groupBy("shard")).applyInPandas(
        search, "file string, offset long, length long"
    )


# --- reading ----------------------------------------------------------------------------


def read_records(places: DataFrame) -> DataFrame:
    """Records at (file, offset, length), read by range and unpacked.

    Columns: page_id, url, record_type, refers_to, payload_digest and
    payload_bytes; of a revisit the last is null, as its payload is elsewhere. A
    response whose payload does not have its digest is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        columns = ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes")
        path, source = None, None
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in columns}
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != path:
                    if source is not None:
                        source.close()
                    path, source = file, open_input(file)
                headers, block = parse_record(zlib.decompress(source.read_at(length, offset), 31))
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                revisit = headers["warc-type"] == "revisit"
                if not revisit and hashlib.sha1(block).hexdigest() != digest:
                    raise ValueError(f"{file}: the payload at {offset} does not have its digest")
                values = (
                    _urn(headers["warc-record-id"]),
                    headers["warc-target-uri"],
                    headers["warc-type"],
                    _urn(headers["warc-refers-to"]) if revisit else None,
                    digest,
                    None if revisit else len(block),
                )
                for c, v in zip(columns, values, strict=True):
                    rows[c].append(v)
            yield rows
        if source is not None:
            source.close()

    ordered = places.repartition("file", F.floor(F.col("offset") / F.lit(8 << 20))).sortWithinPartitions("file", "offset")
    return map_partition(
        ordered,
        run,
        "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long",
    )


def captures(pages: DataFrame, least: int = LEAST_SHARED, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, index them, and read every capture back.

    One row per page: page_id, payload_bytes, payload_digest (SHA-1, of the full
    payload), record_type and refers_to. The payload is the html in UTF-8; a null
    is empty. Of pages with equal payloads of at least ``least`` bytes the one
    with the largest page_id is a response and the others are revisits of it;
    rows that share this page_id are all responses. A row without page_id repeats
    others but is never repeated: among equal payloads without any page_id all
    are responses. Other columns are left out. An empty table gives no rows.
    """
    folder = folder or work_dir(pages.sparkSession, "archives")
    entries = store(write_archives(with_revisits(pages, least), folder))
    blocks, first_keys = build_index(entries)
    records = store(read_records(look_up(entries, blocks, first_keys)))
    # a revisit's payload is that of the response it names
    sizes = (
        records.where("record_type = 'response' and page_id is not null")
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.max("payload_bytes").alias("its_bytes"))
    )
    found = records.join(sizes, ["refers_to", "payload_digest"], "left")
    return found.select(
        "page_id",
        F.coalesce("payload_bytes", "its_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )
