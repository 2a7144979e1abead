"""WARC archives compressed with Zstandard and a shared dictionary.

An archive starts with a skippable frame that holds the dictionary; then comes one frame per record. The writer packs
records of ``pages`` into archives of bounded size, in tasks, under names of the task's attempt. Its result is the manifest;
once that is written, it names exactly the archives of the attempts that counted, whatever retried or lost tasks left in
the folder. The reader takes the archives of a manifest, loads the dictionary from the leading frame, decodes frame by
frame, and checks each record's version line, headers, lengths and digests, and the number of records of each archive.

Payloads of at least ``dedup_from`` bytes that are equal are stored once: the record of the smallest page_id is the
response, others are revisits that keep the HTTP head and refer to it.

Defined results: a null html is an empty payload; a null url is an empty target; a null page_id is a page like any
other (never the smallest while there are others) and comes back as null; an empty table gives an empty result; repeated
rows give a record each, of which one is the response; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.numbering import looked_up
from flowloom.operators.ranges import numbered as placed_in_ranges
from flowloom.plans.scratch import written

#: The skippable frame type that holds a dictionary at the start of an archive.
DICT_MAGIC = 0x184D2A5D
#: The dictionary is trained on this many pages at most, and on this many bytes of each.
SAMPLE_PAGES, SAMPLE_BYTES, DICT_BYTES = 200, 16_384, 65_536
#: An archive is closed when it reaches this many bytes: what a reader holds at once.
ARCHIVE_BYTES = 16 << 20
#: Bytes that the reader feeds at a time; what follows a frame's end is copied, so this bounds the copies.
STEP = 16_384
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, payload binary"


def with_first_copies(pages: DataFrame, dedup_from: int = 100) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses).

    Equal payloads are found among ids and digests alone; a payload meets its first copy by its own page_id, so a payload
    that many pages share is not gathered.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keys = written(rows.filter(F.octet_length("html") >= dedup_from).select("page_id", F.sha2("html", 256).alias("digest")), "page-digests")
    repeated = keys.groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1 AND _first IS NOT NULL")
    known = written(looked_up(keys, written(repeated, "repeated"), "digest").filter("_first IS NOT NULL"), "known")
    refers = written(known.filter("NOT page_id <=> _first").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "_first").distinct(), "revisits")
    holders = written(known.filter("page_id <=> _first").groupBy(F.col("page_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "repeated-holders")
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    digested = rows.withColumn("digest", F.sha2("html", 256))
    names = ["page_id", "url", "html", "digest"]
    once = lambda df: df.join(refers, same, "left").select(*names, F.col("_first").alias("refers_to"))
    if holders.isEmpty():
        return once(digested)
    # a first holder that repeats its page_id: one of its rows is the response, the others revisit it
    again = digested.join(holders, same, "left_semi").withColumn("_any", F.monotonically_increasing_id())
    placed = placed_in_ranges(again, ["url", "_any"], ["page_id", "digest"], "_place")
    return once(digested.join(holders, same, "left_anti")).unionByName(placed.select(*names, F.when(F.col("_place") > 0, F.col("page_id")).alias("refers_to")))


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response or revisit record, uncompressed."""
    name = "none" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed_record(raw: bytes) -> tuple:
    """The fields of RECORD from one record's bytes; raises ValueError if anything is amiss."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    named = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name.lower() in named:
            raise ValueError(f"bad header line {line!r}")
        named[name.lower()] = value.strip(" ")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-target-uri", "warc-payload-digest"):
        if name not in named:
            raise ValueError(f"no {name}")
    n = int(named["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("the block's length is not Content-Length")
    if named.get("warc-block-digest", "") not in ("", "sha256:" + hashlib.sha256(block).hexdigest()):
        raise ValueError("the block's digest differs")
    http, found, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.partition(b":")[2]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not found or not http.startswith(b"HTTP/") or len(sizes) != 1:
        raise ValueError("bad HTTP head")
    kind, digest = named["warc-type"], named["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        if len(payload) != sizes[0] or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("the payload's length or digest differs")
    elif kind != "revisit" or payload or "warc-refers-to" not in named or "warc-profile" not in named:
        raise ValueError(f"bad {kind} record")

    def number(x: str | None) -> int | None:
        if x is None or x == "<urn:page:none>":
            return None
        if not (x.startswith("<urn:page:") and x.endswith(">")):
            raise ValueError(f"bad record id {x!r}")
        return int(x[10:-1])

    target = named["warc-target-uri"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return number(named["warc-record-id"]), sizes[0], digest, kind, number(named.get("warc-refers-to")), target, payload


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame."""
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary


def read_archive(content: bytes) -> Iterator[tuple]:
    """The records of an archive, one frame at a time."""
    view, dictionary = memoryview(content), None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICT_MAGIC:
        n = struct.unpack_from("<I", view, 4)[0]
        if 8 + n > len(view):
            raise ValueError("the dictionary frame is cut short")
        found = bytes(view[8 : 8 + n])
        if found[:4] == zstandard.FRAME_HEADER:
            found = zstandard.ZstdDecompressor().decompress(found)
        dictionary, view = zstandard.ZstdCompressionDict(found) if found else None, view[8 + n :]
    opened = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    at = 0
    while at < len(view):
        frame, raw = opened.decompressobj(), []
        while not frame.eof:
            piece = view[at : at + STEP]
            if not piece:
                raise ValueError("a record's frame is cut short")
            raw.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        yield parsed_record(b"".join(raw))


def trained_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample (SAMPLE_PAGES pages, by a hash of ids and texts, SAMPLE_BYTES of each); empty where there is too little.

    Only hashes below a threshold are candidates, about four times the sample at any size, so what reaches the driver doesn't
    grow with the pages or their partitions.
    """
    share = min(1.0, 4 * SAMPLE_PAGES / max(1, pages.count()))
    order = F.xxhash64("page_id", "html")
    drawn = pages.filter("html IS NOT NULL").filter(F.shiftrightunsigned(order, 1) <= F.lit(min(2**63 - 1, int(share * 2**63))))
    sample = [r[0].encode() for r in drawn.select(F.substring("html", 1, SAMPLE_BYTES).alias("_cut"), order.alias("_order")).orderBy("_order").limit(SAMPLE_PAGES).collect() if r[0]]
    if sum(map(len, sample)) < 8 * DICT_BYTES // 4:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, folder: str, dictionary: bytes | None = None, archive_bytes: int = ARCHIVE_BYTES, dedup_from: int = 100) -> DataFrame:
    """Writes a record per page to archives below ``folder`` (a URI that executors share) and returns the manifest: path, records, bytes."""
    rows = with_first_copies(pages, dedup_from)
    words = trained_dictionary(pages) if dictionary is None else dictionary

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        shared = zstandard.ZstdCompressionDict(words) if words else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=shared) if shared else zstandard.ZstdCompressor(level=3)
        part, attempt, number = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        frames: list[bytes] = []

        def closed() -> pd.DataFrame:
            content = dictionary_frame(words) + b"".join(frames)
            name = f"{top}/pages-{part:06d}-{number:04d}-{attempt}.warc.zst"
            with store.open_output_stream(name, compression=None) as out:
                out.write(content)
            return pd.DataFrame({"path": [name], "records": [len(frames)], "bytes": [len(content)]})

        size = 0
        for batch in batches:
            for page, url, html, digest, refers in zip(batch["page_id"], batch["url"], batch["html"], batch["digest"], batch["refers_to"]):
                if size >= archive_bytes:
                    yield closed()
                    frames.clear()
                    number, size = number + 1, 0
                frames.append(packer.compress(record_bytes(None if pd.isna(page) else int(page), url, html.encode(), digest, None if pd.isna(refers) else int(refers))))
                size += len(frames[-1])
        if frames:
            yield closed()

    # ids as text: pandas would turn longs with nulls into floats
    text = rows.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    return text.mapInPandas(pack, "path string, records long, bytes long")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """The records of the archives that a written ``manifest`` names, or else of all archives below ``folder``: RECORD.

    A record that fails a check fails the job, and so does an archive that holds another number of records than its manifest says.
    """

    def unpacked(content: bytes, records: int | None) -> Iterator[pd.DataFrame]:
        rows, size, n = [], 0, 0
        for row in read_archive(content):
            rows.append(row)
            size += len(row[-1])
            n += 1
            if size > 4 << 20:
                yield frame(rows)
                rows, size = [], 0
        if rows:
            yield frame(rows)
        if records is not None and n != records:
            raise ValueError(f"{n} records in an archive of {records}")

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, records in zip(batch["path"], batch["records"]):
                with store.open_input_stream(path, compression=None) as opened:
                    content = opened.read()
                yield from unpacked(content, records)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield from unpacked(content, None)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    if manifest is not None:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return manifest.select("path", "records").repartition(tasks, "path").mapInPandas(named, RECORD)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInPandas(listed, RECORD)
