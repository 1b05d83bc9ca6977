"""WARC records in seekable Zstandard bundles.

A bundle is a file, NAME.warc.zst, that any Zstandard reader opens.  It groups records into independent frames of bounded
size and ends with the seek table of the seekable format: a skippable frame with the compressed and decompressed size of
every frame.  Tasks write their bundles below the shared folder, each under a name made of its content when it is whole, so
a task that is run again does no harm; the written manifest lists the bundles that count.  The record index maps each
record id to its bundle, its frame and the offset in the frame: a record is read by seeking to one frame.

Payloads repeat on the web, so equal payloads are stored once: the record with the largest id is a response and the
others revisit it.  Who revisits whom is settled on ids and digests alone.  Digests that more than a ten-thousandth of
all rows share are at most ten thousand and meet their rows in a broadcast join; the others meet in a shuffle in which no
key is hot.  Payloads are not shuffled: the pages are scanned again, and a cascade of two bit tables tells responses from
revisits by page id and digest; only pages on which the tables do not agree, few until the tables reach their largest
size, go through an exact join.  Revisits have no block and are written from the table of digests.

Defined results: a null payload is an empty one; empty and short payloads are always responses.  A row without an id
revisits the record with the largest id, if there is one, else it is a response.  Rows that share the largest id are
responses, each with its payload, and share the record id, which is made of page id and digest; other repeated ids give
records of their own that share it too, and a lookup gives all records with that id.  An empty table gives no bundle.
Other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from lucidframe.llm.hashing import key_filter
from lucidframe.llm.text import bounded_batches, table
from lucidframe.session import materialize, own_folder, release

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records in a frame and of frames in a bundle, before compression.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20
MIN_PAYLOAD = 1000
DATE = "2024-01-01T00:00:00Z"

#: Rows of the manifest: a bundle, its size, its frames and its records.
BUNDLES = "bundle string, size long, frames array<struct<at:long,packed:long,size:long>>, records array<struct<page_id:long,record_id:string,frame:int,offset:long,length:long>>"
#: A digest is met by broadcast if more than one in HOT_SHARE rows has it, so there are at most HOT_SHARE of them, and
#: more than LEAST_HOT rows.
HOT_SHARE, LEAST_HOT = 10_000, 1000
#: Bytes of bundles that a task reads.
TASK_BYTES = 64 << 20


@dataclass(frozen=True)
class Place:
    page_id: int | None
    record_id: str
    frame: int
    offset: int
    length: int


def record_id(page_id: int | None, digest: str) -> str:
    """A URN that is the same whenever the record is written again."""
    h = hashlib.sha1(f"{page_id}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def write_record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, refers_to: int | None, size: int | None = None) -> bytes:
    """One WARC/1.1 record; a revisit has no block, and needs no payload if its size is given."""
    kind = "response" if refers_to is None else "revisit"
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload) if size is None else size}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = (payload or b"") if refers_to is None else b""
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(fields, block, offset, length) of the records of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at offset {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        n = int(fields["Content-Length"])
        block, stop = data[end + 4 : end + 4 + n], end + 4 + n
        if len(block) < n or data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at offset {at} is cut short")
        yield fields, block, at, stop + 4 - at
        at = stop + 4


class BundleWriter:
    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.level = frame_bytes, level
        self.open, self.frames, self.places, self.size = bytearray(), [], [], 0

    def add(self, page_id: int | None, name: str, record: bytes) -> None:
        if self.open and len(self.open) + len(record) > self.frame_bytes:
            self.flush()
        self.places.append(Place(page_id, name, len(self.frames), len(self.open), len(record)))
        self.open += record
        self.size += len(record)

    def flush(self) -> None:
        if self.open:
            self.frames.append((zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress(bytes(self.open)), len(self.open)))
            self.open = bytearray()

    def close(self) -> bytes:
        """All frames and the seek table."""
        self.flush()
        entries = b"".join(struct.pack("<II", len(c), n) for c, n in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        return b"".join(c for c, _ in self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


class Bundle:
    """Random access by the seek table at the end; ``source`` is bytes or an open file, of which only what is asked for is read."""

    def __init__(self, source: bytes | pa.NativeFile):
        self.source = pa.BufferReader(source) if isinstance(source, bytes) else source
        size = self.source.size()
        if size < 17:
            raise ValueError("no seek table")
        count, flags, magic = struct.unpack("<IBI", self.source.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        begin = size - 9 - count * entry
        if begin < 8 or struct.unpack("<II", self.source.read_at(8, begin - 8)) != (SKIPPABLE_MAGIC, count * entry + 9):
            raise ValueError("a damaged seek table")
        seek_table = self.source.read_at(count * entry, begin)
        self.frames, at = [], 0
        for i in range(count):
            packed, full = struct.unpack_from("<II", seek_table, i * entry)
            self.frames.append((at, packed, full))
            at += packed

    def frame(self, i: int) -> bytes:
        return read_frame(self.source, *self.frames[i])

    def record(self, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        fields, block, _, _ = next(read_records(self.frame(frame)[offset : offset + length]))
        return fields, block


def read_frame(source: pa.NativeFile, at: int, packed: int, size: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(source.read_at(packed, at), max_output_size=size) if size else b""


def store_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def open_bundle(path: str) -> pa.NativeFile:
    store, name = store_of(path)
    return store.open_input_file(name)


def save_bundle(folder: str, data: bytes) -> str:
    """Writes a bundle under the name of its content, in one step; gives its path."""
    store, root = store_of(folder)
    name = f"{hashlib.sha1(data).hexdigest()}.warc.zst"
    if store.get_file_info(f"{root}/{name}").type == pyarrow.fs.FileType.NotFound:
        store.create_dir(root, recursive=True)
        part = f"{root}/{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as out:
            out.write(data)
        store.move(part, f"{root}/{name}")
    return f"{folder}/{name}"


def bundle_rows(batches: Iterator[pa.RecordBatch], folder: str, frame_bytes: int, bundle_bytes: int) -> Iterator[pa.RecordBatch]:
    """Writes bundles of the rows (page_id, url, payload, digest, refers_to, n) of a task; gives their manifest."""
    longs = lambda *names: pa.list_(pa.struct([(n, pa.string() if n == "record_id" else pa.int32() if n == "frame" else pa.int64()) for n in names]))

    def done(writer: BundleWriter) -> pa.RecordBatch:
        data = writer.close()
        frames, at = [], 0
        for packed, size in writer.frames:
            frames.append({"at": at, "packed": len(packed), "size": size})
            at += len(packed)
        places = [p.__dict__ for p in writer.places]
        columns = [pa.array([save_bundle(folder, data)]), pa.array([len(data)], pa.int64()), pa.array([frames], longs("at", "packed", "size")), pa.array([places], longs("page_id", "record_id", "frame", "offset", "length"))]
        return pa.RecordBatch.from_arrays(columns, ["bundle", "size", "frames", "records"])

    writer = BundleWriter(frame_bytes)
    for batch in batches:
        ids, urls, digests, refers, sizes = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
        for i, payload in enumerate(batch.column(2)):
            writer.add(ids[i], record_id(ids[i], digests[i]), write_record(ids[i], urls[i], payload.as_py(), digests[i], refers[i], sizes[i]))
            if writer.size >= bundle_bytes:
                yield done(writer)
                writer = BundleWriter(frame_bytes)
    if writer.places:
        yield done(writer)


def digests_of(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, n) of rows ``page_id, url, payload``, written to the shared folder."""
    return materialize(pages.select("page_id", "url", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n")), "digests", compression="zstd")


def revisits(digests: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, url, digest, n, refers_to) of the rows that revisit another record."""
    long = digests.where(F.col("n") >= min_payload)
    groups = materialize(long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 and refers_to is not null"), "groups")
    hot = F.col("copies") > max(LEAST_HOT, long.count() // HOT_SHARE)
    # at most HOT_SHARE digests are so frequent
    marked = long.join(F.broadcast(groups.where(hot).select("digest", "refers_to")), "digest", "left")
    cold = groups.where(~hot).select("digest", F.col("refers_to").alias("cold_to"))
    may = key_filter(cold, "digest")(F.col("digest"))
    met = marked.where(F.col("refers_to").isNull() & may).join(cold, "digest").select("page_id", "url", "digest", "n", F.col("cold_to").alias("refers_to"))
    every = marked.where("refers_to is not null").select(met.columns).unionByName(met)
    found = materialize(every.where("page_id is null or page_id <> refers_to"), "revisits", compression="zstd")
    release(groups)
    return found


def responses(pages: DataFrame, digests: DataFrame, repeats: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """The rows (page_id, url, payload, digest, n) that revisit nothing."""
    sure, unsure = response_parts(pages, digests, repeats, min_payload)
    return sure.unionByName(unsure)


def response_parts(pages: DataFrame, digests: DataFrame, repeats: DataFrame, min_payload: int = MIN_PAYLOAD) -> tuple[DataFrame, DataFrame]:
    """Responses that two bit tables tell, without a shuffle, and those that an exact join tells.

    The first table has the keys of all revisits, the second one those of all other rows that the first one lets pass.
    """
    key = [F.col("page_id"), F.col("digest")]
    named = repeats.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"))
    same = (F.col("digest") == F.col("r_digest")) & F.col("page_id").eqNullSafe(F.col("r_id"))
    first = key_filter(repeats, "page_id", "digest")
    long = F.col("n") >= min_payload
    others = materialize(digests.where(long & first(*key)).select("page_id", "digest").join(named, same, "left_anti"), "others")
    second = key_filter(others, "page_id", "digest")
    digested = pages.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    sure = digested.where(~(long & first(*key)))
    unsure = digested.where(long & first(*key) & second(*key)).join(named, same, "left_anti")
    release(others)
    return sure, unsure


def write_bundles(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = MIN_PAYLOAD, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, folder: str | None = None) -> DataFrame:
    """Writes every row's record into bundles below ``folder`` (else below the shared one); gives the written manifest."""
    to = (folder or f"{own_folder(df.sparkSession)}/bundles").rstrip("/")
    pages = bounded_batches(df).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    digests = digests_of(pages)
    repeats = revisits(digests, min_payload)
    none = F.lit(None)
    rows = responses(pages, digests, repeats, min_payload).withColumn("refers_to", none.cast("long")).unionByName(repeats.withColumn("payload", none.cast("binary")))
    names = ["page_id", "url", "payload", "digest", "refers_to", "n"]
    manifest = materialize(rows.select(names).mapInArrow(lambda b: bundle_rows(b, to, frame_bytes, bundle_bytes), BUNDLES), "manifest")
    release(digests, repeats)
    return manifest


def record_index(bundles: DataFrame) -> DataFrame:
    """Record id -> bundle, frame and offset in the frame, and where the frame is in the bundle; no bundle is opened."""
    each = bundles.select("bundle", "frames", F.explode("records").alias("r"))
    place = F.get("frames", F.col("r.frame"))
    return each.select("r.record_id", "r.page_id", "bundle", "r.frame", "r.offset", "r.length", place["at"].alias("frame_at"), place["packed"].alias("frame_packed"), place["size"].alias("frame_size"))


def lookup(bundles: DataFrame, ids: DataFrame) -> DataFrame:
    """Fields and payloads of the records with these ids (one column ``record_id``); a frame is read once, by its range."""
    wanted = record_index(bundles).join(ids.select("record_id").distinct(), "record_id").select("bundle", "frame_at", "frame_packed", "frame_size", "offset", "length", "record_id")
    dealt = bounded_batches(wanted).repartition("bundle", "frame_at").sortWithinPartitions("bundle", "frame_at", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, data = None, b""
        for batch in batches:
            for row in batch.to_pylist():
                if (row["bundle"], row["frame_at"]) != last:
                    last = row["bundle"], row["frame_at"]
                    with open_bundle(row["bundle"]) as file:
                        data = read_frame(file, row["frame_at"], row["frame_packed"], row["frame_size"])
                fields, block, _, _ = next(read_records(data[row["offset"] : row["offset"] + row["length"]]))
                yield pa.RecordBatch.from_arrays([pa.array([row["record_id"]]), pa.array([fields["WARC-Type"]]), pa.array([fields["WARC-Target-URI"]]), pa.array([block], pa.binary())], ["record_id", "record_type", "url", "payload"])

    return dealt.mapInArrow(read, "record_id string, record_type string, url string, payload binary")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """One row per record, parsed from the bundles frame by frame."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, stored_digest string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_bundle(path) as file:
                    bundle = Bundle(file)
                    for i in range(len(bundle.frames)):
                        rows = []
                        for f, block, _, _ in read_records(bundle.frame(i)):
                            number = lambda k: int(f[k]) if f.get(k) else None  # noqa: E731, B023
                            rows.append((number("X-Page-ID"), int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"], number("X-Refers-To-Page"), f["WARC-Record-ID"], hashlib.sha1(block).hexdigest() if f["WARC-Type"] == "response" else None))
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names)

    size = bundles.agg(F.sum("size")).first()[0] or 0
    tasks = max(bundles.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return bundles.select("bundle").repartition(tasks, "bundle").mapInArrow(read, schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_bundles(write_bundles(table(spark, sf_dir, "pages")))
    # what a response holds must be what was announced
    sound = F.when(F.coalesce(F.col("stored_digest") == F.col("payload_digest"), F.lit(True)), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a stored payload differs from its digest")))
    return records.select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to", "record_id")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p
), r AS (SELECT *, CASE WHEN payload_bytes >= {MIN_PAYLOAD} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS top FROM q
), h AS (SELECT *, sha1(page_id || ':' || payload_digest) AS x FROM r)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to,
  '<urn:uuid:' || x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-a' || x[18:20] || '-' || x[21:32] || '>' AS record_id
FROM h
"""
