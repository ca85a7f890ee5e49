"""WARC archives: a deterministic sharded writer and a reader.

Pages are cut into shards of consecutive ids by byte counts per id range. Ranges that
hold too many bytes are divided again between their own smallest and largest id, until
each is small beside a shard, so that shards are of like size however the ids lie; the
cuts depend on the pages alone, not on how Spark happened to partition them. Each shard
is sorted by id and written by a task of its own as gzip members, one per record, in
files that roll when their compressed size passes ROLL. Headers, ids and digests are made
anew from the payload (dates are a parameter), so that a rerun writes the same bytes.

A file is written under a temporary name of its attempt and renamed when whole; each
shard then commits a manifest of its files in the same way, and when all are there the
driver commits the archive, a file that names its shards and says how many records it has, and
removes what lost attempts left. Readers start from that file: they take the files that
the manifests name, check sizes, digests and numbers, and fail if a shard is missing. A
task that is lost or run twice leaves the same names and bytes.

Equal payloads of LEAST bytes or more are stored once: the largest id has the response,
the others are revisits with the payload's digest, its length and the id they refer to.
Who refers to whom is decided on digests alone; those few rows are sorted in among the
pages by the same key, so that the texts are shuffled once, to their shards, and a
digest that a third of all pages share is no task's load.

Folders are reached through Spark's file systems' addresses by ``pyarrow.fs`` (local,
HDFS and object stores). Defined cases: a null text is an empty payload and always a
response; pages with a null id come first, in as many shards as their bytes fill, dealt
by hash, and refer to the page with an id that has their payload, or else to the first of themselves;
ids may lie anywhere in the range of a long; of repeated rows of the responding id one is
the response, the rest refer to it; an empty table gives an archive without files; input
columns beside id, url and text are not archived.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import cut, read_table
from pointlake.storage import scratch

LEAST, ROLL, SHARD = 1000, 64 << 20, 256 << 20
#: Ranges that a range of too many bytes is divided into at most, and the part of a shard that a range may fill.
RANGES, FINE = 1 << 12, 8
ARCHIVE = "archive.manifest.json"
DATE = "2020-01-01T00:00:00Z"
#: Bytes read or written at once, and tasks that read an archive at most.
BLOCK, MOST_TASKS = 1 << 16, 1 << 16


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("/"):
        folder = f"file://{folder}"
    elif folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder)


def record_id(page_id: int | None, digest: str, nth: int | str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}:{nth}").urn


def record(page_id: int | None, url: str | None, payload: bytes, refers: tuple[int | None, str, int | str] | None, nth: int | str, date: str = DATE) -> bytes:
    """One record; ``refers``: the id, hex digest and number of the response it revisits."""
    sha = hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = {
        "WARC-Type": "revisit" if refers else "response",
        "WARC-Record-ID": f"<{record_id(page_id, sha.hexdigest(), nth)}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else "".join(c if c > " " else "%%%02X" % ord(c) for c in url),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(sha.digest()).decode(),
        "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
        "X-Page-Id": page_id,
        "X-Payload-Length": len(payload),
    }
    if refers:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{record_id(*refers)}>", "X-Refers-To-Page-Id": refers[0]}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


class Roller:
    """Writes a shard's files one after the other; nothing is visible before it is whole."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.root = file_system(folder)
        self.shard, self.roll, self.attempt = shard, roll, uuid.uuid4().hex
        self.files: list[dict] = []
        self.out = None

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{len(self.files):05d}.warc.gz"
            self.size, self.records, self.sha = 0, 0, hashlib.sha1()
            self.out = self.fs.open_output_stream(f"{self.root}/.tmp-{self.attempt}-{self.name}", compression=None)
        member = gzip.compress(raw, compresslevel=6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self._rename(self.name)
            self.files.append({"name": self.name, "bytes": self.size, "records": self.records, "sha1": self.sha.hexdigest()})
            self.out = None

    def _rename(self, name: str) -> None:
        put(self.fs, f"{self.root}/.tmp-{self.attempt}-{name}", f"{self.root}/{name}")

    def commit(self) -> list[dict]:
        self.close()
        name = f"shard-{self.shard:06d}.manifest.json"
        with self.fs.open_output_stream(f"{self.root}/.tmp-{self.attempt}-{name}", compression=None) as out:
            out.write(json.dumps({"shard": self.shard, "files": self.files}, indent=1).encode())
        self._rename(name)
        return self.files


def put(files: fs.FileSystem, source: str, target: str) -> None:
    """Rename a whole file into place."""
    if not isinstance(files, fs.LocalFileSystem) and files.get_file_info(target).type != fs.FileType.NotFound:
        files.delete_file(target)  # the same bytes of another attempt; HDFS does not rename over a file
    files.move(source, target)


def commit_archive(folder: str, shards: list[int], files: int, records: int) -> None:
    """Say that the archive is whole, and remove what lost attempts left."""
    source, root = file_system(folder)
    text = json.dumps({"shards": shards, "files": files, "records": records}).encode()
    with source.open_output_stream(f"{root}/.tmp-{ARCHIVE}", compression=None) as out:
        out.write(text)
    put(source, f"{root}/.tmp-{ARCHIVE}", f"{root}/{ARCHIVE}")
    for info in source.get_file_info(fs.FileSelector(root)):
        if info.base_name.startswith(".tmp-"):
            source.delete_file(info.path)


class Sums:
    """Size and digest of what was read of a file."""

    def __init__(self) -> None:
        self.size, self.sha1 = 0, hashlib.sha1()

    def add(self, data: bytes) -> bytes:
        self.size += len(data)
        self.sha1.update(data)
        return data


def read_records(source: fs.FileSystem, path: str, sums: Sums | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file of gzip members."""
    sums = sums or Sums()
    with source.open_input_stream(path, compression=None) as raw:
        unzip, held = zlib.decompressobj(31), b""
        parts: list[bytes] = []
        while data := held or sums.add(raw.read(BLOCK)):
            parts.append(unzip.decompress(data))
            held = b""
            if unzip.eof:
                yield parse(b"".join(parts))
                held, parts, unzip = unzip.unused_data, [], zlib.decompressobj(31)
        if any(parts):
            raise ValueError(f"{path} ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"]:
        raise ValueError("block digest differs")
    return fields, block


def _unsigned(ids: pa.Array) -> np.ndarray:
    """Ids in their order, from 0 up."""
    return ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _range_of(column: Column, starts: list[int]) -> Column:
    """The place of an id among the sorted ``starts`` of ranges (unsigned); null for a null id."""
    edges = np.array(starts, np.uint64)

    def place(ids: pa.Array) -> pa.Array:
        missing = ids.is_null()
        at = np.searchsorted(edges, _unsigned(ids.fill_null(0)), side="right") - 1
        return pa.array(at.astype(np.int32), mask=missing.to_numpy(zero_copy_only=False))

    place.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    return F.arrow_udf(place, "int")(column)


def _shards(keys: DataFrame, most: int) -> list[int]:
    """The first ids (unsigned) of shards of about ``most`` bytes, from (id, n); nothing without ids.

    On the driver there is a row a range, as Arrow: about FINE for each shard.
    """
    known, room = keys.where(F.col("id").isNotNull()), max(1, most // FINE)
    starts, done = [0], False
    while not done:
        found = known.groupBy(_range_of(F.col("id"), starts).alias("r")).agg(F.sum("n").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).toArrow().sort_by("r")
        sizes = found.column("n").to_numpy()
        wide = np.flatnonzero((sizes > room) & (found.column("lo").to_numpy() < found.column("hi").to_numpy()))
        more: set[int] = set()
        for i in wide.tolist():
            lo, hi = (found.column(c)[i].as_py() + (1 << 63) for c in ("lo", "hi"))
            pieces = min(RANGES, max(2, -(-int(sizes[i]) // room)))
            more |= set(range(lo, hi + 1, -(-(hi - lo + 1) // pieces)))
        known_starts, starts = starts, sorted({*starts, *more})
        done = len(starts) == len(known_starts)
    out, held = [], most
    for place, size in zip(found.column("r").to_pylist(), sizes.tolist()):
        if held and held + size > most:
            out.append(starts[place])
            held = 0
        held += size
    return out


def written(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST, roll: int = ROLL, shard_bytes: int = SHARD, date: str = DATE) -> DataFrame:
    """Archive ``pages`` in ``folder``; returns the manifest, one row a file."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), text.alias("payload"))
    salt = F.xxhash64("digest", "url")
    keys = cut(rows.select("id", F.sha1("payload").alias("digest"), "url", F.octet_length("payload").cast("long").alias("n")).select("id", "digest", "n", salt.alias("salt")))
    starts = _shards(keys, shard_bytes)
    without = keys.where("id is null").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    first = max(1, -(-without.n // shard_bytes)) if without.rows else 0  # shards of pages without an id
    shards = first + len(starts)

    def shard(salt: Column) -> Column:
        own = F.pmod(salt, F.lit(max(1, first))).cast("int")
        return own if not starts else F.coalesce(_range_of(F.col("id"), starts) + F.lit(first), own)

    keys = keys.withColumn("shard", shard(F.col("salt")))
    # copies: one row per id and digest that occur where the digest has several rows, in each shard that needs it
    large = keys.where(F.col("n") >= least)
    answers = large.groupBy("digest").agg(F.max("id").alias("answer"), F.min("shard").alias("home"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    notes = large.select("id", "digest", "shard").join(answers, "digest").distinct()
    notes = notes.select("shard", "id", "digest", F.lit(0).alias("what"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "answer", "home")
    own = rows.withColumn("digest", F.sha1("payload")).select(shard(salt).alias("shard"), "id", "digest", F.lit(1).alias("what"), "url", "payload", F.lit(None).cast("long").alias("answer"), F.lit(None).cast("int").alias("home"))
    sorted_ = own.unionByName(notes).repartitionById(max(1, shards), "shard").sortWithinPartitions("shard", "id", "digest", "what", "url")
    schema = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha1", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, note, seen, nth, done = None, None, None, 0, []
        for batch in batches:
            for row in zip(*(c for c in batch.columns)):
                at, id_, digest, what, url, payload, answer, home = (x.as_py() for x in row)
                if roller is None or roller.shard != at:
                    done += [(roller.shard, f) for f in roller.commit()] if roller else []
                    roller, note, seen = Roller(folder, at, roll), None, None
                if what == 0:
                    note = (id_, digest, answer, home)
                    continue
                nth = nth + 1 if seen == (id_, digest) else 0
                seen = (id_, digest)
                copied = note is not None and note[:2] == seen
                refers = None
                if copied and (id_ != note[2] or nth or id_ is None and at != note[3]):
                    refers = (note[2], digest, 0 if note[2] is not None else f"{note[3]}:0")
                roller.add(record(id_, url, payload, refers, f"{at}:{nth}" if id_ is None else nth, date))
        if roller:
            done += [(roller.shard, f) for f in roller.commit()]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.int32()), *[pa.array([f[c] for _, f in done], k) for c, k in (("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha1", pa.string()))]], schema=schema)

    source, root = file_system(folder)
    source.create_dir(root, recursive=True)
    if source.get_file_info(f"{root}/{ARCHIVE}").type != fs.FileType.NotFound:
        source.delete_file(f"{root}/{ARCHIVE}")  # what was here is replaced
    made = cut(sorted_.select("shard", "id", "digest", "what", "url", "payload", "answer", "home").mapInArrow(run, "shard int, name string, bytes long, records long, sha1 string"))
    by = made.groupBy("shard").agg(F.count(F.lit(1)).alias("files"), F.sum("records").alias("records")).collect()  # a row a shard, as the cuts had
    commit_archive(folder, sorted(r.shard for r in by), sum(r.files for r in by), sum(r.records for r in by))
    return made


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row a file of an archive, from the manifests on disk: shard, name, bytes, records, sha1. A missing shard is an error."""
    source, root = file_system(folder)
    if source.get_file_info(f"{root}/{ARCHIVE}").type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{folder} has no whole archive")
    with source.open_input_stream(f"{root}/{ARCHIVE}", compression=None) as raw:
        shards = json.loads(raw.read())["shards"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, root = file_system(folder)
        for batch in batches:
            for n in batch.column(0).to_pylist():
                with source.open_input_stream(f"{root}/shard-{n:06d}.manifest.json", compression=None) as raw:
                    files = json.loads(raw.read())["files"]
                yield pa.RecordBatch.from_pylist([{"shard": n, **f} for f in files], pa.schema([("shard", pa.int64()), ("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha1", pa.string())]))

    return spark.createDataFrame([(n,) for n in shards], "shard long").mapInArrow(run, "shard long, name string, bytes long, records long, sha1 string")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, payload binary"


def read_back(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record of a whole archive, as its manifests on disk say; a file is read record after record and held against its manifest."""
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("payload", pa.binary())]

    def one(fields: dict[str, str], block: bytes) -> tuple:
        payload = block.partition(b"\r\n\r\n")[2]
        digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
        if fields["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("payload digest differs")
        number = lambda name: int(fields[name]) if name in fields else None
        return number("X-Page-Id"), fields.get("WARC-Target-URI"), number("X-Payload-Length"), digest, fields["WARC-Type"], number("X-Refers-To-Page-Id"), fields["WARC-Record-ID"], payload if with_payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, root = file_system(folder)
        for batch in batches:
            for name, size, records, sha1 in zip(*(c.to_pylist() for c in batch.columns)):
                rows: list[tuple] = []
                seen, sums = 0, Sums()
                for fields, block in read_records(source, f"{root}/{name}", sums):
                    rows.append(one(fields, block))
                    seen += 1
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], schema=pa.schema(kinds))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], schema=pa.schema(kinds))
                if (sums.size, seen, sums.sha1.hexdigest()) != (size, records, sha1):
                    raise ValueError(f"{name} differs from its manifest")

    # files are of like size by ROLL: dealt one by one
    files = cut(manifest(spark, folder))
    spread = files.repartition(max(1, min(files.count(), MOST_TASKS))).select("name", "bytes", "records", "sha1")
    return spread.mapInArrow(run, READ)


def op7_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    written(read_table(spark, sf_dir, "pages"), folder, roll=2 << 20, shard_bytes=16 << 20)
    return read_back(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL_OP7 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), a AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS answer FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> answer THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> answer THEN answer END AS refers_to
FROM a
"""
