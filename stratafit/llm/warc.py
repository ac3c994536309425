"""WARC archives as a Spark data source in Python (format "warc"), and deduplicated archiving of pages.

Reading plans one partition for each run of whole files up to a size; filters on record_type, target_uri, record_id,
payload_digest and refers_to are pushed down. Of each record the header is parsed first; the payload of a record that the
filters refuse, or of any record if the option payload is false, is skipped and not decoded. Writing makes one file in
each task, moved into place when the job commits, so that tasks can be repeated. Files are opened by pyarrow's file
systems: any folder that driver and executors share.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .common import bitmap, in_bitmap, materialise, new_folder

#: The columns of a record, and the headers that hold them.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
_ARROW = pa.schema([*[(c, pa.string()) for c in HEADERS], ("payload_bytes", pa.int64()), ("payload", pa.binary())])
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A partition holds whole files of at least this size together.
PARTITION_BYTES = 64 << 20
#: Digests that stand more than once and are broadcast (some 200 bytes each); of more a bitmap is.
FEW = 50_000
#: Bytes of payload in a batch of rows.
BATCH_BYTES = 8 << 20


#: What can't stand in a header line, percent-encoded in targets.
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
#: A gzip member's first bytes: flags, time, kind of packing, system, extra field of 8 bytes: its name, length and value.
_MEMBER = struct.Struct("<4sIBBH2sHI")


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record_bytes(row: dict) -> bytes:
    """One record of an HTTP response, or of its revisit, which has the response's headers but no payload."""
    payload, revisit = row["payload"] or b"", row["record_type"] == "revisit"
    size = len(payload) if row.get("payload_bytes") is None else row["payload_bytes"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (b"" if revisit else payload)
    row = {**row, "target_uri": row["target_uri"] and _UNSAFE.sub(lambda m: quote(m[0]), row["target_uri"])}
    lines = ["WARC/1.1", *[f"{h}: {row[c]}" for c, h in HEADERS.items() if row.get(c) is not None]]
    lines += [f"WARC-Profile: {_PROFILE}"] * revisit + ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member, as WARC readers expect for each record, whose extra field (sl) has the member's whole size, so that
    a reader can step over it."""
    packed = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packed.compress(data) + packed.flush()
    size = _MEMBER.size + len(body) + 8
    return _MEMBER.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 8, b"sl", 4, size) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Member:
    """read and readline over one gzip member, inflated no further than it is read."""

    def __init__(self, file, at: int, end: int):
        self.file, self.at, self.end, self.inflate, self.data, self.place = file, at, end, zlib.decompressobj(zlib.MAX_WBITS | 16), b"", 0

    def _more(self, n: int) -> bool:
        """n bytes more of the member, or as many as there are."""
        out = b""
        while not out and not self.inflate.eof:
            packed = self.inflate.unconsumed_tail
            if not packed:
                self.file.seek(self.at)
                packed = self.file.read(min(self.end - self.at, max(n, 1 << 12)))
                self.at += len(packed)
                if not packed:
                    raise ValueError("a gzip member ends early")
            out = self.inflate.decompress(packed, max(n, 1 << 12))
        self.data, self.place = self.data[self.place :] + out, 0
        return bool(out)

    def read(self, n: int) -> bytes:
        while len(self.data) - self.place < n and self._more(n - len(self.data) + self.place):
            pass
        out = self.data[self.place : self.place + n]
        self.place += len(out)
        return out

    def readline(self) -> bytes:
        while (end := self.data.find(b"\n", self.place)) < 0 and self._more(1):
            pass
        out = self.data[self.place : end + 1 if end >= 0 else len(self.data)]
        self.place += len(out)
        return out


def members(file, size: int) -> Iterator[_Member]:
    """The members of a file that ``member`` has written, found by their sizes alone; nothing if the first is of another kind."""
    at = 0
    while at < size:
        file.seek(at)
        head = file.read(_MEMBER.size)
        if len(head) < _MEMBER.size or head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"sl":
            if at:
                raise ValueError("gzip members of two kinds in one file")
            return
        end = at + _MEMBER.unpack(head)[-1]
        yield _Member(file, at, end)
        at = end


def _header_lines(stream) -> dict[bytes, bytes] | None:
    """The named fields up to the next empty line, names in lower case; None at the end of the file."""
    first = stream.readline()
    while first in (b"\r\n", b"\n"):
        first = stream.readline()
    if not first:
        return None
    out: dict[bytes, bytes] = {b"": first.strip()}
    while (line := stream.readline().rstrip(b"\r\n")) != b"":
        name, _, value = line.partition(b":")
        out[name.strip().lower()] = value.strip()
    return out


def parse(stream, wanted: dict[str, frozenset[str]], payload: bool = True, skip: bool = True) -> Iterator[dict]:
    """Records whose header fields have the wanted values. stream needs read and readline; skip False: it holds one record,
    and what isn't wanted of it is left."""
    while (head := _header_lines(stream)) is not None:
        if not head[b""].startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {head[b''][:40]!r}")
        length = int(head[b"content-length"])
        row = {c: head[h.lower().encode()].decode() if h.lower().encode() in head else None for c, h in HEADERS.items()}
        if any(row[c] not in values for c, values in wanted.items()):
            if not skip:
                return
            _skip(stream, length)
            continue
        if head.get(b"content-type", b"").startswith(b"application/http"):
            status = stream.readline()
            used, http = len(status), {}
            while (line := stream.readline()).rstrip(b"\r\n") != b"":
                used += len(line)
                name, _, value = line.partition(b":")
                http[name.strip().lower()] = value.strip()
            length -= used + len(line)
            size = int(http.get(b"content-length", length))
        else:
            size = length
        row["payload_bytes"] = size
        row["payload"] = stream.read(length) if payload else _skip(stream, length) if skip else None
        yield row
        if not skip:
            return


def _skip(stream, length: int) -> None:
    while length > 0 and (n := len(stream.read(min(length, 1 << 20)))):
        length -= n


class _Buffered:
    """read and readline over a pyarrow stream; big skips read without keeping."""

    def __init__(self, raw):
        self.raw, self.data, self.at = raw, b"", 0

    def read(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        return out + self.raw.read(n - len(out)) if len(out) < n else out

    def readline(self) -> bytes:
        while (end := self.data.find(b"\n", self.at)) < 0:
            more = self.raw.read(1 << 16)
            self.data, self.at = self.data[self.at :] + more, 0
            if not more:
                end = len(self.data) - 1
                break
        out = self.data[self.at : end + 1]
        self.at = end + 1
        return out


@dataclass
class _Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.wanted: dict[str, frozenset[str]] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", ("",))
            if isinstance(f, EqualTo | In) and len(column) == 1 and column[0] in HEADERS:
                values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.wanted[column[0]] = self.wanted.get(column[0], values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, path = _place(self.path)
        infos = fs.get_file_info(pafs.FileSelector(path)) if fs.get_file_info(path).type == pafs.FileType.Directory else [fs.get_file_info(path)]
        runs: list[list[str]] = []
        room = 0
        for f in sorted((f for f in infos if f.is_file and f.base_name.endswith((".warc", ".warc.gz"))), key=lambda f: f.path):
            if room <= 0:
                runs.append([])
                room = PARTITION_BYTES
            runs[-1].append(f.path)
            room -= f.size
        return [_Files(r) for r in runs]

    def read(self, partition):
        if partition is None:
            return
        fs, _ = _place(self.path)
        rows, size = [], 0
        for path in partition.paths:
            for row in self._records(fs, path):
                rows.append(row)
                size += len(row["payload"] or b"") + 200
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def _records(self, fs: pafs.FileSystem, path: str) -> Iterator[dict]:
        if path.endswith(".gz"):
            with fs.open_input_file(path) as file:
                found = False
                for one in members(file, file.size()):
                    found = True
                    yield from parse(one, self.wanted, self.payload, skip=False)  # what is left of a member is stepped over
                if found:
                    return
        with fs.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None) as raw:
            yield from parse(_Buffered(raw), self.wanted, self.payload)


@dataclass
class _Written(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.gzip, self.job = options["path"], options.get("compression", "gzip") == "gzip", uuid.uuid4().hex

    def write(self, iterator):
        fs, path = _place(self.path)
        fs.create_dir(f"{path}/_{self.job}", recursive=True)
        name, out = f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip, None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    out = fs.open_output_stream(f"{path}/_{self.job}/{name}", compression=None)
                out.write(member(record_bytes(row)) if self.gzip else record_bytes(row))
        if out is None:
            return _Written()
        out.close()
        return _Written([name])

    def commit(self, messages):
        fs, path = _place(self.path)
        fs.create_dir(path, recursive=True)
        for m in messages:
            for name in m.names if m else []:
                fs.move(f"{path}/_{self.job}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages):
        fs, path = _place(self.path)
        if fs.get_file_info(f"{path}/_{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{path}/_{self.job}")


class WarcDataSource(DataSource):
    """Options: path; for reading payload (true), for writing compression (gzip, none)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def _likely(keys: DataFrame, count: int):
    """A test, of a column of longs, whether a value may be among keys (key): true for all that are. It broadcasts a bitmap of at most
    16 MB."""
    shared = keys.sparkSession.sparkContext.broadcast(bitmap(keys, "key", count))

    @F.arrow_udf(T.BooleanType())
    def likely(key: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(shared.value, key.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) == 1)

    return likely


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, date: str | None = None) -> DataFrame:
    """The rows of SCHEMA for pages: of equal payloads of ``least`` bytes or more the one with the largest id is the
    response and the others revisit it; all smaller ones are responses. date: that of all records; None: now.

    A null html is an empty payload, a null url leaves out the target. Among rows with equal ids and payloads the one with
    the largest url is the response; rows that are alike in all three are one response and revisits. Ids may be null: such
    a page is only the response if its payload has no other. Record ids are unique, of repeated rows too. Other columns aren't
    read. Very long payloads are one record each. An empty table gives no record. Rows are told apart by what they hold, never by
    their place, so any partitioning, and any task that is run again, gives the same records but for the ids of those that none refers to.

    Revisits are made of keys alone. Payloads stay where they are read: up to FEW digests that stand more than once are broadcast; of
    more a bitmap is, and only the payloads of responses that it can't tell from copies are shuffled.
    """
    spark = pages.sparkSession
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    keys = rows.drop("payload").filter(F.col("payload_bytes") >= least)
    alike = keys.groupBy("digest", "id", "url").agg(F.count("*").alias("n"), F.max("payload_bytes").alias("size"))
    best = alike.groupBy("digest").agg(F.max(F.struct("id", "url", "n", "size")).alias("best"), F.sum("n").alias("copies"))
    best = best.filter("copies > 1").select("digest", F.struct("best.id", "best.url").alias("first"), "best.n", "best.size")  # payloads that stand once need no partner
    best = materialise(best, "copies")
    count, large = best.count(), F.col("payload_bytes") >= least
    is_first = F.struct("id", "url").eqNullSafe(F.col("first"))
    null, columns = F.lit(None), ["id", "url", "payload", "digest", "payload_bytes", "first"]
    known = best.select("digest", "first", "n")
    # Responses and revisits, but for those that are alike in all with their payload's first: these are made from their number.
    if count <= FEW:
        joined = rows.join(F.broadcast(known), (rows["digest"] == known["digest"]) & large, "left").drop(known["digest"])
        single = joined.filter(F.col("first").isNull() | ~is_first | (F.col("n") == 1)).withColumn("is_revisit", F.col("first").isNotNull() & ~is_first)
        single = single.select(*columns, "is_revisit").withColumn("payload", F.when(~F.col("is_revisit"), F.col("payload")))
        firsts = rows.filter(large).join(F.broadcast(known.filter("n > 1")), "digest").filter(is_first)
    else:
        repeats = _likely(best.select(F.xxhash64("digest").alias("key")), count)
        decided = keys.filter(repeats(F.xxhash64("digest"))).join(known, "digest", "left")
        revisits = decided.filter(F.col("first").isNotNull() & ~is_first).select("id", "url", null.cast("binary").alias("payload"), "digest", "payload_bytes", "first", F.lit(True).alias("is_revisit"))
        wanted = decided.filter(F.col("first").isNull() | is_first).select(F.xxhash64("digest", "id", "url").alias("key"), "digest", "id", "url", "first", "n").distinct()
        wanted = materialise(wanted, "wanted")
        asked = _likely(wanted.select("key"), wanted.count())
        plain = rows.filter(~large | ~repeats(F.xxhash64("digest"))).select("id", "url", "payload", "digest", "payload_bytes", null.cast(best.schema["first"].dataType).alias("first"), F.lit(False).alias("is_revisit"))
        asked_for = rows.filter(large & repeats(F.xxhash64("digest")) & asked(F.xxhash64("digest", "id", "url"))).withColumn("key", F.xxhash64("digest", "id", "url"))
        asked_for = asked_for.join(wanted.select("key", F.col("digest").alias("d"), F.col("id").alias("i"), F.col("url").alias("u"), "first", "n"), "key")
        asked_for = asked_for.filter((F.col("digest") == F.col("d")) & F.struct("id", "url").eqNullSafe(F.struct(F.col("i").alias("id"), F.col("u").alias("url"))))
        single = plain.unionByName(revisits).unionByName(asked_for.filter(F.col("first").isNull() | (F.col("n") == 1)).select(*columns, F.lit(False).alias("is_revisit")))
        firsts = asked_for.filter(F.col("first").isNotNull() & (F.col("n") > 1))
    repeated = best.filter("n > 1")
    if not repeated.isEmpty():
        one = firsts.dropDuplicates(["digest"]).select(*columns, F.lit(False).alias("is_revisit"))
        others = repeated.select("first.id", "first.url", null.cast("binary").alias("payload"), "digest", F.col("size").alias("payload_bytes"), "first", F.lit(True).alias("is_revisit"), F.explode(F.sequence(F.lit(2).cast("long"), "n"))).select(*columns, "is_revisit")
        single = single.unionByName(one).unionByName(others)
    # A response that others refer to is named by its digest, and others by a number of their own.
    name = lambda tag, x: F.concat(F.lit("<urn:page:"), tag, F.lit(":"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    referred = F.col("first").isNotNull() & ~F.col("is_revisit")
    return single.select(
        F.when(F.col("is_revisit"), "revisit").otherwise("response").alias("record_type"),
        name(F.when(referred, F.concat(F.lit("sha1-"), "digest")).otherwise(F.uuid()), F.col("id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.when(F.col("is_revisit"), name(F.concat(F.lit("sha1-"), "digest"), F.col("first.id"))).alias("refers_to"),
        "payload_bytes",
        "payload",
    )


def archive(pages: DataFrame, path: str, **names: str) -> None:
    """Write pages as WARC files to the folder path; see ``records`` for odd rows. An empty table writes nothing."""
    register(pages.sparkSession)
    records(pages, **names).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The rows of SCHEMA of a file, or of the .warc and .warc.gz files in a folder; without payload it is null. A folder without files
    gives no row; one that isn't there raises an error."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def through_archive(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id_col, payload_bytes, payload_digest, record_type, refers_to) of each page, from archives written and read back.

    Responses are read with their payload, whose digest is taken anew; of revisits only headers are decoded. An empty
    table gives an empty result.
    """
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    id_type = pages.schema[id_col].dataType.simpleString()
    archive(pages, path, id_col=id_col)
    whole = read_archive(spark, path).filter(F.col("record_type") == "response").withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    heads = read_archive(spark, path, payload=False).filter(F.col("record_type") == "revisit").withColumns({"size": F.col("payload_bytes"), "digest": F.substring_index("payload_digest", ":", -1)})
    page = lambda x: F.nullif(F.regexp_extract(x, "(?s)page:[^:]*:(.*)>", 1), F.lit("")).cast(id_type)
    both = whole.drop("payload").unionByName(heads.drop("payload"))
    return both.select(page("record_id").alias(id_col), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest) as top from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> top then top end as refers_to from m"""
