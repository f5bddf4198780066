"""WARC archives of pages, compressed with Zstandard, as a Spark data source.

``warc_zst`` writes records into ``*.warc.zst`` files and reads them back.  A file starts with a
skippable frame that holds a dictionary; each record is one frame after it, so a file can be cut or
joined between records.  A reader loads the dictionary, decodes frame by frame, and checks the header
lines, lengths and digests of every record.

Files live where ``pyarrow.fs`` reaches (local and shared folders, HDFS, object stores).  A write adds
files and, when all tasks have succeeded, a list of them; files of failed or repeated tasks are on no
list and are not read.  Folders without a list, as other tools write them, are read whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Fixed values of the formats.
DICTIONARY_FRAME, ZSTD_FRAME, ZSTD_DICTIONARY = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

END = b"\r\n\r\n"
CHUNK = 1 << 14  # bytes fed to the decoder at once, as what follows a frame is handed back
BATCH = 8 << 20  # bytes of payload in a batch of records read
SCHEMA = "record_id string, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to string"


class WarcError(ValueError):
    """A file that breaks the format."""


# --- records -----------------------------------------------------------------------------------------


def _value(text: str) -> str:
    """A header value; one that lines could not hold as it is becomes an encoded word."""
    if re.search(r"[\x00-\x1f\x7f]|^\s|\s$|^=\?", text):
        return f"=?utf-8?B?{base64.b64encode(text.encode()).decode()}?="
    return text


def _plain(value: str) -> str:
    found = re.fullmatch(r"=\?utf-8\?B\?([A-Za-z0-9+/=]*)\?=", value)
    return base64.b64decode(found[1]).decode() if found else value


def _digest(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def encode_record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {_value(v)}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + END


def decode_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, names in lower case, and the block; the record must fill ``raw`` exactly."""
    head, found, rest = raw.partition(END)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#-'*+\-.0-9A-Z^-z|~]+", name) or name.lower() in fields and name.lower() != "warc-concurrent-to":
            raise WarcError(f"header line {line[:80]!r}")
        fields[name.lower()] = _plain(value.strip())
    missing = [name for name in REQUIRED if name not in fields]
    if missing:
        raise WarcError(f"no {missing[0]}")
    if not fields["content-length"].isdecimal() or int(fields["content-length"]) != len(rest) - len(END) or not rest.endswith(END):
        raise WarcError("Content-Length is not the block's")
    block = rest[: -len(END)]
    stated = fields.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated != _digest(hashlib.sha1(block).hexdigest()):
        raise WarcError("block digest")
    return fields, block


def page_record(record_id: str, url: str | None, kind: str, digest: str, size: int, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit with the same HTTP header and none."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date, "WARC-Target-URI": url, "WARC-Payload-Digest": _digest(digest),
        "WARC-Block-Digest": _digest(hashlib.sha1(block).hexdigest()), "WARC-Profile": IDENTICAL if kind == "revisit" else None,
        "WARC-Refers-To": refers_to, "Content-Type": "application/http;msgtype=response",
    }
    return encode_record(fields, block)


def read_page(fields: dict[str, str], block: bytes) -> tuple:
    """A row of SCHEMA and the payload (none for a revisit), checked against its lengths and digest."""
    head, found, payload = block.partition(END)
    kind, http = fields["warc-type"], head.decode("latin-1").split("\r\n")
    size = next((line.split(":", 1)[1].strip() for line in http[1:] if line.lower().startswith("content-length:")), "")
    stated = fields.get("warc-payload-digest", "")
    if not found or not http[0].startswith("HTTP/"):
        raise WarcError("no HTTP header in the block")
    if kind == "response" and size and size != str(len(payload)) or kind == "revisit" and (payload or not size.isdecimal() or not stated):
        raise WarcError("payload length")
    actual = hashlib.sha1(payload).hexdigest()
    if kind == "response" and stated.startswith("sha1:") and stated != _digest(actual):
        raise WarcError("payload digest")
    if kind == "revisit":
        actual = base64.b32decode(stated.removeprefix("sha1:")).hex()
    return fields["warc-record-id"], fields.get("warc-target-uri"), kind, int(size) if kind == "revisit" else len(payload), actual, fields.get("warc-refers-to"), payload if kind == "response" else None


# --- files -------------------------------------------------------------------------------------------


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame; the dictionary stands in it as a frame of its own."""
    packed = zstd.ZstdCompressor().compress(dictionary)
    return DICTIONARY_FRAME.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


class Frames:
    """Decoded frames of an open file, with the byte at which each starts."""

    def __init__(self, stream):
        self.stream, self.rest, self.at = stream, b"", 0
        self.decoder = zstd.ZstdDecompressor()

    def _take(self, n: int) -> bytes:
        while len(self.rest) < n and (more := self.stream.read(max(CHUNK, n - len(self.rest)))):
            self.rest += more
        out, self.rest = self.rest[:n], self.rest[n:]
        if len(out) < n:
            raise WarcError("cut off inside a frame")
        self.at += n
        return out

    def _load(self, raw: bytes) -> None:
        raw = zstd.ZstdDecompressor().decompressobj().decompress(raw) if raw[:4] == ZSTD_FRAME else raw
        if raw[:4] != ZSTD_DICTIONARY:
            raise WarcError("no dictionary in the leading frame")
        self.decoder = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_FULLDICT))

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while self.rest or self._more():
            at, magic = self.at, int.from_bytes(self._take(4), "little")
            if magic in SKIPPABLE:
                content = self._take(int.from_bytes(self._take(4), "little"))
                if magic == DICTIONARY_FRAME and not at:
                    self._load(content)
                continue
            if magic.to_bytes(4, "little") != ZSTD_FRAME:
                raise WarcError(f"byte {at}: no frame starts here")
            out, one, feed = [], self.decoder.decompressobj(), ZSTD_FRAME
            try:
                while True:
                    out.append(one.decompress(feed))
                    if one.eof:
                        break
                    feed, self.rest = (self.rest, b"") if self.rest else (self.stream.read(CHUNK), b"")
                    if not feed:
                        raise WarcError(f"byte {at}: cut off inside a frame")
                    self.at += len(feed)
            except zstd.ZstdError as e:
                raise WarcError(f"byte {at}: {e}") from e
            self.rest = one.unused_data
            self.at -= len(self.rest)
            yield at, b"".join(out)

    def _more(self) -> bool:
        self.rest = self.stream.read(CHUNK)
        return bool(self.rest)


def read_file(path: str, name: str) -> Iterator[tuple]:
    """Rows of SCHEMA with payload, for the responses and revisits of a file; one frame is one record."""
    fs, root = opened(path)
    with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
        frames, at = Frames(stream), 0
        try:
            for at, raw in frames:
                fields, block = decode_record(raw)
                if fields["warc-type"] in ("response", "revisit"):
                    yield read_page(fields, block)
        except WarcError as e:
            raise WarcError(f"{name}, record at byte {at}: {e}") from e


# --- data source -------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


@dataclass
class Archive(InputPartition):
    name: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.dictionary = base64.b64decode(options.get("dictionary", ""))
        self.limit, self.date = int(options.get("maxbytes", 256 << 20)), options.get("date", "2024-01-01T00:00:00Z")
        self.level = int(options.get("level", 3))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        shared = zstd.ZstdCompressionDict(self.dictionary) if self.dictionary else None
        encoder = zstd.ZstdCompressor(level=self.level, dict_data=shared, write_checksum=True, write_content_size=True)
        part, files, out, size = TaskContext.get().partitionId(), [], None, 0
        try:
            for batch in iterator:
                columns = [batch.column(c) for c in ("record_id", "target_uri", "record_type", "payload_digest", "payload_bytes", "payload", "refers_to")]
                for row in zip(*columns, strict=True):
                    if out is None or size > self.limit:
                        if out is not None:
                            out.close()
                        files.append(f"part-{part:05d}-{uuid.uuid4().hex}.warc.zst")
                        out = fs.open_output_stream(f"{root}/{files[-1]}", compression=None, buffer_size=1 << 20)
                        about = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": self.date, "WARC-Filename": files[-1], "Content-Type": "application/warc-fields"}
                        start = (dictionary_frame(self.dictionary) if shared else b"") + encoder.compress(encode_record(about, b"format: WARC File Format 1.1\r\n"))
                        out.write(start)
                        size = len(start)
                    record_id, url, kind, digest, n, payload, refers_to = (x.as_py() for x in row)
                    frame = encoder.compress(page_record(record_id, url, kind, digest, n, payload or b"", refers_to, self.date))
                    out.write(frame)
                    size += len(frame)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        before = [x.path for x in fs.get_file_info(pafs.FileSelector(root))] if self.overwrite else []
        name, names = f"{root}/_files-{uuid.uuid4().hex}", [f for m in messages if m for f in m.files]
        with fs.open_output_stream(name + ".tmp") as out:
            out.write(json.dumps(names).encode())
        fs.move(name + ".tmp", name + ".json")
        keep = set(names)
        for path in before:
            if path.rsplit("/", 1)[-1] not in keep:
                fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        for name in [f for m in messages if m for f in m.files]:
            fs.delete_file(f"{root}/{name}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict, with_payload: bool):
        self.path, self.with_payload = options["path"].rstrip("/"), with_payload

    def partitions(self) -> list[Archive]:
        fs, root = opened(self.path)
        names = [x.base_name for x in fs.get_file_info(pafs.FileSelector(root)) if x.is_file]
        lists = [x for x in names if x.startswith("_files-") and x.endswith(".json")]
        if lists:
            names = [f for x in lists for f in json.loads(fs.open_input_stream(f"{root}/{x}").read())]
        return [Archive(x) for x in sorted(names) if x.endswith(".warc.zst")]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [*(x.split()[0] for x in SCHEMA.split(", ")), "payload"]
        schema = pa.schema(list(zip(names, kinds, strict=True))[: 6 + self.with_payload])
        rows, size = [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)], schema=schema)
        for row in read_file(self.path, partition.name) if partition else ():
            rows.append(row[: len(schema)])
            size += 200 + (len(row[6] or b"") if self.with_payload else 0)
            if size > BATCH or len(rows) == 10_000:
                yield made()
                rows, size = [], 0
        if rows:
            yield made()


class WarcZst(DataSource):
    """``warc_zst``: options ``path``, for writing ``dictionary`` (base64), ``maxbytes``, ``level`` and ``date``, for reading ``payload`` (false leaves it out)."""

    @classmethod
    def name(cls) -> str:
        return "warc_zst"

    def _with_payload(self) -> bool:
        return str(self.options.get("payload", "true")).lower() != "false"

    def schema(self) -> str:
        return SCHEMA + ", payload binary" * self._with_payload()

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options), self._with_payload())

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


# --- pages -------------------------------------------------------------------------------------------


def page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def page_of(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, "^<urn:x-page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")


def page_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """One row of the source's schema for each page: a response, or a revisit of an equal payload.

    Of the payloads of ``least`` bytes and more that are equal, the one with the largest page_id is the
    response.  Ids of equal payloads are folded by their SHA-256 before the shuffle; only payloads that
    occur twice are joined back, shorter ones spread by their id.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.col("url").alias("target_uri"), body.alias("html"), F.octet_length(body).cast("long").alias("payload_bytes"))
    own = F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    rows = rows.withColumn("key", F.when(F.col("payload_bytes") >= least, F.sha2("html", 256)).otherwise(own))
    equal = rows.filter(F.col("payload_bytes") >= least).groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("times")).filter("times > 1").drop("times")
    rows = rows.join(equal, "key", "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return rows.select(
        page_urn(F.col("page_id")).alias("record_id"), "target_uri", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "payload_bytes",
        F.sha1("html").alias("payload_digest"), F.when(revisit, page_urn(F.col("last"))).alias("refers_to"), F.when(~revisit, F.col("html").cast("binary")).alias("payload"),
    )


def page_dictionary(pages: DataFrame, samples: int = 256, longest: int = 1 << 16, size: int = 1 << 16) -> bytes:
    """A Zstandard dictionary of ``size`` bytes, trained on at most ``samples`` pages of ``longest`` bytes at most.

    The pages are the first in an order by hash, so reruns agree.  Too few pages give no dictionary.
    """
    order = [F.xxhash64("page_id"), F.col("page_id")]
    short = pages.filter(F.col("page_id").isNotNull() & F.octet_length("html").between(1, longest))
    ids = [r.page_id for r in short.select("page_id").orderBy(*order).limit(samples).collect()]
    texts = {r.page_id: r.html for r in short.filter(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.max("html").alias("html")).collect()} if ids else {}
    try:
        return zstd.train_dictionary(size, [texts[i].encode() for i in dict.fromkeys(ids)]).as_bytes()
    except zstd.ZstdError:
        return b""


def write_pages(pages: DataFrame, path: str, least: int = 1000, dictionary: bytes | None = None, date: str = "2024-01-01T00:00:00Z") -> None:
    """Pages (page_id, url, html) as archives under ``path``, added to those that are there.

    A null html is an empty payload, a null url leaves out the target, a null page_id gives a record id
    without a number and is taken as the smallest.  Repeated rows get a record each: those with the
    largest page_id are all responses.  A very long page is one record.  Other columns are ignored; an
    empty table writes no archive, and ``read_pages`` then gives no rows.  Control characters in a url
    travel as an encoded word.
    """
    pages.sparkSession.dataSource.register(WarcZst)
    found = page_dictionary(pages) if dictionary is None else dictionary
    out = page_records(pages, least).write.format("warc_zst").mode("append")
    out.option("dictionary", base64.b64encode(found).decode()).option("date", date).save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Responses and revisits of all archives under ``path``, checked; an archive that breaks the format fails the job."""
    spark.dataSource.register(WarcZst)
    return spark.read.format("warc_zst").option("payload", str(payload).lower()).load(path)


def read_pages(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Rows (page_id, url, payload_bytes, payload_digest, record_type, refers_to[, html]) of archived pages; a revisit's html is null."""
    ids = page_of(F.col("record_id")).alias("page_id"), F.col("target_uri").alias("url")
    html = [F.col("payload").cast("string").alias("html")] if payload else []
    return read_warc(spark, path, payload).select(*ids, "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"), *html)
