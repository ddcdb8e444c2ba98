"""WARC archives of records compressed one by one with a Zstandard dictionary.

An archive file starts with a skippable frame (fixed magic number, little-endian size) that holds the
dictionary, trained on the file's own first records; then each record is a Zstandard frame of its own.
Revisit records name the response whose payload they repeat and carry no payload.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import filesystem, shared_folder, slices, stage

#: Fixed value of the format: magic number of the dictionary's skippable frame.
DICTIONARY_FRAME = 0x184D2A5D
#: Records that train a file's dictionary, its size, the bytes after which a new file begins, and the compression level.
SAMPLE, DICTIONARY_BYTES, FILE_BYTES, LEVEL = 512, 64 << 10, 1 << 30, 3
#: Payloads shorter than this are always responses.
LEAST_REVISIT = 100
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; ``refers_to`` makes it a revisit without payload."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}|{digest}')}>",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"X-Refers-To-Page: {refers_to}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


class Writer:
    """Writes one archive file: the first records are held back until they have trained the dictionary."""

    def __init__(self, out, sample: int = SAMPLE, level: int = LEVEL):
        self.out, self.sample, self.level = out, sample, level
        self.held: list[bytes] | None = []
        self.written = 0

    def add(self, raw: bytes) -> None:
        if self.held is None:
            self._put(self.compressor.compress(raw))
            return
        self.held.append(raw)
        if len(self.held) >= self.sample or sum(map(len, self.held)) > 64 * DICTIONARY_BYTES * 4:
            self._begin()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _begin(self) -> None:
        import zstandard

        held, self.held = self.held or [], None
        trained, size = None, min(DICTIONARY_BYTES, max(1024, sum(map(len, held)) // 8))
        cut = [x[at : at + 512] for x in held for at in range(0, len(x), 512)]
        for samples in (held, cut):  # few records are cut into pieces, since training wants many samples
            try:
                trained = zstandard.train_dictionary(size, samples)
                break
            except zstandard.ZstdError:  # too little to learn from: no dictionary, no leading frame
                pass
        if trained is not None:
            data = trained.as_bytes()
            self._put(DICTIONARY_FRAME.to_bytes(4, "little") + len(data).to_bytes(4, "little") + data)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=trained, write_checksum=True)
        for raw in held:
            self._put(self.compressor.compress(raw))

    def close(self) -> None:
        if self.held:
            self._begin()
        self.out.close()


def records(source, block: int = 64 << 10) -> Iterator[bytes]:
    """Records of an archive file, streamed: only one record and a block are held."""
    import zstandard

    data = source.read(8)
    trained = None
    if int.from_bytes(data[:4], "little") == DICTIONARY_FRAME:
        want = int.from_bytes(data[4:8], "little")
        trained = zstandard.ZstdCompressionDict(source.read(want))
        data = b""
    frames = zstandard.ZstdDecompressor(dict_data=trained)
    frame, parts = frames.decompressobj(), []
    while data or (data := source.read(block)):
        parts.append(frame.decompress(data))
        data = b""
        if frame.eof:
            yield b"".join(parts)
            data = frame.unused_data
            frame, parts = frames.decompressobj(), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def marked(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` as (key, url, html, digest, size, refers_to): refers_to is the smallest key among equal payloads of
    ``least`` bytes or more, for the rows with a greater or null key."""
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    p = pages.select(key, url.alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long"))
    first = p.where(F.col("size") >= least).groupBy("digest").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return p.join(first, "digest", "left").withColumn("refers_to", F.when(F.col(key).isNull() | (F.col(key) > F.col("first")), F.col("first"))).drop("first")


def write(pages: DataFrame, folder: str, key: str = "page_id", html: str = "html", sample: int = SAMPLE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row; a staged table of the archive files (path, records). A lost task leaves files that no row
    names and is written anew under other names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path, n = None, "", 0

        def closed() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

        for part in slices(batches, "html", 4 << 20):
            for row in part.to_pylist():
                if writer is None:
                    path, n = f"{folder}/part-{uuid.uuid4().hex}.warc.zst", 0
                    fs, at = filesystem(path)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    writer = Writer(fs.open_output_stream(at, compression=None), sample)
                writer.add(record(row[key], row["url"], row["html"].encode("utf-8", "surrogatepass"), row["digest"], row["size"], row["refers_to"]))
                n += 1
                if writer.written > file_bytes:
                    yield closed()
                    writer = None
        if writer is not None:
            yield closed()

    return stage(marked(pages, key, html).mapInArrow(run, "path string, records long"), "archives")


def read(spark: SparkSession, archives: DataFrame, key: str = "page_id", payloads: bool = False) -> DataFrame:
    """``key``, url, payload_bytes, payload_digest, record_type and refers_to of every record in the archive files, and the
    payload if asked for. A response's digest and length are computed from the payload that was read; a revisit's come from its header."""
    files = archives.count()
    names = [key, "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = filesystem(path)
                out, held = [], 0
                with fs.open_input_stream(at, compression=None) as f:
                    for raw in records(f):
                        h, payload = parse(raw)
                        kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha256:")
                        size = int(h["X-Payload-Length"])
                        if kind == "response":
                            size, found = len(payload), hashlib.sha256(payload).hexdigest()
                            if found != digest:
                                raise ValueError(f"{path}: a payload does not match its digest")
                        ints = [int(h[x]) if x in h else None for x in ("X-Page-ID", "X-Refers-To-Page")]
                        out.append((ints[0], h.get("WARC-Target-URI"), size, digest, kind, ints[1], *([payload] if payloads else [])))
                        held += len(payload) * payloads
                        if len(out) >= 4096 or held > 8 << 20:
                            yield flush(out)
                            out, held = [], 0
                if out:
                    yield flush(out)

    schema = f"`{key}` long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return archives.select("path").repartition(max(1, files)).mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None, key: str = "page_id", html: str = "html") -> DataFrame:
    """Write all pages to archives and return what reading them back gives, a row per page.

    A null html is an empty payload. Of records with equal payloads of at least 100 bytes those with the smallest key
    are responses (all of them, if the key repeats) and the rest revisit it; among null keys alone all are responses.
    Other columns are ignored. An empty table writes no file and gives an empty table."""
    spark = pages.sparkSession
    return read(spark, write(pages, folder or shared_folder(spark, "warc"), key, html), key)
