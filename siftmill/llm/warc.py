"""WARC archives as chunked record tables.

A payload is cut into chunks of at most `size` bytes; a chunk is a row (record, chunk number, bytes,
SHA-256 of the payload so far) and a WARC record of its own: the first is the response, the others
are continuation records of its segments. So no row, and no record on disk, is larger than a chunk,
and a reader can check a long payload chunk by chunk.

Archives are WARC/1.1 files in gzip, written and read by Spark's text source, so any store that
Spark reaches will do. Tasks write files side by side; gzip can't be split, so a file is read by one
task, in order. Readers find records by their Content-Length alone: whatever bytes a payload holds
or ends with, nothing in it is taken for a record's end. A block is the payload itself, without
HTTP headers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.llm.shared import bloom_filter, bloom_pass, checked_broadcast, shared_folder, stored, without

#: Format (fixed values): a record's head, and what ends a head and a record.
HEAD = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of a chunk at most, and of the chunks in a batch of rows.
CHUNK, BATCH = 256 * 1024, 2 << 20


def chunk_rows(df: DataFrame, payload_col: str, *more: str, size: int = CHUNK) -> DataFrame:
    """(*more, record_key, chunk_no, data, payload_sha256, payload_bytes, final): the chunked record
    table of the binary column payload_col (null: empty; an empty one has one empty chunk).
    record_key tells records apart; it names the task and the row, so it isn't the same in every
    run. payload_sha256 and payload_bytes are of the payload up to and with this chunk; the row with
    final has those of all of it."""
    kinds = {"record_key": T.StringType(), "chunk_no": T.IntegerType(), "data": T.BinaryType(), "payload_sha256": T.StringType(), "payload_bytes": T.LongType(), "final": T.BooleanType()}
    schema = T.StructType([*df.select(*more).schema, *(T.StructField(n, k) for n, k in kinds.items())])
    fields = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            types = [*(f.type for f in list(batch.schema)[:-1]), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]
            out: list[tuple] = []
            held = 0
            for i in range(batch.num_rows):
                n += 1
                value = batch.column(batch.num_columns - 1)[i]
                payload = memoryview(value.as_buffer() if value.is_valid else b"")  # no copy of it as a whole
                own = [batch.column(k)[i].as_py() for k in range(batch.num_columns - 1)]
                sofar = hashlib.sha256()
                for no, at in enumerate(range(0, max(len(payload), 1), size)):
                    data = payload[at : at + size]
                    sofar.update(data)
                    out.append((*own, f"{task}.{n}", no, bytes(data), sofar.hexdigest(), at + len(data), at + len(data) == len(payload)))
                    held += len(data)
                    if held > BATCH:
                        yield _batch(out, fields, types)
                        out, held = [], 0
            if out:
                yield _batch(out, fields, types)

    return df.select(*more, payload_col).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def revisits(df: DataFrame, id_col: str, digest_col: str, size_col: str, least: int = 100) -> DataFrame:
    """(id_col, digest_col, refers_to), stored: the rows whose payload of `least` bytes or more is that of
    a row with a smaller id, each once. Digests are counted before anything is joined, so a payload
    that a third of all rows share is one row of the right side."""
    own = stored(df.where((F.col(size_col) >= least) & F.col(id_col).isNotNull()).select(id_col, digest_col))
    ends = own.groupBy(digest_col).agg(F.min(id_col).alias("refers_to"), F.max(id_col).alias("highest"))
    first = stored(ends.where("refers_to < highest").select(digest_col, "refers_to"))
    return stored(own.join(checked_broadcast(first), digest_col).where(F.col(id_col) != F.col("refers_to")).select(id_col, digest_col, "refers_to").distinct())


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = 100, size: int = CHUNK, date: datetime | None = None) -> None:
    """Writes a WARC record for each row of df to files below path, as `*.txt.gz`.

    Of rows with equal payloads of at least `least` bytes, the one with the smallest id is the
    response; the others are revisit records without a block that refer to it. A null payload is
    empty, a null URI is left out, and line breaks in a URI are escaped. Rows with a null id are
    written under the id `null` and never revisit. Rows of one id stay apart if their payloads
    differ; rows that repeat wholly give the same record again, under the same name. date is the
    records' (by default now). Only rows that may be revisits are looked up; payloads aren't shuffled.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.select("id", "uri", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"), "payload")
    again = revisits(rows, "id", "digest", "bytes", least)
    first = without(rows, again, "id", "digest").withColumn("refers_to", F.lit(None).cast("long"))
    own = ["id", "uri", "digest", "refers_to"]
    chunks = chunk_rows(first, "payload", *own, size=size)
    near = bloom_pass(rows.select("id", "uri", "digest", "bytes", F.xxhash64("id", "digest").alias("item")), "item", bloom_filter(again.select(F.xxhash64("id", "digest").alias("item")), "item"))
    later = near.join(checked_broadcast(again), ["id", "digest"]).select(
        *own, F.lit("").alias("record_key"), F.lit(0).alias("chunk_no"), F.lit(b"").alias("data"), F.col("digest").alias("payload_sha256"), F.col("bytes").alias("payload_bytes"), F.lit(True).alias("final")
    )
    when = (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                records = [_record(row, when) for row in batch.slice(part, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    # A binary column cast to string keeps its bytes, so the text source writes them as they are.
    lines = chunks.unionByName(later).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def _name(record: object, digest: str, *more: object) -> str:
    return "<urn:" + ":".join(["record", "null" if record is None else str(record), digest, *map(str, more)]) + ">"


def _record(row: dict, when: str) -> bytes:
    """The WARC record of a chunk row."""
    again, first = row["refers_to"] is not None, row["chunk_no"] == 0
    whole = _name(row["id"], row["digest"])
    uri = None if row["uri"] is None else row["uri"].replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "revisit" if again else "response" if first else "continuation"),
        ("WARC-Record-ID", _name(row["id"], row["digest"], "revisit") if again else whole if first else _name(row["id"], row["digest"], row["chunk_no"])),
        ("WARC-Date", when),
        ("WARC-Target-URI", uri),
        ("WARC-Refers-To", _name(row["refers_to"], row["digest"]) if again else None),
        ("WARC-Profile", PROFILE if again else None),
        ("WARC-Segment-Number", None if again or first and row["final"] else row["chunk_no"] + 1),
        ("WARC-Segment-Origin-ID", None if again or first else whole),
        ("WARC-Segment-Total-Length", None if again or first or not row["final"] else row["payload_bytes"]),
        ("WARC-Payload-Digest", f"sha256:{row['payload_sha256']}" if row["final"] else None),
        ("X-Payload-Digest-So-Far", None if row["final"] else f"sha256:{row['payload_sha256']}"),
        ("X-Payload-Bytes", row["payload_bytes"]),
        ("X-Record-Key", row["record_key"] or None),
        ("Content-Type", None if again else "text/html;charset=utf-8"),
        ("Content-Length", len(row["data"])),
    ]
    head = "\r\n".join(f"{k}: {v}" for k, v in fields if v is not None)
    return HEAD + head.encode() + END + row["data"]


_TABLE = "record_id long, record_key string, record_type string, chunk_no int, refers_to long, stated_sha256 string, payload_bytes long, final boolean, data binary"
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_key, record_type, chunk_no, refers_to, stated_sha256, payload_bytes, final, data): the
    chunked record table of the archives below path that write_archive wrote. A revisit has one row
    without data. Raises if a record doesn't end where it says, or an archive ends inside one. The
    empty archive has no rows."""
    names = [c.split()[0] for c in _TABLE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for fields, block in _parsed(b"\n".join([*batch.column(0).to_pylist(), b""]) for batch in batches):
            out.append(_row(fields, block))
            held += len(block) + 256
            if held > BATCH:
                yield _batch(out, names, _TYPES)
                out, held = [], 0
        if out:
            yield _batch(out, names, _TYPES)

    # Lines are how the source hands over a file's bytes, in order; records don't depend on them.
    lines = spark.read.schema("value string").option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, _TABLE)


def _parsed(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records that parts, put together, hold."""
    held = b""
    for part in parts:
        held, at = held + part, 0
        while (end := held.find(END, at)) >= 0:
            if not held.startswith(HEAD, at):
                raise ValueError(f"no record begins where one should: {held[at : at + 40]!r}")
            fields = dict(line.split(": ", 1) for line in held[at + len(HEAD) : end].decode().split("\r\n"))
            stop = end + len(END) + int(fields["Content-Length"])
            if len(held) < stop + len(END):
                break
            if held[stop : stop + len(END)] != END:
                raise ValueError(f"{fields['WARC-Record-ID']}: doesn't end after the bytes that it states")
            yield fields, held[end + len(END) : stop]
            at = stop + len(END)
        held = held[at:]
    if held:
        raise ValueError(f"an archive ends inside a record: {held[:40]!r}")


def _row(fields: dict[str, str], block: bytes) -> tuple:
    number = lambda name: None if (x := name.strip("<>").split(":")[2]) == "null" else int(x)
    final = "WARC-Payload-Digest" in fields
    digest = fields["WARC-Payload-Digest" if final else "X-Payload-Digest-So-Far"].removeprefix("sha256:")
    refers = fields.get("WARC-Refers-To")
    return (
        number(fields["WARC-Record-ID"]), fields.get("X-Record-Key"), fields["WARC-Type"], int(fields.get("WARC-Segment-Number", 1)) - 1,
        None if refers is None else number(refers), digest, int(fields["X-Payload-Bytes"]), final, block,
    )


def verified_records(chunks: DataFrame) -> DataFrame:
    """(record_id, record_type, payload_bytes, payload_digest, refers_to): a row for each record of a
    chunked record table, which may come in any order and be empty. Digests and lengths of
    responses are computed from the chunks, one after another, and must equal what each chunk
    states; a chunk that is missing, the last one too, or there twice raises. Records of one chunk
    are checked where they are; the chunks of longer ones are sorted together first and stream by."""
    schema = "record_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"
    names, types = [c.split()[0] for c in schema.split(", ")], [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sofar, size, then, key = hashlib.sha256(), 0, 0, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["record_type"] == "revisit":
                    out.append((row["record_id"], "revisit", row["payload_bytes"], row["stated_sha256"], row["refers_to"]))
                    continue
                if row["chunk_no"] != then or then and row["record_key"] != key:
                    raise ValueError(f"record {row['record_id']}: chunk {row['chunk_no']} where {then} of {key} was due")
                sofar.update(row["data"])
                size, then, key = size + len(row["data"]), then + 1, row["record_key"]
                if sofar.hexdigest() != row["stated_sha256"] or size != row["payload_bytes"]:
                    raise ValueError(f"record {row['record_id']}, chunk {row['chunk_no']}: other bytes than stated")
                if row["final"]:
                    out.append((row["record_id"], "response", size, sofar.hexdigest(), None))
                    sofar, size, then = hashlib.sha256(), 0, 0
            if out:
                yield _batch(out, names, types)
        if then:
            raise ValueError(f"the last chunk of {key} was due")

    alone = (F.col("chunk_no") == 0) & F.col("final")
    several = chunks.where(~alone).repartition("record_key").sortWithinPartitions("record_key", "chunk_no")
    return chunks.where(alone).mapInArrow(run, schema).union(several.mapInArrow(run, schema))


def round_trip(df: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = 100, size: int = CHUNK) -> DataFrame:
    """df's rows written to archives in the shared folder, read back and verified: see write_archive
    and verified_records."""
    path = shared_folder(df.sparkSession) + "/warc"
    write_archive(df, path, id_col, uri_col, payload_col, least, size)
    return verified_records(read_archive(df.sparkSession, path)).withColumnRenamed("record_id", id_col)
