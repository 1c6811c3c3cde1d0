"""WARC archives: writing, normalising monolithic gzip files record by record, reading back by offset.

An archive that was gzipped as a whole can only be read from its start.  The normaliser inflates such a stream once,
writes every record as a gzip member of its own and a sidecar index (offset and length of each member), after which
any record can be read alone.  Files lie in the shared folder and are opened through ``pyarrow.fs`` by their URI.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, scratch_path, table

CHUNK = 1 << 20
#: Payloads below this many bytes are never written as a revisit.
MIN_REVISIT = 1000


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, size: int) -> bytes:
    """One WARC record: a response with its payload, or a revisit (``refers_to`` given) without."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def inflate(stream) -> Iterator[bytes]:
    """Chunks of a gzip stream, whether of one member or of many, holding one chunk at a time."""
    unzip = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            if unzip.eof:
                unzip = zlib.decompressobj(31)
            out = unzip.decompress(data, CHUNK)
            if out:
                yield out
            data = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
    if not unzip.eof:
        raise ValueError("the gzip stream is cut short")


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The WARC records of an inflated stream, each whole."""
    buffer = bytearray()
    need = 0
    for chunk in chunks:
        buffer += chunk
        while True:
            if not need:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = bytes(buffer[:end])
                need = end + 8 + int(head[head.index(b"Content-Length: ") + 16 :].split(b"\r\n", 1)[0])
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = 0
    if buffer:
        raise ValueError("the archive ends inside a record")


def _member(raw: bytes, level: int) -> bytes:
    zip_ = zlib.compressobj(level, zlib.DEFLATED, 31)
    return zip_.compress(raw) + zip_.flush()


def write_archives(records: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write (page_id, url, payload, digest, refers_to, size) as one monolithic .warc.gz per task; rows: archive, records.

    A retried task writes a new name, and only names of finished tasks are returned.
    """

    def write(batches):
        uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        out = zip_ = None
        n = 0
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if out is None:
                    fs, path = _open(uri)
                    fs.create_dir(path.rsplit("/", 1)[0])
                    out, zip_ = fs.open_output_stream(path, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                whole = lambda x: None if pd.isna(x) else int(x)
                out.write(zip_.compress(record_bytes(whole(row.page_id), row.url, row.payload.encode(), row.digest, whole(row.refers_to), row.size)))
                n += 1
        if out is not None:
            out.write(zip_.flush())
            out.close()
            yield pd.DataFrame({"archive": [uri], "records": [n]})

    # nullable integers as text: pandas has no integer null
    plain = records.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("refers_to").cast("string").alias("refers_to"), "size")
    return plain.mapInPandas(write, "archive string, records long")


def normalise_archives(archives: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Rewrite each archive with one gzip member per record; rows: archive, index (its sidecar), records.

    The sidecar has a JSON line per record: offset, length, id, type.
    """

    def rewrite(batches):
        for pdf in batches:
            for source in pdf["archive"]:
                uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                fs, path = _open(source)
                to, out_path = _open(uri)
                to.create_dir(out_path.rsplit("/", 1)[0])
                at = n = 0
                with fs.open_input_stream(path, compression=None) as raw, to.open_output_stream(out_path, compression=None) as out, to.open_output_stream(out_path + ".idx", compression=None) as index:
                    for record in split_records(inflate(raw)):
                        member = _member(record, level)
                        head = parse_record(record[: record.index(b"\r\n\r\n") + 4])[0]
                        out.write(member)
                        index.write(json.dumps({"offset": at, "length": len(member), "id": head["WARC-Record-ID"], "type": head["WARC-Type"]}).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield pd.DataFrame({"archive": [uri], "index": [uri + ".idx"], "records": [n]})

    return archives.mapInPandas(rewrite, "archive string, index string, records long")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, stored_bytes long"


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of normalised archives, each member inflated alone at its offset in the sidecar.

    A response's digest and length are computed from its payload; one that contradicts its header raises.
    """

    def read(batches):
        number = lambda x: None if x == "<urn:page:null>" else int(x[10:-1])
        for pdf in batches:
            for uri, index in zip(pdf["archive"], pdf["index"]):
                fs, path = _open(uri)
                rows = []
                with fs.open_input_stream(_open(index)[1], compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                with fs.open_input_file(path) as f:
                    for e in entries:
                        head, payload = parse_record(zlib.decompress(f.read_at(e["length"], e["offset"]), 31))
                        digest, size = head["WARC-Payload-Digest"][5:], int(head["WARC-Payload-Length"])
                        if head["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
                            raise ValueError(f"{uri}: record {e['id']} is damaged")
                        refers = head.get("WARC-Refers-To")
                        rows.append((number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], refers and number(refers), len(payload)))
                        if len(rows) == 5000:
                            yield _frame(rows)
                            rows = []
                if rows:
                    yield _frame(rows)

    return archives.mapInPandas(read, RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")])
    return pdf.astype({"page_id": "Int64", "refers_to": "Int64"})


def assign_revisits(pages: DataFrame, id_col: str, payload: str) -> DataFrame:
    """``pages`` with digest (SHA-1), size and refers_to: of equal payloads of at least ``MIN_REVISIT`` bytes the largest
    id is the response (all rows of that id, if it repeats), the others refer to it.  Null payloads are empty; a null id
    refers like any other and is the response only where no row of its payload has an id."""
    known = pages.withColumn("payload", F.coalesce(F.col(payload), F.lit("")))
    known = known.withColumns({"digest": F.sha1(F.encode("payload", "UTF-8")), "size": F.octet_length("payload").cast("long")})
    groups = known.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.max(id_col).alias("response"), F.count("*").alias("copies"))
    groups = groups.where("copies > 1").select("digest", "response")
    joined = known.join(groups, "digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col(id_col).eqNullSafe(F.col("response")), F.col("response"))).drop("response")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Each page as a record that went through a monolithic archive, the normaliser and a read by offset."""
    pages = assign_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id", "html")
    raw = materialise(write_archives(pages.select("page_id", "url", "payload", "digest", "refers_to", "size"), scratch_path(spark, "warc")), "archives")
    spread = raw.repartition(max(1, min(2000, raw.count())), "archive")
    single = materialise(normalise_archives(spread, scratch_path(spark, "members")), "normalised")
    out = read_archives(single.repartition(max(1, min(2000, single.count())), "archive"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "stored_bytes")
