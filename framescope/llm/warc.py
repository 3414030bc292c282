"""WARC archives: written as one gzip stream a file, normalised to one gzip
member a record with a sidecar offset index, and read back through it.

``write`` makes a record of every page row (payload: the html in UTF-8). Of
records with equal payloads (SHA-1) of at least ``LEAST`` bytes the one with
the largest page id is a response and the others are revisits that name it;
rows that repeat that page id are responses too. ``normalise`` inflates each
whole-file stream once, chunk by chunk, and rewrites every record as its own
member; the sidecar has a line ``offset length`` for each. ``read`` seeks
each record by the sidecar and checks its payload against its digest.

Files lie in the session's shared folder under their final names only when
whole, so repeated tasks do no harm. Defined cases: null html is an empty
payload; a null page id or url has no header, and reads back as null; a
repeated payload without any page id has responses only; empty tables give
empty archives; other columns are ignored."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.llm.common import put_file, shared_files, shared_folder, written

LEAST = 1000
CHUNK = 1 << 20
#: Repeated payloads (a digest and an id each) that are broadcast at most.
BROADCAST = 200_000
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
GZIP = 31


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, html, digest, refers_to`` of every page row."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    groups = (rows.where(F.octet_length("html") >= least).groupBy(F.col("digest").alias("same"))
              .agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).where("n > 1").drop("n"))
    groups = written(groups, "payloads")
    if groups.limit(BROADCAST + 1).count() <= BROADCAST:
        groups = F.broadcast(groups)
    joined = rows.join(groups, (F.col("digest") == F.col("same")) & ~F.col("page_id").eqNullSafe(F.col("keeper")), "left")
    return joined.select("page_id", "url", "html", "digest", F.col("keeper").alias("refers_to"))


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}",
            f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write one archive a partition, each a single gzip stream; rows
    ``name, records`` of the archives."""
    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, n = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0

        def stream(out) -> None:
            nonlocal n
            gz = zlib.compressobj(6, zlib.DEFLATED, GZIP)
            for b in batches:
                for page, url, html, digest, refers in zip(b["page_id"], b["url"], b["html"], b["digest"],
                                                           b["refers_to"]):
                    out.write(gz.compress(record(_whole(page), url, html.encode(), digest, _whole(refers))))
                    n += 1
            out.write(gz.flush())

        put_file(folder, name, stream)
        yield pd.DataFrame({"name": [name], "records": [n]})

    ids = F.col("page_id").cast("string"), F.col("refers_to").cast("string")  # pandas has no null integers
    rows = planned(pages, least).select(ids[0].alias("page_id"), "url", "html", "digest", ids[1].alias("refers_to"))
    return written(rows.mapInPandas(archive, "name string, records long"), "archives")


def _whole(value: str | None) -> int | None:
    return None if value is None else int(value)


def _inflated(source) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, in chunks."""
    gz, seen = zlib.decompressobj(GZIP), False
    while block := source.read(CHUNK):
        seen = True
        while block:
            if gz.eof:
                gz = zlib.decompressobj(GZIP)
            data = gz.decompress(block, CHUNK)
            if data:
                yield data
            block = gz.unconsumed_tail or gz.unused_data
    while data := gz.decompress(gz.unconsumed_tail, CHUNK):
        yield data
    if seen and not gz.eof:
        raise ValueError("the archive ends inside its gzip stream")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:] if ": " in line)


def rewritten(source, out) -> Iterator[tuple[int, int]]:
    """Copy every record of a gzip stream into a member of its own; yields
    each member's offset and length. Only a header and a chunk are held."""
    chunks = _inflated(source)
    held, at = b"", 0
    while True:
        while END not in held:
            block = next(chunks, None)
            if block is None:
                if held.strip():
                    raise ValueError("the archive ends inside a record header")
                return
            held += block
        cut = held.index(END) + len(END)
        left = cut + int(_fields(held[:cut])["Content-Length"]) + len(END)
        gz, size = zlib.compressobj(6, zlib.DEFLATED, GZIP), 0
        while left:
            if not held:
                held = next(chunks, None) or b""
                if not held:
                    raise ValueError("the archive ends inside a record")
            piece, held = held[:left], held[left:]
            left -= len(piece)
            packed = gz.compress(piece)
            size += len(packed)
            out.write(packed)
        packed = gz.flush()
        out.write(packed)
        size += len(packed)
        yield at, size
        at += size


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each archive with a member a record and its sidecar index;
    rows ``name, records``."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["name"]:
                files, base = shared_files(source)
                places: list[str] = []

                def members(out) -> None:
                    places.clear()
                    with files.open_input_stream(f"{base}/{name}", compression=None) as src:
                        places.extend(f"{o} {n}\n" for o, n in rewritten(src, out))

                put_file(target, name, members)
                put_file(target, name + ".idx", lambda out: out.write("".join(places).encode()))
                yield pd.DataFrame({"name": [name], "records": [len(places)]})

    return written(_spread(archives).mapInPandas(each, "name string, records long"), "members")


def _spread(archives: DataFrame) -> DataFrame:
    """A partition for each few archives: their rows are small, their work is not."""
    return archives.select("name").repartition(max(1, archives.count()), "name")


def read(archives: DataFrame, folder: str) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type,
    refers_to`` of every record, found by the sidecar index."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["name"]:
                files, base = shared_files(folder)
                with files.open_input_stream(f"{base}/{name}.idx", compression=None) as src:
                    places = [tuple(map(int, x.split())) for x in src.read().decode().splitlines()]
                with files.open_input_file(f"{base}/{name}") as src:
                    for i in range(0, len(places), 1000):
                        yield pd.DataFrame([_read_one(src, *p) for p in places[i:i + 1000]], columns=_COLUMNS)

    types = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    rows = _spread(archives).mapInPandas(each, types)
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("page_id", "refers_to")})


_COLUMNS = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def _read_one(source, offset: int, length: int) -> tuple:
    source.seek(offset)
    data = zlib.decompress(source.read(length), GZIP)
    cut = data.index(END) + len(END)
    f = _fields(data[:cut])
    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(f["X-Payload-Length"])
    if f["WARC-Type"] == "response":
        payload = data[data.index(END, cut) + len(END):-len(END)]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"record at {offset}: the payload does not match its digest")
    return f.get("X-Page-Id"), f.get("WARC-Target-URI"), size, digest, f["WARC-Type"], f.get("X-Refers-To-Page")


def round_trip(spark: SparkSession, pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write, normalise and read back all pages."""
    whole, members = shared_folder(spark, "warc-whole"), shared_folder(spark, "warc-members")
    archives = normalise(write(pages, whole, least), whole, members)
    return read(archives, members)
