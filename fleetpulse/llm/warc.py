"""WARC archives: a writer that stores repeated payloads once, and a sequential reader.

Archives are written one gzip member per record. The reader goes through an
archive once, from front to back: zlib is fed small pieces, a record's head gives
the length of its block, and digests are checked while the block passes by, so
memory does not grow with archives, members or payloads.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm.common import attach, small, table
from fleetpulse.session import work_path, written

PIECE = 1 << 16
#: An archive is closed once it is this long.
ARCHIVE_BYTES = 256 << 20
#: Shorter payloads are always stored.
LEAST_SHARED = 1000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:fleetpulse:page:"
BREAK = b"\r\n"
END = b"\r\n\r\n"


class ArchiveError(ValueError):
    """A member, a length or a digest is not what the archive says."""


def _file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, compressed as a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}",
        "WARC-Page": None if page_id is None else f"<{ID}{page_id}>",
        "WARC-Profile": REVISIT if revisit else None,
        "WARC-Refers-To": f"<{ID}{refers_to}>" if revisit and refers_to is not None else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in head.items() if v is not None], "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode()) + packer.compress(block) + packer.compress(END) + packer.flush()


def write_archives(records: DataFrame, name: str = "warc") -> DataFrame:
    """Write ``records`` (page_id, url, payload string, digest, refers_to, revisit) as archives.

    Returns the stored manifest (path, records, bytes). Each task writes files of
    its own, named at random; the manifest holds the files of tasks that ended
    well, so a repeated task leaves no record twice.
    """
    folder = work_path(records.sparkSession, name)

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _file_system(folder)
        store.create_dir(root, recursive=True)
        path = out = None
        count = size = 0
        for part in parts:
            for row in part.itertuples(index=False):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, count, size = store.open_output_stream(path), 0, 0
                ids = [None if pd.isna(x) else int(x) for x in (row.page_id, row.refers_to)]
                size += out.write(record(ids[0], row.url, row.payload.encode("utf-8"), row.digest, ids[1], bool(row.revisit)))
                count += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [path], "records": [count], "bytes": [size]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [count], "bytes": [size]})

    columns = records.select("page_id", "url", "payload", "digest", "refers_to", "revisit")
    return written(columns.mapInPandas(write, "path string, records long, bytes long"), f"{name}-manifest")


def members(stream) -> Iterator[Iterator[bytes]]:
    """Each gzip member of a stream as its decompressed pieces. A member must be used up before the next."""
    rest = [stream.read(PIECE)]

    def pieces() -> Iterator[bytes]:
        unpack = zlib.decompressobj(31)
        while True:
            # no more than a piece at a time comes out, however well it was packed
            data = unpack.decompress(rest[0], PIECE)
            rest[0] = unpack.unconsumed_tail
            if data:
                yield data
            if unpack.eof:
                rest[0] = unpack.unused_data or stream.read(PIECE)
                return
            if not rest[0]:
                rest[0] = stream.read(PIECE)
                if not rest[0] and not data:
                    raise ArchiveError("the last member is cut off")

    while rest[0]:
        yield pieces()


def _head(pieces: Iterator[bytes], most: int = 1 << 20) -> tuple[dict[str, str], bytes]:
    """Header fields up to the empty line, and what was read beyond it."""
    got = b""
    while END not in got:
        more = next(pieces, None)
        if more is None or len(got) > most:
            raise ArchiveError("a record has no head")
        got += more
    head, rest = got.split(END, 1)
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    return {k.lower(): v for k, v in fields.items()} | {"": lines[0]}, rest


def read_records(stream, keep_payload: bool = True) -> Iterator[dict]:
    """Records of one archive in order: fields, payload (bytes or None), payload_bytes, payload_digest.

    The payload of a revisit is not stored; its length and digest are those that
    the record states. Everything that is stored is verified.
    """
    for pieces in members(stream):
        fields, data = _head(pieces)
        if not fields[""].startswith("WARC/"):
            raise ArchiveError(f"not a WARC record: {fields['']!r}")
        left = int(fields["content-length"])
        block, body, http, kept, length = hashlib.sha1(), hashlib.sha1(), b"", [], 0
        stated = None
        while True:
            now, data = data[:left], data[left:]
            left -= len(now)
            block.update(now)
            if stated is None:
                http += now
                if END in http:
                    inner, now = http.split(END, 1)
                    stated = next(int(x.split(b":")[1]) for x in inner.split(BREAK) if x.lower().startswith(b"content-length:"))
                else:
                    now = b""
            body.update(now)
            length += len(now)
            if keep_payload and now:
                kept.append(now)
            if not left:
                break
            data = next(pieces, None)
            if data is None:
                raise ArchiveError("a block is shorter than its head says")
        if data + b"".join(pieces) != END:
            raise ArchiveError("a block is longer than its head says")
        if fields["warc-block-digest"] != f"sha1:{block.hexdigest()}":
            raise ArchiveError("a block does not have its digest")
        revisit = fields["warc-type"] == "revisit"
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if not revisit and (digest != body.hexdigest() or length != stated):
            raise ArchiveError("a payload does not have its digest")
        yield {
            "fields": fields,
            "payload": b"".join(kept) if keep_payload and not revisit else None,
            "payload_bytes": stated,
            "payload_digest": digest,
        }


def _page(value: str | None) -> int | None:
    return None if value is None else int(value.removeprefix(f"<{ID}").removesuffix(">"))


def read_archives(manifest: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Records of all archives of a manifest: page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest.

    An archive is read by one task; archives are dealt out evenly.
    """
    schema = (
        "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    )

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[tuple]) -> pd.DataFrame:
            made = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"])
            return made.astype({"page_id": "Int64", "refers_to": "Int64"})

        for part in parts:
            for path in part["path"]:
                store, place = _file_system(path)
                rows, held = [], 0
                with store.open_input_stream(place) as stream:
                    for r in read_records(stream, keep_payload):
                        f = r["fields"]
                        rows.append(
                            (
                                _page(f.get("warc-page")),
                                f.get("warc-target-uri"),
                                f["warc-type"],
                                _page(f.get("warc-refers-to")),
                                r["payload"],
                                r["payload_bytes"],
                                r["payload_digest"],
                            )
                        )
                        held += len(r["payload"] or b"") + 200
                        if held > 16 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInPandas(read, schema)


def share_payloads(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Pages as records: page_id, url, payload, digest, refers_to, revisit.

    Of equal payloads of LEAST_SHARED bytes or more the largest key is stored and
    the others refer to it; of rows that repeat that key one is stored. A null
    payload is empty, null keys are the smallest. Digests are grouped before any
    payload moves; groups are sent to all executors while that is within the
    bound, else joined with hot digests salted.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(body), F.lit("")).alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    sharing = rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest")
    groups = sharing.agg(F.count("*").alias("n"), F.max(F.struct("page_id", "row")).alias("best")).where("n > 1")
    groups = written(groups, "warc-groups")
    bytes_proven = groups.count() * 160
    sized = small(groups, bytes_proven)
    joined = rows.join(sized, "digest", "left") if sized is not groups else attach(rows, groups, "digest", "n", ["row"], "left")
    revisit = F.coalesce(F.col("row") != F.col("best.row"), F.lit(False))
    return joined.withColumn("revisit", revisit).select(
        "page_id", "url", "payload", "digest", F.when(F.col("revisit"), F.col("best.page_id")).alias("refers_to"), "revisit"
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    manifest = write_archives(share_payloads(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return read_archives(manifest, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


SQL = r"""
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to, url
FROM r
"""
