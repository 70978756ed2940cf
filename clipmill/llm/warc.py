"""WARC archives: a writer with revisit records and a salvage reader.

The writer gives each record a gzip member of its own and rolls to a new file by
size, so no file is large. A task attempt writes files of a unique name and
returns them as manifest rows; files of lost attempts are in no manifest.

The reader checks every member and record (gzip checksum, version line, header
block, length, block and payload digests, closing line ends). When a check fails
it searches on for the next valid member or version line, goes on from there and
logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, work_dir

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MAGIC = b"\x1f\x8b\x08"
ROLL = 4 << 20
ROWS = "path string, offset long, length long, kind string, record_type string, page_id long, refers_to long, target string, payload binary, payload_bytes long, payload_digest string, reason string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def target_uri(page_id: int | None, url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{'none' if page_id is None else page_id}")


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, first: int | None, first_url: str | None = None) -> bytes:
    """One record; ``payload`` None makes it a revisit of page ``first``, whose address is ``first_url``. Each record has an id of its own."""
    name = "none" if page_id is None else str(page_id)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    fields = {
        "WARC-Type": "response" if payload is not None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": target_uri(page_id, url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        fields["X-Page-Id"] = name
    if payload is None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To-Target-URI": target_uri(first, first_url), "WARC-Refers-To-Date": DATE, "X-Refers-To-Page-Id": str(first)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


# --- reading ---------------------------------------------------------------------------------------


class Damaged(Exception):
    pass


def read_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at ``at`` and the place after it; raises ``Damaged`` with the failed check."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", version.end() - 2)
    if end < 0:
        raise Damaged("header block not closed")
    fields = {}
    for line in data[version.end() : end].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        fields[key.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length) or "warc-type" not in fields:
        raise Damaged("no length or type")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("block shorter or longer than its length")
    block = data[start:stop]
    kind, value = (fields.get("warc-block-digest", ":").split(":", 1) + [""])[:2]
    if kind == "sha1" and value != base32_sha1(block):
        raise Damaged("block digest differs")
    http = block.find(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else -4
    payload = block[http + 4 :] if http != -1 else block
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if digest and digest != base32_sha1(payload):
            raise Damaged("payload digest differs")
        digest, size = base32_sha1(payload), len(payload)
    else:
        told = re.search(rb"(?i)\r\nContent-Length: *([0-9]{1,18})\r\n", block)
        size = int(told[1]) if told else len(payload)
    number = lambda k: int(v) if re.fullmatch(r"-?[0-9]{1,19}", v := fields.get(k, "")) else None
    return {
        "record_type": fields["warc-type"], "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page-id"), "target": fields.get("warc-target-uri"),
        "payload": payload if fields["warc-type"] == "response" else None, "payload_bytes": size, "payload_digest": digest, "fields": fields,
    }, stop + 4


def next_version(data: bytes, at: int) -> int:
    """The next place from ``at`` on where a version line begins a line, or the end."""
    for m in VERSION.finditer(data, at):
        if m.start() == 0 or data[m.start() - 1 : m.start()] == b"\n" or m.start() == at:
            return m.start()
    return len(data)


def salvage_plain(data: bytes) -> Iterator[dict]:
    """Records and gaps of uncompressed data, in order; together they cover it all."""
    at, bad, reason = 0, None, ""
    while at < len(data):
        try:
            found, after = read_record(data, at)
        except Damaged as e:
            if bad is None:
                bad, reason = at, str(e)
            at = next_version(data, at + 1)
            continue
        if bad is not None:
            yield {"kind": "gap", "offset": bad, "length": at - bad, "reason": reason}
            bad = None
        yield found | {"kind": "record", "offset": at, "length": after - at}
        at = after
    if bad is not None:
        yield {"kind": "gap", "offset": bad, "length": len(data) - bad, "reason": reason}


def read_member(data: memoryview, at: int) -> tuple[bytes, int]:
    """The gzip member at ``at``, its checksum verified, and the place after it."""
    engine, plain = zlib.decompressobj(31), []
    while not engine.eof:
        if at >= len(data):
            raise Damaged("member is cut off")
        try:
            plain.append(engine.decompress(data[at : at + 65536]))
        except zlib.error as e:
            raise Damaged(f"member: {e}") from None
        at = min(at + 65536, len(data)) - len(engine.unused_data)
    return b"".join(plain), at


def salvage_members(data: bytes) -> Iterator[dict]:
    """Records and gaps of data made of gzip members.

    A member whose checksum holds but whose inside fails is searched inside; the
    damage is logged with the place of the member. Failing members are skipped to
    the next place where a member begins and holds, or a plain version line does.
    """
    at, bad, reason, view = 0, None, "", memoryview(data)
    while at < len(data):
        try:
            if data[at : at + 3] == MAGIC:
                plain, after = read_member(view, at)
                inside = list(salvage_plain(plain))
                if bad is not None and not any(x["kind"] == "record" for x in inside):
                    raise Damaged("no record in a member after a gap")
            elif bad is not None:
                found, after = read_record(data, at)
                inside = [found | {"kind": "record"}]
            else:
                raise Damaged("no member begins here")
        except Damaged as e:
            if bad is None:
                bad, reason = at, str(e)
            places = [p for p in (data.find(MAGIC, at + 1), next_version(data, at + 1)) if p >= 0]
            at = min(places, default=len(data))
            continue
        if bad is not None:
            yield {"kind": "gap", "offset": bad, "length": at - bad, "reason": reason}
            bad = None
        for x in inside:
            yield x | {"offset": at, "length": after - at}
        at = after
    if bad is not None:
        yield {"kind": "gap", "offset": bad, "length": len(data) - bad, "reason": reason}


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive, compressed or not, whatever its state."""
    head = data[:3] == MAGIC
    compressed = head or (not VERSION.match(data) and 0 <= data.find(MAGIC) < next_version(data, 0))
    return salvage_members(data) if compressed else salvage_plain(data)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record and per gap of all files at ``path`` (a folder or pattern).

    Gaps have kind "gap", their offset and length in the file, and the failed check
    as reason. Empty files give no rows. Files are read whole, so they should be
    rolled at a moderate size, as the writer does.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = [part.split()[0] for part in ROWS.split(", ")]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows, size = [], 0
                for x in salvage(bytes(content)):
                    rows.append([name if n == "path" else x.get(n) for n in names])
                    size += len(x.get("payload") or b"")
                    if size > ROLL:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.mapInPandas(parse, ROWS)


# --- writing ---------------------------------------------------------------------------------------


def write_archives(records: DataFrame, path: str, roll: int = ROLL) -> DataFrame:
    """Write (page_id, url, payload, payload_bytes, digest, first, first_url) as archives below ``path``; gives the manifest (file, records, bytes)."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        parts, size, done = [], 0, []

        def close() -> None:
            nonlocal parts, size
            if parts:
                name = f"{uuid.uuid4().hex}.warc.gz"
                with store.open_output_stream(f"{root}/{name}.part", compression=None) as out:
                    for p in parts:
                        out.write(p)
                store.move(f"{root}/{name}.part", f"{root}/{name}")
                done.append((name, len(parts), size))
            parts, size = [], 0

        for frame in frames:
            for page_id, url, payload, n, digest, first, first_url in zip(*(frame[c] for c in ("page_id", "url", "payload", "payload_bytes", "digest", "first", "first_url")), strict=True):
                whole = lambda v: None if pd.isna(v) else int(v)
                member = gzip.compress(record(whole(page_id), url, None if payload is None else bytes(payload), int(n), base64.b32encode(bytes.fromhex(digest)).decode(), whole(first), first_url), 6, mtime=0)
                parts.append(member)
                size += len(member)
                if size >= roll:
                    close()
        close()
        yield pd.DataFrame(done, columns=["file", "records", "bytes"])

    return cut(records.mapInPandas(write, "file string, records long, bytes long"))


def to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Rows for the writer. Of equal payloads of at least ``least`` bytes the smallest id is the response, others revisit it.

    Payload bytes travel for responses only: ids are settled on narrow rows, so a
    payload that a third of all pages share costs no more than another.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("sha", F.sha2("payload", 256))
    narrow = cut(rows.select("page_id", "url", "sha", F.sha1("payload").alias("digest"), F.length("payload").cast("long").alias("payload_bytes")))
    shared = narrow.filter(F.col("payload_bytes") >= least)
    least_page = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    firsts = cut(shared.groupBy("sha").agg(least_page.alias("f")).select("sha", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url")))
    marked = narrow.join(firsts, "sha", "left").withColumn("first", F.when(F.col("payload_bytes") >= least, F.col("first")).otherwise(F.col("page_id")))
    revisits = marked.filter(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "payload_bytes", "digest", "first", "first_url")
    own = rows.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("first", F.lit(None).cast("long")).withColumn("first_url", F.lit(None).cast("string"))
    keys = firsts.select(F.col("first").alias("page_id"), "sha")
    responses = own.filter(F.col("payload_bytes") >= least).join(keys.filter("page_id IS NOT NULL"), ["page_id", "sha"], "left_semi")
    nameless = own.filter("page_id IS NULL").filter(F.col("payload_bytes") >= least).join(keys.filter("page_id IS NULL").select("sha"), "sha", "left_semi")
    small = own.filter(F.col("payload_bytes") < least)
    columns = ["page_id", "url", "payload", "payload_bytes", "digest", "first", "first_url"]
    return responses.select(columns).unionByName(nameless.select(columns)).unionByName(small.select(columns)).unionByName(revisits.select(columns))


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Incomplete(Exception):
    """Archives that don't give back every record that was written."""


def checked(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """The records of ``found`` that lie in files of ``manifest``.

    Raises ``Incomplete``, with the first of the quarantined gaps, if a file of the
    manifest gives other than its number of records or has a gap.
    """
    named = cut(found.withColumn("file", F.substring_index("path", "/", -1)).join(manifest.select("file"), "file", "left_semi"))
    seen = named.groupBy("file").agg(F.count_if(F.col("kind") == "record").alias("n"), F.count_if(F.col("kind") != "record").alias("gaps"))
    wrong = manifest.join(seen, "file", "left").filter("records <> coalesce(n, 0) OR gaps > 0").limit(5).collect()
    if wrong:
        gaps = named.filter("kind <> 'record'").select("file", "offset", "length", "reason").limit(5).collect()
        raise Incomplete(f"files {[(r.file, r.records, r.n) for r in wrong]}, gaps {[tuple(r) for r in gaps]}")
    return named.filter("kind = 'record'")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives, read them back by the salvage reader, and give the record table.

    A null html is an empty payload; rows that repeat id and html are responses (or
    revisits) alike; a null id is a revisit where its payload has an id elsewhere.
    Records that can't be read back are an error, never a shorter table.
    """
    spark = pages.sparkSession
    path = work_dir(spark, "warc")
    try:
        manifest = write_archives(to_records(pages), path)
        if not manifest.filter("records > 0").limit(1).count():
            return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
        return checked(read_archives(spark, f"{path}/*.warc.gz").drop("payload"), manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    finally:
        remove(spark, path)


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
quints AS (
  SELECT *, list_transform(range(0, 8), lambda g: ('0x' || substr(hex, CAST(g * 5 + 1 AS INTEGER), 5))::BIGINT) AS parts FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(parts, lambda n:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((n >> 15) & 31 AS INTEGER) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((n >> 10) & 31 AS INTEGER) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((n >> 5) & 31 AS INTEGER) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(n & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM quints
"""
