"""WARC archives (operator 1): a writer of gzip-member archives and a salvage reader.

Reader: it walks an archive member by member (or record by record where it is not compressed) and checks each: the
member's CRC, the version line, the length, the closing blank lines and, where given, the block digest. After a failed
check it searches for the next valid member or version line, goes on from there, and logs the bytes between as a gap. Inside a
member whose CRC is right it does the same in the content; such a gap names the content's bytes, as its place is the member's.
Of a member that breaks off, is followed by another too early, or has a wrong CRC or form, what unpacks is kept: records that their own
block digest proves are recovered if their headers, which no digest covers, are well formed and the CRC does not show a changed byte
there; the search goes on behind the bytes they came from, and
the gap has the member's bytes. Every search passes over the archive once.

Writer: ``write`` makes one folder of archives for each task; a task writes under a name of its own and renames the
folder when it is complete, so a lost or repeated task leaves no partial archive under ``part-*``. Archives are rolled
at ``roll_bytes``, which bounds what a reading task holds. Executors reach the folder through ``pyarrow.fs``.

Defined results: null html is an empty payload; of rows with equal payloads of at least ``min_revisit`` bytes the one with the
largest page_id (null: the least) is the response and the others, repeated rows too, are revisits of it; control characters
in a URL are percent-encoded; columns of other names are ignored, whatever the names; an archive of any length is one row in memory; a header of 64 KB or more is none; an empty table leaves a folder without archives, which reads as no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder

ROLL_BYTES = 4 << 20
#: Bytes of a header.
HEAD = 1 << 16
GZIP = b"\x1f\x8b\x08"
RECORD = "file string, begin long, stop long, warc_type string, record_id string, target_uri string, refers_to_id string, payload_digest string, payload_bytes long, payload binary, gap_reason string"
FIELDS = ("file", "begin", "stop", "warc_type", "record_id", "target_uri", "refers_to_id", "payload_digest", "payload_bytes", "payload", "gap_reason")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, copy: int) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{copy}>"


def make_record(url: str | None, rid: str, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit record with the response's HTTP header and no payload."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:x-none")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {rid}", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def plan_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = 0) -> DataFrame:
    """page_id, url, payload, copy and, for revisits, refers_to_page (a struct, as page ids may be null)."""
    least = F.lit(-(2**63))
    rows = pages.select(F.coalesce(F.col(page_id).cast("long"), least).alias("pid"), F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # Narrow rows first: who leads each payload. Only payloads with several rows are joined back.
    narrow = rows.select("pid", "sha").groupBy("pid", "sha").agg(F.count(F.lit(1)).alias("c"))
    lead = narrow.groupBy("sha").agg(F.max("pid").alias("lead"), F.sum("c").alias("n")).where("n > 1").drop("n")
    plan = narrow.select("pid", "sha").join(lead, "sha")
    # The wide rows move once, by page and payload, so no payload's rows meet in one task unless they are the same page.
    order = Window.partitionBy("pid", "sha").orderBy(F.lit(0))
    joined = rows.join(plan, ["pid", "sha"], "left").withColumn("copy", F.row_number().over(order) - 1)
    small = F.octet_length("html") < min_revisit
    revisit = F.col("lead").isNotNull() & ~small & ((F.col("pid") != F.col("lead")) | (F.col("copy") > 0))
    return joined.select("page_id", "url", F.col("html").alias("payload"), "copy", F.when(revisit, F.struct(F.nullif("lead", least).alias("page_id"))).alias("refers_to_page"))


def write(planned: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> None:
    """Write a record per row into archives below folder."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        own, final = f"{root}/_try-{uuid.uuid4().hex}", f"{root}/part-{TaskContext.get().partitionId():06d}"
        held, size, files, records = [], 0, 0, 0

        def roll() -> None:
            nonlocal held, size, files
            with fs.open_output_stream(f"{own}/{files:05d}.warc.gz", compression=None) as out:
                out.write(b"".join(held))
            held, size, files = [], 0, files + 1

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, copy, refers = (c[i].as_py() for c in batch.columns)
                if not files and not held:
                    fs.create_dir(own, recursive=True)
                held.append(gzip_member(make_record(url, record_id(page, copy), payload.encode(), refers and record_id(refers["page_id"], 0))))
                size += len(held[-1])
                records += 1
                if size >= roll_bytes:
                    roll()
        if held:
            roll()
        if files:
            if fs.get_file_info(final).type == pafs.FileType.NotFound:
                fs.move(own, final)
            else:  # another attempt of this task was first
                fs.delete_dir(own)
        yield pa.RecordBatch.from_pydict({"records": [records]})

    planned.mapInArrow(store, "records long").agg(F.sum("records")).collect()


def read_member(data: memoryview, at: int) -> tuple[bytes, int, bool, int | None]:
    """The content of the gzip member at a place, where it ends, and whether it is sound; of one that breaks off or fails a check, all
    that could be unpacked, and its CRC if that is what failed."""
    unpacker, out, fed, step = zlib.decompressobj(31), [], at, 1024  # a small step first, as most false starts break at once
    try:
        while not unpacker.eof and fed < len(data):
            out.append(unpacker.decompress(data[fed : fed + step]))
            fed, step = fed + step, 65536
    except zlib.error as why:
        # What the step that failed held before the fault: halves of it, as far as they go.
        unpacker, size = zlib.decompressobj(31), min(step, len(data) - fed)
        unpacker.decompress(data[at:fed])
        while size:
            trial, half = unpacker.copy(), (size + 1) // 2
            try:
                out.append(trial.decompress(data[fed : fed + half]))
                unpacker, fed, size = trial, fed + half, size - half
            except zlib.error:
                if size == 1:
                    break
                size = half
        # A wrong CRC is told at its last byte.
        return b"".join(out), len(data), False, int.from_bytes(data[fed - 3 : fed + 1], "little") if "data check" in str(why) else None
    return b"".join(out), min(fed, len(data)) - len(unpacker.unused_data), unpacker.eof, None


#: What a byte adds to a CRC-32, by the byte; by that, the byte; and the byte by the highest eight bits of it.
ADDS = [zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)]
BYTES, HIGHEST = {c: b for b, c in enumerate(ADDS)}, {c >> 24: b for b, c in enumerate(ADDS)}


def changed_byte(content: bytes, crc: int) -> int | None:
    """The place of the one byte whose change explains why the content's CRC is not the given one, if there is such a place.

    The CRC is linear: a changed byte adds a number of its own, that each byte behind it carries on. The difference of the
    CRCs is carried back byte by byte until it is such a number.
    """
    rest = zlib.crc32(content) ^ crc
    for place in range(len(content) - 1, -1, -1):
        if rest in BYTES:
            return place
        low = HIGHEST[rest >> 24]
        rest = ((rest ^ ADDS[low]) << 8 & 0xFFFFFFFF) | low
    return None


def unpacked_from(data: memoryview, at: int, size: int) -> int:
    """Where the bytes end that the first ``size`` bytes of the member's content come from; all but one, lest its CRC is looked at."""
    unpacker, fed, left = zlib.decompressobj(31), at, size - 1
    while left > 0:
        piece = data[fed : fed + 65536]
        left -= len(unpacker.decompress(piece, left))
        fed += len(piece) - len(unpacker.unconsumed_tail)
    return fed


#: The names of the WARC format's header fields, and the forms of four of them.
NAMES = frozenset(
    "warc-type warc-record-id warc-date content-length content-type warc-concurrent-to warc-block-digest warc-payload-digest warc-ip-address warc-refers-to warc-refers-to-target-uri "
    "warc-refers-to-date warc-target-uri warc-truncated warc-warcinfo-id warc-filename warc-profile warc-identified-payload-type warc-segment-number warc-segment-origin-id warc-segment-total-length".split()
)
FORMS = {"warc-type": r"warcinfo|response|resource|request|metadata|revisit|conversion|continuation", "warc-record-id": r"<[a-z]+:[^<>\s]+>", "warc-date": r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z", "warc-block-digest": r"sha1:[A-Z2-7]{32}"}


def proven(head: dict) -> bool:
    """Whether a record whose member's checks failed may be taken: its block digest was there (and so held), and its header, which no
    digest covers, has the fields that it must have, in their forms, and none of an unknown name."""
    return head.keys() <= NAMES and all(re.fullmatch(form, head.get(name, "")) for name, form in FORMS.items())


class Marks:
    """The next place of a mark behind a given one, for places that only grow: each byte is searched once."""

    def __init__(self, data: bytes, mark: bytes) -> None:
        self.data, self.mark, self.place = data, mark, -1

    def after(self, at: int) -> int:
        if self.place < at:
            found = self.data.find(self.mark, at)
            self.place = found if found >= 0 else len(self.data)
        return self.place


class Heads:
    """Where the header that begins at a place ends, and where the next line with a version begins."""

    def __init__(self, data: bytes) -> None:
        self.blanks, self.versions = Marks(data, b"\r\n\r\n"), Marks(data, b"\nWARC/1.")

    def end(self, at: int) -> int | None:
        """None if there is no end, another version line comes before it, or the header is longer than HEAD."""
        end = self.blanks.after(at)
        return end if end < min(len(self.blanks.data), self.versions.after(at), at + HEAD) else None


def read_record(data: bytes, at: int, heads: Heads) -> tuple[dict, bytes, int] | str:
    """Headers, block and end of the record at a place, or which check failed. heads: those of data."""
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at):
        return "version"
    head_end = heads.end(at)
    if head_end is None:
        return "header"
    head, line = {}, data.find(b"\r\n", at) + 2
    while line < head_end:
        end = data.find(b"\r\n", line, head_end + 2)
        name, colon, value = data[line:end].partition(b":")
        if not colon:
            return "header"
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        line = end + 2
    if not re.fullmatch(r"[0-9]{1,18}", head.get("content-length", "")):
        return "length"
    begin = head_end + 4
    end = begin + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return "length"
    block = data[begin:end]
    if head.get("warc-block-digest", "").startswith("sha1:") and head["warc-block-digest"][5:] != sha1_base32(block):
        return "digest"
    return head, block, end + 4


def salvage_content(content: bytes) -> tuple[list[tuple], str]:
    """(headers, block, None, end) of each record in a member's content and (None, None, reason, end) of each gap, in order; nothing
    but a reason if there is no record."""
    found, at, gap, why, records = [], 0, None, "empty", 0
    heads, lines = Heads(content), Marks(content, b"WARC/1.")
    while at < len(content):
        got = read_record(content, at, heads)
        if isinstance(got, str):
            if gap is None:
                gap, why = at, got
            at = lines.after(at + 1)
            continue
        if gap is not None:
            found.append((None, None, f"{why} (content bytes {gap} to {at})", at))
            gap = None
        found.append((got[0], got[1], None, got[2]))
        records, at = records + 1, got[2]
    if not records:
        return [], why
    if gap is not None:
        found.append((None, None, f"{why} (content bytes {gap} to {len(content)})", len(content)))
    return found, ""


def salvage(data: bytes) -> Iterator[tuple]:
    """(begin, end, headers, block, None) of each record and (begin, end, None, None, reason) of each gap, in order."""
    view, at, gap, why = memoryview(data), 0, None, ""
    heads, starts = Heads(data), [Marks(data, GZIP), Marks(data, b"WARC/1.")]
    while at < len(data):
        found, end, reason, following = [], at, "", at + 1
        if data.startswith(GZIP, at):
            content, end, sound, crc = read_member(view, at)
            if sound:
                found, reason = salvage_content(content)
                found = [x[:3] for x in found]
            else:
                reason, end = "gzip", at
                # It is cut off, or its CRC or form is wrong: records are taken if their own digest proves them, but none whose header has
                # the byte that makes the CRC wrong; and nothing is searched in the bytes that they came from.
                wrong, last, taken = None if crc is None else changed_byte(content, crc), 0, []
                for head, block, lost, stop in salvage_content(content)[0]:
                    if lost is None and proven(head) and not (wrong is not None and last <= wrong < stop - 4 - len(block)):
                        taken.append((head, block, lost, stop))
                    last = stop
                if taken:
                    following = max(following, unpacked_from(view, at, taken[-1][3]))
                    if gap is not None:
                        yield gap, at, None, None, why
                        gap = None
                for head, block, *_ in taken:
                    yield at, at, head, block, None
        else:
            got = read_record(data, at, heads)
            if isinstance(got, str):
                reason = got
            else:
                found, end = [(got[0], got[1], None)], got[2]
        if reason and not found:
            if gap is None:
                gap, why = at, reason
            at = min(s.after(following) for s in starts)
            continue
        if gap is not None:
            yield gap, at, None, None, why
            gap = None
        for head, block, lost in found:
            yield at, end, head, block, lost
        at = end
    if gap is not None:
        yield gap, len(data), None, None, why


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps (gap_reason not null) of the archives that path names, schema ``RECORD``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("file", pa.string()), ("begin", pa.int64()), ("stop", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to_id", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("gap_reason", pa.string())])
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                out: list[tuple] = []
                for begin, end, head, block, reason in salvage(content.as_py()):
                    if head is None:
                        out.append((name.as_py(), begin, end, *[None] * 7, reason))
                    else:
                        out.append((name.as_py(), begin, end, *described(head, block), None))
                    if len(out) == 512:
                        yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, r, strict=True)) for r in out], schema=kinds)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, r, strict=True)) for r in out], schema=kinds)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, RECORD)


def described(head: dict, block: bytes) -> tuple:
    """Type, ids, digest, size and payload: measured for a response, as its headers say for a revisit."""
    kind, payload = head.get("warc-type"), block
    http_head, digest, size = b"", head.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
    if head.get("content-type", "").startswith("application/http"):
        http_head, _, payload = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        size = re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", http_head)
        return kind, head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-refers-to"), digest, int(size[1]) if size else None, None
    return kind, head.get("warc-record-id"), head.get("warc-target-uri"), None, sha1_base32(payload), len(payload), payload


def archived_pages(spark: SparkSession, pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    folder = new_folder(spark, "warc")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(f"{root}/part-none", recursive=True)
    write(plan_revisits(pages, min_revisit=min_revisit), folder)
    return read(spark, f"{folder}/part-*")


def page_of(rid):
    return F.regexp_extract(rid, r"^<urn:x-page:(-?[0-9]*):", 1).try_cast("long")
