"""WARC archives: legacy ARC archives converted to them, and both written and read back.

An ARC archive begins with a version block: a filedesc record whose body states the version and the names of
the fields of a header line (version 1: URL, IP, date, type, length; version 2 adds result code, checksum,
location, offset and file name). Each record is a header line of that version, the declared number of bytes,
and a newline. The converter reads the version from the block, parses records by it, and makes WARC records
that say the same: an identifier derived from archive and place, the timestamp in ISO form, the type from the
URL's scheme, and SHA-1 digests. It reads archives twice: first for digests alone, which are grouped to find
equal payloads, then to write; payloads are never shuffled. Of records with equal payloads the one with the
smallest key stays whole, the others become revisits that name it.

Archives are gzip files of one member per record, in the folder that driver and executors share. A task names
its files anew on each attempt and lists them in its result, so what a lost attempt left is never read.

Edge cases: null html is an empty payload, a null URL the URL "-"; equal payloads of a third of all rows meet
only as digests; a row without an id comes after those with one, and repeated ids are records of their own:
on ties the first by archive and place stays whole; an empty table writes and reads nothing; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_rows, shared_dir

ROLL_BYTES = 48 << 20  # of one archive, about
ARC_LEVEL, LEVEL = 1, 4
# The fields of a header line by version, as version blocks name them.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
SCHEMES = {"dns": "resource", "http": "response", "https": "response", "filedesc": "warcinfo", "warcinfo": "warcinfo", "metadata": "metadata"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str  # 14 digits
    type: str
    payload: bytes


class Inflated:
    """Bytes of a stream, gzip members one after the other or plain, by lines and by lengths."""

    def __init__(self, stream, at_once: int = 1 << 16):
        self.stream, self.at_once = stream, at_once
        self.raw, self.out, self.at = stream.read(at_once), b"", 0
        self.packed = self.raw[:2] == b"\x1f\x8b"
        self.member = None

    def _more(self) -> bool:
        self.raw = self.raw or self.stream.read(self.at_once)
        if not self.raw:
            if self.member is not None:
                raise ValueError("an archive ends within a record")
            return False
        if self.packed:
            self.member = self.member or zlib.decompressobj(wbits=31)
            own = self.member.decompress(self.raw)
            self.raw = self.member.unused_data
            if self.member.eof:
                self.member = None
        else:
            own, self.raw = self.raw, b""
        self.out, self.at = self.out[self.at :] + own, 0
        return True

    def line(self) -> bytes | None:
        """Up to the next newline, without it; None at the end."""
        while (end := self.out.find(b"\n", self.at)) < 0:
            if not self._more():
                if self.at < len(self.out):
                    raise ValueError("a header line does not end")
                return None
        own = self.out[self.at : end]
        self.at = end + 1
        return own

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while True:
            own = self.out[self.at : self.at + left]
            parts.append(own)
            self.at += len(own)
            left -= len(own)
            if not left:
                return parts[0] if len(parts) == 1 else b"".join(parts)
            if not self._more():
                raise ValueError("a record is shorter than its length says")


def arc_bytes(record: ArcRecord, version: int = 1) -> bytes:
    """A legacy record; blanks of the URL are escaped, since blanks part fields."""
    url = quote(record.url, safe=":/?#[]@!$&'()*+,;=%~-._") or "-"
    values = {"URL": url, "IP-address": record.ip, "Archive-date": record.date, "Content-type": record.type or "-", "Archive-length": str(len(record.payload))}
    line = " ".join(values.get(f, "-") for f in FIELDS[version])
    return line.encode() + b"\n" + record.payload + b"\n"


def version_block(name: str, date: str, version: int) -> bytes:
    """The first record of an archive of that name."""
    body = f"{version} 0 rollcall\n{' '.join(FIELDS[version])}\n".encode()
    return arc_bytes(ArcRecord(f"filedesc://{name}", "0.0.0.0", date, "text/plain", body), version)


def _parsed(line: str, names: tuple[str, ...]) -> dict[str, str]:
    parts = line.split(" ")
    if len(parts) < len(names):
        raise ValueError(f"a header line of {len(parts)} fields instead of {len(names)}")
    # Old URLs may hold blanks: fields are counted from the right.
    return dict(zip(names[1:], parts[-len(names) + 1 :], strict=True), URL=" ".join(parts[: -len(names) + 1]))


def arc_version(body: bytes) -> int:
    """The version that an archive's first record declares in its body's first line."""
    version = int(body.split(b"\n", 1)[0].split(b" ")[0])
    if version not in FIELDS:
        raise ValueError(f"unknown version {version}")
    return version


def read_arc(stream) -> Iterator[ArcRecord]:
    """The records of an archive, its version block first."""
    source, names = Inflated(stream), None
    while (line := source.line()) is not None:
        text = line.decode("utf-8").rstrip("\r")
        if not text:  # archives part records by a newline
            continue
        size = int(text.rpartition(" ")[2])  # the last field in every version
        if size < 0:
            raise ValueError("a length below 0")
        payload = source.take(size)
        if names is None:
            names = FIELDS[arc_version(payload)]
        own = _parsed(text, names)
        yield ArcRecord(own["URL"], own["IP-address"], own["Archive-date"], own["Content-type"], payload)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def iso(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert(record: ArcRecord, key: str, refers_to: tuple[str, str] | None = None, page: str = "") -> bytes:
    """The WARC record of a legacy one; key makes its identifier, refers_to has that of the record it revisits, and its page."""
    own = digest(record.payload)
    kind = "revisit" if refers_to is not None else SCHEMES.get(record.url.partition(":")[0].lower(), "resource")
    payload = b"" if kind == "revisit" else record.payload
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(key)),
        ("WARC-Date", iso(record.date)),
        ("WARC-Target-URI", record.url),
        ("WARC-IP-Address", record.ip),
        ("WARC-Payload-Digest", f"sha1:{own}"),
        ("WARC-Block-Digest", f"sha1:{digest(payload) if kind == 'revisit' else own}"),
        ("Content-Type", record.type),
        ("X-Payload-Length", str(len(record.payload))),
        ("X-Page", page),
        ("Content-Length", str(len(payload))),
    ]
    if refers_to is not None:
        head[5:5] = [("WARC-Refers-To", record_id(refers_to[0])), ("X-Refers-To-Page", refers_to[1]), ("WARC-Profile", PROFILE)]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + payload + b"\r\n\r\n"


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    source = Inflated(stream)
    while (line := source.line()) is not None:
        line = line.rstrip(b"\r")
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while line := (source.line() or b"").rstrip(b"\r"):
            name, _, value = line.decode("utf-8").partition(": ")
            headers[name] = value
        yield headers, source.take(int(headers["Content-Length"]))


class Roll:
    """Archives of a task, one after the other, a gzip member per record."""

    def __init__(self, folder: str, suffix: str, level: int):
        self.folder, self.suffix, self.level = folder, suffix, level
        self.where, self.root = fs.FileSystem.from_uri(folder)
        self.where.create_dir(self.root, recursive=True)
        self.out, self.made = None, -1

    def begin(self) -> str:
        """Opens the next archive; its name, the same on each attempt."""
        self.made, self.size = self.made + 1, 0
        self.file = f"{uuid.uuid4().hex}{self.suffix}"
        self.out = self.where.open_output_stream(f"{self.root}/{self.file}", compression=None)
        return f"{TaskContext.get().partitionId():06d}-{self.made:06d}"

    def add(self, record: bytes) -> None:
        member = gzip.compress(record, self.level, mtime=0)
        self.out.write(member)
        self.size += len(member)

    def end(self) -> str:
        self.out.close()
        self.out = None
        return f"{self.folder}/{self.file}"


def legacy(pages: DataFrame, versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(path, keys) of ARC archives that hold pages (page_id, url, html): keys are the records' page ids in order. The
    archives of a task take turns among the versions."""
    folder = shared_dir(pages.sparkSession, "arc")
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))

    def run(rows):
        roll, keys, version = Roll(folder, ".arc.gz", ARC_LEVEL), [], 0
        for page_id, url, payload in rows:
            if roll.out is None:
                name = roll.begin()
                version = versions[sum(map(int, name.split("-"))) % len(versions)]
                roll.add(version_block(f"{name}.arc", "20240101000000", version))
            roll.add(arc_bytes(ArcRecord(url, "0.0.0.0", "20240101000000", "text/html", payload), version))
            keys.append(page_id)
            if roll.size >= ROLL_BYTES:
                yield roll.end(), keys
                keys = []
        if roll.out is not None:
            yield roll.end(), keys

    return kept(map_rows(rows, run, "path string, keys array<long>"), "arc-list")


def _records(path: str, keys: list) -> Iterator[tuple[int, int | None, str, ArcRecord]]:
    """(place, page id, name of the archive, record) of an archive; place 0 is its version block."""
    where, name = fs.FileSystem.from_uri(path)
    with where.open_input_stream(name, compression=None) as stream:
        title, n = "", 0
        for n, record in enumerate(read_arc(stream)):
            title = record.url if n == 0 else title
            yield n, keys[n - 1] if n else None, title, record
        if n != len(keys):
            raise ValueError(f"{path}: {n} records, {len(keys)} were written")


def converted(archives: DataFrame) -> DataFrame:
    """(path, records) of the WARC archives that say what ARC archives (path, keys) say, one for one."""
    spark = archives.sparkSession
    spread = archives.repartition(max(1, min(archives.count(), 100_000)))

    def digests(rows):
        for path, keys in rows:
            for n, key, title, record in _records(path, keys):
                if n:
                    yield path, n, key, title, digest(record.payload)

    own = kept(map_rows(spread, digests, "path string, place long, page_id long, title string, digest string"), "arc-digests")
    order = F.struct(F.col("page_id").isNull(), "page_id", "title", "place")
    first = own.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first.*")
    first = first.withColumnsRenamed({"page_id": "to_page", "title": "to_title", "place": "to_place"})
    again = own.join(first, "digest").filter("title != to_title or place != to_place")
    revisits = again.groupBy("path").agg(F.collect_list(F.struct("place", "to_title", "to_place", "to_page")).alias("revisits"))  # of one archive
    folder = shared_dir(spark, "warc")

    def run(rows):
        for path, keys, revisits in rows:
            known = {r["place"]: (f"{r['to_title']}#{r['to_place']}", "" if r["to_page"] is None else str(r["to_page"])) for r in revisits or []}
            roll = Roll(folder, ".warc.gz", LEVEL)
            roll.begin()
            for n, key, title, record in _records(path, keys):
                roll.add(convert(record, f"{title}#{n}", known.get(n), "" if key is None else str(key)))
            yield roll.end(), n + 1

    rows = archives.join(revisits, "path", "left").select("path", "keys", "revisits").repartition(max(1, min(archives.count(), 100_000)))
    return kept(map_rows(rows, run, "path string, records long"), "warc-list")


def written(pages: DataFrame, versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(path, records) of the WARC archives that hold a record for each row of pages (page_id, url, html), converted
    from ARC archives of them."""
    return converted(legacy(pages, versions))


def read_back(archives: DataFrame) -> DataFrame:
    """A row for each page's record of the archives, from their bytes; refers_to is the page of the revisited record."""

    def run(rows):
        for path, records in rows:
            where, name = fs.FileSystem.from_uri(path)
            seen = 0
            with where.open_input_stream(name, compression=None) as stream:
                for h, block in read_warc(stream):
                    seen += 1
                    if h["WARC-Type"] == "warcinfo" and h["WARC-Target-URI"].startswith("filedesc:") and seen == 1:
                        continue
                    own, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                    if h["WARC-Type"] != "revisit" and (digest(block) != own or len(block) != size):
                        raise ValueError(f"{h['WARC-Record-ID']}: payload and digest differ")
                    page, refers = h.get("X-Page"), h.get("X-Refers-To-Page")
                    yield int(page) if page else None, size, own, h["WARC-Type"], int(refers) if refers else None, h["WARC-Record-ID"], h["WARC-Date"], h.get("WARC-Refers-To")
            if seen != records:
                raise ValueError(f"{path}: {seen} records, {records} were written")

    spread = archives.repartition(max(1, min(archives.count(), 100_000)))
    return map_rows(spread, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string, refers_to_record string")
