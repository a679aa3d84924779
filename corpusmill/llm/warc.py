"""WARC archives of captures, and their index by external merge.

Captures are written as WARC/1.1 records by Spark's text writer (a record ends in two
line breaks, which is the writer's line separator), gzip-compressed, in the shared
folder, and read back by a reader that decompresses them piece by piece; a task holds
one compressed archive, whose size is bounded on average, and one record. Of captures
with equal payloads that are long enough, the least id is a response and the others
are revisits without a payload. A url with control characters or blanks is written
form-encoded, under a header that says so, and is read back as it was.

The index: each archive is a run of captures sorted by (url key, timestamp, id). Runs
are dealt to ranges of that key of bounded size. Within a range the entries of a run
are brought together in the order in which its archive holds them (by offset: they are not sorted
anew, and the merge checks that order), and a tree of losers merges the runs into one
globally ordered history; a url with a third of all captures is spread over ranges by
timestamp and id.

Defined results: a null html is an empty payload; a null url has an empty key; rows of
equal id are written each, with equal payloads as responses each; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import new_path

#: Payloads of fewer bytes are always written whole.
LEAST_REVISIT = 100
#: Captures and bytes of text in an archive, about; bound what reading one back holds.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 20_000, 32 << 20
#: Captures in one range of the merged index, about.
RANGE_CAPTURES = 100_000
_BREAK = "\r\n"
#: Header of records whose url is form-encoded, and bytes decompressed at a time.
_ENCODED, _PIECE = "X-Target-URI-Encoding", 1 << 18


def url_key(url: Column) -> Column:
    """Sortable key: host labels reversed, then path and query (``com,example,www)/a?b``)."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^[^/?#]*://|#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, captured (a timestamp that follows the id), payload, its bytes and
    digest, and capture (id and digest)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.timestamp_seconds(F.lit(1_600_000_000) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(300_000_000))).alias("captured"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
    )
    return rows.withColumn("capture", F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), "payload_digest"))


def revisits(rows: DataFrame) -> DataFrame:
    """(capture, refers_to) of the captures whose payload an earlier id holds, found without the payloads."""
    small = rows.where(f"payload_bytes >= {LEAST_REVISIT}").select("capture", "payload_digest", "page_id")
    owners = small.groupBy("payload_digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("copies")).where("copies > 1")
    found = small.join(owners, "payload_digest").where("page_id is null or owner <> page_id")
    return found.select("capture", F.col("owner").alias("refers_to")).distinct()


def record(rows: DataFrame) -> Column:
    """A WARC record without its closing line breaks."""
    odd = F.col("url").rlike(r"[\x00-\x20\x7f\x{85}\x{2028}\x{2029}]")
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, *value: F.concat(F.lit(f"{name}: "), *value, F.lit(_BREAK))
    identity = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit(f"WARC/1.1{_BREAK}"),
        F.when(revisit, line("WARC-Type", F.lit("revisit"))).otherwise(line("WARC-Type", F.lit("response"))),
        line("WARC-Record-ID", identity),
        line("WARC-Date", F.date_format(F.to_utc_timestamp("captured", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", F.when(odd, F.url_encode("url")).otherwise(F.col("url"))),
        F.when(odd, line(_ENCODED, F.lit("form"))).otherwise(""),
        line("WARC-Payload-Digest", F.lit("sha256:"), "payload_digest"),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Refers-To", F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(_BREAK),
        F.when(revisit, "").otherwise(F.col("payload")),
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Gzipped WARC files, each sorted by (url key, timestamp, id) and of bounded size."""
    rows = captures(pages)
    n, size = pages.agg(F.count("*"), F.sum(F.octet_length("html"))).first()
    archives = max(1, -(-(size or 0) // ARCHIVE_BYTES), -(-n // ARCHIVE_RECORDS))
    # One shuffle takes the payloads both to the join and to their archive; with fewer
    # partitions than the session's, the join would deal them anew.
    archives = max(archives, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = rows.repartition(archives, "capture").join(revisits(rows).repartition(archives, "capture"), "capture", "left")
    sorted_runs = known.sortWithinPartitions(url_key(F.col("url")), "captured", "page_id")
    (
        sorted_runs.select(record(rows).alias("value"))
        .write.option("lineSep", _BREAK + _BREAK)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", ARCHIVE_RECORDS)
        .text(path)
    )


class _Stream:
    """The decompressed bytes of an archive, of which no more is held than asked for."""

    def __init__(self, data: bytes):
        self.packed, self.unpack = data, zlib.decompressobj(47)
        self.held, self.at, self.begin = bytearray(), 0, 0

    def more(self) -> bool:
        """Decompresses another piece; false at the end."""
        if self.unpack.eof:
            if not (rest := self.unpack.unused_data):
                return False
            self.packed, self.unpack = rest, zlib.decompressobj(47)
        piece = self.unpack.decompress(self.packed, _PIECE)
        self.packed = self.unpack.unconsumed_tail
        if not piece and not self.packed and not self.unpack.eof:
            return False
        if self.begin > _PIECE:
            del self.held[: self.begin]
            self.begin = 0
        self.held += piece
        return True

    def upto(self, mark: bytes) -> bytes | None:
        """Takes what stands before ``mark``, and the mark; null at the end."""
        seen = self.begin
        while (found := self.held.find(mark, seen)) < 0:
            left = max(0, len(self.held) - len(mark) + 1 - self.begin)
            if not self.more():
                return None
            seen = self.begin + left
        return self.take(found + len(mark) - self.begin)[: -len(mark)]

    def take(self, n: int) -> bytes:
        while len(self.held) - self.begin < n and self.more():
            pass
        out = bytes(self.held[self.begin : self.begin + n])
        self.begin, self.at = self.begin + len(out), self.at + len(out)
        return out


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of a gzipped archive."""
    stream = _Stream(data)
    while True:
        at = stream.at
        head = stream.upto(b"\r\n\r\n")
        if head is None:
            if stream.take(1):
                raise ValueError(f"no record at byte {at}")
            return
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        block = stream.take(int(headers["Content-Length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end as one")
        if headers.pop(_ENCODED, None):
            headers["WARC-Target-URI"] = unquote_plus(headers["WARC-Target-URI"])
        yield at, headers, block


CAPTURES = (
    "page_id long, url string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "archive string, offset long, whole boolean"
)


def _identity(value: str) -> int | None:
    inner = value.removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in CAPTURES.split(", ")]
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            rows = []
            for offset, h, block in records(content):
                digest, size = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["WARC-Payload-Length"])
                revisit = h["WARC-Type"] == "revisit"
                whole = revisit or (len(block) == size and hashlib.sha256(block).hexdigest() == digest)
                refers = _identity(h["WARC-Refers-To"]) if revisit else None
                rows.append(
                    (_identity(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Date"], size, digest, h["WARC-Type"], refers, path.rsplit("/", 1)[-1], offset, whole)
                )
                if len(rows) == 5000:
                    yield _frame(rows, names)
                    rows = []
            if rows:
                yield _frame(rows, names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The index entries of all records: each archive is a sorted run. ``whole`` tells
    whether length and digest of the payload read match the headers."""
    files = spark.read.format("binaryFile").load(path)
    return files.where("length > 0").select("path", "content").mapInPandas(_read, CAPTURES)


class Losers:
    """Merges sorted runs of (key, value): each inner node keeps the loser of its match, so that the next
    least entry takes one match per level. A run that is out of order is an error."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.tree = [-1] * self.k
        for run in range(len(runs)):
            self._play(run)

    def _less(self, a: int, b: int) -> bool:
        over_a, over_b = self.at[a] >= len(self.runs[a]), self.at[b] >= len(self.runs[b])
        if over_a or over_b:
            return not over_a or (over_b and a < b)
        x, y = self.runs[a][self.at[a]][0], self.runs[b][self.at[b]][0]
        return x < y or (x == y and a < b)

    def _play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node:
            if self.tree[node] < 0:  # the first to come waits for its opponent
                self.tree[node] = run
                return
            if self._less(self.tree[node], run):
                self.tree[node], run = run, self.tree[node]
            node //= 2
        self.tree[0] = run

    def __iter__(self) -> Iterator:
        while self.runs:
            run = self.tree[0]
            if self.at[run] >= len(self.runs[run]):
                return
            entry = self.runs[run][self.at[run]]
            yield entry
            self.at[run] += 1
            if self.at[run] < len(self.runs[run]) and self.runs[run][self.at[run]][0] < entry[0]:
                raise ValueError("a run is not sorted")
            self._play(run)


def _merge(columns: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: dict[str, list] = {}
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                known = not pd.isna(row[2])
                runs.setdefault(row[3], []).append(((row[0], row[1], known, int(row[2]) if known else 0), row))
        rows = []
        for _, row in Losers([runs[a] for a in sorted(runs)]):
            rows.append(row)
            if len(rows) == 10_000:
                yield _frame(rows, columns)
                rows = []
        if rows:
            yield _frame(rows, columns)

    return run


def merge_index(entries: DataFrame, n_captures: int) -> DataFrame:
    """The entries in global order of (url key, timestamp, id), with their url_key.
    Ranges hold ``RANGE_CAPTURES`` entries, about, which bounds what a merge holds."""
    first = ["url_key", "captured", "page_id", "archive"]
    keyed = entries.withColumn("url_key", url_key(F.col("url")))
    keyed = keyed.select(*first, *[c for c in entries.columns if c not in first])
    ranges = max(1, -(-n_captures // RANGE_CAPTURES))
    dealt = keyed.repartitionByRange(ranges, "url_key", "captured", "page_id", "archive", "offset")
    parts = dealt.sortWithinPartitions("archive", "offset")
    return parts.mapInPandas(_merge(keyed.columns), keyed.schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives, reads them back and merges their index."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return merge_index(read_archives(spark, path), pages.count())


WARC_SQL = """
with captures as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), owned as (
  select *, min(page_id) over (partition by payload_digest) as owner from captures
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and owner <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and owner <> page_id then owner end as refers_to
from owned
"""
