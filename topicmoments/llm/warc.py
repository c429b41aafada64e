"""WARC archives: write pages, read them back, and merge their capture indexes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicmoments.llm.common import join_salted, written
from topicmoments.runtime import shuffle_partitions

#: Payloads from this many bytes on are written once.
DEDUP_BYTES = 100
#: Bytes that one archive should hold, and captures that one task should merge.
ARCHIVE_BYTES = 48 << 20
MERGE_ROWS = 200_000
# fixed values of the format
VERSION, END, PROFILE = "WARC/1.1", "\r\n\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
INDEX = """url_key string, captured string, page_id long, url string, record_type string, refers_to long,
           payload_bytes long, payload_digest string, archive string, offset long, length long"""


def _header_value(text: Column) -> Column:
    """A URL that cannot break a header line: blanks and control characters are percent-encoded."""
    for char, code in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", "%1A")


def with_roles(pages: DataFrame, dedup_bytes: int = DEDUP_BYTES) -> DataFrame:
    """Pages (page_id, url, captured, payload) with digest, bytes and, for later copies, refers_to.

    Digests are counted before they are shuffled; the page with the smallest id of each group is its
    response. Groups are few or their copies many: the join broadcasts the groups if they fit, and
    deals the rows of a large group among several tasks otherwise.
    """
    digested = pages.select("*", F.sha2(F.col("payload").cast("binary"), 256).alias("payload_digest"),
                            F.octet_length("payload").cast("long").alias("payload_bytes"))
    groups = written(digested.filter(F.col("payload_bytes") >= dedup_bytes)
                     .groupBy("payload_digest").agg(F.min("page_id").alias("leader"), F.count("*").alias("n"))
                     .filter("n > 1 and leader is not null"), "payload-groups")
    joined = join_salted(digested, groups, ["payload_digest"], "n", F.coalesce("page_id", F.lit(0)), 250)
    copy = F.col("leader").isNotNull() & ~F.col("leader").eqNullSafe(F.col("page_id")) & (F.col("payload_bytes") >= dedup_bytes)
    return joined.withColumn("refers_to", F.when(copy, F.col("leader"))).drop("leader")


def record_text() -> Column:
    """One WARC record without its closing blank lines, from the columns of `with_roles`."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(HTTP), F.col("payload_bytes").cast("string"), F.lit(END))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    return F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.col("captured")), line("WARC-Target-URI", _header_value(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")),
        F.lit("\r\n"), http, body)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   captured: Column | None = None, dedup_bytes: int = DEDUP_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record for each page to new .warc files in the folder `path`.

    Each task writes the pages of its split, by Spark's own writer: a record is a row of text and
    the blank lines that close it are the row separator. `captured` is the capture time as text
    (default: seconds since 2020, as many as the id). The payload is the page's text in UTF-8.

    A null page text is an empty payload, a null URL is left out, and a page without an id is never
    the response of a group with ids. Equal payloads below `dedup_bytes` are all responses, and so
    are equal rows with the smallest id. An empty table gives archives without records.
    """
    when = captured if captured is not None else F.date_format(
        F.timestamp_seconds(F.lit(1577836800) + F.coalesce(pages[id_col].cast("long"), F.lit(0)) % F.lit(1 << 31)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    plain = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"),
                         when.alias("captured"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("payload"))
    mean = plain.agg(F.avg(F.octet_length("payload"))).first()[0] or 0
    (with_roles(plain, dedup_bytes).select(record_text().alias("record"))
     .write.option("lineSep", END).option("compression", "none")
     .option("maxRecordsPerFile", max(1, int(archive_bytes / (mean + 600)))).text(path))


def parse_archive(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields, block) of each record; raises ValueError on a damaged archive."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record begins at byte {at}")
        fields = dict(line.split(": ", 1) for line in data[at:stop].decode("utf-8").split("\r\n")[1:])
        begin = stop + 4
        end = begin + int(fields["Content-Length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it should")
        yield at, end + 4 - at, fields, data[begin:end]
        at = end + 4


def url_key(url: str | None) -> str:
    """Host names from the last part to the first, then the path and the query: near pages sort together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def page_of(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def capture(archive: str, offset: int, length: int, fields: dict[str, str], block: bytes) -> tuple:
    """An index entry in the order of INDEX; a response's payload must have the length and digest it names."""
    size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4:]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload at byte {offset} of {archive} is damaged")
    url = fields.get("WARC-Target-URI")
    return (url_key(url), fields.get("WARC-Date", ""), page_of(fields["WARC-Record-ID"]), url, fields["WARC-Type"],
            page_of(fields.get("WARC-Refers-To")), size, digest, archive, offset, length)


def order_of(entry: Sequence) -> tuple:
    """Sorting key of an index entry: URL key, time, page, and where it stands."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[8], entry[9]


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """Read the archives; the captures of each, sorted by URL key and time, are one run.

    The runs are written to the shared folder. Archives are read by Spark as whole files, which
    `write_archives` keeps small.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    names = [f.split()[0] for f in INDEX.split(",")]
    schema = pa.schema([(n, pa.int64() if n in ("page_id", "refers_to", "payload_bytes", "offset", "length") else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                archive = name.as_py().rsplit("/", 1)[-1]
                entries = sorted((capture(archive, *record) for record in parse_archive(content.as_py())), key=order_of)
                for a in range(0, len(entries), 10_000):
                    columns = zip(*entries[a:a + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return written(files.mapInArrow(run, INDEX), "runs")


def merge_runs(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted lists with a tree of losers: each step plays only the winner's path again.

    Node i of the tree holds the run that lost there; the winner of all is kept beside the tree. An
    exhausted run loses against every other.
    """
    k = len(runs)
    at = [0] * k
    heads: list[tuple | None] = [run[0] if run else None for run in runs]

    def beats(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    if not k:
        return
    losers = [-1] * k
    winner = -1
    for leaf in range(k):
        best, node = leaf, (leaf + k) // 2
        while node and losers[node] >= 0:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2
        if node:
            losers[node] = best
        else:
            winner = best
    while heads[winner] is not None:
        yield heads[winner]
        at[winner] += 1
        heads[winner] = runs[winner][at[winner]] if at[winner] < len(runs[winner]) else None
        best, node = winner, (winner + k) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2
        winner = best


def capture_histories(runs: DataFrame, rows_per_task: int = MERGE_ROWS) -> DataFrame:
    """All captures in the order of URL key, time and page: the index columns, `part` and `place`.

    Ranges of the key are dealt to tasks; time and page belong to it, so one URL with very many
    captures is split as well. Each task takes its stretch of every sorted run and merges the
    stretches with a loser tree. `part` and `place` in it number the captures through.
    """
    parts = max(shuffle_partitions(runs.sparkSession), -(-runs.count() // rows_per_task))
    names = runs.columns
    at = [names.index(c) for c in ("url_key", "captured", "page_id", "archive", "offset")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        table = pa.Table.from_batches(whole).combine_chunks()
        columns = [table.column(i).to_pylist() for i in at]
        stretches: dict[str, list[tuple]] = {}
        for row, (key, time, page, archive, offset) in enumerate(zip(*columns)):
            stretches.setdefault(archive, []).append((key, time, page is not None, page or 0, archive, offset, row))
        for stretch in stretches.values():
            stretch.sort()  # pieces of a run may come in any order; each is sorted already
        order = [entry[-1] for entry in merge_runs([stretches[a] for a in sorted(stretches)])]
        merged = table.take(pa.array(order, pa.int64()))
        part = TaskContext.get().partitionId()
        merged = merged.append_column("part", pa.array([part] * len(order), pa.int32()))
        merged = merged.append_column("place", pa.array(range(len(order)), pa.int64()))
        yield from merged.to_batches(max_chunksize=10_000)

    dealt = runs.repartitionByRange(parts, "url_key", "captured", "page_id", "archive", "offset")
    return dealt.mapInArrow(run, INDEX + ", part int, place long")
