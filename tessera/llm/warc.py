"""WARC archives and their capture index, merged externally.

Every task writes its records to archives (a gzip member each) and its captures to locally sorted run files with a sparse
index. Runs are merged k ways by a loser tree on URL key, time and page, in passes of bounded fan-in; the last pass works
on ranges of keys, so that many tasks share it and a URL with very many captures is split too. All files lie in the shared
folder; each attempt of a task writes files of its own, and only those that its committed rows name are read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch, through, utf8

EPOCH = 1_704_067_200  # 2024-01-01; a page's capture time is so many seconds plus its id


@dataclass(frozen=True)
class Settings:
    least: int = 1000  # bytes of a payload that may be revisited
    archive: int = 64 << 20  # bytes after which an archive is closed
    run: int = 200_000  # captures of a run
    every: int = 256  # captures between two entries of a run's sparse index
    fan_in: int = 128
    captures: int = 250_000  # of one range of the last merge


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host parts reversed, no scheme, no fragment, lower case; control characters escaped."""
    parts = urlsplit("".join(c if c > " " else f"%{ord(c):02x}" for c in url or ""), allow_fragments=True) if "[" not in (url or "") else None
    if parts is None:
        return "".join(c if c > " " else f"%{ord(c):02x}" for c in url or "").lower()
    host = parts.netloc.lower().removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))}){parts.path.lower() or '/'}" + (f"?{parts.query.lower()}" if parts.query else "")


def sort_key(url: str | None, when: int, page: int) -> str:
    """URL key, time and page as one string whose order is theirs."""
    return f"{url_key(url)}\t{when:012d}\t{page + (1 << 63):020d}"


def stamp(when: int) -> str:
    import datetime

    return datetime.datetime.fromtimestamp(when, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page: int | None, url: str | None, payload: bytes, refers: int | None) -> tuple[bytes, str]:
    """A gzip member with a response or revisit record, and the payload's digest."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {stamp(EPOCH + (page or 0) % (1 << 31))}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02x}" for c in url))
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush(), digest


def parse(raw: bytes) -> dict[str, object]:
    """Headers, payload length, digest and payload of a record; a revisit's come from its headers, a response's from its bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = h["WARC-Type"] == "revisit"
    page = h["WARC-Record-ID"][len("<urn:page:") : -1]
    return {
        "page_id": int(page) if page else None,
        "payload_bytes": int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:]) if revisit else len(payload),
        "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest(),
        "record_type": h["WARC-Type"],
        "refers_to": int(h["WARC-Refers-To"][len("<urn:page:") : -1]) if revisit else None,
        "url": h.get("WARC-Target-URI"),
        "payload": payload,
    }


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Archives:
    """Archives and runs of one attempt of a task."""

    def __init__(self, folder: str, s: Settings) -> None:
        self.s, self.folder, self.name, self.n = s, folder, uuid.uuid4().hex, 0
        self.fs, self.root = opened(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.out, self.captures, self.files, self.runs = None, [], [], []

    def add(self, page: int | None, url: str | None, payload: bytes, refers: int | None) -> None:
        if self.out is None:
            self.file = f"{self.name}-{self.n}.warc.gz"
            self.n += 1
            self.out, self.at = self.fs.open_output_stream(f"{self.root}/{self.file}"), 0
            self.files.append(self.file)
        member, digest = record(page, url, payload, refers)
        self.out.write(member)
        self.captures.append(f"{sort_key(url, (page or 0) % (1 << 31), page or 0)}\t{'revisit' if refers is not None else 'response'}\t{digest}\t{self.file}\t{self.at}\t{len(member)}")
        self.at += len(member)
        if self.at >= self.s.archive:
            self.out.close()
            self.out = None
        if len(self.captures) >= self.s.run:
            self.flush()

    def flush(self) -> None:
        if self.captures:
            self.captures.sort()
            path = f"{self.name}-{len(self.runs)}.run"
            self.runs.append((path, *write_run(self.fs, f"{self.root}/{path}", self.captures, self.s)))
            self.captures = []

    def close(self) -> None:
        self.flush()
        if self.out is not None:
            self.out.close()


def write_run(fs: pafs.FileSystem, path: str, lines, s: Settings) -> tuple[int, list[str]]:
    """Write sorted captures and, behind them, the sparse index with the place where it begins; gives their number and the index's keys."""
    index, n, at = [], 0, 0
    with fs.open_output_stream(path) as out:
        for line in lines:
            if n % s.every == 0:
                index.append((key_of(line), at))
            raw = line.encode() + b"\n"
            out.write(raw)
            at += len(raw)
            n += 1
        tail = json.dumps(index).encode()
        out.write(tail + at.to_bytes(8, "little"))
    return n, [k for k, _ in index]


def key_of(line: str) -> str:
    return "\t".join(line.split("\t", 3)[:3])


def read_run(uri: str, low: str | None, high: str | None) -> Iterator[tuple[str, str]]:
    """(key, capture) of a run with low <= key < high, in order; the sparse index gives where to begin."""
    fs, path = opened(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 8)
        end = int.from_bytes(f.read(8), "little")
        f.seek(end)
        index = json.loads(f.read(size - 8 - end))
        at = index[max(0, bisect.bisect_left([k for k, _ in index], low) - 1)][1] if low is not None and index else 0
        f.seek(at)
        rest = b""
        while at < end or rest:
            piece = f.read(min(1 << 18, end - at))
            at += len(piece)
            lines = (rest + piece).split(b"\n")
            rest = lines.pop()
            for raw in lines:
                line = raw.decode()
                key = key_of(line)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield key, line


class LoserTree:
    """k-way merge: inner nodes hold the losers of the matches below, so that each step replays one path to the root."""

    def __init__(self, runs: list[Iterator[tuple[str, str]]]) -> None:
        self.runs, self.k = runs, len(runs)
        self.head = [next(r, None) for r in runs]
        self.tree = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self.play(leaf)

    def less(self, a: int, b: int) -> bool:
        """Whether run a's head comes first; ended runs come last, ties go to the earlier run."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:
                self.tree[node] = winner
                return
            if self.less(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple[str, str]]:
        while self.k and (best := self.head[self.tree[0]]) is not None:
            yield best
            leaf = self.tree[0]
            self.head[leaf] = next(self.runs[leaf], None)
            winner, node = leaf, (leaf + self.k) // 2
            while node > 0:
                if self.less(self.tree[node], winner):
                    self.tree[node], winner = winner, self.tree[node]
                node //= 2
            self.tree[0] = winner


@dataclass(frozen=True)
class Written:
    """What ``write`` leaves: the folder, and tables of archives (file) and of runs (run, n, fences)."""

    folder: str
    archives: DataFrame
    runs: DataFrame


def payload_hash(payload: str, s: Settings) -> Column:
    """SHA-256 of a payload that may be revisited, null for a smaller one."""
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    return F.when(F.octet_length(raw) >= s.least, F.sha2(raw, 256))


def revisits(pages: DataFrame, s: Settings, page: str, payload: str) -> DataFrame:
    """(page, sha, refers): pages whose payload equals that of a page with a larger id, which is the response for all of them.

    A page is told apart by its id and its payload, so rows that share an id but not a payload are judged apart, and rows
    equal in both alike. Sizes grow with the input, so nothing is broadcast; the rows of a hot payload hold ids and hashes only.
    """
    d = pages.select(F.col(page).alias("page"), payload_hash(payload, s).alias("sha")).where("page is not null and sha is not null")
    last = cut(d.groupBy("sha").agg(F.max("page").alias("refers"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return d.join(last.hint("merge"), "sha").where("page <> refers").distinct()


def write(pages: DataFrame, s: Settings = Settings(), page: str = "page_id", url: str = "url", payload: str = "html") -> Written:
    """Archives and capture runs of ``pages``, one record for each row.

    Rows without an id are responses that nothing refers to; a null payload is empty. Of rows with equal payloads those with
    the largest id are responses (several if that row is repeated), all others revisit it, repeated ones each by itself.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    seen = cut(revisits(pages, s, page, payload)).withColumnsRenamed({"sha": "same"})
    rows = pages.select(F.col(page).alias("p"), F.col(url).alias("u"), F.col(payload).alias("t"), payload_hash(payload, s).alias("sha"))
    rows = rows.join(seen.hint("merge"), (F.col("p") == F.col("page")) & (F.col("sha") == F.col("same")), "left").select("p", "u", "t", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Archives(folder, s)
        for batch in batches:
            data, at = utf8(batch.column("t"))
            for k, (p, u, r) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("p", "u", "refers")), strict=True)):
                made.add(p, u, data[at[k] : at[k + 1]].tobytes(), r)
        made.close()
        kinds, names = ["file"] * len(made.files) + ["run"] * len(made.runs), made.files + [r[0] for r in made.runs]
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(names, pa.string()), pa.array([0] * len(made.files) + [r[1] for r in made.runs], pa.int64()), pa.array([[]] * len(made.files) + [r[2] for r in made.runs], pa.list_(pa.string()))], ["kind", "name", "n", "fences"])

    done = cut(through(rows, run, "kind string, name string, n long, fences array<string>"))
    return Written(folder, done.where("kind = 'file'").select(F.col("name").alias("file")), done.where("kind = 'run'").select(F.col("name").alias("run"), "n", "fences"))


def merged(written: Written, s: Settings = Settings()) -> DataFrame:
    """The global index, a row for each record, repeated rows included: range, place, urlkey, captured (s), page_id, record_type, payload_digest, file, offset and size, ordered by
    urlkey, captured and page_id over (range, place)."""
    folder, runs = written.folder, written.runs
    spark = runs.sparkSession

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        for batch in batches:
            for names in batch.column("names").to_pylist():
                path = f"{uuid.uuid4().hex}.run"
                n, fences = write_run(fs, f"{root}/{path}", (line for _, line in LoserTree([read_run(f"{folder}/{r}", None, None) for r in names])), s)
                yield pa.RecordBatch.from_pydict({"run": [path], "n": [n], "fences": [fences]})

    while (count := runs.count()) > s.fan_in:
        groups = -(-count // s.fan_in)
        # a run's group is its hash's rank by buckets: groups differ a little in size, none is unbounded
        grouped = runs.groupBy(F.pmod(F.xxhash64("run"), F.lit(groups)).alias("g")).agg(F.collect_list("run").alias("names"))
        runs = cut(grouped.select("names").repartition(groups).mapInArrow(combine, "run string, n long, fences array<string>"))
    names = [r.run for r in runs.select("run").collect()]
    total = runs.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // s.captures), min(spark.sparkContext.defaultParallelism, total // 2000))
    lows = [None]
    if parts > 1:
        fences = runs.select(F.explode("fences").alias("k")).repartitionByRange(parts, "k")
        lows += sorted(r.k for r in fences.groupBy(F.spark_partition_id().alias("i")).agg(F.min("k").alias("k")).collect())[1:]
    ranges = [(k, a, b) for k, (a, b) in enumerate(zip(lows, [*lows[1:], None], strict=True))]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, low, high in zip(*(batch.column(c).to_pylist() for c in ("k", "low", "high")), strict=True):
                held, place = [], 0
                for _, line in LoserTree([read_run(f"{folder}/{r}", low, high) for r in names]):
                    held.append(line.split("\t"))
                    if len(held) == 20_000:
                        yield table_of(k, place, held)
                        place, held = place + len(held), []
                if held:
                    yield table_of(k, place, held)

    frame = spark.createDataFrame(ranges, "k int, low string, high string").repartition(len(ranges))
    return frame.mapInArrow(merge, "range int, place long, urlkey string, captured long, page_id long, record_type string, payload_digest string, file string, offset long, size long")


def table_of(k: int, place: int, lines: list[list[str]]) -> pa.RecordBatch:
    url, when, page, kind, digest, file, at, size = zip(*lines, strict=True)
    n = len(lines)
    return pa.RecordBatch.from_arrays(
        [pa.array([k] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()), pa.array(url), pa.array([int(x) for x in when], pa.int64()), pa.array([int(x) - (1 << 63) for x in page], pa.int64()), pa.array(kind), pa.array(digest), pa.array(file), pa.array([int(x) for x in at], pa.int64()), pa.array([int(x) for x in size], pa.int64())],
        ["range", "place", "urlkey", "captured", "page_id", "record_type", "payload_digest", "file", "offset", "size"],
    )


def read(written: Written, payloads: bool = False) -> DataFrame:
    """Every record of the archives, repeated rows included, read from front to back: file, offset, page_id, payload_bytes, payload_digest, record_type,
    refers_to and url; with ``payloads`` also payload (null for revisits)."""
    folder = written.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows: list[dict] = []
                for at, raw in members(f"{folder}/{name}"):
                    rows.append(parse(raw) | {"file": name, "offset": at})
                    if len(rows) == 500:
                        yield batch_of(rows, payloads)
                        rows = []
                if rows:
                    yield batch_of(rows, payloads)

    n = max(1, min(written.archives.count(), 10_000))
    return written.archives.repartition(n).mapInArrow(run, "file string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads)


def batch_of(rows: list[dict], payloads: bool) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "offset": pa.int64(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()}
    cols = [pa.array([r[c] for r in rows], t) for c, t in kinds.items()]
    if payloads:
        cols.append(pa.array([r["payload"] if r["record_type"] == "response" else None for r in rows], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, [*kinds, *(["payload"] if payloads else [])])


def members(uri: str) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a file, one at a time."""
    fs, path = opened(uri)
    with fs.open_input_stream(path) as f:
        z, begun, taken, out, piece = zlib.decompressobj(31), 0, 0, [], b""
        while piece or (piece := f.read(1 << 20)):
            out.append(z.decompress(piece))
            if z.eof:
                taken += len(piece) - len(z.unused_data)
                yield begun, b"".join(out)
                begun, piece = taken, z.unused_data
                z, out = zlib.decompressobj(31), []
            else:
                taken += len(piece)
                piece = b""
        if out and any(out):
            raise ValueError(f"{uri} ends within a record")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every page archived, indexed and read back."""
    from .common import table

    s = Settings()
    written = write(table(spark, sf_dir, "pages"), s)
    index = merged(written, s).select("file", "offset")
    # both sides grow with the pages, though the tables they start from are small: never broadcast
    return read(written).join(index.hint("merge"), ["file", "offset"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS d FROM pages),
k AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
CASE WHEN p.n >= 1000 AND k.last <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN p.n >= 1000 AND k.last <> p.page_id THEN k.last END AS refers_to
FROM p LEFT JOIN k USING (d)
"""
