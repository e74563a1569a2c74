"""JSON files cut into their records by many tasks.

A large JSON list or object has no lines to split at, so it is read in pieces that end with a closing
brace, and Spark deals the pieces of a file to tasks by byte ranges. Where a range begins, nobody knows
yet whether it is inside a string and how deep. One scan sums each range up: whether it flips the string
state, and, for either state at its beginning, by how much it goes deeper and how many commas it has at
each relative depth. A running total over the ranges of a file, a small table, gives the state, depth and
record number at which each range begins; a second scan cuts the records. What a range has of a record that
began before it or ends behind it is joined by record number.

A file must hold one list or one object and nothing else, whatever its size; anything else, an
empty file among them, stops the job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorate.session import broadcast_if_small, materialise

# Ranges of one read whose starting points are sent to all tasks.
MAX_RANGES = 2_000_000

_BLANK = np.array([b in b" \t\r\n" for b in range(256)])
_OPEN, _CLOSE = np.array([b in b"[{" for b in range(256)]), np.array([b in b"]}" for b in range(256)])
_MARK = b"\xef\xbb\xbf"


def _names(path: Column) -> tuple[Column, Column, Column]:
    name = F.element_at(F.split(path, "/"), -1)
    return path.alias("path"), name.alias("file"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem")


def file_list(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int]]:
    """(path, length) of the files at the given paths, those of a folder by name, as Spark's own listing names them."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out: list[tuple[str, int]] = []

    def walk(status) -> None:
        path = status.getPath()
        if not status.isDirectory():
            # Without a host Spark writes one slash.
            out.append((re.sub(r"^(\w+):///", r"\1:/", path.toUri().toString()), status.getLen()))
            return
        for inner in sorted(path.getFileSystem(conf).listStatus(path), key=lambda s: s.getPath().getName()):
            if not inner.getPath().getName().startswith(("_", ".")):
                walk(inner)

    for given in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(given)
        walk(path.getFileSystem(conf).getFileStatus(path))
    return out


def require_content(spark: SparkSession, paths: Sequence[str]) -> None:
    """Refuse empty files: Spark's readers give no row for them."""
    if empty := [path for path, length in file_list(spark, paths) if not length]:
        raise ValueError(f"empty JSON files: {empty[:3]}")


def _ranges(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[pa.RecordBatch]]]:
    """(path, start, batches) of each run of rows of one byte range; a run is read to its end before the next."""
    source = (batch for batch in rows if batch.num_rows)
    ahead = next(source, None)
    while ahead is not None:
        path, start = ahead.column("path")[0], ahead.column("start")[0]

        def own() -> Iterator[pa.RecordBatch]:
            nonlocal ahead
            while ahead is not None:
                same = pc.and_(pc.equal(ahead.column("path"), path), pc.equal(ahead.column("start"), start))
                other = pc.index(same, False).as_py()
                if other < 0:
                    yield ahead
                    ahead = next(source, None)
                    continue
                if other:
                    yield ahead.slice(0, other)
                ahead = ahead.slice(other)
                return

        yield path.as_py(), start.as_py(), own()


def _bytes(batch: pa.RecordBatch) -> np.ndarray:
    """The pieces of a batch with the brace behind each, as they stand in the file."""
    column = batch.column("value")
    text = b"}".join(v.as_buffer().to_pybytes() for v in column) + b"}"
    return np.frombuffer(text, np.uint8)


def _inside(data: np.ndarray, state: int) -> np.ndarray:
    """By byte, 1 inside a string (its opening quote among it); a piece never begins behind a backslash."""
    plain = np.flatnonzero(data != 92)
    last = np.full(len(data), -1)
    last[plain] = plain
    last = np.maximum.accumulate(last)
    before = np.concatenate(([-1], last[:-1]))
    escaped = ((np.arange(len(data)) - 1 - before) & 1) == 1
    quote = (data == 34) & ~escaped
    return (np.cumsum(quote) + state) & 1


def _steps(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Depth behind each byte, from 0."""
    out = inside == 0
    return np.cumsum((_OPEN[data] & out).astype(np.int64) - (_CLOSE[data] & out))


SUMMARY = "path string, start bigint, size bigint, flips int, down array<bigint>, commas array<map<bigint,bigint>>, bytes bigint, first string"


def _summaries(rows: DataFrame) -> DataFrame:
    """One row per byte range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start, own in _ranges(batches):
            state, down, commas, held, first, size = 0, [0, 0], [{}, {}], 0, None, 0
            for batch in own:
                data = _bytes(batch)
                size = batch.column("size")[0].as_py()
                held += len(data)
                inside = _inside(data, state)
                for s in (0, 1):
                    mine = inside ^ s
                    depth = _steps(data, mine) + down[s]
                    at, n = np.unique(depth[(data == 44) & (mine == 0)], return_counts=True)
                    for d, c in zip(at.tolist(), n.tolist()):
                        commas[s][d] = commas[s].get(d, 0) + c
                    down[s] = int(depth[-1])
                state = int(inside[-1])
                if first is None:
                    text = data.tobytes().removeprefix(_MARK).lstrip()
                    first = chr(text[0]) if text else None
            row = {"path": path, "start": start, "size": size, "flips": state, "down": down, "commas": [list(c.items()) for c in commas], "bytes": held, "first": first}
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.map_(pa.int64(), pa.int64())), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

    return rows.mapInArrow(run, SUMMARY)


def _starts(ranges: DataFrame) -> DataFrame:
    """Where each range begins: string state, depth, records before it; and whether it ends its file and with a brace."""
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    file = Window.partitionBy("path")
    zero = F.lit(0).cast("bigint")
    rows = ranges.withColumn("state", (F.coalesce(F.sum("flips").over(before), zero) % 2).cast("int"))
    rows = rows.withColumn("own", F.element_at("down", F.col("state") + 1)).withColumn("depth", F.coalesce(F.sum("own").over(before), zero))
    commas = F.element_at("commas", F.col("state") + 1)
    rows = rows.withColumn("n", F.coalesce(F.element_at(commas, 1 - F.col("depth")), zero))
    rows = rows.withColumn("pos", F.coalesce(F.sum("n").over(before), zero)).withColumn("kind", F.first("first").over(Window.partitionBy("path").orderBy("start")))
    last = F.col("start") == F.max("start").over(file)
    # Pieces count a brace that the last one may not have; a byte order mark is not counted.
    rows = rows.withColumn("extra", F.sum("bytes").over(file) - F.col("size")).withColumn("last", last)
    return rows.select("path", "start", "state", "depth", "pos", "kind", "last", F.col("extra").isin(1, -2).alias("open_end"))


class Cutter:
    """Cuts the bytes of a range into records; they come in several stretches."""

    def __init__(self, path: str, state: int, depth: int, pos: int, opened: bool) -> None:
        self.path, self.state, self.depth, self.pos, self.opened = path, state, depth, pos, opened
        self.rest: list[bytes] = []

    def feed(self, data: np.ndarray) -> list[tuple[int, bool, bytes]]:
        """(pos, whether the value ends with it, text) of each record that ends in ``data``."""
        if not len(data):
            return []
        inside = _inside(data, self.state)
        after = _steps(data, inside) + self.depth
        before = np.concatenate(([self.depth], after[:-1]))
        if (after < 0).any():
            raise ValueError(f"JSON that closes what it did not open: {self.path}")
        # Outside of the value only white space may stand, but for its opening sign.
        loose = np.flatnonzero((before == 0) & ~_BLANK[data])
        at = 0
        if len(loose):
            if self.opened or len(loose) > 1 or after[loose[0]] != 1:
                raise ValueError(f"something stands beside the JSON value: {self.path}")
            self.opened, at = True, int(loose[0]) + 1
        closes = (after == 0) & (before == 1)
        text = data.tobytes()
        found = []
        for end in np.flatnonzero((inside == 0) & (data == 44) & (after == 1) | closes).tolist():
            found.append((self.pos, bool(closes[end]), b"".join([*self.rest, text[at:end]])))
            self.rest, at = [], end + 1
            self.pos += not closes[end]
        self.state, self.depth = int(inside[-1]), int(after[-1])
        if self.depth:
            self.rest.append(text[at:])
        return found


CUT = "path string, pos bigint, kind string, part bigint, whole boolean, closes boolean, raw binary"


def _records(path: str, kind: str, part: int, whole: list[bool], found: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    n = len(found)
    at, closes, texts = zip(*found)
    columns = [pa.array([path] * n), pa.array(at, pa.int64()), pa.array([kind] * n), pa.array([part] * n, pa.int64())]
    columns += [pa.array(whole, pa.bool_()), pa.array(closes, pa.bool_()), pa.array(texts, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["path", "pos", "kind", "part", "whole", "closes", "raw"])


def _cut(rows: DataFrame) -> DataFrame:
    """Records, and parts of records that lie in several ranges."""

    def stretches(own: Iterator[pa.RecordBatch], start: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Batches and their bytes, without a mark at the beginning and a last brace that is not in the file."""
        held = None
        for batch in own:
            if held is not None:
                yield held
            data = _bytes(batch)
            if start == 0 and held is None and data[:3].tobytes() == _MARK:
                data = data[3:]
            held = batch, data
        batch, data = held
        yield batch, data[:-1] if batch.column("last")[0].as_py() and batch.column("open_end")[0].as_py() else data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start, own in _ranges(batches):
            cutter, seen = None, 0
            for batch, data in stretches(own, start):
                if cutter is None:
                    state, depth, pos, kind, last = (batch.column(c)[0].as_py() for c in ("state", "depth", "pos", "kind", "last"))
                    if kind not in ("[", "{"):
                        raise ValueError(f"neither a list nor an object: {path}")
                    cutter = Cutter(path, state, depth, pos, start > 0)
                found = cutter.feed(data)
                if found:
                    # The first record of a later range may have begun before it.
                    whole = [start == 0 or seen + i > 0 for i in range(len(found))]
                    for ok, (at, closes, text) in zip(whole, found):
                        if ok and not text.strip(b" \t\r\n") and not (at == 0 and closes):
                            raise ValueError(f"nothing stands beside a comma: {path}")
                    yield _records(path, kind, start, whole, found)
                    seen += len(found)
            if last and cutter.depth:
                raise ValueError(f"JSON that ends too early: {path}")
            if cutter.rest:
                yield _records(path, kind, start, [False], [(cutter.pos, False, b"".join(cutter.rest))])

    return rows.mapInArrow(run, CUT)


def read_json_values(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, file, stem, kind, pos, raw): the elements of a list (kind ``[``) or the members ``"key": value`` of an object (``{``).

    ``raw`` is a record's own JSON text and ``pos`` its place, from 0. A path may be a folder of files.
    """
    require_content(spark, paths)
    rows = spark.read.option("lineSep", "}").text(list(paths))
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), "value")
    ranges = materialise(_summaries(rows))
    if ranges.limit(MAX_RANGES + 1).count() > MAX_RANGES:
        raise ValueError("too many byte ranges for one read; read the files in several calls")
    known = materialise(_starts(ranges))
    cut = materialise(_cut(rows.join(F.broadcast(known), ["path", "start"])))
    parts = cut.where("not whole").groupBy("path", "pos", "kind")
    parts = parts.agg(F.array_sort(F.collect_list(F.struct("part", "raw"))).alias("parts"), F.max("closes").alias("closes"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["raw"])).cast("string")
    parts = parts.withColumn("raw", joined)
    # An empty list or object has one blank record; beside a comma something must stand.
    failed = F.raise_error(F.concat(F.lit("nothing stands beside a comma: "), F.col("path"))).cast("string")
    told = F.when(_blank(F.col("raw")) & ~((F.col("pos") == 0) & F.col("closes")), failed).otherwise(F.col("raw"))
    # A part of a record stays null even where the planner evaluates a later parser before the filter.
    own = F.when(F.col("whole"), F.col("raw").cast("string"))
    whole = cut.where("whole").select("path", "pos", "kind", own.alias("raw"))
    found = whole.unionByName(parts.select("path", "pos", "kind", told.alias("raw")))
    return found.where(~_blank(F.col("raw"))).select(*_names(F.col("path")), "kind", "pos", "raw")


def _blank(raw: Column) -> Column:
    return F.trim(F.translate(raw, "\t\r\n", "   ")) == ""


def read_json_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, file, stem, kind, pos, raw): the lines of JSON-lines files, each a record (kind ``line``); ``pos`` is the line's number.

    Files are split among tasks; blank lines count but give nothing. A path may be a folder of files.
    """
    require_content(spark, paths)
    rows = spark.read.option("lineSep", "\n").text(list(paths))
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("path", "start").agg(F.count("*").alias("n"))
    known = materialise(counts.select("path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("first")))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, own in _ranges(batches):
            done = 0
            for batch in own:
                pos = np.arange(done, done + batch.num_rows) + batch.column("first")[0].as_py()
                done += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(pos, pa.int64()), batch.column("value")], names=["path", "pos", "raw"])

    numbered = rows.join(broadcast_if_small(known, MAX_RANGES), ["path", "start"]).mapInArrow(number, "path string, pos bigint, raw string")
    raw = F.regexp_replace("raw", "^\\x{feff}|\\r$", "")
    return numbered.select(*_names(F.col("path")), F.lit("line").alias("kind"), "pos", raw.alias("raw")).where(F.trim(raw) != "")
