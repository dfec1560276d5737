"""Text files whose records are not lines, read in parallel: quoted CSV (S3) and JSON arrays.

Where a record ends depends on all that comes before: a line break or a brace inside quotes is text. So Spark's own
readers take such a file whole, in one task. Here Spark's text reader still cuts the file into blocks (its splits), at
a separator that every record ends with: a line feed for CSV, ``}`` for JSON objects. Then

1. each block is scanned once for every state it may begin in (outside or inside quotes) and gives, for each, the state
   it ends in, the change of nesting depth, and how many records end at which relative depth;
2. the blocks of a file are composed in order on the driver: one small row a block, at most ``MAX_BLOCKS``. Now each
   block's true start is known, and so is the number of records before it;
3. blocks are scanned again from their true starts and give whole records with their numbers. Only a record that
   crosses a border between blocks comes in pieces, one from each block it touches, which are put together by its number.

A scan passes each byte once and keeps one record. A record's size is bounded by Spark's limit of 2 GB a row, as ever.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BLOCKS = 2_000_000  # splits of one read; beyond it raise spark.sql.files.maxPartitionBytes

OUTSIDE, INSIDE = 0, 1


class CsvLines:
    """Chunks are lines; a record ends with a line that leaves no quote open. Fields may be quoted by ``"``, doubled inside."""

    separator, base = b"\n", 0

    @staticmethod
    def step(state: int, line: bytes) -> tuple[int, int]:
        """(state after the line, change of depth)."""
        if b'"' not in line:
            return state, 0
        i, n = 0, len(line)
        while True:
            if state == INSIDE:
                i = line.find(b'"', i)
                if i < 0:
                    return INSIDE, 0
                if line[i + 1:i + 2] == b'"':
                    i += 2
                    continue
                state, i = OUTSIDE, i + 1
            elif i < n and line[i] == 0x22 and (i == 0 or line[i - 1] == 0x2C):
                state, i = INSIDE, i + 1
                continue
            i = line.find(b",", i)
            if i < 0:
                return OUTSIDE, 0
            i += 1

    @staticmethod
    def blank(data: bytes) -> bool:
        return not data.rstrip(b"\r\n")


class JsonObjects:
    """Chunks end before a ``}``; a record is an object at depth 1, inside the file's one array."""

    separator, base = b"}", 1
    _MARKS = re.compile(rb'\\.|["{}\[\]]', re.S)

    @classmethod
    def step(cls, state: int, chunk: bytes) -> tuple[int, int]:
        depth = 0
        for m in cls._MARKS.finditer(chunk + b"}"):
            c = m[0]
            if c == b'"':
                state = OUTSIDE if state == INSIDE else INSIDE
            elif state == OUTSIDE:
                depth += (c in (b"{", b"[")) - (c in (b"}", b"]"))
        return state, depth

    @staticmethod
    def blank(data: bytes) -> bool:
        return False


RULES = {"csv": CsvLines, "json": JsonObjects}


def _chunks(spark: SparkSession, path: str, separator: bytes) -> DataFrame:
    lines = spark.read.option("lineSep", separator.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.col("value").cast("binary").alias("chunk"), F.col("_metadata.file_size").alias("size"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes, int]]:
    for b in batches:
        for file, block, chunk, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
            yield file, block, chunk.as_py(), size


_SUMMARY = "file string, block long, start int, end int, depth int, at array<int>, ends array<long>, bytes long, size long, returns boolean"


def _summarise(kind: str):
    rule = RULES[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        where, now, size, whole, returns = None, [], 0, 0, False

        def close() -> None:
            for start, (end, depth, ends, _) in enumerate(now):
                rows.append((*where, start, end, depth, list(ends), list(ends.values()), size, whole, returns))

        for file, block, chunk, whole_size in _runs(batches):
            if (file, block) != where:
                if where is not None:
                    close()
                where, now, size, whole, returns = (file, block), [[OUTSIDE, 0, {}, True], [INSIDE, 0, {}, False]], 0, whole_size, chunk.endswith(b"\r")
            size += len(chunk) + 1
            for s in now:
                fresh = s[3]  # a record may begin here
                s[0], change = rule.step(s[0], chunk)
                s[1] += change
                if s[0] == OUTSIDE and not (fresh and rule.blank(chunk)):
                    s[2][s[1]] = s[2].get(s[1], 0) + 1
                s[3] = s[0] == OUTSIDE
        if where is not None:
            close()
        if rows:
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in _SUMMARY.split(", ")])

    return run


def _starts(summary: list, base: int) -> dict:
    """{(file, block): (state, depth, records before, bytes before the last chunk if no separator follows it else -1,
    whether the file's first line ends with a carriage return)}."""
    blocks: dict = {}
    for r in summary:
        blocks.setdefault(r["file"], {}).setdefault(r["block"], {})[r["start"]] = r
    starts = {}
    for file, some in blocks.items():
        state, depth, before = OUTSIDE, 0, 0
        unended = sum(r[OUTSIDE]["bytes"] for r in some.values()) > next(iter(some.values()))[OUTSIDE]["size"]
        last, first = max(some), min(some)
        for block in sorted(some):
            r = some[block][state]
            starts[file, block] = (state, depth, before, r["bytes"] if unended and block == last else -1, some[first][OUTSIDE]["returns"])
            before += dict(zip(r["at"], r["ends"])).get(base - depth, 0)
            state, depth = r["end"], depth + r["depth"]
    return starts


_PIECE = "file string, number long, block long, whole boolean, data binary"


def _assemble(kind: str, shared):
    rule = RULES[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = shared.value
        rows: list[tuple] = []
        where, size = None, 0
        state = depth = number = seen = 0
        until, returns = -1, False
        held: list[bytes] = []
        cut = False  # the record began in another block

        def made(*rest) -> tuple:
            data = b"".join(held)
            # as Spark's reader has it: in a file of CR LF lines a line break inside quotes is LF
            return (*rest, data.replace(b"\r\n", b"\n") if returns and rule is CsvLines else data)

        def batch() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in _PIECE.split(", ")])
            rows.clear()
            return made

        for file, block, chunk, _ in _runs(batches):
            if (file, block) != where:
                if held:
                    rows.append(made(*where[:1], number + 1, where[1], False))
                where, held, seen = (file, block), [], 0
                state, depth, number, until, returns = starts[where]
                cut = block > 0 and not (state == OUTSIDE and depth == rule.base)
            fresh = not held and not cut
            seen += len(chunk) + 1
            if seen == until and rule is JsonObjects:  # the file ends without a separator: no object ends here
                held.append(chunk)
                continue
            state, change = rule.step(state, chunk)
            depth += change
            if fresh and state == OUTSIDE and rule.blank(chunk):
                continue
            held += [chunk, rule.separator]
            if state == OUTSIDE and depth == rule.base:
                rows.append(made(file, number + 1, block, not cut))
                size += len(rows[-1][4])
                number, held, cut = number + 1, [], False
                if len(rows) >= 1024 or size >= 4 << 20:
                    size = 0
                    yield batch()
        if held:
            rows.append(made(*where[:1], number + 1, where[1], False))
        if rows:
            yield batch()

    return run


def _records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, number, data binary): every record of every file with its number from 1, and what follows the last."""
    rule = RULES[kind]
    chunks = _chunks(spark, path, rule.separator)
    summary = chunks.mapInArrow(_summarise(kind), _SUMMARY).limit(2 * MAX_BLOCKS + 1).collect()
    if len(summary) > 2 * MAX_BLOCKS:
        raise ValueError(f"more than {MAX_BLOCKS} blocks: raise spark.sql.files.maxPartitionBytes")
    starts = _starts(summary, rule.base)
    pieces = chunks.mapInArrow(_assemble(kind, spark.sparkContext.broadcast(starts)), _PIECE)  # one entry a block
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "data"))), lambda p: p["data"])
    crossing = pieces.where("NOT whole").groupBy("file", "number").agg(parts.alias("parts"))
    crossing = crossing.select("file", "number", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x)).alias("data"))
    return pieces.where("whole").select("file", "number", "data").unionByName(crossing)


def read_quoted_csv(spark: SparkSession, path: str, *, numbered: bool = True) -> DataFrame:
    """CSV files with a header and quoted fields that may hold line breaks, read by many tasks; all columns text.

    Rows, and what counts as one, are those of Spark's reader with ``multiLine``. With ``numbered``, ``line_no`` counts a
    file's data rows from 1 in file order. Blank lines between records are skipped. A quote that is never closed makes
    the rest of its file one record. The files are scanned once while the DataFrame is built.
    """
    options = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}
    names = spark.read.options(**options).csv(path).columns  # reads the first record only
    found = _records(spark, path, "csv")
    text = F.regexp_replace(F.col("data").cast("string"), "\r?\n$", "")
    rows = found.where("number > 1").select((F.col("number") - 1).alias("line_no"), F.from_csv(text, _ddl(names), {k: v for k, v in options.items() if k != "header"}).alias("row"))
    return rows.select(*(["line_no"] if numbered else []), *[F.col("row")[c].alias(c) for c in names])


def _ddl(names: list[str]) -> str:
    return ", ".join("`" + c.replace("`", "``") + "` string" for c in names)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, *, number: str | None = None, broken: str | None = None) -> DataFrame:
    """The objects of files that each hold one JSON array, read by many tasks.

    Good files give the rows of Spark's reader with ``multiLine``. An element that is no object of the schema's shape gives a
    row of nulls; ``broken`` names a column that then holds its text (a column of text, null for good elements), and
    ``number`` one with the element's place in its file, from 1. A file that ends before its array does has its last piece
    reported the same way. The files are scanned once while the DataFrame is built.
    """
    found = _records(spark, path, "json")
    corrupt = broken or "_broken"
    whole = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    text = F.regexp_replace(F.col("data").cast("string"), r"^[\s,]*(\[\s*)?", "")
    rows = found.select("number", text.alias("text")).where(~F.col("text").rlike(r"^[\s\]]*$"))  # not the end of the array
    row = F.from_json("text", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    rows = rows.select("number", "text", row.alias("row"))
    out = [F.col("row")[f.name].alias(f.name) for f in schema.fields]
    if number:
        out.append(F.col("number").alias(number))
    if broken:
        out.append(F.col("row")[corrupt].alias(broken))
    return rows.select(*out)
