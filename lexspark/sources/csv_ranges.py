"""Quoted CSV with line breaks inside fields, read by ranges of bytes.

Whether a line starts inside of a quoted field depends on all quotes before it in its file. Each line is a step of an automaton with two states, outside and inside; the steps of a range make one step, those of a file's ranges are put together by a prefix scan over one row a range, and then each range cuts its own lines into records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.session import stored

#: Ranges whose states are broadcast at most, some 100 bytes each; for more, lines are dealt by range and sorted again.
BROADCAST = 200_000
#: Steps of a line, as the state behind it from outside (1: inside) plus twice that from inside.
CLOSES, SWAPS, STAYS, OPENS = 0, 1, 2, 3


def line_step(line: Column, sep: str = ",") -> Column:
    """What a line does to the state: CLOSES, SWAPS, STAYS or OPENS.

    A quote opens a field only where the field starts; elsewhere outside it is a character. Inside, a doubled quote is one. A line without quotes stays, and costs one search.
    """
    pieces = F.split(line, '"', -1)

    def behind(inside: bool) -> Column:
        # 0 at a field's start, 1 within a field, 2 within quotes, 3 behind a quote that closes unless another follows
        first = F.get(pieces, F.lit(0))
        start = F.lit(2) if inside else F.when((first == "") | F.endswith(first, F.lit(sep)), 0).otherwise(1)

        def step(s: Column, piece: Column) -> Column:
            quoted = F.when((s == 0) | (s == 3), 2).when(s == 2, 3).otherwise(1)
            return F.when((piece == "") | (quoted == 2), quoted).when(F.endswith(piece, F.lit(sep)), 0).otherwise(1)

        return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), start, step) == 2

    return F.when(F.contains(line, F.lit('"')), behind(False).cast("int") + 2 * behind(True).cast("int")).otherwise(STAYS)


def states_before(steps: np.ndarray, start: int) -> tuple[np.ndarray, int]:
    """The state before each of some steps (1: inside), and that behind all."""
    n = len(steps)
    sure = np.where((steps == CLOSES) | (steps == OPENS), np.arange(n), -1)
    last = np.maximum.accumulate(sure) if n else sure
    swaps = np.cumsum(steps == SWAPS)
    known = np.maximum(last, 0)
    after = np.where(last >= 0, (steps[known] == OPENS) ^ ((swaps - swaps[known]) & 1), start ^ (swaps & 1)).astype(np.int8) if n else np.zeros(0, np.int8)
    return np.concatenate([[start], after[:-1]]).astype(np.int8) if n else after, int(after[-1]) if n else start


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """Rows of one range side by side: its key, and where its rows start and end in the batch."""
    file, block = batch.column("file").to_pylist(), np.asarray(batch.column("block"))
    at = 0
    while at < len(file):
        same = np.flatnonzero(block[at:] != block[at])
        end = at + int(same[0]) if len(same) else len(file)
        end = next((i for i in range(at, end) if file[i] != file[at]), end)
        yield (file[at], int(block[at])), at, end
        at = end


def _lines(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """(file, block, line, value, step): lines in the order of each range, which lies in one task. Only \\n ends a line; a \\r before it stays."""
    read = spark.read.option("lineSep", "\n").text(path)
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.col("value"))
    return rows.withColumn("step", line_step(F.col("value"), sep))


def _ranges(lines: DataFrame) -> DataFrame:
    """(file, block, inside, row, crlf): the state at each range's start, the number of records that start before it in its file, and whether the file's first line ends with \\r\\n. Ranges tell what they do for either state; one row each is shuffled."""
    ddl = "file string, block long, step int, n0 long, n1 long, cr boolean"
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("step", pa.int32()), ("n0", pa.int64()), ("n1", pa.int64()), ("cr", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, count, cr = None, [0, 1], [0, 0], False
        told = lambda: pa.record_batch([pa.array([x], f.type) for x, f in zip((*key, state[0] + 2 * state[1], *count, cr), schema, strict=True)], schema=schema)
        for batch in batches:
            steps = np.asarray(batch.column("step"))
            for now, a, b in _runs(batch):
                if now != key:
                    if key is not None:
                        yield told()
                    key, state, count, cr = now, [0, 1], [0, 0], batch.column("cr")[a].as_py()
                for s in (0, 1):
                    before, state[s] = states_before(steps[a:b], state[s])
                    count[s] += int((before == 0).sum())
        if key is not None:
            yield told()

    found = lines.select("file", "block", "step", F.endswith("value", F.lit("\r")).alias("cr")).mapInArrow(run, ddl)
    in_file = Window.partitionBy("file").orderBy("block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    # the state before a range: the last sure step before it, swapped once for each swap since
    swap = (F.col("step") == SWAPS).cast("int")
    found = found.withColumns({"crlf": F.first("cr").over(in_file), "_swaps": F.coalesce(F.sum(swap).over(earlier), F.lit(0))})
    sure = F.when(F.col("step").isin(CLOSES, OPENS), F.struct((F.col("step") == OPENS).cast("int").alias("s"), F.col("_swaps").alias("n")))
    found = found.withColumn("_sure", F.last(sure, ignorenulls=True).over(earlier))
    inside = F.coalesce(F.col("_sure.s") + F.col("_swaps") - F.col("_sure.n"), F.col("_swaps")) % 2
    found = found.withColumn("inside", inside.cast("int"))
    started = F.when(F.col("inside") == 0, F.col("n0")).otherwise(F.col("n1"))
    return found.select("file", "block", "inside", F.coalesce(F.sum(started).over(earlier), F.lit(0)).alias("row"), "crlf")


def records(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """(file, row, value): the records of CSV files with their number from 0 in their file, their line breaks inside quotes kept.

    Files are read twice by ranges of bytes: once for what quotes do, once to cut. A record that crosses ranges is put together from its pieces, which alone are shuffled; memory holds a batch of lines and one record. An unclosed quote takes in the rest of its file. Lines end with \\n or \\r\\n; in files whose first line ends with \\r\\n, breaks inside quotes become \\n.
    """
    lines = _lines(spark, path, sep)
    ddl = "file string, row long, block long, whole boolean, crlf boolean, value string"
    schema = pa.schema([("file", pa.string()), ("row", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("crlf", pa.bool_()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, row, crlf = None, 0, 0, False
        held: list[str] = []  # lines of the record that isn't closed yet
        headed = False  # whether it starts in this range

        def closed(whole: bool):
            return (key[0], row - 1, key[1], whole and headed, crlf, "\n".join(held))

        def batch_of(rows):
            return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            steps, values = np.asarray(batch.column("step")), batch.column("value")
            inside, first = np.asarray(batch.column("inside")), np.asarray(batch.column("row"))
            for now, a, b in _runs(batch):
                if now != key:
                    if held:
                        yield batch_of([closed(state == 0)])
                    key, state, row, held, headed = now, int(inside[a]), int(first[a]), [], False
                    crlf = batch.column("crlf")[a].as_py()
                before, after = states_before(steps[a:b], state)
                behind = np.append(before[1:], after)
                alone = (before == 0) & (behind == 0)
                number = row + np.cumsum(before == 0)  # of records that start up to each line
                plain = np.flatnonzero(alone)
                if len(plain):  # lines that are records go on as they are
                    n = len(plain)
                    yield pa.record_batch([pa.array([key[0]] * n, pa.string()), pa.array(number[plain] - 1), pa.array(np.full(n, key[1])), pa.array(np.ones(n, bool)), pa.array(np.full(n, crlf)), values.take(pa.array(plain + a)).cast(pa.string())], schema=schema)
                out = []
                for i in np.flatnonzero(~alone).tolist():
                    if before[i] == 0:
                        held, headed = [], True
                    row = int(number[i])
                    held.append(values[a + i].as_py())
                    if behind[i] == 0:
                        out.append(closed(True))
                        held, headed = [], False
                row, state = int(number[-1]), after
                if out:
                    yield batch_of(out)
        if held:
            yield batch_of([closed(state == 0)])

    ranges = stored(_ranges(lines), "csv-ranges")
    columns = ("file", "block", "value", "step", "inside", "row", "crlf")
    if ranges.count() <= BROADCAST:  # a broadcast join leaves lines in their order
        placed = lines.join(F.broadcast(ranges), ["file", "block"]).select(*columns)
    else:
        placed = lines.join(ranges, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "line").select(*columns)
    pieces = placed.mapInArrow(run, ddl)
    whole = pieces.where("whole").select("file", "row", "crlf", "value")
    parts = pieces.where("NOT whole").groupBy("file", "row").agg(F.first("crlf").alias("crlf"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda x: x["value"]), "\n").alias("value"))
    value = F.when(F.col("crlf"), F.replace("value", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("value"))
    return whole.unionByName(parts).select("file", "row", F.regexp_replace(value, "\r$", "").alias("value"))


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """All columns of CSV files as text, with `_file` (name) and `_row` (the record's number in its file; 0 is the header).

    Names are those of the first header; other files bring their columns in the same order. Short rows are filled up with nulls, further cells are left, and empty lines are no rows.
    """
    options = {"multiLine": "true", "escape": '"', "sep": sep, "mode": "PERMISSIVE"}
    names = spark.read.options(header=True, **options).csv(path).columns
    rows = records(spark, path, sep).where("row > 0 AND value <> ''")
    cells = F.from_csv("value", ", ".join(f"`{n.replace('`', '``')}` string" for n in names), options)
    return rows.select(cells.alias("c"), F.element_at(F.split("file", "/"), -1).alias("_file"), F.col("row").alias("_row")).select("c.*", "_file", "_row")

