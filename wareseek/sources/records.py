"""CSV whose values span lines, read by many tasks a file.

A line break ends a record only where the quotes before it are even in number. A first pass over the
splits of the files counts each split's quotes; sums over the splits before one tell whether it starts
inside a value. With that a second pass puts the lines of each split together to records by itself.
What a split's end cuts, one record at most, meets its rest in a small shuffle, for which the files are
read once more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wareseek.storage import is_small, materialise

# A split is a row of some hundred bytes; 100 TB in splits of 128 MB are 800,000.
MAX_BROADCAST_SPLITS = 1_000_000
_WHOLE, _HEAD, _REST = 0, 1, 2
_RECORDS = "file string, split long, number long, part int, record string"
_ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("split", pa.int64()),
        ("number", pa.int64()),
        ("part", pa.int32()),
        ("record", pa.string()),
    ]
)


class UnbalancedQuotesError(ValueError):
    """A file ends inside a quoted value."""


def read_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The records of CSV files as texts: ``file``, ``split``, ``number``, ``record``.

    ``split`` is the byte at which the record's split starts and ``number`` counts the records of a
    split, so the three order a file's records; the first one of all is its header. Records end with
    a line feed, or a carriage return and a line feed; empty lines between records are left out, as
    are byte order marks. Quotes must enclose values or be doubled inside them: a lone quote within an
    unquoted value would move all later ends, so a file whose quotes are odd in number is refused.

    All passes must see the same splits: a cluster whose default parallelism changes between
    them fails with an error, and ``spark.sql.files.minPartitionNum`` keeps it from doing so.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )
    splits = _open_splits(lines)
    if is_small(splits, MAX_BROADCAST_SPLITS):
        marked = lines.join(F.broadcast(splits), ["file", "split"], "left")
    else:  # the ids keep the order of lines over the shuffle
        marked = lines.join(splits, ["file", "split"], "left").repartition("file", "split")
        marked = marked.sortWithinPartitions("file", "split", "at")
    parts = marked.select("file", "split", "inside", "line").mapInArrow(_to_records, _RECORDS)
    whole = parts.where(F.col("part") == _WHOLE).drop("part")
    records = whole.unionByName(_joined(parts.where(F.col("part") != _WHOLE)))
    return records.withColumn("record", F.regexp_replace("record", "^\ufeff|\r$", ""))


def parse_records(records: DataFrame, names: Sequence[str], options: dict) -> DataFrame:
    """Columns of text from the records of :func:`read_records`, headers left out.

    Every file's header must be ``names``, in that order, or the job fails. It is the first record of the
    split at byte 0.
    """
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    header = (F.col("split") == 0) & (F.col("number") == 0)
    rows = records.select("*", F.from_csv("record", schema, options).alias("row"))
    same = F.array(*[F.col("row")[n] for n in names]).eqNullSafe(F.array(*[F.lit(n) for n in names]))
    other = F.raise_error(F.concat("file", F.lit(f" has another header than {', '.join(names)}: "), "record"))
    body = rows.where(F.when(~header, True).when(same, False).otherwise(other.cast("boolean")))
    return body.select("row.*")


def _open_splits(lines: DataFrame) -> DataFrame:
    """For every split whether it starts inside a value."""
    odd = F.sum(F.regexp_count("line", F.lit('"'))) % 2
    splits = materialise(lines.groupBy("file", "split").agg(odd.alias("odd")), "csv-splits")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    upto = splits.select("file", "split", "odd", F.coalesce(F.sum("odd").over(before), F.lit(0)).alias("before"))
    last = upto.groupBy("file").agg(F.max_by(F.col("before") + F.col("odd"), "split").alias("odd"))
    unbalanced = last.where(F.col("odd") % 2 != 0).take(1)
    if unbalanced:
        raise UnbalancedQuotesError(f"{unbalanced[0]['file']} ends inside a quoted value")
    return upto.select("file", "split", (F.col("before") % 2 != 0).alias("inside"))


def _joined(cut: DataFrame) -> DataFrame:
    """Whole records from those that the ends of splits cut: a head, then what further splits hold of it."""
    order = Window.partitionBy("file").orderBy("split", "number")
    heads = F.sum(F.when(F.col("part") == _HEAD, 1).otherwise(0)).over(order)
    pieces = F.sort_array(F.collect_list(F.struct("split", "number", "record")))
    whole = cut.withColumn("head", heads).groupBy("file", "head").agg(pieces.alias("pieces"))
    return whole.select(
        "file",
        F.col("pieces")[0]["split"].alias("split"),
        F.col("pieces")[0]["number"].alias("number"),
        F.array_join(F.col("pieces")["record"], "\n").alias("record"),
    )


def _to_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of splits whose lines come in order, one split after the other."""
    place, inside, number, held, part = None, 0, 0, [], _WHOLE

    def rows(records: list | pa.Array, parts: list[int], first: int) -> pa.RecordBatch:
        n = len(parts)
        numbers = pa.array(np.arange(first, first + n))
        columns = [pa.array([place[0]] * n, pa.string()), pa.array([place[1]] * n, pa.int64()), numbers]
        return pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.int32()), pa.array(records, pa.string())], schema=_ARROW)

    def cut() -> Iterator[pa.RecordBatch]:
        if held:  # the next split goes on with this record
            yield rows(["\n".join(held)], [_REST if part == _REST else _HEAD], number)

    for batch in batches:
        for run in _runs(batch):
            here = (run.column("file")[0].as_py(), run.column("split")[0].as_py())
            if here != place:
                yield from cut()
                starts_inside = run.column("inside")[0].as_py()
                if starts_inside is None:
                    raise ValueError(f"{here[0]} was split differently in the second pass, at byte {here[1]}")
                place, inside, number, held = here, int(starts_inside), 0, []
                part = _REST if starts_inside else _WHOLE
            lines = run.column("line")
            after = (np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)) + inside) & 1
            ends = np.flatnonzero(after == 0) + 1
            if not len(ends):
                held += lines.to_pylist()
                inside = int(after[-1])
                continue
            first = "\n".join(held + lines.slice(0, ends[0]).to_pylist())
            groups = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), lines)
            found = [first] if part == _REST or first.strip("\r\ufeff") else []
            parts = [part] * len(found)
            found += [r for r in pc.binary_join(groups, "\n").to_pylist() if r and r != "\r"]
            yield rows(found, parts + [_WHOLE] * (len(found) - len(parts)), number)
            number, part = number + len(found), _WHOLE
            held, inside = lines.slice(ends[-1]).to_pylist(), int(after[-1])
    yield from cut()


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of rows of the same split."""
    if not batch.num_rows:
        return
    files, splits = batch.column("file"), batch.column("split")
    changed = pc.or_(
        pc.not_equal(files.slice(1), files.slice(0, len(files) - 1)),
        pc.not_equal(splits.slice(1), splits.slice(0, len(splits) - 1)),
    )
    cuts = [0, *(np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
