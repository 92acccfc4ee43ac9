"""JSON values that hold an array, read by many tasks although each is one value: a split finds its place inside strings and nesting. Arrays of objects, and arrays of arrays that
an object wraps.

Spark's text reader cuts a file at every closing brace (or bracket), in splits as large as spark.sql.files.maxPartitionBytes says. What a split does to the place is known without
knowing where it begins: whether it turns inside and outside of strings about, and by how much it changes the depth, for either beginning. These few numbers
for each split, added up in the order of a file, tell each split where it begins. Then each split cuts its elements; what lies before
the first end and after the last one goes to a grouping by element, so an element may lie over any number of splits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Splits up to which their places are broadcast; of more, pieces and places are joined by shuffle and sorted again.
MAX_SPLITS = 100_000
_ESCAPE = re.compile(r"\\.", re.S)
_GAP = re.compile(r"[\s,\[]*")
_SIGN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S)


def _change(piece: str, close: str) -> tuple[int, tuple[int, int]]:
    """What a piece with the closing sign after it does: whether strings turn about (1), and the change of depth if it begins outside of a string and inside of one."""
    parts = _ESCAPE.sub("", piece).split('"')
    turns, other = (len(parts) - 1) % 2, "]" if close == "}" else "}"
    depth = [sum(x.count("{") + x.count("[") - x.count(other) for x in parts[begin::2]) for begin in (0, 1)]
    ends_outside = (turns == 0, turns == 1)
    return turns, (depth[0] - ends_outside[0], depth[1] - ends_outside[1])


def _start(text: str, within: int, depth: int, level: int) -> int:
    """Where the first element of depth level + 1 begins in a text that begins inside of a string (1) or outside, at a depth; -1 if none does."""
    for m in _SIGN.finditer('"' * within + text):
        if m[0] in "[{":
            if depth == level:
                return m.start() - within
            depth += 1
        elif m[0] in "]}":
            depth -= 1
    return -1


def _pieces(spark: SparkSession, path: str, close: str = "}") -> DataFrame:
    return spark.read.option("lineSep", close).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _summed(close: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per split: turns, and the change of depth for both beginnings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for piece, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns, by = _change(piece, close)
                s = seen.setdefault((file, block), [0, 0, 0])
                s[1], s[2] = s[1] + by[s[0]], s[2] + by[1 - s[0]]
                s[0] ^= turns
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen], pa.int64()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in range(3))], ["file", "block", "turns", "outside", "inside"])

    return run


def _places(pieces: DataFrame, close: str) -> DataFrame:
    """Per split: whether it begins inside of a string (1), and its depth there."""
    splits = pieces.mapInArrow(_summed(close), "file string, block long, turns long, outside long, inside long")
    before = W.Window.partitionBy("file").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    begun = splits.withColumn("within", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2)
    change = F.when(F.col("within") == 1, F.col("inside")).otherwise(F.col("outside"))
    return begun.withColumn("depth", F.coalesce(F.sum(change).over(before), F.lit(0))).select("file", "block", "within", "depth")


def _cut(close: str, level: int, only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces of each split in order, with its place -> (file, block, part, text): whole elements, those of depth level + 1 (part null), and what belongs to one begun before (0) or goes on after it (1).
    only: whether nothing but commas may stand between elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, within, depth, begun, first = None, [], 0, 0, False, (0, 0)
        out: list[tuple[str, int, int | None, str]] = []

        def left() -> None:
            if at is not None and begun:
                out.append((*at, 0, "".join(held)))
            elif at is not None and (start := _start(text := "".join(held), *first, level)) >= 0:
                out.append((*at, 1, text[start:]))

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string()))], ["file", "block", "part", "text"])
            out.clear()
            return made

        for batch in batches:
            for piece, file, block, w, d in zip(*(batch.column(n).to_pylist() for n in ("value", "file", "block", "within", "depth")), strict=True):
                if at != (file, block):
                    left()
                    at, held, within, depth, first = (file, block), [], w, d, (w, d)
                    begun = depth > level
                turns, by = _change(piece, close)
                depth, within = depth + by[within], within ^ turns
                held += [piece, close]
                if not within and depth == level:  # an element has ended
                    text = "".join(held)
                    start = 0 if begun else _start(text, *first, level)
                    if not begun and only and _GAP.match(text).end() != start:
                        raise ValueError(f"{file}: an element is no object: {text[: start + 40]!r}")
                    if start >= 0:
                        out.append((file, block, 0 if begun else None, text[start:]))
                    held, begun, first = [], False, (0, depth)
            if out:
                yield batch_of()
        left()
        if out:
            yield batch_of()

    return run


def json_elements(spark: SparkSession, path: str, close: str = "}", level: int = 1, only: bool = True) -> DataFrame:
    """(file, text): the elements of depth level + 1 that end with the closing sign, of the JSON values in the files at path. A file that ends within an element loses that one."""
    pieces = _pieces(spark, path, close)
    places = _places(pieces, close)
    if places.count() <= MAX_SPLITS:
        placed = pieces.join(F.broadcast(places), ["file", "block"])  # pieces stay in order
    else:
        placed = pieces.withColumn("n", F.monotonically_increasing_id()).join(places, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "n")
    cut = placed.select("value", "file", "block", "within", "depth").mapInArrow(_cut(close, level, only), "file string, block long, part int, text string")
    # a part that goes on (1) begins an element; the parts 0 of the following splits belong to it
    order = W.Window.partitionBy("file").orderBy("block", "part")
    parts = cut.where("part IS NOT NULL").withColumn("g", F.last(F.when(F.col("part") == 1, F.col("block")), ignorenulls=True).over(order))
    joined = parts.groupBy("file", "g").agg(F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("t"))
    return cut.where("part IS NULL").select("file", "text").unionByName(joined.select("file", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text")))


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(text): each object of the JSON arrays in the files at path. ValueError for elements that are no objects."""
    return json_elements(spark, path).select("text")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of JSON arrays as rows of schema; names that an object lacks are null."""
    return json_objects(spark, path).select(F.from_json("text", schema).alias("r")).where("r IS NOT NULL").select("r.*")


def read_json_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(columns, d): the names and a row of each matrix in files {"columns": [names], "data": [[cells], ...], ...}, cells as text. The matrix has to be the only array of arrays in its
    file; names hold no bracket. Names, a few for each file, are joined by file."""
    rows = json_elements(spark, path, "]", 2, only=False).select("file", F.from_json("text", "array<string>").alias("d")).where("d IS NOT NULL")
    head = r'(?s)(?<!\\)"columns"\s*:\s*\[(.*)$'
    names = _pieces(spark, path, "]").where(F.col("value").rlike(head)).select("file", F.from_json(F.concat(F.lit("["), F.regexp_extract("value", head, 1), F.lit("]")), "array<string>").alias("columns"))
    return rows.join(names.where("columns IS NOT NULL").dropDuplicates(["file"]), "file").select("columns", "d")
