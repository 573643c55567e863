"""Line deduplication over sorted hashes; results are compressed keep bitmaps, one a document.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Two independent 64-bit hashes of every key
are dealt to partitions by ranges of (hash, document) and sorted by (hash, document, position). A task then streams its
partition once: a run of one hash is held back only until ``min_docs`` documents of it were seen, and from then on its lines
go out as they come. Ranges end between documents, never inside one, so a line of a third of all documents lies in many
partitions and no task gets it whole. What a partition cannot decide alone are its first and its last run: their few held
rows and one row of counts for each go out marked, and are settled by the sum over partitions.

Dropped positions meet by document and become a bitmap (a bit a line, 1 keeps it, zlib over ``numpy.packbits``). Texts are not
shuffled for any of this; ``apply_bitmaps`` joins them to the bitmaps where text is wanted.

With ``keep_first`` the first occurrence of a line (least id, then position) stays; without, all of them go. Rows of equal
id and text are one document and all get its bitmap; equal texts under different ids (null is an id) are different
documents. Null and empty texts are one empty line. Keys of fewer than ``min_chars`` code points stay always. An empty table gives no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialise, shared_dir
from ._text import slices

#: What a row of the streamed table is: a line to drop, a line or a first line of a run that may go on elsewhere, a count of such a run.
DROP, EDGE, FIRST, COUNT = range(4)
_ROW = ["h1", "h2", "id", "doc", "pos"]
_OUT = ["kind", *_ROW, "docs", "part"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\v\f\r")), string.ascii_uppercase, string.ascii_lowercase)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _document(id_: Column, text: Column) -> Column:
    """Tells apart rows of one id by their text."""
    return F.xxhash64(id_, F.coalesce(text, F.lit("")))


def _marked(rows: pa.Table, kind: np.ndarray, part: int) -> pa.RecordBatch:
    columns = [pa.array(kind.astype(np.int32)), *(rows.column(c).combine_chunks() for c in _ROW), pa.nulls(len(kind), pa.int64()), pa.array(np.full(len(kind), part, np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=_OUT)


def _count(run: pa.Table, docs: int, part: int) -> pa.RecordBatch:
    """One row that says how many documents of a run this partition has."""
    one = run.slice(0, 1)
    columns = [pa.array([COUNT], pa.int32()), *(one.column(c).combine_chunks() for c in _ROW), pa.array([docs], pa.int64()), pa.array([part], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=_OUT)


class _Runs:
    """The runs of equal hashes in sorted rows, with the documents of each."""

    def __init__(self, rows: pa.Table):
        h1, h2, doc = (rows.column(c).to_numpy() for c in ("h1", "h2", "doc"))
        fresh = np.ones(len(h1), bool)
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        other = fresh.copy()
        other[1:] |= doc[1:] != doc[:-1]
        self.start = np.flatnonzero(fresh)
        self.docs = np.add.reduceat(other.astype(np.int64), self.start)
        self.size = np.diff(np.append(self.start, len(h1)))
        self.key = (int(h1[0]), int(h2[0]))
        self.last = (int(h1[-1]), int(h2[-1]))


def _different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches without lines that repeat the one before: those of rows of one id and text."""
    before = None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("h1", "h2", "doc", "pos")], axis=1)
        if len(key):
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]).any(axis=1)
            fresh[0] = before is None or (key[0] != before).any()
            before = key[-1]
            if fresh.any():
                yield pa.Table.from_batches([batch]).filter(pa.array(fresh))


def _stream(min_docs: int, keep_first: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a sorted partition; holds the rows of the open run while it has fewer than ``min_docs`` documents."""
    part = TaskContext.get().partitionId()
    held: pa.Table | None = None
    decided: tuple[int, int] | None = None  # the open run, once it has documents enough
    first = True  # the run at hand is the partition's first

    def edge(run: pa.Table, docs: int, leads: bool) -> Iterator[pa.RecordBatch]:
        kind = np.full(run.num_rows, FIRST if keep_first else EDGE)
        kind[1:] = EDGE
        known = int(keep_first and not leads)  # begun in this partition: its first line is the first of all
        if run.num_rows > known:
            yield _marked(run.slice(known), kind[known:], part)
        yield _count(run, docs, part)

    for rows in _different(batches):
        if held is not None:
            rows = pa.concat_tables([held, rows])
            held = None
        runs = _Runs(rows)
        enough = runs.docs >= min_docs
        going = decided is not None and decided == runs.key
        if going:
            enough[0] = True
        elif decided is not None:
            decided, first = None, False
        kind = np.where(np.repeat(enough, runs.size), DROP, -1)
        begun = np.ones(len(runs.start), bool)
        begun[0] = not going
        if keep_first:
            kind[runs.start[enough & begun]] = -1
        if first and not going and enough[0]:
            yield _count(rows, int(runs.docs[0]), part)
            if keep_first:
                kind[0] = FIRST  # goes only if an earlier partition has the run
        if first and len(runs.start) > 1 and not enough[0]:
            yield from edge(rows.slice(0, int(runs.size[0])), int(runs.docs[0]), True)
        if len(runs.start) > 1:
            first = False
        at = int(runs.start[-1])
        if enough[-1]:
            if begun[-1] and not first:
                yield _count(rows.slice(at), int(runs.docs[-1]), part)
            decided = runs.last
        else:
            held, decided = rows.slice(at), None
        out = np.flatnonzero(kind >= 0)
        if len(out):
            yield _marked(rows.take(pa.array(out)), kind[out], part)
    if held is not None:
        yield from edge(held, int(_Runs(held).docs[0]), first)


def dropped_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_docs: int = 10, keep_first: bool = False, min_chars: int = 1) -> DataFrame:
    """``id, doc, pos``: lines (from 0) that go, each once."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    lines = chosen.select("id", _document(F.col("id"), F.col("text")).alias("doc"), F.posexplode(F.transform(_lines(F.col("text")), line_key)).alias("pos", "key"))
    hashed = lines.where(F.length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "doc", "pos")
    dealt = hashed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "h1", "h2", "id", "doc")
    kind = hashed.schema["id"].dataType.simpleString()
    schema = f"kind int, h1 long, h2 long, id {kind}, doc long, pos int, docs long, part int"
    streamed = dealt.sortWithinPartitions("h1", "h2", "id", "doc", "pos").mapInArrow(partial(_stream, min_docs, keep_first), schema)
    found = materialise(streamed, shared_dir(spark), "runs")
    totals = found.where(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("docs").alias("total"), F.min("part").alias("begins")).where(F.col("total") >= min_docs)
    open_ = found.where(F.col("kind").isin(EDGE, FIRST)).drop("docs").join(totals, ["h1", "h2"])
    settled = open_.where((F.col("kind") == EDGE) | (F.col("begins") < F.col("part")))
    gone = found.where(F.col("kind") == DROP).select("id", "doc", "pos").unionByName(settled.select("id", "doc", "pos"))
    return gone


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = batch.column("n_lines").to_numpy()
        gone = batch.column("gone")
        dropped, keep = np.zeros(len(lines), np.int64), []
        for i, n in enumerate(lines):
            bits = np.ones(n, np.uint8)
            if gone[i].is_valid:
                bits[gone[i].values.to_numpy()] = 0
            dropped[i] = n - bits.sum()
            keep.append(zlib.compress(np.packbits(bits).tobytes()))
        yield pa.record_batch([batch.column("id"), batch.column("doc"), batch.column("n_lines"), pa.array(dropped), pa.array(keep, pa.binary())], names=["id", "doc", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_docs: int = 10, keep_first: bool = False, min_chars: int = 1) -> DataFrame:
    """One row a document: ``id, doc`` (hash of id and text), ``n_lines, n_dropped`` and ``keep``, the compressed bitmap."""
    gone = dropped_lines(docs, id_column, text_column, min_docs, keep_first, min_chars)
    listed = gone.groupBy("id", "doc").agg(F.collect_set("pos").alias("gone"))
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    every = chosen.select("id", _document(F.col("id"), F.col("text")).alias("doc"), F.size(_lines(F.col("text"))).cast("long").alias("n_lines")).distinct()
    right = listed.select(F.col("id").alias("_id"), F.col("doc").alias("_doc"), "gone")
    met = every.join(right, every["id"].eqNullSafe(right["_id"]) & (every["doc"] == right["_doc"]), "left").select("id", "doc", "n_lines", "gone")
    kind = chosen.schema["id"].dataType.simpleString()
    return met.mapInArrow(_bitmaps, f"id {kind}, doc long, n_lines long, n_dropped long, keep binary")


def kept_text(text: str, keep: bytes) -> str:
    """The lines of ``text`` whose bit is set, joined by line feeds."""
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(line for line, bit in zip(lines, bits, strict=True) if bit)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            kept = [kept_text(t or "", k) if d else t for t, k, d in zip(*(batch.column(c).to_pylist() for c in ("text", "keep", "n_dropped")), strict=True)]
            yield pa.record_batch([batch.column("row"), batch.column("n_lines"), batch.column("n_dropped"), pa.array(kept, pa.string())], names=["row", "n_lines", "n_dropped", "text"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns ``id_column, n_lines, n_dropped, text`` (what stays) of every row of ``docs``; null texts stay null."""
    chosen = docs.select(F.col(id_column).alias("row"), F.col(text_column).alias("text"))
    chosen = chosen.withColumn("is", _document(F.col("row"), F.col("text")))
    met = chosen.join(bitmaps, chosen["row"].eqNullSafe(bitmaps["id"]) & (chosen["is"] == bitmaps["doc"]))
    kind = chosen.schema["row"].dataType.simpleString()
    out = met.select("row", "n_lines", "n_dropped", "keep", "text").mapInArrow(_applied, f"row {kind}, n_lines long, n_dropped long, text string")
    return out.withColumnRenamed("row", id_column)


def deduplicate_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_docs: int = 10, keep_first: bool = False, min_chars: int = 1) -> DataFrame:
    """Every row's text without the lines that go; bitmaps are written once before the texts meet them."""
    bitmaps = materialise(keep_bitmaps(docs, id_column, text_column, min_docs, keep_first, min_chars), shared_dir(docs.sparkSession), "bitmaps")
    return apply_bitmaps(docs, bitmaps, id_column, text_column)
