"""Source divergence audit: how far the word distributions of the sources of a language lie from each other and from the whole.

Terms are runs of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]`` with A-Z lower-cased. A language keeps the V terms of at least ``min_docs`` of its
documents (rows). A group (language, source) gives a kept term p = 1 + floor(10**9 (count + 2) / (N + 2 V)), N its
occurrences of kept terms; the language as a whole likewise. Two of them diverge at a term by
floor((p - q)**2 / (p + q)). Everything is done in whole numbers: the quotient by long division in base 1000, so it is
exact for up to 9 * 10**15 occurrences.

Terms of a language are dealt to blocks by hash. In a block a group is a vector of counts by place, compressed with zlib, and groups
sit in seats by hash of the source. Seats stay where they are, a partition each; their peers' vectors travel. With n seats, seat i
meets seat (r - i) mod n in round r, so in n rounds every two seats meet once, and each meets itself once. In a meeting of seats
i < j only the vectors of j move, and every meeting of two groups gives the row of each side. A round is a job that writes its
sums; a meeting holds two seats of one block, whatever the size of the corpus or of a source. The terms on which a group stands out from
its language are ranked when its vectors are made: a heap of the ``top`` first in every block, merged by rank.

Null text, language and source are read as ''. Repeated rows count each time. Groups without terms have rows too; without any
kept term all values are 0 and no term has a row. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialise, shared_dir

#: The same runs over the bytes of UTF-8: every byte of a code point from U+0080 on is 0x80 or more.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Terms that a task holds before it sends their counts; rows of a block of terms; groups meant for a seat; seats of a language at most;
#: shares that a meeting holds at a time; parts of a source's terms that meet their group's row apart.
HELD, BLOCK, SEAT, SEATS, CELLS, SALT = 1 << 19, 1 << 16, 4, 64, 1 << 21, 32
ONE = 10**9


def terms(text: str) -> list[bytes]:
    return [t.lower() for t in _TERM.findall(text.encode())]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every term of a group, for the rows of a task."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in held.items():
            n = np.fromiter(found.values(), np.int64, len(found))
            columns = [pa.array([lang] * len(found), pa.string()), pa.array([source] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(n >> 32), pa.array(n & 0xFFFFFFFF)]
            yield pa.record_batch(columns, names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            own = held.setdefault((lang, source), {})
            before = len(own)
            for term, n in Counter(terms(text)).items():
                own[term] = own.get(term, 0) + (n << 32) + 1
            size += len(own) - before
            if size >= HELD:
                yield from sent()
                held, size = {}, 0
    yield from sent()


def kept_counts(docs: DataFrame, lang_column: str = "lang", source_column: str = "source", text_column: str = "text", min_docs: int = 10) -> DataFrame:
    """``lang, source, term, n`` for kept terms, and ``leads`` on one row of each (lang, term); one exchange, by language and term."""
    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang_column, "lang"), (source_column, "source"), (text_column, "text"))))
    parts = read.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    counts = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    own = Window.partitionBy("lang", "term")
    known = counts.withColumn("all", F.sum("docs").over(own)).withColumn("leads", (F.row_number().over(own.orderBy("source")) == 1).cast("long"))
    return known.where(F.col("all") >= min_docs).select("lang", "source", "term", "n", "leads")


def shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(10**9 (count + 2) / (n + 2 v)) exactly, by long division in base 1000."""
    by = max(n + 2 * v, 1)
    quotient, rest = np.divmod(counts.astype(np.int64) + 2, by)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, by)
        quotient = quotient * 1000 + digits
    return quotient + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Counts other than 0 by ascending place."""
    steps = np.diff(places, prepend=0).astype("<u4")
    return zlib.compress(steps.tobytes() + counts.astype("<i8").tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64)), np.frombuffer(raw, "<i8", n, 4 * n)


_BLOCK = "kind string, lang string, block int, source string, seat int, seats int, n long, v long, size int, vector binary, term string, value long"
_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_MEETING = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _block(rows: pa.Table, top: int) -> pa.Table:
    """Vectors of all groups of a language over one block of terms, and the heaps of its foremost terms."""
    lang, block = rows.column("lang")[0].as_py(), rows.column("block")[0].as_py()
    term = np.array([t.encode() if t is not None else b"" for t in rows.column("term").to_pylist()], object)
    count = rows.column("n").to_numpy()
    names, place = np.unique(term[count > 0], return_inverse=True) if (count > 0).any() else (np.zeros(0, object), np.zeros(0, np.int64))
    total = np.zeros(len(names), np.int64)
    np.add.at(total, place, count[count > 0])
    v, all_n = rows.column("v")[0].as_py(), rows.column("all_n")[0].as_py()
    whole = shares(total, all_n, v)
    code = rows.column("source").combine_chunks().dictionary_encode()
    sources, owner = code.dictionary.to_pylist(), code.indices.to_numpy()
    own_n, seat = rows.column("own_n").to_numpy(), rows.column("seat").to_numpy()
    seats = rows.column("seats")[0].as_py()
    where = np.full(len(count), -1, np.int64)
    where[count > 0] = place
    out: list[tuple] = []
    order = np.argsort(owner, kind="stable")
    edges = np.searchsorted(owner[order], np.arange(len(sources) + 1))
    for k, source in enumerate(sources):
        mine = order[edges[k] : edges[k + 1]]
        one = mine[0]
        mine = mine[where[mine] >= 0]
        mine = mine[np.argsort(where[mine])]
        at, n = where[mine], count[mine]
        out.append(("vector", lang, block, source, int(seat[one]), seats, int(own_n[one]), v, len(names), packed(at, n), None, None))
        p, q = shares(n, int(own_n[one]), v), whole[at]
        more = np.flatnonzero(p > q)
        value = divergence(p[more], q[more])
        if len(value) > top:  # only those that reach the top-th value meet in the heap
            more, value = (x[value >= np.partition(value, len(value) - top)[len(value) - top]] for x in (more, value))
        for less, i in heapq.nsmallest(top, zip((-value).tolist(), at[more].tolist(), strict=True)):
            out.append(("term", lang, block, source, None, None, None, None, None, None, names[i].decode(), -less))
    columns = list(zip(*out, strict=True))
    kinds = [_TYPES[c.split()[1]] for c in _BLOCK.split(", ")]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_NAMES)


class _Seat:
    """The groups of a seat with their vectors over one block."""

    def __init__(self, rows: pa.Table):
        self.names = rows.column("source").to_pylist()
        self.n, self.v = rows.column("n").to_pylist(), rows.column("v")[0].as_py()
        self.vectors = [unpacked(x) for x in rows.column("vector").to_pylist()]

    def shares(self, low: int, high: int) -> np.ndarray:
        """A row a group: its shares at the places from ``low`` to ``high``."""
        out = np.zeros((len(self.names), high - low), np.int64)
        for row, n, (places, counts) in zip(out, self.n, self.vectors, strict=True):
            a, b = np.searchsorted(places, (low, high))
            row[places[a:b] - low] = counts[a:b]
            row[:] = shares(row, n, self.v)
        return out


def _meet(residents: pa.Table, visitors: pa.Table) -> pa.Table:
    """All meetings of two seats over one block, both directions of each; a seat that visits itself meets every two once."""
    if not residents.num_rows or not visitors.num_rows:
        return _MEETING.empty_table()
    lang, size = residents.column("lang")[0].as_py(), residents.column("size")[0].as_py()
    same = residents.column("seat")[0].as_py() == visitors.column("from")[0].as_py()
    own = _Seat(residents)
    peers = own if same else _Seat(visitors)
    far = np.zeros((len(own.names), len(peers.names)), np.int64)
    step = max(1, CELLS // (len(own.names) + len(peers.names)))
    for low in range(0, size, step):
        p = own.shares(low, min(low + step, size))
        q = p if same else peers.shares(low, min(low + step, size))
        for i, row in enumerate(p):
            far[i] += divergence(row, q).sum(axis=1)
    a, b, value = [], [], []
    for i, name in enumerate(own.names):
        for j, peer in enumerate(peers.names):
            if not same or name < peer:
                a += (name, peer)
                b += (peer, name)
                value += (int(far[i, j]),) * 2
    return pa.Table.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value, pa.int64())], schema=_MEETING)


def _vectors(docs: DataFrame, counts: DataFrame, lang_column: str, source_column: str) -> DataFrame:
    """Rows of every (lang, block, source): kept terms with counts, and one of count 0 for the group itself."""
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang_column, "lang"), (source_column, "source"))))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.sum("leads").alias("leads"), F.count("*").alias("cells"))
    groups = named.distinct().join(sums, ["lang", "source"], "left").na.fill(0)
    rows = F.greatest(F.lit(BLOCK), 4 * F.col("groups"))
    by_lang = groups.groupBy("lang").agg(F.sum("own_n").alias("all_n"), F.sum("leads").alias("v"), F.sum("cells").alias("cells"), F.count("*").alias("groups"))
    by_lang = by_lang.select("lang", "all_n", "v", F.greatest(F.lit(1), F.ceil(F.col("cells") / rows)).cast("int").alias("blocks"), F.least(F.lit(SEATS), F.ceil(F.col("groups") / F.lit(SEAT))).cast("int").alias("seats"))
    known = groups.select("lang", "source", "own_n").join(by_lang, "lang").withColumn("seat", F.pmod(F.xxhash64("source", F.lit(7)), F.col("seats")).cast("int"))
    empty = known.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"))
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    parts = counts.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term", F.lit(3)), F.lit(SALT)).cast("int").alias("salt"))
    filled = parts.join(salted, ["lang", "source", "salt"]).drop("salt").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    return empty.unionByName(filled).drop("blocks")


def _rounds(spark: SparkSession, vectors: DataFrame, folder: str) -> list[DataFrame]:
    """The meetings of every round, written round by round; residents keep their partitions all the while."""
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seated = vectors.repartition(places, "lang", "block", "seat").persist(StorageLevel.MEMORY_AND_DISK)
    last = seated.agg(F.max("seats").alias("n")).first()["n"] or 0
    done = []
    for r in range(last):
        to = F.pmod(F.lit(r) - F.col("seat"), F.col("seats")).cast("int")
        playing = seated.where(F.col("seats") > r)
        residents = playing.where(to >= F.col("seat"))
        visitors = playing.where(to <= F.col("seat")).withColumn("from", F.col("seat")).withColumn("seat", to)
        keys = ["lang", "block", "seat"]
        met = residents.groupBy(*keys).cogroup(visitors.groupBy(*keys)).applyInArrow(_meet, "lang string, source string, item string, value long")
        done.append(materialise(met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), folder, f"round-{r}"))
    seated.unpersist()
    return done


def audit(docs: DataFrame, lang_column: str = "lang", source_column: str = "source", text_column: str = "text", min_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``: all peers of a group by divergence, and its foremost ``top`` terms."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    counts = materialise(kept_counts(docs, lang_column, source_column, text_column, min_docs), folder, "counts")
    dealt = _vectors(docs, counts, lang_column, source_column)

    def made(rows: pa.Table) -> pa.Table:
        return _block(rows, top)

    blocks = materialise(dealt.groupBy("lang", "block").applyInArrow(made, _BLOCK), folder, "blocks")
    rounds = _rounds(spark, blocks.where(F.col("kind") == "vector").drop("kind", "term", "value"), folder)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    foremost = blocks.where(F.col("kind") == "term").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")).alias("rank")).where(F.col("rank") <= top)
    if not rounds:
        return foremost
    pairs = reduce(DataFrame.unionByName, rounds).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).unionByName(foremost)
