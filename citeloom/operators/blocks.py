"""All pairs of rows as pairs of blocks, for thresholds so low that most rows would meet by any token.

Rows are packed into blocks, one row of arrays each, which are written once and crossed with each other. A pair of blocks is
compared by numpy inside a task, a strip of rows at a time, and only pairs at the threshold leave it. The work is that of all
pairs, a few nanoseconds each; no pair is shuffled or written, and memory is that of two blocks and a strip.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialise

#: Rows and cells of a block at most (a row of more cells is a block), rows of a strip, and parts into which each side is dealt at most.
ROWS, CELLS, STRIP, PARTS = 4096, 1 << 20, 128, 256
#: Tokens that are columns of a dense matrix; rarer ones are met by their codes.
TOP = 256
#: Pairs that are added up exactly at once.
TURN = 4096

Pairs = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]


def pack(batches: Iterator[pa.RecordBatch], parts: int, cells: str | None = None) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows: ``block`` and each column as an array. ``cells`` is an array column whose elements are counted."""

    def block(k: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        whole = [pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), c.chunk(0)) for c in table.columns]
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() + k * parts], pa.int64()), *whole], ["block", *table.column_names])

    k, held, n, size = 0, [], 0, 0
    for batch in batches:
        sizes = np.asarray(batch.column(cells).value_lengths()) if cells else np.zeros(len(batch), np.int64)
        at = 0
        while at < len(batch):
            over = np.searchsorted(np.cumsum(sizes[at:]), CELLS - size, "right")
            take = min(ROWS - n, len(batch) - at, int(over))
            if take or not n:
                take = max(take, 1)
                held, n, size, at = [*held, batch.slice(at, take)], n + take, size + int(sizes[at : at + take].sum()), at + take
            if n >= ROWS or at < len(batch):
                yield block(k, held)
                k, held, n, size = k + 1, [], 0, 0
    if held:
        yield block(k, held)


def blocks(rows: DataFrame, n: int, folder: str, cells: str | None = None, by: str | None = None) -> DataFrame:
    """``rows``, about ``n``, dealt evenly, packed in the order of ``by`` and written."""
    parts = max(1, -(-n // ROWS))
    dealt = rows.repartition(parts)
    dealt = dealt.sortWithinPartitions(by) if by else dealt
    schema = "block long, " + ", ".join(f"`{c}` array<{kind}>" for c, kind in rows.dtypes)
    return materialise(dealt.mapInArrow(lambda batches: pack(batches, max(parts, 1 << 20), cells), schema), folder, "blocks")


def crossed(packed: DataFrame, compare: Callable[[dict, dict], Pairs], kind: str, also: tuple[str, ...] = ()) -> DataFrame:
    """``a, b, value`` of what ``compare`` finds between two blocks, given as dicts of their columns: places in each and values.

    Columns ``a`` and ``b`` have ids of type ``kind``, the lesser first; rows of one id make no pair. Strings
    ``also`` of both rows come as ``a_`` and ``b_``, of which either may be the lesser's.
    """
    parts = max(1, min(packed.count(), PARTS))
    side = lambda p: packed.repartition(parts).select(*(F.col(c).alias(f"{p}_{c}") for c in packed.columns))
    one, two = F.col("a_block"), F.col("b_block")
    odd = (one + two) % 2 == 1
    pairs = side("a").crossJoin(side("b")).where((one == two) | ((one < two) & ~odd) | ((one > two) & odd))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                x, y = ({c[2:]: batch.column(c)[k].values if pa.types.is_list(batch.column(c).type) else batch.column(c)[k].as_py() for c in batch.schema.names if c.startswith(p)} for p in ("a_", "b_"))
                for i, j, value in compare(x, y):
                    if x["block"] == y["block"]:
                        upper = i < j
                        i, j, value = i[upper], j[upper], value if value is None else value[upper]
                    if len(i):
                        known = pa.nulls(len(i), pa.float64()) if value is None else pa.array(value, pa.float64())
                        own = [z[c].take(pa.array(at)) for c in ("id", *also) for z, at in ((x, i), (y, j))]
                        yield pa.RecordBatch.from_arrays([*own[:2], known, *own[2:]], ["a", "b", "value", *more])

    more = [f"{p}_{c}" for c in also for p in "ab"]
    found = pairs.mapInArrow(each, f"a {kind}, b {kind}, value double" + "".join(f", {c} string" for c in more))
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value", *more)


def coded(tokens: DataFrame, folder: str) -> DataFrame:
    """``tokens`` (token and others) with a number ``code`` instead of ``token``, the most frequent under ``TOP``; those of one row go."""
    count = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    listed = materialise(count.withColumn("code", F.monotonically_increasing_id() + TOP), folder, "vocabulary")
    place = F.row_number().over(Window.orderBy(F.desc("df"), "token")) - 1
    top = F.broadcast(listed.orderBy(F.desc("df"), "token").limit(TOP).select("token", place.cast("long").alias("code")))
    rest = tokens.join(top, "token", "left_anti").join(listed.select("token", "code"), "token")
    return tokens.join(top, "token").unionByName(rest).drop("token")


def _sparse(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Columns ``cells`` (arrays of code and weight) as a dense matrix of the top tokens, and row, code and weight of the others."""
    cells = block["cells"]
    row = np.repeat(np.arange(len(cells)), np.asarray(cells.value_lengths()))
    flat = cells.flatten()
    code, weight = np.asarray(flat.field("code")), np.asarray(flat.field("weight"))
    dense, top = np.zeros((len(cells), TOP)), code < TOP
    dense[row[top], code[top]] = weight[top]
    return dense, row[~top], code[~top], weight[~top]


def products(x: dict, y: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By strips of rows of ``x``: the first row, products with all rows of ``y`` over the top tokens in single precision and over the
    others, and both dense matrices."""
    (a, arow, acode, aw), (b, brow, bcode, bw) = _sparse(x), _sparse(y)
    single, other = a.astype(np.float32), np.ascontiguousarray(b.astype(np.float32).T)
    order = np.argsort(bcode, kind="stable")
    brow, bcode, bw = brow[order], bcode[order], bw[order]
    words, own = np.unique(acode, return_inverse=True)
    low = np.searchsorted(bcode, words, "left")
    many = np.searchsorted(bcode, words, "right") - low
    met = many[own] > 0
    arow, aw, own = arow[met], aw[met], own[met]
    for first in range(0, len(a), STRIP):
        last = min(first + STRIP, len(a))
        cut = slice(*np.searchsorted(arow, (first, last)))
        n = many[own[cut]]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low[own[cut]] - ends + n, n)
        sums = np.bincount(np.repeat((arow[cut] - first) * len(b), n) + brow[at], np.repeat(aw[cut], n) * bw[at], (last - first) * len(b))
        yield first, single[first:last] @ other, sums.reshape(last - first, len(b)), a, b


def cosines(least: float) -> Callable[[dict, dict], Pairs]:
    """Rows of unit length with a product of ``least`` or more; single precision only chooses what is added up in double precision."""

    def compare(x: dict, y: dict) -> Pairs:
        for first, near, rare, a, b in products(x, y):
            i, j = np.nonzero(near + rare >= least - 1e-4)
            for k in range(0, len(i), TURN):
                r, c = i[k : k + TURN], j[k : k + TURN]
                value = np.einsum("ij,ij->i", a[first + r], b[c]) + rare[r, c]
                good = value >= least
                yield first + r[good], c[good], value[good]

    return compare


def overlaps(least: float) -> Callable[[dict, dict], Pairs]:
    """Sets (cells of weight 1, ``k`` members) with a Jaccard similarity of ``least`` or more; all sums are whole numbers."""

    def compare(x: dict, y: dict) -> Pairs:
        p, q = (np.asarray(z["k"]).astype(np.float64) for z in (x, y))
        for first, near, rare, *_ in products(x, y):
            both = near + rare
            share = both / (p[first : first + len(both), None] + q[None, :] - both)
            i, j = np.nonzero(share >= least)
            yield first + i, j, share[i, j]

    return compare


def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, value, n`` with 64 bits of a string's letters (first and second occurrences, letters modulo 32) and of its pairs of
    neighbouring letters, ends included (modulo 64)."""
    for batch in batches:
        letters, pairs = np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.uint64)
        for k, text in enumerate(batch.column("value").to_pylist()):
            codes = [ord(c) for c in text]
            seen = twice = both = 0
            for c in codes:
                twice |= seen & (1 << c % 32)
                seen |= 1 << c % 32
            for c, d in zip([0, *codes], [*codes, 0]):
                both |= 1 << (c * 31 + d) % 64
            letters[k], pairs[k] = seen | twice << 32, both
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(letters.view(np.int64)), pa.array(pairs.view(np.int64))], [*batch.schema.names, "letters", "pairs"])


def near_strings(least: float) -> Callable[[dict, dict], Pairs]:
    """Strings (``masks``, in order of length) that may have an edit similarity of ``least`` or more: ``e`` edits take away or add ``e`` letters and
    ``2 * e`` pairs of letters at most."""

    def lengths(n: np.ndarray) -> list[tuple[int, int, int]]:
        """Each length, its first place, and the place after its last."""
        values, first = np.unique(n, return_index=True)
        return list(zip(values.tolist(), first.tolist(), [*first.tolist()[1:], len(n)]))

    def compare(x: dict, y: dict) -> Pairs:
        (n, a, ap), (m, b, bp) = ((np.asarray(z["n"]), np.asarray(z["letters"]).view(np.uint64), np.asarray(z["pairs"]).view(np.uint64)) for z in (x, y))
        for long, low, high in lengths(n):
            for other, at, end in lengths(m):
                most = int(np.floor((1 - least) * max(long, other) + 1e-9))
                if abs(long - other) > most:
                    continue
                for first in range(low, high, STRIP):
                    last = min(first + STRIP, high)
                    i, j = np.nonzero(np.bitwise_count(a[first:last, None] & ~b[None, at:end]) <= most)
                    i, j = i + first, j + at
                    near = (np.bitwise_count(b[j] & ~a[i]) <= most) & (np.bitwise_count(ap[i] & ~bp[j]) <= 2 * most) & (np.bitwise_count(bp[j] & ~ap[i]) <= 2 * most)
                    yield i[near], j[near], None

    return compare
