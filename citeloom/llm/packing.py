"""Best-fit packing of tokenised documents into sequences, large items by matching.

A document is its token ids and an end id. A longer one than the capacity is cut into full pieces; its first piece
takes the rest. Pieces longer than a third of the capacity are matched: from the longest down, each with the longest
other one that still fits, so a sequence has at most two of them. Smaller pieces, from the longest down, go to the
tightest gap that takes them.

Only lengths matter to that plan, and there are no more lengths than the capacity. So the driver plans on the counts
of pieces by length (at most ``capacity`` numbers, whatever the input): runs of sequences that are filled alike. A
piece then finds its place from its length and its rank among the pieces of that length; ranks come from counts by
length and hash bucket, so the pieces of a hot length are spread over many tasks, equal rows among them.

Null and empty texts are the end id alone. Ties (equal length) are ranked by bucket, id, piece, start, checksum and
place in the written pieces; repeated rows each get a place. Null ids are packed as any other. An empty table gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialise, shared_dir
from ._text import slices

CAPACITY = 1024
END = 2
#: The pre-tokenizing pattern of the vocabulary, with possessive repeats; it splits alike.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def _encoder(vocabulary: str | None):
    """Byte-level BPE over a vocabulary file of ``base64 rank`` lines; gives the ids of the same vocabulary's JSON."""
    import tiktoken

    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


def token_ids(text: str, vocabulary: str | None = None) -> list[int]:
    """Ids of ``text``; the special token's string gives its own id, as the JSON tokenizer does."""
    encode = _encoder(vocabulary).encode_ordinary
    if SPECIAL not in text:
        return encode(text)
    ids: list[int] = []
    for k, part in enumerate(text.split(SPECIAL)):
        ids += [SPECIAL_ID] * (k > 0) + encode(part)
    return ids


def _pieces(vocabulary: str | None, capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = 0
    for whole in batches:
        for batch in slices(whole, "text"):
            owner, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*token_ids(text or "", vocabulary), END], dtype="<u4")
                edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k in range(len(edges) - 1):
                    owner.append(row)
                    piece.append(k)
                    start.append(edges[k])
                    length.append(edges[k + 1] - edges[k])
                    crc.append(zlib.crc32(ids[edges[k] : edges[k + 1]].tobytes()))
            ids_of = batch.column("id").take(pa.array(owner, pa.int64()))
            turn = np.arange(made, made + len(owner))
            made += len(owner)
            yield pa.record_batch([ids_of, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(turn, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32", "turn"])


@dataclass
class Plan:
    """Runs of pieces: those of ``length`` with ranks from ``rank`` on lie at ``offset`` of sequences from ``sequence`` on."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted((self.length << 44) + self.rank, (length << 44) + rank, "right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """How to pack ``counts`` pieces of each length (1 to ``capacity``)."""
    left, ranked = {s: c for s, c in counts.items() if c > 0}, dict.fromkeys(counts, 0)
    runs: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, how many)
    order: list[int] = []  # gaps in use, ascending
    total = 0

    def put(size: int, many: int, first: int, offset: int) -> None:
        runs.append((size, ranked[size], first, offset))
        ranked[size] += many
        left[size] -= many

    def leave(gap: int, first: int, many: int) -> None:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(order, gap)
        gaps[gap].append((first, many))

    large = sorted(s for s in left if 3 * s > capacity)
    for size in reversed(large):
        while left[size]:
            partners = [q for q in large[: bisect.bisect_right(large, min(size, capacity - size))] if left[q] > (q == size)]
            mate = partners[-1] if partners else None
            many = left[size] if mate is None else left[size] // 2 if mate == size else min(left[size], left[mate])
            put(size, many, total, 0)
            if mate is not None:
                put(mate, many, total, size)
            leave(capacity - size - (mate or 0), total, many)
            total += many
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect.bisect_left(order, size)
            if at == len(order):
                many = -(-left[size] // (capacity // size))
                leave(capacity, total, many)
                total += many
                continue
            gap = order[at]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = min(gap // size, left[size])
            filled = min(many, left[size] // each)
            for k in range(each):
                put(size, filled, first, capacity - gap + k * size)
            leave(gap - each * size, first, filled)
            if filled < many:
                leave(gap, first + filled, many - filled)
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 4)
    return Plan(*(table[:, k] for k in range(4)), total)


def _placed(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sequence, offset = shared.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
        kept = ["id", "piece", "start", "length", "ids_crc32"]
        yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: ``id_column, piece, start, length, ids_crc32, sequence_id, offset``.

    ``vocabulary``: path of a byte-level BPE rank file on every machine; by default the public 50k one.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    columns = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = materialise(chosen.mapInArrow(partial(_pieces, vocabulary, capacity), f"{columns}, turn long"), shared_dir(spark), "pieces")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "turn"), F.lit(buckets)))
    cells = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    planned = plan({r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32", "turn")
    ranked = pieces.withColumn("own", F.row_number().over(own)).join(base, ["length", "bucket"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own") - 1).alias("rank"))
    shared = spark.sparkContext.broadcast(planned)
    return ranked.mapInArrow(partial(_placed, shared), f"{columns}, sequence_id long, offset long").withColumnRenamed("id", id_column)
