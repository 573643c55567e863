"""Alignment of two tokenizers over the same bytes: which tokens of A and B overlap, and where both cut.

Every byte of a text has an owner in A and one in B: token numbers repeated by token lengths. Where the pair of owners changes
from one byte to the next, a new link begins; where both change at once, both tokenizers cut, and the tokens between two
such places are a group. All texts of a slice are worked in one pass over such arrays.

A is a byte-level BPE, which reads a space and the text; B a SentencePiece model, which adds that space itself. Specials' strings
inside texts are plain text to both. A text that is null, empty or not given back byte for byte by both (B's normaliser, a U+2581 of its own) has no
tokens.

Links are counted in the tasks that make them and summed by id pair over all texts. The written table of texts keeps every
text's pairs with their multiplicity, sorted, as compressed differences. The ``listed`` most frequent pairs with their counts are
broadcast, at most that many whatever the input; only pairs beyond those are sent to their counts by an exchange, one row for a
text and pair. Repeated rows count each time. Null ids are ids as any other. An empty table gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
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
from .packing import _encoder

#: Pairs whose counts are broadcast (16 bytes each), and links that a task counts before it sends the counts.
LISTED, CHUNK = 1 << 21, 1 << 21
#: Bits of a B id in a packed pair.
B_BITS = 24


@dataclass
class Side:
    """Token lengths by id, and the bytes of a token by id."""

    length: np.ndarray
    token: list[bytes]

    @classmethod
    def of(cls, token: list[bytes]) -> Side:
        return cls(np.array([len(t) for t in token], np.int64), token)


@lru_cache(maxsize=2)
def _side_a(path: str | None) -> Side:
    encoding = _encoder(path)
    return Side.of([encoding.decode_single_token_bytes(i) for i in range(encoding.n_vocab)])


@lru_cache(maxsize=2)
def _side_b(path: str | None):
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        tokens.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return model, Side.of(tokens)


@dataclass
class Texts:
    """Ids of a slice of texts: those of row i are ``ids[first[i]:first[i + 1]]``."""

    ids: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, rows: list[list[int]]) -> Texts:
        first = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int64)
        return cls(np.fromiter((i for r in rows for i in r), np.int64, int(first[-1])), first)


def encoded(texts: list[str | None], path_a: str | None = None, path_b: str | None = None) -> tuple[Texts, Texts]:
    """Ids of both tokenizers; none for texts that one of them does not give back."""
    a, (model, b) = _side_a(path_a), _side_b(path_b)
    encode = _encoder(path_a).encode_ordinary
    rows_a, rows_b = [], []
    for text in texts:
        ids_a: list[int] = []
        ids_b: list[int] = []
        if text:
            whole = b" " + text.encode()
            ids_b = model.encode(text)
            if b"".join([b.token[i] for i in ids_b]) == whole:
                ids_a = encode(" " + text)
            if not ids_a or b"".join([a.token[i] for i in ids_a]) != whole:
                ids_a, ids_b = [], []
        rows_a.append(ids_a)
        rows_b.append(ids_b)
    return Texts.of(rows_a), Texts.of(rows_b)


@dataclass
class Aligned:
    """Links as places of tokens of A and B in byte order, and the group of every token; groups of a slice are numbered on."""

    link_a: np.ndarray
    link_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    groups: int


def align(length_a: np.ndarray, length_b: np.ndarray) -> Aligned:
    """Owners of every byte under both; consecutive different owner pairs are links, joint changes are cuts."""
    owner_a = np.repeat(np.arange(len(length_a)), length_a)
    owner_b = np.repeat(np.arange(len(length_b)), length_b)
    if not len(owner_a):
        none = np.zeros(0, np.int64)
        return Aligned(none, none, none, none, 0)
    new_a, new_b = np.ones(len(owner_a), bool), np.ones(len(owner_b), bool)
    new_a[1:], new_b[1:] = owner_a[1:] != owner_a[:-1], owner_b[1:] != owner_b[:-1]
    at = np.flatnonzero(new_a | new_b)
    group = np.cumsum(new_a & new_b) - 1
    return Aligned(owner_a[at], owner_b[at], group[new_a], group[new_b], int(group[-1]) + 1)


@lru_cache(maxsize=2)
def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to ``most`` with room for a mark after them, and which of these bytes count."""
    wide = len(str(most))
    text = np.char.rjust(np.arange(most + 1).astype("S"), wide).view(np.uint8).reshape(-1, wide)
    out = np.concatenate([text, np.zeros((most + 1, 1), np.uint8)], axis=1)
    used = out != ord(" ")
    return out, used


def group_digests(a: Texts, b: Texts, found: Aligned) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for every row; '' without tokens."""
    group = np.concatenate([2 * found.group_a, 2 * found.group_b + 1])
    ids = np.concatenate([a.ids, b.ids])
    order = np.argsort(group, kind="stable")
    group, ids = group[order], ids[order]
    digits, used = _digits(int(ids.max()) if len(ids) else 0)
    text, keep = digits[ids], used[ids]
    mark = np.full(len(ids), ord(","), np.uint8)
    last = np.flatnonzero(group[1:] != group[:-1])
    mark[last] = np.where(group[last] % 2 == 0, ord("|"), ord(";"))
    text[:, -1] = mark
    first = a.first + b.first
    ends = first[1:][np.diff(first) > 0]
    keep[ends - 1, -1] = False
    written = np.concatenate([[0], np.cumsum(keep.sum(axis=1))])
    flat = text[keep].tobytes()
    spans = zip(written[first[:-1]].tolist(), written[first[1:]].tolist(), strict=True)
    return [hashlib.sha256(flat[s:e]).hexdigest() if e > s else "" for s, e in spans]


def packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending pairs as differences, and how often each occurs."""
    return zlib.compress(np.diff(pairs, prepend=0).astype("<i8").tobytes() + times.astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<i8", n)), np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64)


def _aligned_slices(paths: tuple[str | None, str | None], batches: Iterator[pa.RecordBatch]):
    side_a, side_b = _side_a(paths[0]), _side_b(paths[1])[1]
    for whole in batches:
        for batch in slices(whole, "text", 1 << 18):
            a, b = encoded(batch.column("text").to_pylist(), *paths)
            yield batch, a, b, align(side_a.length[a.ids], side_b.length[b.ids])


def _texts(paths: tuple[str | None, str | None], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a text: what it says by itself, and its pairs."""
    for batch, a, b, found in _aligned_slices(paths, batches):
        n_a, n_b = np.diff(a.first), np.diff(b.first)
        heads = found.group_a[a.first[:-1][n_a > 0]]
        groups = np.zeros(len(n_a), np.int64)
        groups[n_a > 0] = np.diff(np.append(heads, found.groups))
        pair = (a.ids[found.link_a] << B_BITS) | b.ids[found.link_b]
        edges = np.searchsorted(found.link_a, a.first)
        lists = [packed(*np.unique(pair[s:e], return_counts=True)) for s, e in zip(edges[:-1], edges[1:], strict=True)]
        columns = [pa.array(n_a), pa.array(n_b), pa.array(groups), pa.array(np.diff(edges)), pa.array(group_digests(a, b, found), pa.string()), pa.array(lists, pa.binary())]
        yield pa.record_batch([batch.column("id"), *columns], names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link counts of the pairs of a task's texts."""
    held, size = [], 0

    def sent() -> pa.RecordBatch:
        pair, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        total = np.zeros(len(pair), np.int64)
        np.add.at(total, place, np.concatenate([n for _, n in held]))
        return pa.record_batch([pa.array(pair), pa.array(total)], names=["pair", "n"])

    for batch in batches:
        for data in batch.column("pairs").to_pylist():
            held.append(unpacked(data))
            size += len(held[-1][0])
            if size >= CHUNK:
                yield sent()
                held, size = [], 0
    if size:
        yield sent()


def pair_counts(texts: DataFrame) -> DataFrame:
    """``pair, n, best``: links of every id pair of all texts, and whether none of the same B id has more."""
    counted = texts.select("pairs").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    b = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    return counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(b)))


class Listed:
    """Counts of the most frequent pairs, for look-up by whole arrays."""

    def __init__(self, pair: np.ndarray, n: np.ndarray, best: np.ndarray):
        order = np.argsort(pair)
        self.pair, self.n, self.best = pair[order], n[order], best[order]

    def find(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those that are listed, and which are."""
        if not len(self.pair):
            return np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
        at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
        return at, self.pair[at] == pair


def _scored(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What listed pairs say of every text."""
    listed = shared.value
    for batch in batches:
        best, total = [], []
        for data in batch.column("pairs").to_pylist():
            pair, times = unpacked(data)
            at, known = listed.find(pair)
            n, is_best = (x[at[known]] for x in (listed.n, listed.best)) if len(listed.pair) else (pair[:0], np.zeros(0, bool))
            best.append(int(times[known][is_best].sum()))
            total.append(int((n * times[known]).sum()))
        kept = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(best, pa.int64()), pa.array(total, pa.int64())], names=[*kept, "n_best", "count_sum"])


def _others(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of every text that are not listed."""
    for batch in batches:
        rows, pairs, counts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, data in zip(batch.column("row").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
            pair, times = unpacked(data)
            rest = ~shared.value.find(pair)[1]
            rows += [row] * int(rest.sum())
            pairs.append(pair[rest])
            counts.append(times[rest])
        yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(np.concatenate(pairs)), pa.array(np.concatenate(counts))], names=["row", "pair", "times"])


def aligned_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Written table of a row a text: counts, digest of its groups, and its packed pairs with their multiplicity."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    texts = chosen.mapInArrow(partial(_texts, (path_a, path_b)), f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary")
    return materialise(texts.withColumn("row", F.monotonically_increasing_id()), shared_dir(spark), "texts")


def alignment(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_a: str | None = None, path_b: str | None = None, listed: int = LISTED) -> DataFrame:
    """``id_column, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, a row for every row of ``docs``."""
    spark = docs.sparkSession
    texts = aligned_texts(docs, id_column, text_column, path_a, path_b)
    counts = materialise(pair_counts(texts), shared_dir(spark), "pairs")
    many = counts.count()
    first = counts if many <= listed else counts.orderBy(F.desc("n"), "pair").limit(listed)
    top = first.toArrow()
    shared = spark.sparkContext.broadcast(Listed(*(top.column(c).to_numpy() for c in ("pair", "n", "best"))))
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    scored = texts.mapInArrow(partial(_scored, shared), schema)
    if many > listed:
        rare = texts.select("row", "pairs").mapInArrow(partial(_others, shared), "row long, pair long, times long").join(counts, "pair")
        rest = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
        met = scored.join(rest, "row", "left")
        scored = met.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return scored.select(F.col("id").alias(id_column), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
