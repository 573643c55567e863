"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation of a text maximises the sum of its pieces' scores. A search takes a text bit by bit and keeps
scores of the last ``longest piece`` positions and backpointers since the last boundary that every surviving path
shares: a position can still matter while it lies within the longest piece of the end, so whenever the paths from all
those positions meet in one boundary, the ids before it are committed. A text's ids come out as soon as they are
certain, in memory that does not grow with the text.

``search`` runs many such streams in step with numpy; ``Stream`` is one that takes bytes as they come. Where no piece of
the model holds a space after another character, all paths meet before every space that follows another character:
``encode`` begins a stream at each such boundary, searches equal streams of a slice once, and cuts long texts there into
slices. Models whose pieces cross words have a stream for each text. Ties go to the longest last piece.

Pieces and scores are read from a model file, whose path on every machine is a parameter; the search treats the scores as
those of a unigram model, whatever the file was trained as. Characters that are no piece become byte pieces. As usual,
spaces are written as U+2581 and a text gets one space in front, which decoding takes off again. A U+2581 of the text
itself becomes byte pieces, so decoding is exact for every text.

Null texts have null ids, empty ones none. Repeated rows are treated alike; other columns are passed over, whatever
their names; an empty table gives no rows. No shuffle: memory is one slice of rows, its distinct streams, and the ids of
its longest text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import _BASE, _BYTE, _INVERSE, Lookup, _power, mix, ragged, slices, utf8

#: Bytes of text that are searched together.
SLICE = 4 << 20
#: How much worse than the worst piece a character without a piece is; fixed by the format.
UNKNOWN_PENALTY = 10.0
MARK = "▁".encode()


class Model:
    """Pieces as bytes (space for U+2581), their scores, and the ids of the 256 byte pieces."""

    def __init__(self, pieces: list[tuple[bytes, float, int]], bytes_at: list[int]):
        self.size = 1 + max([i for _, _, i in pieces] + bytes_at)
        self.ids = {piece: (i, score) for piece, score, i in pieces}
        self.unknown = min((score for _, score, _ in pieces), default=0.0) - UNKNOWN_PENALTY
        self.longest = max((len(p) for p, _, _ in pieces), default=1)
        self.crossing = any(b" " in p.lstrip(b" ") for p, _, _ in pieces)
        self.bytes_at = np.array(bytes_at, np.int32)
        listed = list(self.ids.items())
        self.lookup = Lookup(np.array([_hash_of(p) for p, _ in listed], np.uint64))
        self.id_of, self.score_of = np.array([i for _, (i, _) in listed], np.int32), np.array([s for _, (_, s) in listed])
        text = {i: p for p, (i, _) in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(bytes_at)}
        runs = [text.get(i, b"") for i in range(self.size)]
        self.bytes, self.first = np.frombuffer(b"".join(runs), np.uint8), np.cumsum([0, *map(len, runs)])


def _hash_of(piece: bytes) -> int:
    data = np.frombuffer(piece, np.uint8)
    return int(mix((_BYTE[data] * _power(_BASE, len(data))).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(data)))[0])


@lru_cache(maxsize=4)
def load(path: str | None = None) -> Model:
    """The model in a SentencePiece file; by default the public 32k one."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    read = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, bytes_at = [], [0] * 256
    for i in range(read.get_piece_size()):
        if read.is_byte(i):
            bytes_at[int(read.id_to_piece(i)[3:5], 16)] = i
        elif not (read.is_control(i) or read.is_unknown(i) or read.is_unused(i)):
            plain.append((read.id_to_piece(i).encode().replace(MARK, b" "), read.get_score(i), i))
    return Model(plain, bytes_at)


def _width(lead: int) -> int:
    """Bytes of the character whose first byte is ``lead``."""
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Stream:
    """A Viterbi search over bytes that come in parts; ``feed`` and ``close`` give the ids that have become certain."""

    def __init__(self, model: Model):
        self.model = model
        self.data = bytearray()
        #: For each position of ``data``: best score, position before, id (-1: byte pieces); None where no path ends.
        self.best: list[tuple[float, int, int] | None] = [(0.0, -1, -1)]

    def _extend(self) -> None:
        end = len(self.best)
        chosen = None
        for start in range(max(0, end - self.model.longest), end):
            if self.best[start] is not None and (found := self.model.ids.get(bytes(self.data[start:end]))):
                score = self.best[start][0] + found[1]
                if chosen is None or score > chosen[0]:
                    chosen = (score, start, found[0])
        start = end - 1
        while start > 0 and self.data[start] & 0xC0 == 0x80:
            start -= 1
        whole = end - start == _width(self.data[start])
        if whole and self.best[start] is not None and bytes(self.data[start:end]) not in self.model.ids:
            score = self.best[start][0] + self.model.unknown
            if chosen is None or score > chosen[0]:
                chosen = (score, start, -1)
        self.best.append(chosen)

    def _commit(self, upto: int) -> list[int]:
        """Ids of the path to position ``upto``, which becomes the new beginning."""
        out, at = [], upto
        while at > 0:
            _, before, piece = self.best[at]
            out += [piece] if piece >= 0 else self.model.bytes_at[np.frombuffer(bytes(self.data[before:at]), np.uint8)][::-1].tolist()
            at = before
        del self.data[:upto]
        base = self.best[upto][0]
        moved = [None if b is None else (b[0] - base, b[1] - upto, b[2]) for b in self.best[upto:]]
        self.best = [(0.0, -1, -1), *moved[1:]]
        return out[::-1]

    def _meeting(self) -> int:
        """The last boundary that the paths from all positions that can still matter share."""
        reach = max(self.model.longest, 4)
        ends = {k for k in range(max(0, len(self.best) - reach), len(self.best)) if self.best[k] is not None}
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(self.best[last][1])
        return max(ends.pop(), 0) if ends else 0

    def feed(self, part: bytes) -> list[int]:
        out = []
        for byte in part:
            self.data.append(byte)
            self._extend()
            if len(self.best) % max(self.model.longest, 4) == 0 and (upto := self._meeting()):
                out += self._commit(upto)
        return out

    def close(self) -> list[int]:
        return self._commit(len(self.best) - 1)


def stream_ids(model: Model, data: bytes) -> list[int]:
    """Ids of bytes (spaces unescaped) by one stream."""
    stream = Stream(model)
    return stream.feed(data) + stream.close()


class _Streams:
    """Searches over many byte runs in step, longest first: a window of scores and the backpointers not committed yet."""

    def __init__(self, model: Model, n: int):
        self.model, self.window = model, max(model.longest, 4)
        self.best = np.full((n, self.window + 1), -np.inf)
        self.best[:, 0] = 0.0
        self.origin = 0
        self.step, self.token = np.zeros((n, 2 * self.window), np.int32), np.zeros((n, 2 * self.window), np.int32)
        self.base = np.zeros(n, np.int64)
        self.rows: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []

    def make_room(self, end: int, active: int) -> None:
        """Columns for backpointers up to ``end``; those before what every active stream has committed are let go."""
        width = self.step.shape[1]
        if end - self.origin < width:
            return
        least = int(self.base[:active].min())
        gone = least - self.origin
        more = max(0, end - least + self.window - width)
        for name in ("step", "token"):
            held = getattr(self, name)[:active, gone:]
            setattr(self, name, np.concatenate([held, np.zeros((active, gone + more), np.int32)], axis=1))
        self.origin = least

    def meeting(self, end: int, row: np.ndarray) -> np.ndarray:
        """For each of ``row`` the last boundary that the paths from all positions of the window share."""
        ends = np.arange(end - self.window + 1, end + 1)
        live = np.isfinite(self.best[row][:, ends % (self.window + 1)]) & (ends >= 0)
        paths = np.where(live, ends, np.where(live, ends, -1).max(axis=1)[:, None])
        todo = np.arange(len(row))
        while len(todo):
            high, low = paths[todo].max(axis=1), paths[todo].min(axis=1)
            apart = high > low
            todo, high = todo[apart], high[apart]
            before = high - self.step[row[todo], high - self.origin]
            paths[todo] = np.where(paths[todo] == high[:, None], before[:, None], paths[todo])
        return paths[:, 0]

    def commit(self, row: np.ndarray, upto: np.ndarray) -> None:
        """Give out the ids of the paths of ``row`` to ``upto``."""
        row, upto = row[upto > self.base[row]], upto[upto > self.base[row]]
        if not len(row):
            return
        least = int(self.base[row].min())
        out = np.full((len(row), int(upto.max()) - least), -1, np.int32)
        at, todo = upto.copy(), np.arange(len(row))
        while len(todo):
            column = at[todo] - self.origin
            out[todo, at[todo] - 1 - least] = self.token[row[todo], column]
            at[todo] -= self.step[row[todo], column]
            todo = todo[at[todo] > self.base[row[todo]]]
        used = out >= 0
        self.rows.append(np.repeat(row, used.sum(axis=1)))
        self.ids.append(out[used])
        self.base[row] = upto


def search(model: Model, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the runs of ``size`` bytes at ``start``: joined, and how many each has."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    many, n = int(size[0]) if len(size) else 0, len(start)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=total[1:])
    inverse = _power(_INVERSE, len(data) + 1)
    inner = np.append((data & 0xC0) == 0x80, False)
    streams = _Streams(model, n)
    best, ring = streams.best, streams.window + 1
    lead = np.zeros(n, np.int64)
    active = n
    for end in range(1, many + 1):
        while size[active - 1] < end:
            active -= 1
        streams.make_room(end, active)
        step, token, column = streams.step, streams.token, end - streams.origin
        own = data[start[:active] + end - 1]
        lead[:active] = np.where((own & 0xC0) == 0x80, lead[:active], end - 1)
        best[:active, end % ring] = -np.inf
        step[:active, column], token[:active, column] = 1, model.bytes_at[own]
        row = np.flatnonzero((size[:active] == end) | ~inner[start[:active] + end])
        known = np.zeros(active, bool)
        for length in range(min(end, model.longest), 0, -1):
            at = row[np.isfinite(best[row, (end - length) % ring])]
            if not len(at):
                continue
            first = start[at] + end - length
            found = model.lookup.find(mix((total[first + length] - total[first]) * inverse[first] + np.uint64(length)))
            hit = found >= 0
            at, found = at[hit], found[hit]
            known[at[lead[at] == end - length]] = True
            score = best[at, (end - length) % ring] + model.score_of[found]
            better = score > best[at, end % ring]
            at, found = at[better], found[better]
            best[at, end % ring], step[at, column], token[at, column] = score[better], length, model.id_of[found]
        at = row[~known[row]]
        score = best[at, lead[at] % ring] + model.unknown
        better = score > best[at, end % ring]
        at = at[better]
        best[at, end % ring], step[at, column], token[at, column] = score[better], 1, model.bytes_at[own[at]]
        done = np.arange(int(np.searchsorted(-size[:active], -end)), active)
        streams.commit(done, np.full(len(done), end))
        if end % streams.window == 0 and len(done) < active:
            row = np.arange(active - len(done))
            streams.commit(row, streams.meeting(end, row))
    row = order[np.concatenate([np.zeros(0, np.int64), *streams.rows])]
    place = np.argsort(row, kind="stable")
    return np.concatenate([np.zeros(0, np.int32), *streams.ids])[place], np.bincount(row, minlength=n)


def _boundaries(data: np.ndarray, rows: np.ndarray, crossing: bool) -> np.ndarray:
    """Where streams begin: at each text, and where all paths meet in any case."""
    begins = np.zeros(len(data), bool)
    if not crossing:
        begins[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20)
    begins[rows[:-1][np.diff(rows) > 0]] = True
    return np.flatnonzero(begins)


def _encode_slice(data: np.ndarray, rows: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts with their spaces in front, and where each text's begin."""
    start = _boundaries(data, rows, model.crossing)
    end = np.append(start[1:], len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=total[1:])
    keys = mix((total[end] - total[start]) * _power(_INVERSE, len(data))[start] + (end - start).astype(np.uint64))
    _, where, stream = np.unique(keys, return_index=True, return_inverse=True)
    ids, counts = search(model, data, start[where], (end - start)[where])
    out, ends = ragged(ids, np.concatenate([[0], np.cumsum(counts)]), stream)
    return out, ends[np.searchsorted(start, rows)]


def encode(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every text of a column (null: none), joined, and where each text's begin (one more at the end)."""
    prefixed = pa.array([b"" if not t else b" " + t.encode() for t in column.to_pylist()], pa.binary()).cast(pa.string())
    data, rows = utf8(prefixed)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(rows), np.int64)
    if len(rows) > 2 or len(data) <= SLICE or model.crossing:
        return _encode_slice(data, rows, model)
    out, at = [], 0
    while at < len(data):  # one long text: slices that end where all paths meet
        meets = _boundaries(data[at : at + 2 * SLICE], np.array([0, 1]), False)
        later = meets[meets >= SLICE]
        upto = at + (int(later[0]) if len(later) and at + 2 * SLICE < len(data) else len(data) - at)
        out.append(_encode_slice(data[at:upto], np.array([0, upto - at]), model)[0])
        at = upto
    ids = np.concatenate(out)
    return ids, np.array([0, len(ids)])


def decode(ids: np.ndarray, first: np.ndarray, model: Model) -> list[bytes]:
    """The texts of joined ids, as UTF-8."""
    data, ends = ragged(model.bytes, model.first, ids)
    return [data[ends[a] : ends[b]].tobytes()[1:] for a, b in zip(first[:-1], first[1:], strict=True)]


def _encode(path: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = load(path)
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            ids, first = encode(batch.column("text"), model)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()), mask=batch.column("text").is_null())
            yield pa.record_batch([batch.column("id"), lists], names=["id", "ids"])


def _decode(path: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = load(path)
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            lists = batch.column("ids")
            first = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            texts = decode(lists.flatten().to_numpy(zero_copy_only=False), first, model)
            kept = [None if null else t for t, null in zip(texts, lists.is_null().to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("id"), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "text"])


def encode_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """``id_column`` and ``ids`` (array of int) for every row."""
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(partial(_encode, path), f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode_ids(encoded: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", path: str | None = None) -> DataFrame:
    """``id_column`` and ``text`` for every row of ids."""
    chosen = encoded.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(partial(_decode, path), f"id {kind}, text string").withColumnRenamed("id", id_column)


def _digest(path: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = load(path)
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            ids, first = encode(batch.column("text"), model)
            back = decode(ids, first, model)
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            raw = ids.astype("<u4")
            crcs = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]
            columns = [pa.array(np.diff(first), pa.int64()), pa.array(crcs, pa.int64()), pa.array([zlib.crc32(t) for t in back], pa.int64()), pa.array([a == b for a, b in zip(back, texts, strict=True)])]
            yield pa.record_batch([batch.column("id"), *columns], names=["id", "n_ids", "ids_crc32", "decoded_crc32", "exact"])


def round_trip(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """``id_column``, ``n_ids``, ``ids_crc32`` (little-endian 32-bit ids), ``decoded_crc32`` and ``exact``: whether
    decoding the ids gives the text again."""
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    out = chosen.mapInArrow(partial(_digest, path), f"id {kind}, n_ids long, ids_crc32 long, decoded_crc32 long, exact boolean")
    return out.withColumnRenamed("id", id_column)
