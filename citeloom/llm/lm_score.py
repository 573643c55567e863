"""Cross-entropy difference scoring: per-token loss under a target model minus that under a background model.

Both models are bigram models over all words of the corpus, with a word for unseen ones and a start mark. Both are smoothed
alike, by ``strength`` pseudo-counts spread as the model's own unigrams, and matched in size: background counts are scaled to
the target's total. The target is the labelled good text; the background is all text. A document's score is the mean over its
words of the difference of the two losses in bits; lower means closer to the target. With ``vocabulary`` a number, both models
know that many most frequent words only, and all others as one.

The loss of word w after v is log2(c(v) + strength) - log2(c(v w) + strength * unigram(w)). The driver gets the ``LISTED`` most
frequent words with their counts and a matrix of counts of pairs of the ``PAIRED`` most frequent, both of a fixed size, and
broadcasts them: tasks work out what these say by themselves. Everything else goes through one exchange: pairs that end in a
word not listed by that word's hash, other pairs by their own. A place gets every occurrence of a pair, and of a word that is
not listed, so it counts them exactly and sends each row its part of the losses. Pairs of two listed words travel as their numbers,
others as hashes. Places grow in number with the corpus. What
meets in one is bounded by the share of the corpus that words beyond the listed, and pairs with a word beyond the paired,
have; no group is one of frequent words.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, told apart by a 64-bit hash, pairs by another; equally frequent words are
ranked by it. Null and empty texts have no words: losses and score are null. Label rows with a null id or label are ignored, and of
several labels of one id the worst counts. Without any target document both models are uniform over nothing seen and the
score is the background's distance from uniform. Repeated rows count and are scored each time; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._shared import materialise, shared_dir
from ._text import _PLACE, Lookup, mix, slices, words

#: Words that a task counts before it sends the counts.
CHUNK = 1 << 22
#: Pairs that a task holds before it sends them to their places, and pairs that a place is meant to get.
SENT, HELD = 1 << 19, 1 << 21
#: Most frequent words whose counts are broadcast, and those of them whose pairs are.
LISTED, PAIRED = 1 << 16, 1 << 10
#: Rows whose number agrees but for this many bits get their parts of the losses together.
HOME = 12
#: What a packed record counts for: background and score, target, background only, score only.
BOTH, TARGET, BACKGROUND, SCORED = range(4)
#: What a packed record knows of its pairs: a word that is not listed, a listed word after one that is not, two listed words (or a start).
WORD_OPEN, PAIR_OPEN, NUMBERED = range(3)
#: Bits of the map that tells most documents without a good label before their texts are dealt.
MAPPED = 1 << 26


def _sent(keys: list[np.ndarray], weights: list[np.ndarray]) -> pa.RecordBatch:
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    weight = np.concatenate(weights)
    background, target = np.bincount(place, minlength=len(key)), np.bincount(place, weights=weight, minlength=len(key))
    return pa.record_batch([pa.array(key.astype(np.int64)), pa.array(background.astype(np.int64)), pa.array(target.astype(np.int64))], names=["key", "background", "target"])


def _counted(read, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the keys that ``read`` gives for slices of rows, of all rows and of the target's."""
    keys, weights, held = [], [], 0
    for whole in batches:
        for batch in slices(whole, "text"):
            found, first = read(batch)
            target = batch.column("target").to_numpy(zero_copy_only=False).astype(np.int64)
            keys.append(found)
            weights.append(np.repeat(target, np.diff(first)))
            held += len(found)
            if held >= CHUNK:
                yield _sent(keys, weights)
                keys, weights, held = [], [], 0
    if keys:
        yield _sent(keys, weights)


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    found = words(batch.column("text"))
    return found.hashes(), found.first


class Vocabulary:
    """Numbers of words: 0 to n - 1 for those listed, n for any other; n + 1 stands before the first word."""

    def __init__(self, hashes: np.ndarray):
        self.lookup, self.n = Lookup(hashes), len(hashes)

    @property
    def width(self) -> int:
        return self.n + 2

    def bigrams(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """``previous * width + word`` for every word of every row, and the rows' beginnings."""
        hashes, first = _words(batch)
        number = self.lookup.find(hashes).astype(np.int64)
        number[number < 0] = self.n
        before = np.empty_like(number)
        before[1:] = number[:-1]
        starts = first[:-1][np.diff(first) > 0]
        before[starts] = self.n + 1
        return before * self.width + number, first


@dataclass
class Models:
    vocabulary: Vocabulary
    target: np.ndarray
    background: np.ndarray


def losses(counts: np.ndarray, strength: float) -> np.ndarray:
    """Bits of each word (column) after each word (row) under smoothed bigram counts."""
    width = len(counts)
    words_seen = counts.sum(axis=0)
    unigram = (words_seen + 1) / (words_seen.sum() + width)
    smoothed = counts + strength * unigram
    smoothed /= counts.sum(axis=1, keepdims=True) + strength
    return -np.log2(smoothed).astype(np.float32)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word: occurrences and those followed by another, of all rows and of the target's."""
    names = ["key", "n", "follow", "target_n", "target_follow", "starts", "target_starts"]
    held, size = [], 0

    def sent():
        hashes, follow, target = (np.concatenate(x) for x in zip(*held, strict=True))
        key, place = np.unique(hashes, return_inverse=True)
        weights = (~target, follow & ~target, target, follow & target)
        columns = [np.bincount(place, weights=w, minlength=len(key)).astype(np.int64) for w in weights]
        return pa.record_batch([pa.array(key.astype(np.int64)), *map(pa.array, columns)], names=names[:5])

    for whole in batches:
        for batch in slices(whole, "text"):
            hashes, first = _words(batch)
            follow = np.ones(len(hashes), bool)
            follow[first[1:][np.diff(first) > 0] - 1] = False
            target = np.repeat(batch.column("target").to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
            held.append((hashes, follow, target))
            size += len(hashes)
            if size >= CHUNK:
                yield sent()
                held, size = [], 0
    if held:
        yield sent()


class Listed:
    """The most frequent words, their counts under both models, and the losses that need nothing else."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, totals: np.ndarray, distinct: int, strength: float):
        """``counts``: rows target and background by columns of occurrences and of those followed; ``totals``: all words and starts."""
        self.lookup, self.n, self.paired, self.strength = Lookup(hashes), len(hashes), min(len(hashes), PAIRED), strength
        self.scale = np.array([1.0, totals[0, 0] / max(totals[1, 0], 1)])
        self.size = totals[:, 0] * self.scale + distinct + 2
        self.unigram = self.unigrams(counts[:, 0])
        self.after = self.contexts(np.concatenate([counts[:, 1], totals[:, 1:]], axis=1))
        self.cells = np.zeros((2, 0))

    def unigrams(self, n: np.ndarray) -> np.ndarray:
        return (n * self.scale[:, None] + 1) / self.size[:, None]

    def contexts(self, n: np.ndarray) -> np.ndarray:
        return np.log2(n * self.scale[:, None] + self.strength)

    def pairs(self, n: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        return -np.log2(n * self.scale[:, None] + self.strength * unigram)

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Words and those before, as hashes and as numbers (-1: not listed; before the first: n), whether each is followed, whether the matrix has the pair, and the rows' beginnings."""
        hashes, first = _words(batch)
        number = self.lookup.find(hashes).astype(np.int64)
        before, before_hash, follow = np.empty_like(number), np.empty_like(hashes), np.ones(len(hashes), bool)
        before[1:], before_hash[1:] = number[:-1], hashes[:-1]
        filled = np.diff(first) > 0
        before[first[:-1][filled]], before_hash[first[:-1][filled]], follow[first[1:][filled] - 1] = self.n, 0, False
        inside = (number >= 0) & (number < self.paired) & (before >= 0) & ((before < self.paired) | (before == self.n))
        return hashes, before_hash, number, before, follow, inside, first

    def cell(self, number: np.ndarray, before: np.ndarray) -> np.ndarray:
        return np.minimum(before, self.paired) * self.paired + number

    def seen(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Cells of the matrix for every pair that it has, and the rows' beginnings."""
        _, _, number, before, _, inside, first = self.read(batch)
        return self.cell(number[inside], before[inside]), np.concatenate([[0], np.cumsum(inside)])[first]

    def fill(self, counts: np.ndarray) -> None:
        """Take the matrix's counts, rows target and background."""
        self.cells = self.pairs(counts, np.tile(self.unigram[:, : self.paired], self.paired + 1)).astype(np.float32)


@dataclass
class WholeModels:
    """Counts of frequent words and pairs, and the texts that hold the others."""

    listed: Listed
    docs: DataFrame
    text_column: str
    target: DataFrame
    tokens: int


def _perhaps(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """``rows`` without most of those whose id is not marked, and with all that are; the map's size is fixed, whatever the rows."""
    kinds = {x.schema[0].dataType.simpleString() for x in (rows, marked)}
    if len(kinds) > 1 or kinds - {"tinyint", "smallint", "int", "bigint", "string"}:
        return rows
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAPPED))
    at = marked.select(place("label_id").alias("place")).select(F.shiftright("place", 15).alias("part"), F.col("place").bitwiseAND(32767).alias("bit"))
    maps = at.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map"))
    there = F.expr("shiftright(CAST(conv(hex(substring(map, CAST(shiftright(place, 3) & 4095 AS INT) + 1, 1)), 16, 10) AS INT), CAST(place & 7 AS INT)) & 1") == 1
    placed = rows.withColumn("place", place("id")).withColumn("part", F.shiftright("place", 15))
    return placed.join(F.broadcast(maps), "part").where(there).select(rows.columns)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: int | None = None, strength: float = 32.0, good: str = "quality = 1 AND coalesce(toxic, 0) = 0") -> Models | WholeModels:
    """Models of the documents with labels that are all ``good`` and of all documents."""
    if vocabulary is not None:
        return _train_limited(docs, labels, id_column, text_column, vocabulary, strength, good)
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    marked = labels.select(F.col(id_column).alias("label_id"), F.expr(good).alias("good")).dropna().groupBy("label_id").agg(F.min("good").alias("good"))
    marked = marked.where("good").select("label_id").hint("shuffle_hash")
    # Each marked id is there once. A left semi join would be put before the map.
    target = materialise(_perhaps(chosen, marked).join(marked, F.col("id") == F.col("label_id")).select("text"), shared_dir(spark), "target")
    rows = chosen.select("text", F.lit(False).alias("target")).unionByName(target.select("text", F.lit(True).alias("target")))

    columns = ("n", "follow", "target_n", "target_follow")
    counts = rows.mapInArrow(_occurrences, "key long, n long, follow long, target_n long, target_follow long").groupBy("key").agg(*(F.sum(c).alias(c) for c in columns))
    totals = Observation()
    top = counts.observe(totals, F.count(F.lit(1)).alias("distinct"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns)).orderBy(F.desc("n"), "key").limit(LISTED).toArrow()
    n = totals.get
    # Every row with words has one word that none follows, and one start.
    starts = [[n["target_n"], n["target_n"] - n["target_follow"]], [n["n"], n["n"] - n["follow"]]]
    held = np.array([[top.column(c).to_numpy() for c in pair] for pair in (("target_n", "target_follow"), ("n", "follow"))], dtype=np.float64)
    listed = Listed(top.column("key").to_numpy().astype(np.uint64), held, np.array(starts, dtype=np.float64), n["distinct"], strength)

    cells = rows.mapInArrow(partial(_counted, listed.seen), "key long, background long, target long").groupBy("key").agg(F.sum("background").alias("background"), F.sum("target").alias("target")).toArrow()
    place, size = cells.column("key").to_numpy(), (listed.paired + 1) * listed.paired
    of_target, of_all = (np.bincount(place, weights=cells.column(c).to_numpy(), minlength=size) for c in ("target", "background"))
    listed.fill(np.stack([of_target, of_all - of_target]))
    return WholeModels(listed, docs, text_column, target, n["n"])


def _train_limited(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, vocabulary: int, strength: float, good: str) -> Models:
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    all_text = chosen.select("text", F.lit(False).alias("target"))
    schema = "key long, background long, target long"
    counts = all_text.mapInArrow(partial(_counted, _words), schema).groupBy("key").agg(F.sum("background").alias("n"))
    top = counts.orderBy(F.desc("n"), "key").limit(vocabulary).toArrow()
    known = Vocabulary(top.column("key").to_numpy().astype(np.uint64))

    marked = labels.select(F.col(id_column).alias("label_id"), F.expr(good).alias("good")).dropna().groupBy("label_id").agg(F.min("good").alias("good"))
    marked = marked.where("good").select("label_id").hint("shuffle_hash")
    rows = chosen.join(marked, F.col("id") == F.col("label_id"), "left").select("text", F.col("label_id").isNotNull().alias("target"))
    cells = rows.mapInArrow(partial(_counted, known.bigrams), schema).groupBy("key").agg(F.sum("background").alias("background"), F.sum("target").alias("target")).toArrow()
    width = known.width
    place = cells.column("key").to_numpy()
    background, target = (np.bincount(place, weights=cells.column(c).to_numpy(), minlength=width * width).reshape(width, width) for c in ("background", "target"))
    scale = target.sum() / max(background.sum(), 1)
    return Models(known, losses(target, strength), losses(background * scale, strength))


def _score(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    models: Models = shared.value
    for whole in batches:
        for batch in slices(whole, "text"):
            cells, first = models.vocabulary.bigrams(batch)
            size = np.diff(first)
            means = []
            for table in (models.target, models.background):
                total = np.concatenate([[0.0], np.cumsum(table.ravel()[cells], dtype=np.float64)])
                means.append(pa.array((total[first[1:]] - total[first[:-1]]) / np.maximum(size, 1), mask=size == 0))
            score = pa.array(means[0].to_numpy(zero_copy_only=False) - means[1].to_numpy(zero_copy_only=False), mask=size == 0)
            yield pa.record_batch([batch.column("id"), pa.array(size.astype(np.int64)), *means, score], names=["id", "n_words", "target_loss", "background_loss", "score"])


def _planes(x: np.ndarray) -> bytes:
    """Bytes of numbers, all first ones, all second ones and so on: those of no information compress to nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _flat(planes: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _packed(shared, places: int, kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of pairs for each place, and with each row that is scored what the listed words say of it."""
    listed: Listed = shared.value
    names = ["place", "role", "known", "rows", "pairs", "words", "follow", "ids", "n", "target_loss", "background_loss"]
    held, size = [], 0

    def sent(role: int):
        place, of, pair, word, follow, known = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(place * 3 + known, kind="stable")
        place, of, pair, word, follow, known = (x[order] for x in (place, of, pair, word, follow, known))
        cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], np.diff(place * 3 + known) != 0])), [len(place)]])
        runs = list(zip(cuts[:-1], cuts[1:], strict=True))
        steps = [_planes(np.diff(of[i:j], prepend=0)) for i, j in runs]
        pairs_of = [_planes(pair[i:j].astype(np.int32)) if known[i] == NUMBERED else pair[i:j].tobytes() for i, j in runs]
        names_of = [_planes(word[i:j].astype(np.int32)) if known[i] else word[i:j].tobytes() for i, j in runs]
        first, none = cuts[:-1], pa.nulls(len(runs), pa.binary())
        return pa.record_batch([pa.array(place[first].astype(np.int32)), pa.array(np.full(len(runs), role, np.int32)), pa.array(known[first].astype(np.int32)), pa.array(steps, pa.binary()), pa.array(pairs_of, pa.binary()), pa.array(names_of, pa.binary()), pa.array([b"" if known[i] else follow[i:j].tobytes() for i, j in runs], pa.binary()), pa.nulls(len(runs), pa.list_(kind)), none, none, none], names=names)

    role = BOTH
    for whole in batches:
        for batch in slices(whole, "text"):
            if not batch.num_rows:
                continue
            now = int(batch.column("role")[0].as_py())
            if held and now != role:
                yield sent(role)
                held, size = [], 0
            role = now
            hashes, before_hash, number, before, follow, inside, first = listed.read(batch)
            row = batch.column("row").to_numpy()
            if role in (BOTH, SCORED):
                losses_of = []
                for k in range(2):
                    told = np.where(before >= 0, listed.after[k][before], 0.0)
                    told[inside] += listed.cells[k][listed.cell(number[inside], before[inside])]
                    total = np.concatenate([[0.0], np.cumsum(told)])
                    losses_of.append((total[first[1:]] - total[first[:-1]]).tobytes())
                ids = pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), batch.column("id"))
                blank = pa.nulls(1, pa.binary())
                alone = [pa.array([int(row[0]) % places], pa.int32()), pa.array([role], pa.int32()), pa.nulls(1, pa.int32()), pa.array([_planes(row)]), blank, blank, blank]
                yield pa.record_batch([*alone, ids, *(pa.array([x]) for x in (np.diff(first).astype(np.int64).tobytes(), *losses_of))], names=names)
            go = ~inside
            known = np.where(number[go] < 0, WORD_OPEN, np.where(before[go] < 0, PAIR_OPEN, NUMBERED))
            pair = mix(before_hash[go] * _PLACE[0] + hashes[go] * _PLACE[1])
            word = np.where(known != WORD_OPEN, number[go], hashes[go].astype(np.int64))
            place = (np.where(known != WORD_OPEN, pair, mix(hashes[go])) % np.uint64(places)).astype(np.int64)
            pair = np.where(known == NUMBERED, before[go].astype(np.uint64), pair)
            held.append((place, np.repeat(row, np.diff(first))[go], pair, word, follow[go], known))
            size += int(go.sum())
            if size >= SENT:
                yield sent(role)
                held, size = [], 0
    if size:
        yield sent(role)


def _homeward(kind: pa.DataType, rows: np.ndarray, losses_of: list[np.ndarray], ids: pa.Array | None = None, n: np.ndarray | None = None) -> pa.Table:
    """Parts of losses, and ids and numbers of words where given, as one record for each home of ascending rows."""
    home = rows >> HOME
    cuts = np.concatenate([np.flatnonzero(np.diff(home, prepend=-1) != 0), [len(rows)]])
    runs = list(zip(cuts[:-1], cuts[1:], strict=True))
    packed = lambda x, f=_planes: pa.array([f(x[i:j]) for i, j in runs], pa.binary())
    own = pa.nulls(len(runs), pa.list_(kind)) if ids is None else pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), ids)
    words_of = pa.nulls(len(runs), pa.binary()) if n is None else packed(n)
    return pa.table([pa.array(home[cuts[:-1]]), packed(rows), own, words_of, *(packed(x.astype(np.float32)) for x in losses_of)], names=["home", "rows", "ids", "n", "target_loss", "background_loss"])


def _placed(shared, kind: pa.DataType, table: pa.Table) -> pa.Table:
    """What the pairs of one place add to each row's losses."""
    listed: Listed = shared.value
    out = []
    told = table.filter(pc.is_null(table.column("known")))
    if told.num_rows:
        rows = np.concatenate([_flat(x, np.int64) for x in told.column("rows").to_pylist()])
        order = np.argsort(rows)
        n, *losses_of = (np.concatenate([np.frombuffer(x, t) for x in told.column(c).to_pylist()])[order] for c, t in (("n", np.int64), ("target_loss", np.float64), ("background_loss", np.float64)))
        out.append(_homeward(kind, rows[order], losses_of, pc.list_flatten(told.column("ids").combine_chunks()).take(pa.array(order)), n))
    for known in (WORD_OPEN, PAIR_OPEN, NUMBERED):
        part = table.filter(pc.fill_null(pc.equal(table.column("known"), known), False))
        if not part.num_rows:
            continue
        joined = lambda c, kind, p=part: np.concatenate([np.frombuffer(x, kind) for x in p.column(c).to_pylist()])
        numbers = lambda c, p=part: np.concatenate([_flat(x, np.int32) for x in p.column(c).to_pylist()])
        word = numbers("words") if known else joined("words", np.int64)
        pair = numbers("pairs").astype(np.int64) * listed.n + word if known == NUMBERED else joined("pairs", np.uint64)
        sizes = np.array(pc.binary_length(part.column("pairs")).to_pylist()) // (4 if known == NUMBERED else 8)
        role = np.repeat(part.column("role").to_numpy().astype(np.int8), sizes)
        counts_for = [role == TARGET, (role == BOTH) | (role == BACKGROUND)]
        scored = np.flatnonzero((role == BOTH) | (role == SCORED))
        row = np.concatenate([np.cumsum(_flat(x, np.int64)) for x in part.column("rows").to_pylist()])[scored]
        counted = lambda place, size, more=True: np.stack([np.bincount(place, weights=c & more, minlength=size) for c in counts_for])
        key, at = np.unique(pair, return_inverse=True)
        of_pair = counted(at, len(key))[:, at[scored]]
        if known:
            losses_of = listed.pairs(of_pair, listed.unigram[:, word[scored]])
        else:
            follow = joined("follow", np.bool_)
            key, at = np.unique(word, return_inverse=True)
            unigram, after = listed.unigrams(counted(at, len(key))), listed.contexts(counted(at, len(key), follow))
            at = at[scored]
            losses_of = listed.pairs(of_pair, unigram[:, at]) + after[:, at] * follow[scored]
        rows, at = np.unique(row, return_inverse=True)
        out.append(_homeward(kind, rows, [np.bincount(at, weights=x, minlength=len(rows)) for x in losses_of]))
    return pa.concat_tables(out)


def _summed(table: pa.Table) -> pa.Table:
    """Means of the rows of one home."""
    own = table.filter(pc.is_valid(table.column("n")))
    rows, n = (np.concatenate([_flat(x, np.int64) for x in own.column(c).to_pylist()]) for c in ("rows", "n"))
    order = np.argsort(rows)
    at = order[np.searchsorted(rows[order], np.concatenate([_flat(x, np.int64) for x in table.column("rows").to_pylist()]))]
    means = []
    for c in ("target_loss", "background_loss"):
        part = np.concatenate([_flat(x, np.float32) for x in table.column(c).to_pylist()])
        means.append(np.bincount(at, weights=part, minlength=len(rows)) / np.maximum(n, 1))
    return pa.table([pc.list_flatten(own.column("ids").combine_chunks()), pa.array(n), *(pa.array(x, mask=n == 0) for x in (*means, means[0] - means[1]))], names=["id", "n_words", "target_loss", "background_loss", "score"])


def _score_whole(docs: DataFrame, models: WholeModels, id_column: str, text_column: str) -> DataFrame:
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    id_type = chosen.schema["id"].dataType
    kind, arrow = id_type.simpleString(), to_arrow_type(id_type)
    same = docs is models.docs and text_column == models.text_column
    none = F.lit(None).cast(id_type).alias("id")
    parts = [(chosen, BOTH if same else SCORED), (models.target.select(none, "text"), TARGET)]
    if not same:
        parts.append((models.docs.select(none, F.col(models.text_column).alias("text")), BACKGROUND))
    shared = spark.sparkContext.broadcast(models.listed)
    places = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-models.tokens // HELD))
    schema = f"place int, role int, known int, rows binary, pairs binary, words binary, follow binary, ids array<{kind}>, n binary, target_loss binary, background_loss binary"
    packed = [part.select("id", "text", F.monotonically_increasing_id().alias("row"), F.lit(role).alias("role")).mapInArrow(partial(_packed, shared, places, arrow), schema) for part, role in parts]
    met = reduce(DataFrame.unionByName, packed)

    def placed(table: pa.Table) -> pa.Table:
        return _placed(shared, arrow, table)

    sums = met.groupBy("place").applyInArrow(placed, f"home long, rows binary, ids array<{kind}>, n binary, target_loss binary, background_loss binary")
    out = sums.groupBy("home").applyInArrow(_summed, f"id {kind}, n_words long, target_loss double, background_loss double, score double")
    return out.withColumnRenamed("id", id_column)


def score(docs: DataFrame, models: Models | WholeModels, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``n_words``, ``target_loss``, ``background_loss`` (bits a word) and ``score``, their difference."""
    if isinstance(models, WholeModels):
        return _score_whole(docs, models, id_column, text_column)
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(models)
    out = chosen.mapInArrow(partial(_score, shared), f"id {kind}, n_words long, target_loss double, background_loss double, score double")
    return out.withColumnRenamed("id", id_column)
