"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of length 0 to ``order``. A byte is coded in the longest context that the
language has seen: with escape method C, a context seen n times with d distinct next bytes gives a byte seen c times
the probability c / (n + d) and the escape to the next shorter context d / (n + d); below the empty context, all
256 bytes are alike. Statistics are frozen after training, so the code length of a text is exact: the sum over its
bytes of -log2 of those products. The language of the shortest code wins; the score is its share of the posterior
under equal priors.

Training counts cover every byte of every row given. A byte counts once, for the n-gram of ``order`` + 1 bytes that ends there
(fewer at a row's beginning); counts of shorter ones are sums over those that end in them. Counts, code lengths and escapes are
tables of Spark, one row an n-gram. An n-gram is a whole number, its bytes behind a leading 1, so dropping the last byte gives its
context. The most frequent ones, at most ``CELLS`` numbers, are broadcast; every part of a frequent n-gram is as frequent, so a
byte whose n-gram is among them is coded there. What the broadcast cannot tell is met by joins: each distinct n-gram once
with the table, its code length with the rows that have it. Prediction covers every whole text and reads the text alone.
``usual_bits`` tells how many bits a byte texts take, so that text of none of the languages can be told by its length.

``und``: the text is null or has no letter (no Unicode category L*); its score is 0. With no trainable row, every text
is ``und``. Ties go to the alphabetically first language. Repeated rows are predicted alike; other columns are passed
over, whatever their names.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialise, shared_dir
from ._text import slices, utf8

UNDETERMINED = "und"
_NEAR_LETTER = re.compile(r"[^\W\d_]")
#: Bits over a language's usual length that any text may have, so that short ones pass.
SLACK_BITS = 256
#: Numbers that the broadcast code lengths may have: n-grams by languages.
CELLS = 1 << 21
#: Bytes that a task collects before it counts them, and distinct n-grams that it holds before it sends their counts.
CHUNK, HELD = 1 << 22, 1 << 21
#: Code lengths met by joins are summed as whole numbers of this part of a bit, in any order alike.
FINE = 1 << 24
#: Bits a byte are counted in steps of this part of a bit.
STEPS = 1 << 10


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode category L; the pattern also finds other numbers, such as fractions."""
    return any(m[0].isalpha() for m in _NEAR_LETTER.finditer(text))


def grams(data: np.ndarray, rows: np.ndarray, length: int) -> np.ndarray:
    """The integer of the ``length`` bytes that end at each byte; -1 where they would begin before the row does."""
    out = np.zeros(len(data), np.int64)
    for back in range(length - 1, -1, -1):
        out <<= 8
        out[back:] += data[: len(data) - back] if back else data
    for k in range(length - 1):
        at = rows[:-1] + k
        out[at[at < rows[1:]]] = -1
    return out


def coded(data: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The n-gram of at most ``size`` bytes that ends at each byte and begins in its row, behind a leading 1."""
    out = np.zeros(len(data), np.int64)
    for back in range(size - 1, -1, -1):
        out <<= 8
        out[back:] += data[: len(data) - back] if back else data
    mark = np.left_shift(1, 8 * _reach(rows, size))
    return (out & (mark - 1)) | mark


def _reach(rows: np.ndarray, size: int) -> np.ndarray:
    """For each byte how many bytes up to it are in its row, ``size`` at most."""
    return np.minimum(np.arange(rows[-1]) - np.repeat(rows[:-1], np.diff(rows)) + 1, size)


def _length(keys: np.ndarray) -> np.ndarray:
    """Bytes of n-grams behind a leading 1."""
    return sum((keys >= 1 << 8 * k).astype(np.int64) for k in range(1, 8))


def _end(keys: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes behind a leading 1."""
    return (keys & ((1 << 8 * length) - 1)) | (1 << 8 * length)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _count(order: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams of ``order`` + 1 bytes, and of shorter ones that begin a row, by language."""
    fresh: dict[str, list[np.ndarray]] = {}
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    size = 0

    def settle() -> None:
        for name, keys in fresh.items():
            now = np.unique(np.concatenate(keys), return_counts=True)
            held[name] = _merged([held[name], now]) if name in held else now
        fresh.clear()

    def sent() -> Iterator[pa.RecordBatch]:
        for name, (keys, n) in held.items():
            yield pa.record_batch([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
        held.clear()

    for whole in batches:
        for batch in slices(whole, "text"):
            lang = np.array(batch.column("lang").to_pylist(), dtype=object)
            for name in sorted(set(lang)):
                data, rows = utf8(batch.filter(pa.array(lang == name)).column("text"))
                fresh.setdefault(name, []).append(coded(data, rows, order + 1))
                size += len(data)
            if size >= CHUNK:
                settle()
                size = 0
                if sum(len(keys) for keys, _ in held.values()) >= HELD:
                    yield from sent()
    settle()
    yield from sent()


@dataclass
class Table:
    """A map from sorted n-grams to a row of floats for each language, found through an open hash table."""

    keys: np.ndarray
    values: np.ndarray

    def __post_init__(self) -> None:
        bits = max(10, int(len(self.keys)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(self.keys), dtype=np.int32)
        at = self._home(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if it has none."""
        at = self._home(keys)
        out = self.slots[at]
        if not len(self.keys):
            return out
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            out[todo] = self.slots[at[todo]]
            found = out[todo]
            todo = todo[(found >= 0) & (self.keys[found] != keys[todo])]
        return out


@dataclass
class Model:
    """For length k + 1 in ``codes``: bits of an n-gram's last byte after its k-byte context, escapes included, by language.

    ``escapes`` has for each k-byte context the bits to leave it, 0 for a language that has not seen it. Without ``rest``, these
    are all n-grams; with it they are the frequent ones, and ``rest`` has the code lengths and escapes of every n-gram.
    """

    languages: list[str]
    codes: list[Table]
    escapes: list[Table]
    rest: DataFrame | None = None

    def told(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code length of what the tables can tell of each row, and n-grams of the bytes left over with where they end."""
        size = len(self.codes)
        keys = coded(data, rows, size)
        bits = np.zeros((len(data), len(self.languages)), np.float32)
        length = _reach(rows, size)
        known = np.zeros(len(data), bool)
        for k in range(size):
            at = np.flatnonzero(length == k + 1)
            row = self.codes[k].find(keys[at] - (1 << 8 * (k + 1)))
            bits[at[row >= 0]] = self.codes[k].values[row[row >= 0]]
            known[at[row >= 0]] = True
        total = np.zeros((len(data) + 1, len(self.languages)))
        np.cumsum(bits, axis=0, dtype=np.float64, out=total[1:])
        left = np.flatnonzero(~known)
        return total[rows[1:]] - total[rows[:-1]], keys[left], left

    def steps(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """For distinct n-grams: the longest end in ``codes`` (its length), the bits there, and for each longer end which have it and whether ``escapes`` has its context, with the bits to leave that."""
        length, deepest = _length(keys), np.zeros(len(keys), np.int64)
        base = np.full((len(keys), len(self.languages)), 8.0, np.float32)
        for k in range(len(self.codes)):
            row = self.codes[k].find(np.where(length > k, _end(keys, k + 1) - (1 << 8 * (k + 1)), -1))
            base[row >= 0], deepest[row >= 0] = self.codes[k].values[row[row >= 0]], k + 1
        out = []
        for k in range(len(self.codes)):
            at = np.flatnonzero((deepest <= k) & (length > k))
            row = self.escapes[k].find((_end(keys[at], k + 1) >> 8) - (1 << 8 * k))
            out.append((at, row >= 0, self.escapes[k].values[row] if len(self.escapes[k].keys) else np.zeros((len(at), len(self.languages)), np.float32)))
        return deepest, base, out

    def lengths(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Code length in bits of each row under each language."""
        order = len(self.codes) - 1
        bits = np.zeros((len(data), len(self.languages)), np.float32)
        left = np.arange(len(data))
        for k in range(order, -1, -1):
            keys = grams(data, rows, k + 1)[left]
            row = self.codes[k].find(keys)
            hit = row >= 0
            bits[left[hit]] += self.codes[k].values[row[hit]]
            left, keys = left[~hit], keys[~hit]
            inside = np.flatnonzero(keys >= 0)
            context = self.escapes[k].find(keys[inside] >> 8)
            seen = context >= 0
            bits[left[inside[seen]]] += self.escapes[k].values[context[seen]]
        bits[left] += 8.0
        total = np.zeros((len(data) + 1, len(self.languages)))
        np.cumsum(bits, axis=0, dtype=np.float64, out=total[1:])
        return total[rows[1:]] - total[rows[:-1]]


def freeze(languages: list[str], keys: np.ndarray, own: np.ndarray, leave: np.ndarray, order: int, rest: DataFrame | None = None) -> Model:
    """Tables of n-grams behind a leading 1 with their own bits (NaN: a language has not seen it) and the bits to leave them as contexts.

    With an n-gram, its end and its beginning must be there; the empty one is the empty context.
    """
    length = _length(keys)
    codes, escapes = [], []
    lower = None
    for k in range(order + 1):
        at = np.flatnonzero(length == k)
        context = Table(keys[at] - (1 << 8 * k), leave[at].astype(np.float32))
        escapes.append(context)
        at = np.flatnonzero(length == k + 1)
        gram = keys[at] - (1 << 8 * (k + 1))
        below = np.full((len(at), len(languages)), 8.0) if lower is None else lower.values[lower.find(gram & ((1 << (8 * k)) - 1))]
        bits = np.where(np.isnan(own[at]), context.values[context.find(gram >> 8)] + below, own[at]) if len(at) else own[at]
        lower = Table(gram, bits.astype(np.float32))
        codes.append(lower)
    return Model(languages, codes, escapes, rest)


def train(rows: DataFrame, text_column: str = "text", lang_column: str = "lang", order: int = 4) -> Model:
    """A model of the languages of ``rows``, from all of them."""
    spark = rows.sparkSession
    known = rows.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).dropna()
    folder = shared_dir(spark)
    counted = materialise(known.mapInArrow(partial(_count, order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), folder, "counts")
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    if not languages:
        return Model([], [], [])
    whole = range(len(languages))
    ends = F.explode(F.array(*(F.when(F.col("gram") >= (1 << 8 * k), F.col("gram").bitwiseAND((1 << 8 * k) - 1).bitwiseOR(1 << 8 * k)) for k in range(1, order + 2))))
    seen = counted.select("lang", ends.alias("key"), "n").where("key IS NOT NULL").groupBy("key").agg(*(F.sum(F.when(F.col("lang") == name, F.col("n")).otherwise(0)).alias(f"n{i}") for i, name in enumerate(languages)))
    seen = materialise(seen, folder, "seen")
    context = F.shiftright("key", 8).alias("context")
    contexts = materialise(seen.groupBy(context).agg(*(F.sum(f"n{i}").alias(f"t{i}") for i in whole), *(F.sum(F.signum(f"n{i}")).alias(f"d{i}") for i in whole)), folder, "contexts")
    leave = F.array(*(F.when(F.col(f"d{i}") > 0, -F.log2(F.col(f"d{i}") / (F.col(f"t{i}") + F.col(f"d{i}")))).otherwise(0.0) for i in whole))
    own = F.array(*(F.when(F.col(f"n{i}") > 0, -F.log2(F.col(f"n{i}") / (F.col(f"t{i}") + F.col(f"d{i}")))) for i in whole))
    coded_rows = seen.withColumn("context", context).join(contexts, "context").select("key", reduce(operator.add, (F.col(f"n{i}") for i in whole)).alias("n"), own.alias("own"))
    rest = coded_rows.join(contexts.select(F.col("context").alias("key"), leave.alias("leave")), "key", "left")
    rest = materialise(rest, folder, "rest")

    # An n-gram is no more frequent than its parts, so those from a count on have all their parts.
    level = F.floor(F.log2("n") * 16)
    most, left = max(CELLS // len(languages), 1), 0
    levels = sorted(((r["level"], r["count"]) for r in rest.groupBy(level.alias("level")).count().collect()), reverse=True)
    least = None
    for at, n in levels:
        left += n
        if left > most:
            break
        least = at
    broadcast = rest.where(level >= least) if least is not None else rest.where("false")
    empty = contexts.where("context = 1").select(F.lit(1).cast("long").alias("key"), F.array(*(F.lit(None).cast("double") for _ in whole)).alias("own"), leave.alias("leave"))
    none = F.array(*(F.lit(0.0) for _ in whole))
    short = [F.col("own").cast("array<float>").alias("own"), F.coalesce("leave", none).cast("array<float>").alias("leave")]  # as the tables hold them
    keys, own, leave = _columns(broadcast.select("key", "own", "leave").unionByName(empty).select("key", *short), len(languages))
    return freeze(languages, keys, own, leave, order, rest if left > most else None)


def _columns(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (key, own, leave) on the driver, the lists as matrices of ``size`` columns; the answer of Spark is not kept beside them."""
    found = rows.toArrow()
    square = lambda c: pc.fill_null(pc.list_flatten(found.column(c)), float("nan")).to_numpy().reshape(-1, size)
    return found.column("key").to_numpy(), square("own"), square("leave")


def training_rows(rows: DataFrame, id_column: str, text_column: str, lang_column: str, rows_per_language: int, bytes_per_language: int) -> tuple[DataFrame, list[str]]:
    """The sample that ``train`` reads (id, text, lang) and its languages."""
    known = rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).dropna(subset=["text", "lang"])
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    share = {r["lang"]: min(1.0, rows_per_language / r["n"], bytes_per_language / max(r["size"], 1)) for r in sizes}
    if not share:
        return known, []
    rate = F.create_map(*(F.lit(x) for name in sorted(share) for x in (name, share[name])))
    return known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20)), sorted(share)


def usual_bits(found: DataFrame) -> dict[str, float]:
    """By language, the most bits a byte that a text of it takes: twice what 99 % of the predicted rows take, which leaves
    room for passages in another language. Rows are counted in steps of 1 / ``STEPS`` bits."""
    steps = found.where(F.col("lang_pred") != UNDETERMINED).groupBy("lang_pred", F.round(F.col("bits_per_byte") * STEPS).alias("step")).count()
    return {r["lang_pred"]: 2.0 * r["most"] / STEPS for r in steps.groupBy("lang_pred").agg(F.percentile("step", F.lit(0.99), F.col("count")).alias("most")).collect()}


def fits(usual: dict[str, float], size: Column) -> Column:
    """Whether a predicted text of ``size`` bytes is not longer in code than texts of its language are, but for ``SLACK_BITS``."""
    if not usual:
        return F.lit(True)
    most = F.create_map(*(F.lit(x) for pair in sorted(usual.items()) for x in pair))[F.col("lang_pred")]
    return F.coalesce((F.col("bits_per_byte") - most) * size <= SLACK_BITS, F.lit(True))


def _verdicts(languages: list[str], ids: pa.Array, named: np.ndarray, size: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    if languages:
        best = bits.argmin(axis=1)
        least = bits.min(axis=1)
        score = 1.0 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(axis=1)
    else:
        named, best, least, score = named & False, np.zeros(len(ids), int), np.zeros(len(ids)), np.zeros(len(ids))
    names = [languages[b] if ok else UNDETERMINED for b, ok in zip(best, named, strict=True)]
    return pa.record_batch(
        [ids, pa.array(names, pa.string()), pa.array(np.where(named, score, 0.0)), pa.array(np.where(named, least / np.maximum(size, 1), 0.0))],
        names=["id", "lang_pred", "score", "bits_per_byte"],
    )


def _named(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([t is not None and has_letter(t) for t in batch.column("text").to_pylist()], bool)


def _predict(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    for whole in batches:
        for batch in slices(whole, "text", 1 << 19):
            data, rows = utf8(batch.column("text"))
            bits = model.lengths(data, rows) if model.languages else np.zeros((len(batch), 0))
            yield _verdicts(model.languages, batch.column("id"), _named(batch), np.diff(rows), bits)


def _tell(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the broadcast tells of each row, and the n-grams that it cannot tell with their counts."""
    model: Model = shared.value
    for whole in batches:
        for batch in slices(whole, "text", 1 << 19):
            data, rows = utf8(batch.column("text"))
            bits, keys, at = model.told(data, rows)
            row = np.searchsorted(rows, at, "right") - 1
            order = np.lexsort((keys, row))
            keys, row = keys[order], row[order]
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(keys) != 0) | (np.diff(row) != 0)])) if len(keys) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate([cut, [len(keys)]]))
            first = pa.array(np.searchsorted(row[cut], np.arange(len(rows))), pa.int32())
            told = pa.ListArray.from_arrays(pa.array(np.arange(len(rows)) * len(model.languages), pa.int32()), pa.array(bits.ravel()))
            lists = [pa.ListArray.from_arrays(first, x) for x in (pa.array(keys[cut]), pa.array(n.astype(np.int64)))]
            yield pa.record_batch([batch.column("row"), batch.column("id"), pa.array(_named(batch)), pa.array(np.diff(rows)), told, *lists], names=["row", "id", "named", "size", "bits", "keys", "counts"])


def _ask(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each n-gram and each end of it that the broadcast lacks: that end, and its context or the bits to leave it."""
    model: Model = shared.value
    size = len(model.languages)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * size, pa.int32()), pa.array(x.astype(np.float64).ravel()))
    for batch in batches:
        keys = batch.column("key").to_numpy()
        _, base, steps = model.steps(keys)
        for k, (at, known, leave) in enumerate(steps):
            end = _end(keys[at], k + 1)
            told = lists(leave)
            told = pc.if_else(pa.array(known), told, pa.nulls(len(at), told.type))
            yield pa.record_batch([pa.array(keys[at]), lists(base[at]), pa.array(np.full(len(at), k, np.int32)), pa.array(end), pa.array(end >> 8, mask=known), told], names=["key", "base", "step", "end", "context", "leave"])


def _judge(languages: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits, more = (pc.list_flatten(batch.column(c)).to_numpy().reshape(-1, len(languages)) for c in ("bits", "more"))
        yield _verdicts(languages, batch.column("id"), batch.column("named").to_numpy(zero_copy_only=False), batch.column("size").to_numpy(), bits + more / FINE)


def _predict_by_joins(chosen: DataFrame, model: Model, kind: str) -> DataFrame:
    spark, rest, size = chosen.sparkSession, model.rest, len(model.languages)
    shared = spark.sparkContext.broadcast(Model(model.languages, model.codes, model.escapes))
    told = chosen.withColumn("row", F.monotonically_increasing_id()).mapInArrow(partial(_tell, shared), f"row long, id {kind}, named boolean, size long, bits array<double>, keys array<long>, counts array<long>")
    told = materialise(told, shared_dir(spark), "told")
    missed = told.select("row", F.explode(F.arrays_zip("keys", "counts")).alias("m")).select("row", F.col("m.keys").alias("key"), F.col("m.counts").alias("n"))
    asked = missed.select("key").distinct().mapInArrow(partial(_ask, shared), "key long, base array<double>, step int, end long, context long, leave array<double>")
    asked = asked.join(rest.select(F.col("key").alias("end"), "own"), "end", "left")
    open_, done = asked.where("context IS NOT NULL").drop("leave"), asked.where("context IS NULL")
    open_ = open_.join(rest.select(F.col("key").alias("context"), "leave"), "context", "left")
    steps = open_.unionByName(done).groupBy("key").agg(F.first("base").alias("base"), F.sort_array(F.collect_list(F.struct("step", "own", "leave"))).alias("steps"))
    code = F.aggregate("steps", F.col("base"), lambda below, s: F.transform(below, lambda b, i: F.coalesce(F.get(s["own"], i), b + F.coalesce(F.get(s["leave"], i), F.lit(0.0)))))
    codes = steps.select("key", F.transform(code, lambda x: F.round(x * FINE).cast("long")).alias("code"))
    sums = missed.join(codes, "key").groupBy("row").agg(F.array(*(F.sum(F.col("n") * F.col("code")[i]) for i in range(size))).alias("more"))
    none = F.array(*(F.lit(0).cast("long") for _ in range(size)))
    summed = told.drop("keys", "counts").join(sums, "row", "left").withColumn("more", F.coalesce("more", none)).drop("row")
    return summed.mapInArrow(partial(_judge, model.languages), f"id {kind}, lang_pred string, score double, bits_per_byte double")


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``lang_pred``, ``score`` (0 to 1) and ``bits_per_byte`` (of the winner) for every row."""
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    if model.rest is not None:
        return _predict_by_joins(chosen, model, kind).withColumnRenamed("id", id_column)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = chosen.mapInArrow(partial(_predict, shared), f"id {kind}, lang_pred string, score double, bits_per_byte double")
    return out.withColumnRenamed("id", id_column)


def held_out(id_column: str = "doc_id") -> Column:
    """True for rows kept out of training: crc32 of the id's digits is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))
