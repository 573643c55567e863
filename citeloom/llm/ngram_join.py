"""N-gram Jaccard join: documents whose sets of word shingles have Jaccard similarity at or above a threshold.

Method: a count-vector R-tree. The shingles of a set are hashed into groups; the group counts are a point. The
overlap of two sets is at most the sum of the coordinate minima of their points, and of two R-tree boxes at most the
sum of the minima of their upper corners, so one traversal prunes most pairs; what survives is verified on the sets.

Spark deals the work out so that no task holds an unbounded group:

1. ``described``: equal sets become one (by a 64-bit digest of the set), so copies cost one point.
2. ``members``: sets that can be similar meet in buckets. Two sets at the threshold differ in ``h`` shingles at most, so
   of ``h + 1 + s`` parts that a hash cuts all shingles into, they agree in ``s + 1`` at least. A set's keys are its
   parts, several shingles each, so that unrelated sets hardly ever meet; parts without a rare shingle are passed over
   where the set has ``s`` of them at most (so that one of the ``s + 1`` remains). ``h`` follows from the larger set's
   size; sizes up to ``SHORT``, and thresholds at which parts would be small, use the prefix filter instead, rare
   shingles first. Which shingles are rare, and which keys so many sets hold that they skip the exchange, comes from a
   bounded sample and affects speed only.
3. ``stars``: each bucket's smallest member is compared with the others, first by the bound of their points, then, one
   partner for each set, shingle by shingle. A group of copies ends here, in work linear in its size.
4. ``candidates``: buckets that are not of one class by then go through the R-tree join, which links points whose bound
   reaches the threshold. Large buckets are dealt as pairs of blocks, without those inside the largest class.
5. ``verify``: the classes that such links connect are dealt alike, and what survives the R-tree there is compared
   shingle by shingle. A spanning forest of the true links leaves each block.
6. ``components`` of the links of 3 and 5 give the classes.

Nulls and texts without a word: empty set, linked with nothing. Ids may be of any type that has an order; null ids are
kept, each linked by its text as any other row; a component's id is the smallest non-null id in it. Repeated rows give
repeated result rows. Other input columns are ignored, whatever their names. Distinct sets agree in their 64-bit digest
with probability 2**-64 a pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import components, materialise, sampled, shared_dir
from ._text import mix, shingle_sets, slices

#: Sets in a block of a bucket or of a candidate component, and their shingles; a task holds two blocks at a time.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 22
#: Points in a leaf and children of an inner node of the R-tree.
FANOUT = 16
#: Documents in the sample that says which shingles are frequent, and the most shingles it may name.
SAMPLE, FREQUENT = 4096, 1 << 18
#: Sets of the sample that hold a key at which it skips the exchange, with its smallest holder there as the star.
HEAVY = 8
#: Digests of sets that a task remembers, so as not to send the keys of a copy again.
SEEN = 1 << 18
#: Bits for each chosen id, and at most, of the table by which texts are passed over before the join; broadcast.
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Up to this size sets meet by shared shingles of their prefix; beyond, levels of parts grow by half. Thresholds at which
#: parts would have fewer shingles than PART on average have no levels.
SHORT, PART = 64, 4


def prefix_length(n: int, num: int, den: int) -> int:
    """Shingles of a set of ``n`` of which one at least is shared with any set at similarity ``num/den``."""
    return n - -(-num * n // den) + 1


def required(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap of sets of sizes ``a`` and ``b`` at similarity ``num/den``."""
    return -(-num * (a + b) // (num + den))


def groups_for(n: int) -> int:
    """Coordinates of the point of a set of ``n`` shingles: a power of two near ``n / 12``, 16 to 1024."""
    return 1 << min(10, max(4, (n // 12).bit_length()))


def point(shingles: np.ndarray) -> np.ndarray:
    """Counts of shingles by group; a count of 255 or more is told as 255 and counts as unbounded."""
    g = groups_for(len(shingles))
    counts = np.bincount((shingles >> np.uint64(7)).astype(np.int64) & (g - 1), minlength=g)
    return np.minimum(counts, 255).astype(np.uint8)


def fold(points: list[np.ndarray], sizes: np.ndarray, g: int) -> np.ndarray:
    """Points of ``g`` or more coordinates as a matrix of ``g``, by adding up groups that share low bits."""
    out = np.empty((len(points), g), np.int32)
    for i, p in enumerate(points):
        out[i] = np.where(p == 255, sizes[i], p.astype(np.int32)).reshape(-1, g).sum(axis=0)
    return out


class Forest:
    """Components of 0..n-1 under joins, as a label for each."""

    def __init__(self, n: int, label: np.ndarray | None = None):
        self.label = np.arange(n) if label is None else label.copy()

    def join(self, x: int, y: int) -> None:
        self.label[self.label == self.label[y]] = self.label[x]

    def apart(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs whose ends have different labels."""
        keep = self.label[x] != self.label[y]
        return x[keep], y[keep]


class RTree:
    """Bulk-loaded over points in order of size and then of the widest coordinates; keeps the upper corner of each box."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        spread = np.argsort(-points.var(axis=0), kind="stable")[:2] if len(points) > FANOUT else [0]
        band = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // (FANOUT * FANOUT)
        self.order = np.lexsort((*(points[:, c] for c in spread), band))
        self.sizes, self.points = sizes[self.order], points[self.order]
        self.levels = [(self.sizes, self.sizes, self.points)]
        while len(self.levels[-1][0]) > 1:
            low, high, corner = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(corner, at, axis=0)))

    def joined(self, other: RTree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions (self, other) whose bound reaches the least overlap, a pair of leaves at a time."""
        depth = min(len(self.levels), len(other.levels)) - 1
        tops = [(i, j) for i in range(len(self.levels[depth][0])) for j in range(len(other.levels[depth][0]))]
        stack = [(depth, np.array(tops, dtype=np.int64).reshape(-1, 2))]
        while stack:
            level, pairs = stack.pop()
            if self is other:
                pairs = pairs[pairs[:, 0] <= pairs[:, 1]] if level else pairs[pairs[:, 0] < pairs[:, 1]]
            low, high, corner = self.levels[level]
            low2, high2, corner2 = other.levels[level]
            i, j = pairs[:, 0], pairs[:, 1]
            fits = (num * low[i] <= den * high2[j]) & (num * low2[j] <= den * high[i])
            i, j = i[fits], j[fits]
            parts = []
            for a in range(0, len(i), 4096):
                bound = np.minimum(corner[i[a : a + 4096]], corner2[j[a : a + 4096]]).sum(axis=1)
                keep = bound >= required(low[i[a : a + 4096]], low2[j[a : a + 4096]], num, den)
                parts.append((i[a : a + 4096][keep], j[a : a + 4096][keep]))
            for x, y in parts:
                if not len(x):
                    continue
                if level == 0:
                    yield x, y
                    continue
                kids = np.arange(FANOUT)
                for b in range(0, len(x), 64):
                    p = (x[b : b + 64, None] * FANOUT + kids)[:, :, None]
                    q = (y[b : b + 64, None] * FANOUT + kids)[:, None, :]
                    p, q = np.broadcast_arrays(p, q)
                    p, q = p.ravel(), q.ravel()
                    real = (p < len(self.levels[level - 1][0])) & (q < len(other.levels[level - 1][0]))
                    stack.append((level - 1, np.stack([p[real], q[real]], axis=1)))


def similar(s: np.ndarray, t: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets reach the threshold, by exact intersection."""
    if len(s) > len(t):
        s, t = t, s
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    return int((t[at] == s).sum()) * (num + den) >= num * (len(s) + len(t))


def forest_links(sizes: np.ndarray, points: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int, sets: list[np.ndarray] | None = None, labels: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs (one of ``left``, one of ``right``) that the bound lets pass.

    With ``sets``, of those pairs only the ones whose sets reach the threshold; with ``labels``, none between equal ones. Points of one dimension are joined in
    it, and with those of twice that in the lower one; sizes further apart never reach a threshold over one half.
    """
    forest, dims = Forest(len(sizes), labels), np.array([len(p) for p in points])

    def tree(of: np.ndarray, g: int) -> RTree:
        return RTree(sizes[of], fold([points[k] for k in of], sizes[of], g))

    for g in np.unique(dims).tolist():
        low, low2 = left[dims[left] == g], right[dims[right] == g]
        high, high2 = left[dims[left] == 2 * g], right[dims[right] == 2 * g]
        sides = [(low, low), (low, high)] if left is right else [(low, low2), (low, high2), (high, low2)]
        for one, other in sides:
            if not len(one) or not len(other):
                continue
            a = tree(one, g)
            b = a if one is other else tree(other, g)
            for x, y in a.joined(b, num, den):
                x, y = forest.apart(one[a.order[x]], other[b.order[y]])
                while len(x):
                    p, q = int(x[0]), int(y[0])
                    if sets is None or similar(sets[p], sets[q], num, den):
                        forest.join(p, q)
                        yield p, q
                        x, y = forest.apart(x[1:], y[1:])
                    else:
                        x, y = x[1:], y[1:]


def _digest(s: np.ndarray) -> int:
    return int(mix(mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0].astype(np.int64))


@dataclass(frozen=True)
class Level:
    """Pairs whose larger set has over ``under`` and at most ``upto`` shingles agree in ``spare + 1`` of ``parts`` parts."""

    number: int
    under: int
    upto: int
    parts: int
    spare: int


def levels(num: int, den: int, most: int = 1 << 40) -> list[Level]:
    """Levels for sizes up to ``most``; ``spare`` is what the smallest sets of a level have of empty parts, and a margin.

    None if parts are too small to tell sets apart much better than single shingles, of which a prefix has far fewer: at a
    threshold of 0.9 the smallest sets of a level have over five shingles a part, at 0.8 about two.
    """
    out, under = [], SHORT
    if num * (num + den) < 3 * PART * den * (den - num):  # least / apart in what follows, for large sets
        return out
    while under < most:
        upto = under + under // 2
        apart, least = (den - num) * 2 * upto // (num + den), -(-num * (under + 1) // den)
        parts, spare = apart + 1, 0
        for _ in range(8):
            empty = parts * math.exp(-least / parts)
            spare = math.ceil(empty + 4 * math.sqrt(empty)) + 1
            parts = apart + 1 + spare
        out.append(Level(len(out) + 1, under, upto, parts, spare))
        under = upto
    return out


def keys_of(s: np.ndarray, num: int, den: int, frequent: np.ndarray, steps: list[Level]) -> np.ndarray:
    """Keys of a sorted set: any two sets at the threshold share one."""
    n, found = len(s), []
    at = np.searchsorted(frequent, s)
    at[at == len(frequent)] = 0
    rare = frequent[at] != s if len(frequent) else np.ones(n, bool)
    if n <= SHORT or not steps:
        length = prefix_length(n, num, den)
        found.append(mix(np.concatenate([s[rare], s[~rare]])[:length] + np.uint64(0x51ED270B)))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(s), out=total[1:])
    for level in steps:
        if den * n < num * (level.under + 1):
            break
        if n > level.upto:
            continue
        part = ((s >> np.uint64(32)) * np.uint64(level.parts)) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        held, sums = part[start], np.diff(total[np.append(start, n)])
        strong = np.add.reduceat(rare, start, dtype=np.int64) > 0
        if level.parts - int(strong.sum()) <= level.spare:
            held, sums = held[strong], sums[strong]
        else:
            every = np.zeros(level.parts, np.uint64)
            every[held.astype(np.int64)] = sums
            held, sums = np.arange(level.parts, dtype=np.uint64), every
        found.append(mix(sums + mix(held * np.uint64(0x2545F4914F6CDD1D) + np.uint64(level.number))))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _lists(values: list[np.ndarray | None]) -> pa.Array:
    sizes = np.cumsum([0, *(0 if v is None else len(v) for v in values)])
    held = [v for v in values if v is not None]
    flat = np.concatenate(held).astype(np.int64) if held else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int64()), mask=pa.array([v is None for v in values], pa.bool_()))


def _sample_sets(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = [s for s in shingle_sets(batch.column("text"), n) if len(s)]
            yield pa.record_batch([pa.array([_digest(s) for s in sets], pa.int64()), _lists(sets)], names=["sid", "shingles"])


def _sample_keys(num: int, den: int, frequent: np.ndarray, steps: list[Level], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = (s.values.to_numpy(zero_copy_only=False).astype(np.uint64) for s in batch.column("shingles"))
        yield pa.record_batch([batch.column("sid"), _lists([keys_of(s, num, den, frequent, steps) for s in sets])], names=["sid", "keys"])


def _describe(n: int, num: int, den: int, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: size, digest and point of its set, and its keys unless the task has sent them before."""
    frequent, heavy, steps = shared.value
    seen: set[int] = set()
    for whole in batches:
        for batch in slices(whole, "text"):
            sizes, digests, points, keys, stars = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), n):
                sizes.append(len(s))
                sid = _digest(s) if len(s) else None
                digests.append(sid)
                points.append(point(s).tobytes() if len(s) else None)
                if sid is None or sid in seen:
                    keys.append(None)
                    stars.append(None)
                    continue
                if len(seen) < SEEN:
                    seen.add(sid)
                own = keys_of(s, num, den, frequent, steps)
                at = np.searchsorted(heavy, own)
                at[at == len(heavy)] = 0
                often = heavy[at] == own if len(heavy) else np.zeros(len(own), bool)
                keys.append(own[~often])
                stars.append(own[often])
            yield pa.record_batch([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()), pa.array(points, pa.binary()), _lists(keys), _lists(stars)], names=["id", "n", "sid", "point", "keys", "stars"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, sid) in order, rows (bucket, rep, sid, pair) of the sets of each key that two or more hold.

    ``rep`` is the smallest of them. Buckets of the same sets have the same number, so that they cost one; ``pair`` says
    that there are two. A key is held in memory as one array of digests.
    """
    key, held = None, []

    def closed(keys: np.ndarray, sids: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])
        keys, sids = keys[new], sids[new]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(keys)))
        number = mix(np.add.reduceat(mix(sids.astype(np.uint64)), start) + size.astype(np.uint64)) if len(keys) else np.zeros(0, np.uint64)
        others = np.ones(len(keys), bool)
        others[start] = False
        rows = np.stack([np.repeat(number, size).astype(np.int64), np.repeat(sids[start], size), sids, np.repeat(size == 2, size)], axis=1)[others]
        rows = np.unique(rows, axis=0)
        return pa.record_batch([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array(rows[:, 3] > 0)], names=["bucket", "rep", "sid", "pair"])

    for batch in batches:
        keys, sids = batch.column("key").to_numpy(), batch.column("sid").to_numpy()
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if last or keys[0] != key:
            parts = [*held, (keys[:last], sids[:last])]
            yield closed(np.concatenate([k for k, _ in parts]), np.concatenate([x for _, x in parts]))
            held = []
        key = keys[-1]
        held.append((keys[last:], sids[last:]))
    if held:
        yield closed(np.concatenate([k for k, _ in held]), np.concatenate([x for _, x in held]))


def _bounded(num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets whose sizes and points let them reach the threshold."""
    for batch in batches:
        keep = []
        for n, m, p, q in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "point", "other")), strict=True):
            fits = num * max(n, m) <= den * min(n, m)
            if fits:
                p, q, sizes = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8), np.array([n, m])
                both = fold([p, q], sizes, min(len(p), len(q)))
                fits = int(both.min(axis=0).sum()) >= int(required(sizes[:1], sizes[1:], num, den)[0])
            keep.append(fits)
        yield batch.select(["rep", "sid"]).filter(pa.array(keep, pa.bool_()))


def _sets_of(n: int, batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    """Rows (values of ``names``, set) of a table with ``sid`` and ``text``; only texts that have the digest ``sid``, as ids
    may repeat with other texts."""
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = shingle_sets(batch.column("text"), n)
            for sid, s, *row in zip(batch.column("sid").to_pylist(), sets, *(batch.column(c).to_pylist() for c in names), strict=True):
                if len(s) and _digest(s) == sid:
                    yield (*row, sid, s)


def _star_links(n: int, num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """True links between the star of a block (``side`` 0, first in order) and its members."""
    star, links = None, []
    for cell, i, side, sid, s in _sets_of(n, batches, ("cell", "i", "side")):
        if side == 0:
            star = (cell, i, s)
        elif star is not None and star[:2] == (cell, i) and similar(star[2], s, num, den):
            links.append((sid, cell))
        if len(links) >= 10_000:
            yield _edges(links)
            links = []
    yield _edges(links)


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([u for u, _ in links], pa.int64()), pa.array([v for _, v in links], pa.int64())], names=["u", "v"])


def _chosen_bits(ids: DataFrame) -> np.ndarray:
    """A table with the bits of the hashed ids set, of some bits an id up to a fixed most; comes to the driver as words."""
    many = ids.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * many).bit_length()))
    at = F.pmod(F.xxhash64("of"), F.lit(bits))
    words = ids.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, int(pmod(xxhash64(of), {bits}) % 64))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return table.view(np.uint64)


def _maybe_chosen(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose hashed id has its bit set: all chosen ones and few others."""
    last = np.uint64(64 * len(shared.value) - 1)
    for batch in batches:
        at = batch.column("at").to_numpy().astype(np.uint64) & last
        on = (shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
        yield batch.select(["id", "text"]).filter(pa.array(on.astype(bool)))


Rows = list[tuple]


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[tuple[tuple, Rows]]:
    """Groups of rows that arrive in order of ``keys``."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*keys, *columns)), strict=True):
            if row[: len(keys)] != now:
                if rows:
                    yield now, rows
                now, rows = row[: len(keys)], []
            rows.append(row[len(keys) :])
    if rows:
        yield now, rows


def _linked(pairs: Callable, groups: Iterator[tuple[tuple, Rows]]) -> Iterator[pa.RecordBatch]:
    """Links of each group of block pairs: rows ``side, sid, label, payload`` under ``cell, i, j``."""
    links: list[tuple[int, int]] = []
    for (_, i, j), rows in groups:
        rows = sorted({(side, sid): (side, sid, label, payload) for side, sid, label, payload in rows}.values(), key=lambda r: r[:2])
        side = np.array([r[0] for r in rows])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        labels = np.unique([r[2] for r in rows], return_inverse=True)[1]
        if labels.max() == 0 or not len(left) or (i != j and not len(right)):
            continue
        links += [(rows[p][1], rows[q][1]) for p, q in pairs([r[3] for r in rows], left, left if i == j else right, labels)]
        if len(links) >= 10_000:
            yield _edges(links)
            links = []
    yield _edges(links)


def _candidates(num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs(points: list[dict], left: np.ndarray, right: np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, int]]:
        sizes = np.array([p["n"] for p in points], np.int64)
        yield from forest_links(sizes, [np.frombuffer(p["point"], np.uint8) for p in points], left, right, num, den, labels=labels)

    return _linked(pairs, _grouped(batches, ("cell", "i", "j"), ("side", "sid", "label", "point")))


def _verify(n: int, num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, int]]:
        sizes = np.array([len(s) for s in sets], np.int64)
        yield from forest_links(sizes, [point(s) for s in sets], left, right, num, den, sets, labels)

    def groups() -> Iterator[tuple[tuple, Rows]]:
        now, rows = None, []
        for cell, i, j, side, label, sid, s in _sets_of(n, batches, ("cell", "i", "j", "side", "label")):
            if (cell, i, j) != now:
                if rows:
                    yield now, rows
                now, rows = (cell, i, j), []
            rows.append((side, sid, label, s))
        if rows:
            yield now, rows

    return _linked(pairs, groups())


def _sampled_order(docs: DataFrame, folder: str, n: int, num: int, den: int) -> tuple[np.ndarray, DataFrame, list[Level]]:
    """From the distinct sets of a sample of at most ``SAMPLE`` documents: shingles that two or more hold (``FREQUENT`` at
    most), keys that ``HEAVY`` or more hold with the smallest of them, and the levels. For speed only."""
    sample = sampled(docs, F.col("id"), SAMPLE).mapInArrow(partial(_sample_sets, n), "sid long, shingles array<long>")
    sample = materialise(sample.repartition("sid").dropDuplicates(["sid"]), folder, "sample")
    counts = sample.select(F.explode("shingles").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    rows = counts.where("n > 1").orderBy(F.desc("n"), "key").limit(FREQUENT).select("key").toArrow().column("key")
    frequent, steps = np.sort(rows.to_numpy().astype(np.uint64)), levels(num, den)
    keys = sample.mapInArrow(partial(_sample_keys, num, den, frequent, steps), "sid long, keys array<long>")
    heavy = keys.select("sid", F.explode("keys").alias("key")).groupBy("key").agg(F.min("sid").alias("rep"), F.count("*").alias("n")).where(F.col("n") >= HEAVY)
    return frequent, materialise(heavy.select("key", "rep"), folder, "heavy"), steps


def _block_pairs(members: DataFrame, payload: str) -> DataFrame:
    """``members`` (with ``cell``, ``sid``, ``n``, ``label``) sent to the pairs of blocks that theirs is in, in order of them.

    A cell has so many blocks that each holds about ``BLOCK`` sets and ``BLOCK_SHINGLES`` shingles at most. The class with
    the most members of a cell of several blocks has blocks of its own, which meet those of the other classes only.
    """
    classes = members.groupBy("cell", "label").agg(F.count("*").alias("many"), F.sum("n").alias("weight"))

    def blocks(many: str, weight: str):
        return F.greatest(F.ceil(F.col(many) / F.lit(BLOCK)), F.ceil(F.col(weight) / F.lit(BLOCK_SHINGLES))).cast("int")

    cells = classes.groupBy("cell").agg(F.max(F.struct("many", "label", "weight")).alias("top"), F.sum("many").alias("all"), F.sum("weight").alias("total"))
    cells = cells.select("cell", "top.label", (F.col("all") - F.col("top.many")).alias("rest"), (F.col("total") - F.col("top.weight")).alias("rest_weight"), F.col("top.many").alias("many"), F.col("top.weight").alias("weight"), blocks("all", "total").alias("blocks"))
    cells = cells.where("rest > 0").select("cell", F.col("label").alias("top"), "blocks", blocks("many", "weight").alias("tops"), blocks("rest", "rest_weight").alias("rests"))
    held, on = members.join(cells, "cell"), F.col("label") == F.col("top")
    hashed = F.xxhash64("sid")
    own = F.when(F.col("blocks") == 1, 0).when(on, F.pmod(hashed, F.col("tops"))).otherwise(F.col("tops") + F.pmod(hashed, F.col("rests"))).cast("int")
    first = F.when(F.col("blocks") == 1, 0).when(on, F.col("tops")).otherwise(0)
    last = F.when(F.col("blocks") == 1, 0).otherwise(F.col("tops") + F.col("rests") - 1)
    spread = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(first, last)))
    pairs = spread.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "sid", "label", payload)
    return pairs.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The texts of ``chosen`` (written already; id ``of`` and what else it has)."""
    bits = docs.sparkSession.sparkContext.broadcast(_chosen_bits(chosen.select("of")))
    kind = docs.schema["id"].dataType.simpleString()
    likely = docs.withColumn("at", F.xxhash64("id")).mapInArrow(partial(_maybe_chosen, bits), f"id {kind}, text string")
    return likely.join(chosen, likely["id"].eqNullSafe(chosen["of"])).drop("id", "of")


def ngram_jaccard_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per input row: ``id_column``, ``n_shingles``, ``component_id`` (smallest id reachable by links).

    Two rows link when ``den * |A & B| >= num * |A | B|`` over their sets of ``n``-word shingles; ``num / den`` is over
    one half. See the module for the method and for nulls, empties, ties and repeats.
    """
    if not den < 2 * num <= 2 * den:
        raise ValueError("the threshold lies over 1/2 and at most at 1")
    spark = docs.sparkSession
    folder = shared_dir(spark)
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    frequent, heavy, steps = _sampled_order(docs, folder, n, num, den)
    heaviest = np.sort(heavy.select("key").toArrow().column("key").to_numpy().astype(np.uint64))  # bounded: keys of the sample
    shared = spark.sparkContext.broadcast((frequent, heaviest, steps))
    described = docs.mapInArrow(partial(_describe, n, num, den, shared), f"id {kind}, n long, sid long, point binary, keys array<long>, stars array<long>")
    described = materialise(described, folder, "described")
    rows = described.select("id", "n", "sid", "point")

    keys = described.select("sid", F.explode("keys").alias("key")).repartition("key").sortWithinPartitions("key", "sid")
    met = keys.mapInArrow(_met, "bucket long, rep long, sid long, pair boolean")
    often = described.select("sid", F.explode("stars").alias("key")).join(F.broadcast(heavy), "key").where("sid <> rep")
    members = met.unionByName(often.select(F.col("key").alias("bucket"), "rep", "sid", F.lit(False).alias("pair"))).distinct()
    members = materialise(members, folder, "members")
    held = members.select("sid").union(members.select("rep")).distinct()
    first = described.where("keys is not null").select("id", "n", "sid", "point")  # of a set, one row a task: not its copies
    points = first.join(held, "sid", "left_semi").groupBy("sid").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("point").alias("point"))
    points = materialise(points, folder, "points")

    stars = points.select(F.col("sid").alias("rep"), F.col("n").alias("m"), F.col("point").alias("other"))
    pairs = members.select("rep", "sid").distinct().join(points.select("sid", "n", "point"), "sid").join(stars, "rep")
    close = materialise(pairs.mapInArrow(partial(_bounded, num, den), "rep long, sid long"), folder, "close")
    star = close.groupBy("sid").agg(F.min("rep").alias("cell"))
    star = star.join(points.select("sid", F.col("id").alias("of"), "n"), "sid")
    cells = star.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    ends = star.join(cells, "cell").select("of", "sid", "cell", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("i"), F.lit(1).alias("many"))
    heads = cells.join(points.select(F.col("sid").alias("cell"), F.col("id").alias("of")), "cell").select("of", F.col("cell").alias("sid"), "cell", F.lit(-1).alias("i"), F.col("blocks").alias("many"))
    chosen = materialise(ends.unionByName(heads), folder, "stars")
    spread = _texts(docs, chosen).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    dealt = spread.select("sid", "cell", F.when(F.col("i") < 0, F.col("k")).otherwise(F.col("i")).alias("i"), (F.col("i") >= 0).cast("int").alias("side"), "text")
    dealt = dealt.repartition("cell", "i").sortWithinPartitions("cell", "i", "side")
    true = materialise(dealt.mapInArrow(partial(_star_links, n, num, den), "u long, v long"), folder, "true")
    classes = components(true, folder, "classes")

    labelled = classes.select(F.col("node").alias("sid"), "label")
    open_pairs = members.where("pair").join(close, ["rep", "sid"], "left_semi")
    still = members.where("not pair").unionByName(open_pairs)
    still = still.select("bucket", "sid").union(still.select("bucket", "rep")).distinct().join(labelled, "sid", "left")
    still = still.select("sid", F.col("bucket").alias("cell"), F.coalesce("label", "sid").alias("label"))
    mixed = still.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    still = materialise(still.join(mixed.select("cell"), "cell", "left_semi").join(points, "sid"), folder, "still")
    dealt = _block_pairs(still.withColumn("point", F.struct("n", "point")), "point")
    near = materialise(dealt.mapInArrow(partial(_candidates, num, den), "u long, v long"), folder, "near")
    if not near.isEmpty():
        classed = still.select(F.col("sid").alias("u"), F.col("label").alias("a")).distinct()
        across = near.join(classed, "u").join(classed.withColumnsRenamed({"u": "v", "a": "b"}), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        united = components(across, folder, "united").select(F.col("node").alias("label"), F.col("label").alias("cell"))
        chosen = still.select("sid", F.col("id").alias("of"), "n", "label").distinct().join(united, "label")
        chosen = materialise(chosen, folder, "chosen")
        links = _block_pairs(_texts(docs, chosen), "text").mapInArrow(partial(_verify, n, num, den), "u long, v long")
        classes = components(true.unionByName(materialise(links, folder, "links")), folder, "all")

    own = rows.where("sid is not null").groupBy("sid").agg(F.min("id").alias("least"))
    found = own.join(classes, own["sid"] == classes["node"], "left").select("sid", "least", F.coalesce("label", "sid").alias("label"))
    least = found.groupBy("label").agg(F.min("least").alias("component_id"))
    found = found.join(least, "label").select("sid", "component_id")
    return rows.join(found, "sid", "left").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
