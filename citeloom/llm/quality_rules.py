"""Quality rules: a learned decision list over text statistics, emitted as an ordered Spark conditional expression.

``text_statistics`` measures every whole text inside its partition (no shuffle). ``learn`` grows and prunes rules on
the labelled statistics by sequential covering: each rule is a conjunction of thresholds that names bad documents; it is
grown by information gain on two thirds of the rows, pruned on the rest, and accepted only at high precision there,
so that clean documents stay. Covered rows leave, and the next rule is learned from what is left.

All labelled documents teach, each id once. Thresholds are on nine features, ``features``: the words, and ratios of the
counts to words, characters or lines. For learning, a feature is rounded up to 9 binary digits; thresholds are such numbers, so
unrounded features pass them alike. One job a step counts the rows inside by feature and rounded value: the driver gets these
histograms, whose size does not grow with the rows. Ids may be of any type that has an order.

Nulls and empty texts: no words, so all statistics are 0. A label row with a null id or label is ignored; of several
labels of one id the worst counts. Without usable labels, or with labels of one class only, the list is empty and keeps
everything. Repeated rows are judged alike; other columns are passed over, whatever their names.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialise, shared_dir
from ._text import mix, slices, words

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Statistics of a text besides ``n_words``, all counts.
COUNTS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines")
_SYMBOL, _UPPER, _DIGIT, _MARK, _INNER = (np.zeros(256, dtype=bool) for _ in range(5))
_SYMBOL[list(SYMBOLS)] = True
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT[ord("0") : ord("9") + 1] = True
_MARK[list(b".,;:!?")] = True
_INNER[0x80:0xC0] = True
_BLANK = " \t\n\x0b\x0c\r"


def _per_row(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[rows[1:]] - total[rows[:-1]]


def repeated_words(hashes: np.ndarray, first: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """For each row, the words that lie in a window of ``size`` words that the row has twice or more."""
    n = len(hashes)
    covered = np.zeros(n + 1, np.int64)
    if n >= size:
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        windows = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            windows = mix(windows + hashes[k : n - size + 1 + k])
        starts = np.flatnonzero(row[: n - size + 1] == row[size - 1 :])
        keys = mix(windows[starts] ^ mix(row[starts].astype(np.uint64)))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = starts[twice]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + size, -1)
    return _per_row(np.cumsum(covered)[:-1] > 0, first)


def duplicate_lines(text: str | None) -> tuple[int, int]:
    """Lines with a word, and of those the ones equal to an earlier line."""
    lines = [x for x in (text or "").split("\n") if x.strip(_BLANK)]
    return len(lines), len(lines) - len(set(lines))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            found = words(batch.column("text"))
            data, rows = found.data, found.rows
            inside = np.zeros(len(data) + 1, np.int64)
            np.add.at(inside, found.start, 1)
            np.add.at(inside, found.end, -1)
            inside = np.cumsum(inside)[:-1] > 0
            lines = [duplicate_lines(t) for t in batch.column("text").to_pylist()]
            values = {
                "n_words": np.diff(found.first),
                "word_chars": _per_row(inside & ~_INNER[data], rows),
                "n_symbols": _per_row(_SYMBOL[data], rows),
                "n_dup_lines": np.array([d for _, d in lines], np.int64),
                "n_repeat_words": repeated_words(found.hashes(lower=False), found.first),
                "n_upper": _per_row(_UPPER[data], rows),
                "n_digits": _per_row(_DIGIT[data], rows),
                "n_marks": _per_row(_MARK[data], rows),
                "n_lines": np.array([n for n, _ in lines], np.int64),
            }
            yield pa.record_batch([batch.column("id"), *(pa.array(v.astype(np.int64)) for v in values.values())], names=["id", *values])


def text_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``n_words`` and the columns of ``COUNTS`` for every row."""
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in ("n_words", *COUNTS))
    return chosen.mapInArrow(_measure, schema).withColumnRenamed("id", id_column)


def features() -> dict[str, Column]:
    """What rules put thresholds on: ratios of the statistics, each defined for a text without words."""
    per_word = F.greatest("n_words", F.lit(1))
    per_char = F.greatest("word_chars", F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "chars_per_word": F.col("word_chars") / per_word,
        "symbols_per_word": F.col("n_symbols") / per_word,
        "dup_lines_per_line": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_per_word": F.col("n_repeat_words") / per_word,
        "upper_per_char": F.col("n_upper") / per_char,
        "digits_per_char": F.col("n_digits") / per_char,
        "marks_per_word": F.col("n_marks") / per_word,
        "words_per_line": F.col("n_words") / F.greatest("n_lines", F.lit(1)),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self, x: Column | None = None) -> Column:
        x = features()[self.feature] if x is None else x
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def covers(rule: Rule, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(operator.and_, (c.holds(values) for c in rule), np.ones(n, bool))


def _gain(bad: np.ndarray, now: np.ndarray, then: np.ndarray) -> float:
    """FOIL's information gain of narrowing ``now`` to ``then`` for the class ``bad``."""
    p0, n0, p1, n1 = (bad & now).sum(), (~bad & now).sum(), (bad & then).sum(), (~bad & then).sum()
    return p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p0 / (p0 + n0))) if p1 else 0.0


def grow(values: dict[str, np.ndarray], bad: np.ndarray, most: int = 4, cuts: int = 48) -> Rule:
    """Conditions added one at a time, each of greatest gain, until only bad rows are covered or none gains."""
    rule, inside = (), np.ones(len(bad), bool)
    while len(rule) < most and (inside & ~bad).any():
        best, chosen = 0.0, None
        for name, x in values.items():
            for cut in np.unique(np.quantile(x[inside], np.linspace(0, 1, cuts))):
                for above in (True, False):
                    condition = Condition(name, above, float(cut))
                    gain = _gain(bad, inside, inside & condition.holds(values))
                    if gain > best + 1e-9:
                        best, chosen = gain, condition
        if chosen is None:
            break
        rule += (chosen,)
        inside &= chosen.holds(values)
    return rule


def prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The shortest beginning of ``rule`` with the best (p - n) / (p + n) on held-back rows."""

    def worth(k: int) -> float:
        inside = covers(rule[:k], values, len(bad))
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def sequential_covering(values: dict[str, np.ndarray], bad: np.ndarray, held: np.ndarray, precision: float = 0.97, support: int = 3, most: int = 12) -> list[Rule]:
    """Rules for the bad class, in order; ``held`` marks the rows that prune and accept instead of growing."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most and (bad & left & ~held).sum() >= support:
        part = {name: x[left & ~held] for name, x in values.items()}
        rule = grow(part, bad[left & ~held])
        back = {name: x[left & held] for name, x in values.items()}
        rule = prune(rule, back, bad[left & held])
        if not rule:
            break
        inside = covers(rule, values, len(bad)) & left
        p, n = (bad & inside & held).sum(), (~bad & inside & held).sum()
        if p < support or p < precision * (p + n):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: false for the first rule that holds, true if none does."""
    out = None
    for rule in rules:
        test = reduce(operator.and_, (c.column() for c in rule))
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def _rounded(x: Column) -> Column:
    """The least number of 9 binary digits that is not under ``x``; powers of two make that exact."""
    unit = F.pow(F.lit(2.0), F.floor(F.log2(x)) - 8)
    return F.when(x > 0, F.ceil(x / unit) * unit).otherwise(0.0)


def _between(ends: np.ndarray) -> float:
    """The rounded number in the middle of two neighbours, not over the second."""
    middle = float(ends.mean())
    unit = 2.0 ** (np.floor(np.log2(middle)) - 8) if middle > 0 else 1.0
    return float(np.floor(middle / unit) * unit)


def _holds(rule: Rule) -> Column:
    return reduce(operator.and_, (c.column(F.col(c.feature)) for c in rule), F.lit(True))


def _grown(rows: DataFrame, support: int, most: int = 4, cuts: int = 48) -> Rule:
    """``grow`` over a table of rounded features, one histogram a step."""
    rule, names = (), list(features())
    value = F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.col(name).alias("value")) for i, name in enumerate(names)))).alias("x")
    while len(rule) < most:
        found = rows.where(_holds(rule)).select("bad", value).groupBy("x.feature", "x.value").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).toArrow()
        feature, values, n, bad = (found.column(c).to_numpy() for c in ("feature", "value", "n", "bad"))
        best, chosen = 0.0, None
        for i, name in enumerate(names):
            at = np.flatnonzero(feature == i)
            at = at[np.argsort(values[at])]
            ends, bads = np.cumsum(n[at]), np.cumsum(bad[at])
            if not len(at) or bads[-1] == ends[-1] or not rule and bads[-1] < support:
                return rule
            before = np.log2(bads[-1] / ends[-1])
            for k in np.unique(np.searchsorted(ends, np.linspace(0, 1, cuts) * (ends[-1] - 1), "right")):
                for above in (True, False):
                    p, size = (bads[-1] - bads[k], ends[-1] - ends[k]) if above else (bads[k], ends[k])
                    gain = p * (np.log2(p / size) - before) if p else 0.0
                    if gain > best + 1e-9:
                        best, chosen = gain, Condition(name, above, _between(values[at[k : k + 2]]))
        if chosen is None:
            break
        rule += (chosen,)
    return rule


def _covering(rows: DataFrame, precision: float = 0.97, support: int = 3, most: int = 12) -> list[Rule]:
    """``sequential_covering`` over a table of rounded features."""
    rules: list[Rule] = []
    while len(rules) < most:
        left = rows.where(reduce(operator.and_, (~_holds(r) for r in rules), F.lit(True)))
        rule = _grown(left.where("NOT held"), support)
        if not rule:
            break
        parts = range(1, len(rule) + 1)
        told = left.where("held").agg(*(F.coalesce(F.sum(F.when(_holds(rule[:k]), x)), F.lit(0)).alias(f"{c}{k}") for k in parts for c, x in (("p", F.col("bad")), ("n", 1 - F.col("bad"))))).first()
        worth = lambda k, of=told: (of[f"p{k}"] - of[f"n{k}"]) / (of[f"p{k}"] + of[f"n{k}"]) if of[f"p{k}"] + of[f"n{k}"] else -1.0
        best = max(parts, key=lambda k: (worth(k), -k))
        p, n = told[f"p{best}"], told[f"n{best}"]
        if p < support or p < precision * (p + n):
            break
        rules.append(rule[:best])
    return rules


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> list[Rule]:
    """Rules learned from all labelled documents (label 0: bad); of unequal rows of one id the least counts."""
    known = labels.select(F.col(id_column).alias("label_id"), F.col(label_column).alias("label")).dropna().groupBy("label_id").agg((F.min("label") == 0).cast("int").alias("bad"))
    measured = text_statistics(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), "id", "text")
    back = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0
    rounded = F.min(F.struct(*(_rounded(c).alias(n) for n, c in features().items()))).alias("x")
    rows = measured.join(known, F.col("id") == F.col("label_id")).groupBy("id", "bad").agg(rounded).select("bad", back.alias("held"), "x.*")
    rows = materialise(rows, shared_dir(docs.sparkSession), "labelled")
    of = rows.agg(F.min("bad").alias("least"), F.max("bad").alias("most")).first()
    return _covering(rows) if of["least"] != of["most"] else []


def judge(docs: DataFrame, rules: list[Rule], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``text_statistics`` with ``base_failed`` (under 20 words, or over 30 % repeated words) and ``kept``."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = text_statistics(docs, id_column, text_column).withColumn("base_failed", base)
    return judged.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """``judge`` by rules that are learned from ``labels``."""
    return judge(docs, learn(docs, labels, id_column, text_column, label_column), id_column, text_column)
