"""Quality rules: text statistics, and decision lists learned from labelled ones.

Sequential covering: a rule is a conjunction of thresholds, grown on two thirds of
the labelled documents by information gain, pruned on the rest, and kept if it is
precise there; what it covers is set aside for the next rule. The ordered rules
become one Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.words import Powers, U, mix, pieces, scan, spans_hash, windows

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_digits", "n_marks")
STATS = BASE + MORE

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?,.;:\"'()[]{}-_/\\~^=+@"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_LINES = Powers(0xA0761D6478BD642F)
_LINE_VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _again(keys: np.ndarray) -> np.ndarray:
    """Marks every key that occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """Statistics of every whole text; a null text has only zeros."""
    s = scan(texts)
    data, offsets, n = s.data, s.offsets, len(s.offsets) - 1
    out = {"n_words": s.counts.astype(np.int64)}
    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[s.begin] += 1
    in_word[s.end] -= 1
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool) if len(data) else np.zeros(0, bool)
    out["word_chars"] = _per_text(in_word & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = _per_text(_SYMBOL[data], offsets)
    out["n_upper"], out["n_digits"], out["n_marks"] = (_per_text(t[data], offsets) for t in (_UPPER, _DIGIT, _MARK))

    feeds = np.flatnonzero(data == 0x0A)
    starts = np.union1d(feeds + 1, offsets[:-1])
    starts = starts[starts < len(data)]
    line_of = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), offsets[line_of + 1])
    closed = (ends > starts) & (data[np.maximum(ends, 1) - 1] == 0x0A) if len(starts) else np.zeros(0, bool)
    ends = ends - closed
    words_before = np.searchsorted(s.begin, np.stack([starts, ends]))
    real = words_before[1] > words_before[0]
    starts, ends, line_of = starts[real], ends[real], line_of[real]
    out["n_lines"] = np.bincount(line_of, minlength=n).astype(np.int64)
    keys = spans_hash(_LINE_VALUES[data], starts, ends, _LINES) ^ mix(line_of.astype(U) + U(1))
    distinct = np.unique(keys, return_index=True)[1]
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_of[distinct], minlength=n)

    begin, owner = windows(s.hashes, s.first, 3)
    keys = mix(mix(s.hashes[begin] + U(1)) + mix(s.hashes[begin + 1] + U(2)) * U(3) + mix(s.hashes[begin + 2] + U(3)) * U(5))
    hit = begin[_again(keys ^ mix(owner.astype(U) + U(1)))] if len(begin) else begin
    repeated = np.zeros(len(s.begin), bool)
    for k in range(3):
        repeated[hit + k] = True
    out["n_repeat_words"] = _per_text(repeated, s.first)
    return out


def _stats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        stats = text_stats(batch.column("text"))
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in kept] + [pa.array(stats[c], pa.int64()) for c in STATS], names=[*kept, *STATS]
        )


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of its whole text; null text: zeros."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in STATS)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_stats_of, schema)


# What rules may look at: shares of a document's own size, so one threshold serves all lengths.
FEATURES: dict[str, tuple[str, str]] = {
    "symbols_per_char": ("n_symbols", "word_chars"),
    "chars_per_word": ("word_chars", "n_words"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "marks_per_char": ("n_marks", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
}


def feature(name: str) -> Column:
    part, whole = FEATURES[name]
    return F.col(part).cast("double") / F.greatest(F.col(whole), F.lit(1)).cast("double")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        value = feature(self.feature)
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int, cuts: int) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < longest and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        if not p0:
            break
        best: tuple[float, Condition | None] = (1e-9, None)
        for name, values in x.items():
            order = np.argsort(values[inside], kind="stable")
            v, b = values[inside][order], bad[inside][order]
            edges = np.flatnonzero(v[1:] > v[:-1])
            if len(edges) > cuts:
                edges = edges[np.linspace(0, len(edges) - 1, cuts).astype(int)]
            below_p, below_n = np.cumsum(b)[edges], np.cumsum(~b)[edges]
            for above, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)
                if len(gain) and gain.max() > best[0]:
                    e = edges[int(gain.argmax())]
                    best = (float(gain.max()), Condition(name, above, float((v[e] + v[e + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return tuple(rule)


def learn_rules(
    x: dict[str, np.ndarray],
    bad: np.ndarray,
    pruning: np.ndarray,
    longest: int = 4,
    most_rules: int = 12,
    precision: float = 0.95,
    least: int = 3,
    cuts: int = 128,
) -> list[Rule]:
    """An ordered list of rules for bad documents; whatever no rule covers is good.

    A rule must cover ``least`` bad documents still left, and be right for a share of
    ``precision`` of what it covers, on the pruning part and on all.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)

    def worth(rule: Rule, part: np.ndarray) -> float:
        c = _covers(rule, x, len(bad)) & part & left
        p, n = (c & bad).sum(), (c & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    def accepted(rule: Rule) -> bool:
        hit = _covers(rule, x, len(bad)) & left
        tried = hit & pruning
        right, among = (hit & bad).sum(), (tried & bad).sum()
        return right >= least and right >= precision * hit.sum() and among >= precision * tried.sum()

    barred: set[str] = set()  # features that a first condition has failed with
    while len(rules) < most_rules:
        grow = left & ~pruning
        rule = _grow({k: v[grow] for k, v in x.items() if k not in barred}, bad[grow], longest, cuts)
        if not rule:
            break
        # From the whole rule to its first conditions: the best on the pruning part that is precise enough.
        fit = [rule[:size] for size in range(1, len(rule) + 1) if accepted(rule[:size])]
        if not fit:
            barred.add(rule[0].feature)
            continue
        best = max(fit, key=lambda r: (worth(r, pruning), -len(r)))
        rules.append(best)
        left &= ~_covers(best, x, len(bad))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The rules, in order, as one conditional expression: true keeps a document."""
    out = None
    for rule in rules:
        condition = rule[0].column()
        for c in rule[1:]:
            condition = condition & c.column()
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labelled_stats(docs: DataFrame, labels: DataFrame, most_labelled: int) -> list:
    """Statistics and label of at most ``most_labelled`` labelled documents, chosen by a hash of the id."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_labelled)
    )
    texts = docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    return with_stats(texts).join(F.broadcast(chosen), "doc_id").limit(2 * most_labelled).collect()


def fit_rules(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, **settings) -> list[Rule]:
    """Learns a decision list from ``labels`` (doc_id, quality 0 or 1) of ``docs``.

    ``most_labelled`` bounds what the driver learns from; it is a sample of the
    labelled rows only. No labels, or labels of one class: no rules. Labels other
    than 0 and 1 and null ids are passed over; of contradicting labels the lower counts.
    """
    rows = sorted(labelled_stats(docs, labels, most_labelled), key=lambda r: (r["doc_id"], *[r[c] for c in STATS]))
    if not rows:
        return []
    stats = {c: np.array([r[c] for r in rows], np.float64) for c in STATS}
    x = {name: stats[a] / np.maximum(stats[b], 1.0) for name, (a, b) in FEATURES.items()}
    ids = np.array([r["doc_id"] for r in rows], np.int64)
    return learn_rules(x, np.array([r["quality"] == 0 for r in rows]), mix(ids.view(U)) % U(3) == 0, **settings)


def judge(docs: DataFrame, rules: list[Rule], least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """doc_id, the statistics, base_failed and kept for every row of ``docs``.

    Null or empty text: no words, so base_failed. Null doc_id and repeated rows:
    judged like any other. Empty table: empty result. Other columns are ignored.
    """
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < least_words) | (100 * repeated > most_repeated * n)
    return (
        with_stats(docs)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & verdict(rules))
    )


def _filtered(names: list[str], rules: list[Rule], least_words: int, most_repeated: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            s = text_stats(batch.column("text"))
            ok = (s["n_words"] >= least_words) & (100 * s["n_repeat_words"] <= most_repeated * s["n_words"])
            x = {k: s[a].astype(np.float64) / np.maximum(s[b], 1) for k, (a, b) in FEATURES.items()}
            for rule in rules:
                ok &= ~_covers(rule, x, len(ok))
            yield batch.filter(pa.array(ok)).select(names)

    return keep


def keep_good(docs: DataFrame, rules: list[Rule], least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns; the same decisions as ``judge``, without a join."""
    return docs.mapInArrow(_filtered(docs.columns, rules, least_words, most_repeated), docs.schema)
