"""Removal of repeated substrings of words by recompression.

Rounds of recompression turn a text into ever longer symbols: a round names runs of
equal neighbours, then pairs of a left and a right symbol. A name is a hash of the
parts' names, the same in every task, and which symbols go left is a bit of the
name. So equal substrings get equal symbols, except near their ends.

How far from the ends is bounded, since symbols have a greatest length in every
round: ``EDGE`` words. Every window of ``WINDOW`` words therefore holds symbols that
any other occurrence of the window holds at the same place. One of them, the same in
every occurrence, stands for the window. Windows next to each other that share this
symbol are a block; only blocks are shuffled, one row for about fifteen words.

What a block or a window is, is told by 128 bits: two hashes over its words, made from two
hashes of each word. Symbols in one document only end there. Where all blocks with a symbol are equal,
all but those of the smallest doc_id go. Only where blocks with a symbol differ, at
the edges of copied passages, are their windows looked at one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.store import discard, only, written
from tidewire.llm.words import Powers, Scan, U, mix, pieces, scan, second_hashes, signed, spans_hash, windows

WINDOW = 50
#: Per round: most words of a run's symbol and of a pair's symbol.
ROUNDS = ((2, 4), (4, 8))
LONGEST = ROUNDS[-1][1]
#: A run at the border may reach beyond it, so up to a whole run is unsure; then the first
#: symbol may have been paired with one outside.
EDGE = sum(run + run for run, _ in ROUNDS)
assert WINDOW - 2 * EDGE >= 2 * LONGEST - 1  # then a whole symbol lies within

_BLOCKS, _BLOCKS_TOO = Powers(0x8EBC6AF09C88C6E3), Powers(0xA0761D6478BD642F)
_CONTENT = ("block", "block_too")
_BLOCK = "name long, block long, block_too long, doc long, hash int, first int, n int"


def symbols(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, words) of the symbols after all rounds, over the words of many texts."""
    name = hashes
    start = np.arange(len(hashes))
    size = np.ones(len(hashes), np.int64)
    border = np.zeros(len(hashes) + 1, bool)
    border[first] = True  # no symbol reaches over the beginning of a text
    for level, (run, pair) in enumerate(ROUNDS):
        # Runs: all neighbours with one name, if together not longer than allowed.
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | border[start[1:]]
        heads = np.flatnonzero(new)
        times = np.diff(np.append(heads, len(name)))
        whole = (times > 1) & (times * size[heads] <= run)
        head = np.ones(len(name), bool)
        head[~new & np.repeat(whole, times)] = False
        made = mix(name[heads] + mix(times.astype(U) + U(977 + level)))
        name = name.copy()
        name[heads[whole]] = made[whole]
        size = size.copy()
        size[heads[whole]] *= times[whole]
        name, start, size = name[head], start[head], size[head]
        # Pairs: a left symbol and the right one behind it.
        left = (mix(name + U(31 * level + 7)) >> U(63)).astype(bool)
        joins = left[:-1] & ~left[1:] & (size[:-1] + size[1:] <= pair) & ~border[start[1:]]
        at = np.flatnonzero(joins)
        name, size = name.copy(), size.copy()
        name[at] = mix(name[at] * U(3) + mix(name[at + 1] + U(13 * level + 5)))
        size[at] += size[at + 1]
        head = np.ones(len(name), bool)
        head[at + 1] = False
        name, start, size = name[head], start[head], size[head]
    return name, start, size


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Place of the first least value in ``values[low:high]`` for each pair; no range is empty."""
    places = np.arange(len(values))
    tables = [places]
    span = 1
    while 2 * span <= int((high - low).max(initial=1)):
        a = tables[-1][: len(places) - 2 * span + 1]
        b = tables[-1][span : span + len(a)]
        tables.append(np.where(values[b] < values[a], b, a))
        span *= 2
    level = np.log2(high - low).astype(np.int64)
    out = np.empty(len(low), np.int64)
    for k, table in enumerate(tables):
        here = np.flatnonzero(level == k)
        a, b = table[low[here]], table[high[here] - (1 << k)]
        out[here] = np.where(values[b] < values[a], b, a)
    return out


def blocks(s: Scan) -> tuple[np.ndarray, ...]:
    """(symbol's name, block's two hashes, text, first window's word within the text, windows) of every block."""
    begin, owner = windows(s.hashes, s.first, WINDOW)
    if not len(begin):
        return (np.zeros(0, np.int64),) * 6
    name, start, size = symbols(s.hashes, s.first)
    low = np.searchsorted(start, begin + EDGE)
    high = np.searchsorted(start + size, begin + WINDOW - EDGE, side="right")
    # Long symbols are rare ones; of these the one whose mixed name is least.
    rank = ((LONGEST - size).astype(U) << U(59)) | (mix(name ^ U(0x2545F4914F6CDD1D)) >> U(5))
    chosen = _least(rank, low, high)
    new = np.ones(len(begin), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(begin)))
    text = owner[at]
    ends = begin[at] + count - 1 + WINDOW
    # Where the symbol lies in the block belongs to what the block is.
    inside = (start[chosen[at]] - begin[at]).astype(U)
    content, too = (signed(mix(h + inside)) for h in _contents(s, begin[at], ends))
    return signed(name[chosen[at]]), content, too, text, begin[at] - s.first[text], count


def _contents(s: Scan, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the words ``begin`` to ``end``, for each pair of places."""
    return spans_hash(s.hashes, begin, end, _BLOCKS), spans_hash(second_hashes(s), begin, end, _BLOCKS_TOO)


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        name, content, too, text, first, count = blocks(scan(batch.column("text")))
        where = pa.array(text)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(name, pa.int64()),
                pa.array(content, pa.int64()),
                pa.array(too, pa.int64()),
                batch.column("doc").take(where),
                batch.column("hash").take(where),
                pa.array(first.astype(np.int32)),
                pa.array(count.astype(np.int32)),
            ],
            names=["name", *_CONTENT, "doc", "hash", "first", "n"],
        )


def _ranges(batch: pa.RecordBatch, row: int, column: str) -> list[tuple[int, int]]:
    return [(r["first"], r["n"]) for r in batch.column(column)[row].as_py() or ()]


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window in the ranges of a text: hash, doc, and its place."""
    for batch in pieces(batches):
        s = scan(batch.column("text"))
        firsts, owners = [], []
        for row in range(batch.num_rows):
            for first, n in _ranges(batch, row, "open"):
                firsts.append(np.arange(first, first + n) + s.first[row])
                owners.append(np.full(n, row))
        begin = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        content, too = _contents(s, begin, begin + WINDOW)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(signed(content), pa.int64()),
                pa.array(signed(too), pa.int64()),
                batch.column("doc").take(pa.array(owner)),
                batch.column("hash").take(pa.array(owner)),
                pa.array((begin - s.first[owner]).astype(np.int32), pa.int32()),
            ],
            names=[*_CONTENT, "doc", "hash", "first"],
        )


def text_hash() -> Column:
    return F.hash("text")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc, hash, gone: for each text the ranges (first window, windows) that start in a smaller doc_id too."""
    keyed = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc"), text_hash().alias("hash"), "text"
    )
    found = written(keyed.mapInArrow(_block_rows, _BLOCK), "blocks")
    content = F.struct(*_CONTENT)
    names = (
        found.groupBy("name")
        .agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min(content).alias("a"), F.max(content).alias("b"))
        .where(F.col("low") < F.col("high"))
        .select("name", "low", (F.col("a") == F.col("b")).alias("alike"))
    )
    # Written by itself, so that the shuffle of the counts is gone before that of the rows.
    names = written(names, "names")
    shared = written(found.join(names, "name"), "blocks-shared")
    discard(found, names)
    differing = shared.where(~F.col("alike")).drop("low", "alike")
    smallest = differing.groupBy("name", *_CONTENT).agg(F.min("doc").alias("low"))
    told = written(differing.join(smallest, ["name", *_CONTENT]).drop("name", *_CONTENT), "blocks-told")
    alike = written(
        shared.where(F.col("alike") & (F.col("doc") > F.col("low"))).select("doc", "hash", "first", "n"), "blocks-alike"
    )
    discard(shared)
    # A block whose equal starts in a smaller doc_id is gone whole; the first of its kind stays open.
    opened = (
        told.where(F.col("doc") == F.col("low"))
        .groupBy("doc", "hash")
        .agg(F.collect_set(F.struct("first", "n")).alias("open"))
    )
    texts = only(keyed, opened.select("doc").distinct(), "doc").join(opened, ["doc", "hash"])
    each = written(texts.mapInArrow(_window_rows, "block long, block_too long, doc long, hash int, first int"), "windows")
    first_seen = each.groupBy(*_CONTENT).agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    first_seen = written(first_seen.where(F.col("low") < F.col("high")).drop("high"), "windows-shared")
    later = each.join(first_seen, list(_CONTENT)).where(F.col("doc") > F.col("low"))
    parts = (
        alike,
        told.where(F.col("doc") > F.col("low")).select("doc", "hash", "first", "n"),
        later.select("doc", "hash", "first", F.lit(1).alias("n")),
    )
    every = parts[0].unionAll(parts[1]).unionAll(parts[2])
    gone = written(every.groupBy("doc", "hash").agg(F.collect_set(F.struct("first", "n")).alias("gone")), "gone")
    discard(alike, told, each, first_seen)
    return gone


def _cut(out: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            s = scan(batch.column("text"))
            removed = np.zeros(batch.num_rows, np.int64)
            kept_texts: list[bytes] = []
            for row in range(batch.num_rows):
                low, high = int(s.first[row]), int(s.first[row + 1])
                gone = _ranges(batch, row, "gone")
                if gone:
                    change = np.zeros(high - low + 1, np.int64)
                    for first, n in gone:
                        change[first] += 1
                        change[first + n - 1 + WINDOW] -= 1
                    stays = np.cumsum(change[:-1]) == 0
                    removed[row] = int((~stays).sum())
                    places = low + np.flatnonzero(stays)
                    at, to = s.begin[places].tolist(), s.end[places].tolist()
                    body, base = s.data[s.offsets[row] : s.offsets[row + 1]].tobytes(), int(s.offsets[row])
                    kept_texts.append(b" ".join([body[a - base : b - base] for a, b in zip(at, to, strict=True)]))
                else:
                    # bytes.split parts at the same six characters.
                    kept_texts.append(b" ".join(s.data[s.offsets[row] : s.offsets[row + 1]].tobytes().split()))
            if out == "digest":
                last = pa.array([hashlib.sha256(t).hexdigest() for t in kept_texts])
            else:
                last = pa.array([t.decode() for t in kept_texts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(s.counts, pa.int64()), pa.array(removed), last],
                names=["doc_id", "n_words", "n_removed", out],
            )

    return cut


def remove_repeats(docs: DataFrame, out: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, and the kept words joined by one blank as ``text``, or their
    SHA-256 if ``out`` is ``digest``.

    A word goes if a window of 50 words around it also starts in a document with a
    smaller doc_id. Null text: no words. Fewer than 50 words: nothing goes. Null
    doc_id: it is compared with nothing and keeps its words. Rows of one doc_id are one
    document and remove nothing from each other. Empty table: empty result. Other
    columns are ignored.
    """
    gone = repeated_ranges(docs)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash")
    )
    joined = texts.join(
        gone, (F.col("doc_id") == F.col("doc")) & (F.col("text_hash") == F.col("hash")), "left"
    ).select("doc_id", "text", "gone")
    return joined.mapInArrow(_cut(out), f"doc_id long, n_words long, n_removed long, {out} string")
