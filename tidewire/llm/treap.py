"""Ranked lexical search in K2-treaps over a grid of terms and documents.

A shard is a grid whose rows are terms and whose columns are documents; a point is a term's
impact in a document. The grid is a compressed quadtree: each level keeps, for its
non-empty cells only, which of the four parts of a cell are not empty, and the greatest impact
in it. Parts are found by counting the parts before, so there are no pointers.

A search follows the rows of all terms of an item down together, one range of documents at a
time, best first: what the terms can add at most in a range, by the maxima of the cells they
have come to, says which ranges are split next. Ranges that cannot reach the item's
threshold, its k-th best score so far, are left out; a range of one document has its exact score.

Columns are ordered by document length, so documents of a range have like impacts and the
maxima are near to them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.store import reachable, written
from tidewire.llm.words import LOWER, Powers, pieces, spans_hash

#: ASCII letters and digits, and all bytes of other characters.
IN_TERM = np.ones(256, bool)
IN_TERM[:128] = False
IN_TERM[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_VALUES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = Powers(0x9E3779B97F4A7C15)
_PARTS = np.array([bin(m).count("1") for m in range(16)], np.int64)


@dataclass
class Terms:
    data: np.ndarray  # lower-cased bytes
    begin: np.ndarray  # of each term
    end: np.ndarray
    first: np.ndarray  # number of terms before each text, and of all


def terms_of(texts: pa.Array) -> Terms:
    """Terms of every whole text; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = int(offsets[0])
    data = np.frombuffer(data, np.uint8)[low : int(offsets[-1])] if data else np.zeros(0, np.uint8)
    offsets = offsets - low
    inside = IN_TERM[data]
    before, after = inside.copy(), inside.copy()
    before[1:] &= ~inside[:-1]
    after[:-1] &= ~inside[1:]
    # A term ends with its text, whatever the next one begins with.
    filled = np.flatnonzero(offsets[:-1] < offsets[1:])
    before[offsets[filled]] = inside[offsets[filled]]
    after[offsets[filled + 1] - 1] = inside[offsets[filled + 1] - 1]
    begin, end = np.flatnonzero(before), np.flatnonzero(after) + 1
    return Terms(LOWER[data], begin, end, np.searchsorted(begin, offsets))


class Vocabulary:
    """The rows of the grid: distinct terms, found by hash and compared byte by byte."""

    def __init__(self, terms: list[str]):
        joined = terms_of(pa.array(terms, pa.large_string()))
        if len(joined.begin) != len(terms):
            raise ValueError("each entry must be one term")
        hashes = self._hashes(joined)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.rows = hashes[order], order
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("terms must differ, and so must their hashes")
        self.data, self.begin, self.end = joined.data, joined.begin, joined.end

    def __len__(self) -> int:
        return len(self.rows)

    @staticmethod
    def _hashes(t: Terms) -> np.ndarray:
        with np.errstate(over="ignore"):
            return spans_hash(_VALUES[t.data], t.begin, t.end, _POWERS)

    def rows_of(self, t: Terms) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``t``, their rows) of the terms that are in the vocabulary."""
        if not len(self) or not len(t.begin):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = self._hashes(t)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        places = np.flatnonzero(self.hashes[at] == hashes)
        rows = self.rows[at[places]]
        size = t.end[places] - t.begin[places]
        same = size == self.end[rows] - self.begin[rows]
        places, rows, size = places[same], rows[same], size[same]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differ = t.data[np.repeat(t.begin[places], size) + within] != self.data[np.repeat(self.begin[rows], size) + within]
        wrong = np.zeros(len(places) + 1, np.int64)
        np.add.at(wrong, np.repeat(np.arange(len(places)), size)[differ], 1)
        good = wrong[:-1] == 0
        return places[good], rows[good]


_POSTINGS = "doc_id long, n long, term array<int>, tf array<int>"


def _postings(vocabulary: Vocabulary):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            t = terms_of(batch.column("text"))
            places, term = vocabulary.rows_of(t)
            doc = np.searchsorted(t.first, places, side="right") - 1
            key, tf = np.unique(doc * np.int64(max(len(vocabulary), 1)) + term, return_counts=True)
            doc, term = key // max(len(vocabulary), 1), key % max(len(vocabulary), 1)
            edges = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(t.first), pa.int64()),
                    pa.ListArray.from_arrays(edges, pa.array(term, pa.int32())),
                    pa.ListArray.from_arrays(edges, pa.array(tf, pa.int32())),
                ],
                names=["doc_id", "n", "term", "tf"],
            )

    return rows


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a term adds to a document's score for each unit of its weight."""
    # Beyond 64 bits only where the products could be so large.
    if n.size and 90 * int(n.max()) * docs >= 2**63:
        m = np.array([10 + (90 * int(x) * docs) // total for x in n.tolist()], object)
        return np.array([(10**9 * a) // (1000 * a + 8 * b) for a, b in zip(tf.tolist(), m, strict=True)], np.int64)
    m = 10 + (90 * n * docs) // max(total, 1)
    return (10**9 * tf) // (1000 * tf + 8 * m)


class Treap:
    """A compressed quadtree over points (row, column) whose cells keep the greatest value in them."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, side: int):
        self.height = max(1, int(side - 1).bit_length())
        key = _interleaved(row.astype(np.uint64), column.astype(np.uint64)).astype(np.int64)
        order = np.argsort(key)
        key, value = key[order], value[order]
        levels = [(None, value)]
        for _ in range(self.height):
            new = np.append(True, (key[1:] >> 2) != (key[:-1] >> 2)) if len(key) else np.zeros(0, bool)
            heads = np.flatnonzero(new)
            mask = np.bitwise_or.reduceat((1 << (key & 3)).astype(np.uint8), heads) if len(key) else np.zeros(0, np.uint8)
            value = np.maximum.reduceat(value, heads) if len(key) else value
            key = key[heads] >> 2
            levels.append((mask, value))
        #: From the root down: which parts a cell has, where its first part is, and the greatest value.
        self.levels = [(m, np.cumsum(_PARTS[m]) - _PARTS[m] if m is not None else None, v) for m, v in reversed(levels)]

    def part(self, level: int, cell: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The cells of the next level that are a given part of cells of a level; -1 where that is empty."""
        mask, first, _ = self.levels[level]
        have = np.where(cell >= 0, mask[cell], 0)
        inside = (have >> part) & 1
        return np.where(inside == 1, first[cell] + _PARTS[have & ((1 << part) - 1)], -1)

    def most(self, level: int, cell: np.ndarray) -> np.ndarray:
        return np.where(cell >= 0, self.levels[level][2][cell], 0)


def _spread(x: np.ndarray) -> np.ndarray:
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


def _interleaved(row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Bits of the row and the column in turn, the row's higher."""
    return (_spread(row) << np.uint64(1)) | _spread(column)


def best_of(treap: Treap, rows: np.ndarray, weights: np.ndarray, k: int, least: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(columns, scores) of all documents that score at least the k-th best, or ``least`` if that is more.

    ``step`` ranges are split at once, those with the highest bounds first; longer ranges
    go first of equal ones.
    """
    none = np.zeros(0, np.int64)
    if not len(rows) or not len(treap.levels[0][2]):
        return none, none
    height = treap.height
    # Ranges still to be split, by level: columns, bounds, and the cell each term has come to.
    open_ = {0: [(np.zeros(1, np.int64), np.array([np.iinfo(np.int64).max]), np.zeros((1, len(rows)), np.int64))]}
    found: list[tuple[np.ndarray, np.ndarray]] = []
    best: list[int] = []
    heap = [(-np.iinfo(np.int64).max, 0, 0)]
    while heap:
        bound, level, at = heapq.heappop(heap)
        if -bound < least:
            break
        column, bounds, cells = open_[level][at]
        open_[level][at] = None
        keep = bounds >= least
        column, cells = column[keep], cells[keep]
        # Both halves of each range; a row's bit of this level says which half of the rows it is in.
        row_bit = (rows >> (height - 1 - level)) & 1
        halves = [treap.part(level, cells, (row_bit << 1) | half) for half in (0, 1)]
        cells = np.concatenate(halves)
        column = np.concatenate([column << 1, (column << 1) | 1])
        bounds = treap.most(level + 1, cells) @ weights
        keep = bounds >= least
        column, bounds, cells = column[keep], bounds[keep], cells[keep]
        if not len(column):
            continue
        if level + 1 == height:
            found.append((column, bounds))
            best = heapq.nlargest(k, best + bounds.tolist())
            if len(best) == k:
                least = max(least, best[-1])
            continue
        order = np.argsort(-bounds, kind="stable")
        for low in range(0, len(order), step):
            take = order[low : low + step]
            held = open_.setdefault(level + 1, [])
            held.append((column[take], bounds[take], cells[take]))
            heapq.heappush(heap, (-int(bounds[take[0]]), level + 1, len(held) - 1))
    if not found:
        return none, none
    columns, scores = (np.concatenate(x) for x in zip(*found, strict=True))
    good = scores >= least
    return columns[good], scores[good]


@dataclass
class Query:
    """An item's terms: rows of the grid and their weights."""

    item: int | None
    rows: np.ndarray
    weights: np.ndarray


_HITS = "item int, doc_id long, score long"


def _searcher(queries: list[Query], docs: int, total: int, k: int, terms: int, shard_points: int, shard_docs: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = [1] * len(queries)  # thresholds, kept from shard to shard
        kept: list[list[int]] = [[] for _ in queries]
        held: list[pa.RecordBatch] = []

        def shard() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            n = table.column("n").to_numpy()
            order = np.argsort(n, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            lists = table.column("term").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(n)), sizes)
            term = lists.flatten().to_numpy().astype(np.int64)
            tf = table.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)
            treap = Treap(term, place[owner], impacts(tf, n[owner], docs, total), max(terms, len(n)))
            ids = table.column("doc_id").combine_chunks()
            for i, query in enumerate(queries):
                columns, scores = best_of(treap, query.rows, query.weights, k, least[i])
                if not len(columns):
                    continue
                kept[i] = heapq.nlargest(k, kept[i] + scores.tolist())
                if len(kept[i]) == k:
                    least[i] = max(least[i], kept[i][-1])
                good = scores >= least[i]
                chosen = ids.take(pa.array(order[columns[good]]))
                # Of equal scores the smallest ids stay; no more than k documents can be among the best.
                ranked = pa.table({"d": chosen, "s": pa.array(scores[good])})
                first = pc.sort_indices(ranked, [("s", "descending"), ("d", "ascending")], null_placement="at_end")[:k]
                ranked = ranked.take(first).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ranked), i, np.int32)),
                        ranked.column("d").combine_chunks(),
                        ranked.column("s").combine_chunks(),
                    ],
                    names=["item", "doc_id", "score"],
                )

        points = rows = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                held.append(part)
                points += len(part.column("term").flatten())
                rows += part.num_rows
                if points >= shard_points or rows >= shard_docs:
                    yield from shard()
                    points = rows = 0
        if held:
            yield from shard()

    return search


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _blocks(items: DataFrame, block_terms: int) -> Iterator[list[tuple[int | None, list[str]]]]:
    """Items with their distinct terms, in blocks of at most ``block_terms`` terms or one item."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TERM), F.lit(0))
    low = F.transform(found, lambda t: F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    each = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(low).alias("term")).distinct()
    listed = each.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    block: list[tuple[int | None, list[str]]] = []
    room = block_terms
    for row in listed.orderBy("item_id").toLocalIterator():
        if block and len(row["terms"]) > room:
            yield block
            block, room = [], block_terms
        block.append((row["item_id"], row["terms"]))
        room -= len(row["terms"])
    if block:
        yield block


def _ranked(docs: DataFrame, block: list[tuple[int | None, list[str]]], k: int, shard_points: int, shard_docs: int) -> DataFrame:
    """item, doc_id, score: each shard's best for the items of a block, by their place in it."""
    terms = sorted({t for _, ts in block for t in ts})
    vocabulary = Vocabulary(terms)
    postings = written(docs.mapInArrow(_postings(vocabulary), _POSTINGS), "postings")
    row = postings.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    counted = postings.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = {r["term"]: r["df"] for r in counted.collect()}  # one row per term of the block
    at = {t: i for i, t in enumerate(terms)}
    queries = []
    for item, own in block:
        rows = np.array([at[t] for t in own if at[t] in df], np.int64)
        weights = np.array([weight(row["docs"], df[r]) for r in rows.tolist()], np.int64)
        queries.append(Query(item, rows[weights > 0], weights[weights > 0]))
    search = _searcher(queries, row["docs"], row["total"], k, len(terms), shard_points, shard_docs)
    return postings.where(F.size("term") > 0).mapInArrow(search, _HITS)


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = 200_000, shard_points: int = 2_000_000, shard_docs: int = 65_536
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for every item.

    Equal scores go by ascending doc_id, null last. Rows of ``docs`` are documents each, repeated
    or not; a null text has no terms and counts as no document. Rows of ``items`` with one
    item_id, null included, are one item; an item without terms, or whose terms no document has,
    has no rows. Empty tables: empty result. Other columns are ignored.

    Items come to the driver in blocks of at most ``block_terms`` terms, which go to all tasks; each
    block reads the documents once. A shard has at most ``shard_points`` points and 1024 documents more.
    """
    spark = reachable(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(items, block_terms):
        hits = _ranked(keyed, block, k, shard_points, shard_docs)
        top = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item int, item_id long")
        found = written(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        out = out.unionAll(found)
    return out
