"""Spelling variants of words, found with K-d trees over letter-count vectors.

A word's vector holds how often it has each letter. One edit changes it little: a
replaced letter raises one count and lowers another, an inserted one raises one, a
deleted one lowers one; so near words lie at most 2 apart, summed over all letters.
For each length there is a K-d tree of that length's words, and each word searches
the trees of its own length and of those one shorter and one longer. A search goes
into a branch only if the counts that one edit may change lead there; in a leaf the
letters' order decides.

The upper part of each tree is laid out on a bounded sample of words and is known to
all tasks: its leaves are cells, to which Spark sends the words that lie there and
those that search there. A cell's own words are built into the lower part of the
tree, and the searching words stream past it. So words are compared with those of a
few cells; no pair but near ones is ever a row, and these are summed up at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.store import reachable, written

#: Letters a-z, then the 64 code points from U+00C0 up.
LETTERS = 26 + 64
#: Words of a leaf that are compared one by one; larger leaves of equal vectors are matched by halves.
LEAF = 48
_LOW7, _TOP = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def lowered(text: Column) -> Column:
    """A-Z as a-z; every other letter stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_words(docs: DataFrame, least: int = 7, often: int = 2, every: int = 31) -> DataFrame:
    """word, n: words of at least ``least`` letters that are found at least ``often`` times.

    Where ``every`` divides the checksum of ``doc_id:run`` the run loses the letter that the
    checksum points at. Null text has no words, a null doc_id counts as an empty one.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        # A shorter run cannot become long enough.
        F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"),
    )
    runs = runs.select("doc", lowered(F.col("run")).alias("run"))
    check = F.crc32(F.concat_ws(":", "doc", "run"))
    at = F.pmod(check, F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(check % every == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= often)


@dataclass
class Words:
    """Words of one length as rows of letter numbers, with their counts."""

    letters: np.ndarray  # (words, length)
    n: np.ndarray
    number: np.ndarray  # of the word in the table it was taken from

    def __len__(self) -> int:
        return len(self.n)

    def take(self, rows: np.ndarray) -> Words:
        return Words(self.letters[rows], self.n[rows], self.number[rows])

    def vectors(self) -> np.ndarray:
        length = self.letters.shape[1]
        out = np.zeros((len(self), LETTERS), np.uint8 if length < 256 else np.int32)
        rows = np.arange(len(self))
        for k in range(length):
            out[rows, self.letters[:, k]] += 1
        return out


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letter numbers of all words, where each word begins and the last one ends)."""
    words = words.cast(pa.large_string())
    _, where, data = words.buffers()
    offsets = np.frombuffer(where, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    whole = data != 0xC3  # the first of two bytes says nothing
    places = np.append(0, np.cumsum(whole))
    data = data[whole]
    return np.where(data < 0x80, data - ord("a"), data - 0x80 + 26).astype(np.uint8), places[offsets - offsets[0]]


def by_length(words: pa.Array, n: np.ndarray) -> dict[int, Words]:
    letters, edges = letters_of(words)
    lengths = np.diff(edges)
    out = {}
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        out[length] = Words(letters[edges[rows][:, None] + np.arange(length)], n[rows], rows)
    return out


@dataclass
class Split:
    """A branch of a K-d tree: fewer than ``least`` of ``letter`` to the left, the others to the right."""

    letter: int
    least: int
    left: object  # Split or leaf
    right: object


def build(vectors: np.ndarray, rows: np.ndarray, most: int, leaf) -> object:
    """A K-d tree over ``vectors[rows]``; ``leaf(rows)`` makes a leaf of at most ``most`` rows or equal vectors."""
    if len(rows) <= most:
        return leaf(rows)
    here = vectors[rows]
    least = np.ceil(here.mean(0)).astype(here.dtype)
    share = (here >= least).mean(0)
    letter = int(np.argmin(np.abs(share - 0.5)))
    right = here[:, letter] >= least[letter]
    if right.all() or not right.any():
        return leaf(rows)
    sides = [build(vectors, rows[~right], most, leaf), build(vectors, rows[right], most, leaf)]
    return Split(letter, int(least[letter]), *sides)


def search(tree: object, vectors: np.ndarray, up: bool, down: bool) -> Iterator[tuple[object, np.ndarray]]:
    """(leaf, rows) for all leaves that vectors can get to by one edit.

    The edit may raise one count if ``up`` and lower one if ``down``. Which letter was
    raised or lowered on the way is kept, so no way needs two edits.
    """
    free = 255  # no letter has this number
    n = len(vectors)
    todo = [(tree, np.arange(n), np.full(n, free if up else 254, np.uint8), np.full(n, free if down else 254, np.uint8))]
    while todo:
        node, rows, raised, sunk = todo.pop()
        if not isinstance(node, Split):
            # Ways with different letters may lead to one leaf.
            yield node, np.unique(rows)
            continue
        have = vectors[rows, node.letter].astype(np.int64) + (raised == node.letter) - (sunk == node.letter)
        right = have >= node.least
        lift = ~right & (raised == free) & (sunk != node.letter) & (have + 1 >= node.least)
        sink = right & (sunk == free) & (raised != node.letter) & (have - 1 < node.least)
        for branch, stays, goes, side in ((node.right, right, lift, raised), (node.left, ~right, sink, sunk)):
            go = np.flatnonzero(stays) if not goes.any() else np.concatenate([np.flatnonzero(stays), np.flatnonzero(goes)])
            if not len(go):
                continue
            new = [raised[go], sunk[go]]
            moved = np.arange(len(go)) >= int(stays.sum())
            new[0 if side is raised else 1][moved] = node.letter
            todo.append((branch, rows[go], *new))


def packed(letters: np.ndarray) -> np.ndarray:
    """Eight letters to a number, the first one lowest; filled up with zeros."""
    rows, length = letters.shape
    wide = np.zeros((rows, -(-length // 8) * 8), np.uint8)
    wide[:, :length] = letters + 1
    return wide.view(np.uint64)


def _replaced(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether exactly one letter differs, for packed words of one length that broadcast."""
    differ = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]), np.int64)
    for k in range(x.shape[-1]):
        d = x[..., k] ^ y[..., k]
        differ += np.bitwise_count((((d & _LOW7) + _LOW7) | d) & _TOP)
    return differ == 1


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many first letters are the same."""
    same = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]), np.int64)
    on = np.ones(same.shape, bool)
    for k in range(min(x.shape[-1], y.shape[-1])):
        d = x[..., k] ^ y[..., k]
        low = np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)) >> 3
        same += np.where(on, np.where(d == 0, 8, low), 0)
        on &= d == 0
    return same


class Bundle:
    """Words of one length with what comparing them needs."""

    def __init__(self, words: Words):
        self.words, self.n = words, words.n
        self.ahead, self.behind = packed(words.letters), packed(words.letters[:, ::-1])

    @property
    def length(self) -> int:
        return self.words.letters.shape[1]


def near(asks: Bundle, a: np.ndarray, held: Bundle, b: np.ndarray) -> np.ndarray:
    """Whether words ``a`` of one bundle and ``b`` of another are one edit apart; index arrays that broadcast."""
    if asks.length == held.length:
        return _replaced(asks.ahead[a], held.ahead[b])
    same = _alike(asks.ahead[a], held.ahead[b])
    short = min(asks.length, held.length)
    # Fillers at the ends must not count as letters that are the same.
    return np.minimum(same, short) + np.minimum(_alike(asks.behind[a], held.behind[b]), short) >= short


def _half_pairs(asks: Bundle, rows: np.ndarray, held: Bundle, members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that agree in their first or last half, which one edit leaves as it is on one side."""
    half = min(asks.length, held.length) // 2
    rest = min(asks.length, held.length) - half
    seen = None
    for part in (slice(None, half), slice(-rest, None)):
        keys = [np.ascontiguousarray(w.letters[r][:, part]) for w, r in ((asks.words, rows), (held.words, members))]
        q, m = (k.view(np.dtype((np.void, k.shape[1]))).ravel() for k in keys)
        names = np.unique(np.concatenate([q, m]), return_inverse=True)[1]
        q, m = names[: len(q)], names[len(q) :]
        order = np.argsort(m, kind="stable")
        low, high = np.searchsorted(m[order], q), np.searchsorted(m[order], q, side="right")
        for first in range(0, len(q), 4096):  # keeps the pairs of a step few
            a, z = low[first : first + 4096], high[first : first + 4096]
            times = z - a
            left = np.repeat(np.arange(first, first + len(a)), times)
            right = order[np.repeat(a - (np.cumsum(times) - times), times) + np.arange(times.sum())]
            if seen is not None:  # those that agree in the first half were given already
                new = seen[0][left] != seen[1][right]
                left, right = left[new], right[new]
            yield rows[left], members[right]
        seen = q, m


class Cell:
    """A cell's words in a K-d tree."""

    def __init__(self, words: Words):
        self.held = Bundle(words)
        vectors = words.vectors()
        self.tree = build(vectors, np.arange(len(words)), LEAF, lambda rows: rows)

    def answer(self, words: Words, step: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per searching word: near words, the largest count among them, and the number of such a word.

        Of words with that count it is the first in code-point order; -1 if there is none.
        """
        asks, held = Bundle(words), self.held
        found = np.zeros(len(words), np.int64)
        best = np.zeros(len(words), np.int64)
        of = np.full(len(words), -1, np.int64)
        # Members come in code-point order, so the lowest place is the first word.
        for members, rows in search(self.tree, words.vectors(), asks.length <= held.length, asks.length >= held.length):
            if len(members) > LEAF:
                pairs = _half_pairs(asks, rows, held, members)
            else:
                size = max(1, step // len(members))
                pairs = ((rows[k : k + size, None], members[None, :]) for k in range(0, len(rows), size))
            for a, b in pairs:
                hit = np.nonzero(near(asks, a, held, b))
                a, b = (np.broadcast_to(x, np.broadcast_shapes(a.shape, b.shape))[hit] for x in (a, b))
                if not len(a):
                    continue
                np.add.at(found, a, 1)
                order = np.lexsort((b, -held.n[b], a))
                a, b = a[order], b[order]
                first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                a, b = a[first], b[first]
                better = (held.n[b] > best[a]) | ((held.n[b] == best[a]) & ((of[a] < 0) | (b < of[a])))
                best[a[better]], of[a[better]] = held.n[b[better]], b[better]
        return found, best, of


_SENT = "cell long, kind byte, word string, n long"
_FOUND = "word string, n_near long, form_n long, form string"
#: Cells of a length have numbers below this.
_WIDE = 1 << 24


class _Number:
    """Numbers the cells of one length as they are made."""

    def __init__(self, length: int):
        self.next = length * _WIDE

    def __call__(self, rows: np.ndarray) -> int:
        self.next += 1
        return self.next - 1


def plan_cells(words: DataFrame, cell_words: int, sample_words: int) -> dict[int, object]:
    """For each length with more than ``cell_words`` words the upper part of its tree, laid out on a sample.

    About ``sample_words`` words are taken by their hash and come to the driver. The cells are
    larger than ``cell_words`` where more than ``sample_words`` / 16 of these would be needed.
    """
    lengths = words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    large = lengths.where(F.col("n") > cell_words).agg(
        F.collect_list("length").alias("lengths"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    )
    row = large.first()
    if not row["n"]:
        return {}
    thin = max(1, -(-row["n"] // sample_words))
    taken = words.where(F.length("word").isin(row["lengths"]) & (F.pmod(F.xxhash64("word"), F.lit(thin)) == 0))
    sample = pa.array([r["word"] for r in taken.select("word").collect()], pa.large_string())
    most = max(16, cell_words // thin)
    return {
        length: build(group.vectors(), np.arange(len(group)), most, _Number(length))
        for length, group in by_length(sample, np.zeros(len(sample), np.int64)).items()
    }


def _sender(plan: dict[int, object]):
    def cells(length: int, vectors: np.ndarray, up: bool, down: bool):
        tree = plan.get(length)
        if tree is None:
            yield length * _WIDE, np.arange(len(vectors))
        else:
            yield from search(tree, vectors, up, down)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column("word"), batch.column("n").to_numpy()
            for length, group in by_length(words, n).items():
                vectors = group.vectors()
                # Held in its own cell; searching its own length, the longer and the shorter one.
                ways = ((0, length, False, False), (1, length, True, True), (2, length + 1, True, False), (3, length - 1, False, True))
                for kind, where, up, down in ways:
                    for cell, rows in cells(where, vectors, up, down):
                        at = pa.array(group.number[rows])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(rows), cell), pa.int64()),
                                pa.array(np.full(len(rows), kind), pa.int8()),
                                words.take(at),
                                pa.array(group.n[rows], pa.int64()),
                            ],
                            names=["cell", "kind", "word", "n"],
                        )

    return send


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by cell, a cell's own words first: the answers that a cell has for the others."""
    now, own, cell, names = None, [], None, None

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        key = batch.column("cell").to_numpy() * 2 + (batch.column("kind").to_numpy() > 0)
        edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(key[low]) // 2, int(key[low]) % 2, batch.slice(low, high - low)

    for batch in batches:
        for number, asking, part in parts(batch) if batch.num_rows else ():
            if number != now:
                now, own, cell = number, [], None
            if not asking:
                own.append(part)
                continue
            if not own:
                continue  # no word has this length
            if cell is None:
                table = pa.Table.from_batches(own).combine_chunks()
                names = table.column("word").combine_chunks()
                (words,) = by_length(names, table.column("n").to_numpy()).values()
                cell = Cell(words)
            for group in by_length(part.column("word"), part.column("n").to_numpy()).values():
                found, best, of = cell.answer(group)
                rows = np.flatnonzero(found)
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("word").take(pa.array(group.number[rows])).cast(pa.string()),
                            pa.array(found[rows]),
                            pa.array(best[rows]),
                            names.take(pa.array(of[rows])).cast(pa.string()),
                        ],
                        names=["word", "n_near", "form_n", "form"],
                    )


def near_words(words: DataFrame, cell_words: int = 8192, sample_words: int = 200_000) -> DataFrame:
    """word, n_near, form_n, form: for every word with near ones, how many, and the most frequent of them.

    Two words are near if they differ by one inserted, deleted or replaced letter. Of equally
    frequent ones the first in code-point order is taken.
    """
    sent = words.mapInArrow(_sender(plan_cells(words, cell_words, sample_words)), _SENT)
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartition(max(tasks, 1), "cell").sortWithinPartitions("cell", "kind", "word")
    found = written(dealt.mapInArrow(_searched, _FOUND), "near-words")
    # A word's near ones lie in several cells.
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following the forms of (word, form) ends; forms never lead in a circle.

    Each round doubles the way that is followed.
    """
    ways = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots")
    while ways.where("open").take(1):
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = written(
            ways.join(further, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")
            ),
            "roots",
        )
    return ways.select("word", "root")


def group_variants(docs: DataFrame, times: int = 10, cell_words: int = 8192) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` that is long and frequent enough.

    A word's form is its most frequent near word, if that is found at least ``times`` times
    as often; the root is the last of the forms of forms. Null, empty and letterless texts have no
    words; repeated rows count again; other columns are ignored. Empty table: empty result.
    """
    reachable(docs.sparkSession)
    words = written(count_words(docs), "words")
    joined = words.join(near_words(words, cell_words), "word", "left")
    more = F.col("form_n") >= times * F.col("n")
    found = written(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(more, F.col("form")).alias("form"),
            F.when(more, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
