"""Best-two-fit packing of tokenised documents into sequences of one size.

Lengths are at most the size of a sequence, so the numbers of pieces per length
say all that packing needs. Bins are filled on these counts: the largest piece
that fits, again and again; then the smallest piece in the bin gives way to the
two unpacked pieces that fit its place and the gap most tightly. A filled bin is
repeated as often as the counts allow, so the plan has a few rows per length
however many documents there are. Pieces find their place by their rank among
the pieces of their length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.store import written
from tidewire.llm.words import pieces as sliced

END = (0).to_bytes(4, "little")
_PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"

# Fixed value: how the vocabulary's tokenizer splits words before it merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same for words of lower-case Latin-1 letters and printable ASCII, and which words are such.
_LATIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_LATIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from 256 up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WordIds:
    """Token ids of words as little-endian bytes, kept for words that were seen.

    The tokenizer drops white space and merges only within words, so a text's ids
    are those of its parts between blanks and line feeds. Plain Latin words are split
    here and merged by the tokenizer's model alone; all others go through the whole.
    """

    def __init__(self, path: str, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.seen: dict[str, bytes] = {"": b""}
        self.merged: dict[str, bytes] = {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)["pre_tokenizer"].get("pretokenizers", [{}])
        self.known = steps[0].get("pattern") == {"Regex": SPLIT}

    def _of(self, words: list[str]) -> list[bytes]:
        if len(self.seen) + len(words) > self.most:
            self.seen, self.merged = {"": b""}, {}
        seen, merged, rest = self.seen, self.merged, []
        new = set(words).difference(seen)
        for word in new:
            if self.known and _LATIN.fullmatch(word) and "<|" not in word:
                parts = _LATIN_SPLIT.findall(word.lower())
                for part in parts:
                    if part not in merged:
                        letters = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
                        merged[part] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
                seen[word] = merged[parts[0]] if len(parts) == 1 else b"".join([merged[p] for p in parts])
            else:
                rest.append(word)
        for word, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            seen[word] = array("I", found.ids).tobytes()
        return [seen[word] for word in words]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """For each text the ids and the end id; null is empty."""
        plain = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        if self.known and not pc.any(pc.match_substring(plain, "<|")).as_py():
            # The tokenizer lowers letters itself, behind its special tokens; so there are fewer words to keep.
            plain = pc.ascii_lower(plain)
        lists = pc.split_pattern(plain, " ")
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        ids = self._of(coded.dictionary.to_pylist())
        sizes = np.array([len(b) // 4 for b in ids], np.int64)
        begins = np.cumsum(sizes) - sizes
        taken = sizes[which]
        ends = np.cumsum(taken)
        places = np.repeat(begins[which] - (ends - taken), taken) + np.arange(taken.sum())
        tokens = np.frombuffer(b"".join(ids), "<u4")[places]
        edges = np.append(0, ends)[lists.offsets.to_numpy()]
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield tokens[low:high].tobytes() + END


_tokenizers: dict[str, WordIds] = {}


def _tokenized(path: str, size: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = WordIds(path)
        words, step = _tokenizers[path], 4 * size
        for batch in sliced(batches, 2 << 20):
            out: list[tuple] = []
            encoded = words.encode(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                for n, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[i], types[i]) for i in range(len(names))], names=names
            )

    return cut


def tokenize(docs: DataFrame, path: str, size: int = 2048, with_ids: bool = True) -> DataFrame:
    """Pieces of at most ``size`` token ids: doc_id, piece, start, length, ids_crc32 and, if asked, ids."""
    schema = _PIECE + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenized(path, size, with_ids), schema)


def plan_bins(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, pieces per bin, bins, first bin, offset) that place all pieces.

    Piece ``rank`` of a row goes to bin ``first bin + (rank - first rank) // per bin``.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    ranks, rows, bins = np.zeros(size + 1, np.int64), [], 0
    while left.any():
        used: dict[int, int] = {}
        gap = size
        while gap and len(fits := np.flatnonzero(left[: gap + 1])):
            length = int(fits[-1])
            n = int(min(left[length], gap // length))
            used[length] = used.get(length, 0) + n
            left[length] -= n
            gap -= n * length
        if gap:
            smallest = min(used)
            pair = _best_pair(left, smallest, gap + smallest)
            if pair:
                left[smallest] += 1
                used[smallest] -= 1
                for length in pair:
                    left[length] -= 1
                    used[length] = used.get(length, 0) + 1
        used = {length: n for length, n in sorted(used.items(), reverse=True) if n}
        times = 1 + min(int(left[length]) // n for length, n in used.items())
        offset = 0
        for length, n in used.items():
            left[length] -= n * (times - 1)
            rows.append((length, int(ranks[length]), n, times, bins, offset))
            ranks[length] += n * times
            offset += n * length
        bins += times
    return rows


def _best_pair(left: np.ndarray, more_than: int, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is the largest in (more_than, room]."""
    first = np.flatnonzero(left[:room])
    if not len(first):
        return None
    place = np.searchsorted(first, room - first, side="right") - 1
    ok = place >= 0
    first_of, second = first[ok], first[place[ok]]
    # A length can be taken twice only if two pieces have it; else take the next smaller partner.
    twice = (first_of == second) & (left[second] < 2)
    second = np.where(twice, np.where(place[ok] > 0, first[np.maximum(place[ok] - 1, 0)], -room), second)
    sums = first_of + second
    if not len(sums) or sums.max() <= more_than:
        return None
    best = int(sums.argmax())
    return int(first_of[best]), int(second[best])


def _placed(rows: list[tuple[int, int, int, int, int, int]]):
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    lengths, ranks, per, _, bins, offsets = table.T
    keys = (lengths << 44) + ranks

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            row = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            within = rank - ranks[row]
            sequence = bins[row] + within // per[row]
            offset = offsets[row] + within % per[row] * length
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)],
                names=[*kept, "sequence_id", "offset"],
            )

    return place


def pack(
    docs: DataFrame, path: str, size: int = 2048, with_ids: bool = True, rows_per_salt: int = 500_000
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    A document is its token ids and an end id 0; only one longer than ``size`` is
    cut, and only its last piece may be shorter. Null or empty text: the end id
    alone. Repeated rows and null doc_ids: each row is packed. Empty table: empty
    result. Ranks are given within (length, salt), so that no length, however
    common, is ranked in one task. The driver sees one count per length.
    """
    cut = written(tokenize(docs, path, size, with_ids), "packing")
    salts = max(1, -(-cut.count() // rows_per_salt))
    key = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")
    salted = cut.withColumn("salt", key)
    per_salt = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_salt.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    totals = {r["length"]: r["n"] for r in per_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return cut.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        salted.withColumn("row", F.row_number().over(order))
        .join(bases, ["length", "salt"])
        .withColumn("rank", F.col("base") + F.col("row") - 1)
        .select(*cut.columns, "rank")
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_placed(plan_bins(totals, size)), schema)
