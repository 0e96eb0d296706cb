"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A
3-gram is the product of its letters' vectors, each rotated by its place; a text
is the sum of its 3-grams, a language the sum of its texts. A text gets the
language with the highest cosine, once the mean of all languages is taken away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.words import U, mix, pieces

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point whether it is a letter; made once per worker."""
    if not _letters:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
        _letters.append(table)
    return _letters[0]


def letter_vectors(code_points: np.ndarray, dims: int) -> np.ndarray:
    """+1 and -1 from the bits of mixed (code point, place) numbers."""
    places = np.arange(dims // 64, dtype=U)
    bits = mix(mix(code_points.astype(U) + U(0x51ED2701))[:, None] + places[None, :] * U(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def gram_vectors(grams: np.ndarray, dims: int) -> np.ndarray:
    """Bound vectors of packed 3-grams."""
    mask = U((1 << 21) - 1)
    codes, place = np.unique(np.concatenate([grams >> U(42), (grams >> U(21)) & mask, grams & mask]), return_inverse=True)
    base = letter_vectors(codes, dims)
    a, b, c = place.reshape(3, -1)
    return np.roll(base, 2, 1)[a] * np.roll(base, 1, 1)[b] * base[c]


def _compact(grams: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct packed 3-grams, which of them each is); by tables where the letters are few, else by sorting."""
    seen = np.zeros(0x110000, bool)
    for g in grams:
        seen[g] = True
    letters = np.flatnonzero(seen)
    n = len(letters)
    a, b, c = grams
    if n > 200:
        return np.unique((a.astype(U) << U(42)) | (b.astype(U) << U(21)) | c, return_inverse=True)
    number = np.zeros(0x110000, np.int32)
    number[letters] = np.arange(n)
    key = (number[a] * n + number[b]) * n + number[c]
    used = np.zeros(n**3, bool)
    used[key] = True
    found = np.flatnonzero(used)
    place = np.zeros(n**3, np.int32)
    place[found] = np.arange(len(found))
    code = letters.astype(U)
    return (code[found // n**2] << U(42)) | (code[found // n % n] << U(21)) | code[found % n], place[key]


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct 3-grams, which one each is, where each text's begin) over lower-case letters.

    Words are parted by one blank, texts begin and end with one.
    """
    is_letter = _is_letter()
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "replace"), np.uint32)
    begins = np.cumsum([1, *[len(t) + 1 for t in lowered]])
    letter = is_letter[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank behind each word
    keep[:-1] |= letter[1:] & ~letter[:-1]  # and one before it
    place = np.flatnonzero(keep)
    shown = np.where(letter[place], codes[place], np.uint32(0))
    alone = np.ones(len(shown), bool)
    alone[1:] = (shown[1:] != 0) | (shown[:-1] != 0)
    place, shown = place[alone], shown[alone]
    if len(shown) < 3:
        return np.zeros(0, U), np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    real = np.flatnonzero(shown[1:-1] != 0)  # a 3-gram belongs to the text of its middle, a letter
    edges = np.searchsorted(place[1:-1][real], begins)
    distinct, which = _compact((shown[real], shown[real + 1], shown[real + 2]))
    return distinct, which, edges


def _bundles(dims: int):
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in pieces(batches):
            langs = batch.column("lang").to_pylist()
            distinct, which, edges = grams_of(batch.column("text").to_pylist())
            if not len(distinct):
                continue
            vectors = gram_vectors(distinct, dims)
            size = np.diff(edges)
            # Each text weighs the root of its length: long ones more, but not all. Whole
            # numbers add up alike in any order, so reruns agree to the last bit.
            weights = np.repeat(np.rint(65_536 / np.sqrt(np.maximum(size, 1))), size)
            for lang in set(langs):
                mine = np.repeat(np.array([x == lang for x in langs]), size)
                weight = np.bincount(which[mine], weights[mine], minlength=len(distinct))
                used = np.flatnonzero(weight)
                sums[lang] = sums.get(lang, 0) + weight[used] @ vectors[used].astype(np.float64)
        for lang, values in sums.items():
            n = len(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(values.astype(np.int64))],
                names=["lang", "dim", "value"],
            )

    return bundle


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit_prototypes(docs: DataFrame, learn_from: Column, dims: int = 512, most_languages: int = 10_000) -> dict[str, np.ndarray]:
    """A unit vector per language, from all rows of ``docs`` that ``learn_from`` marks.

    Tasks send one vector per language; more languages than ``most_languages`` is an
    error, so the driver's share is bounded. Null lang and texts without a letter
    teach nothing.
    """
    rows = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    summed = (
        rows.mapInArrow(_bundles(dims), "lang string, dim int, value long")
        .groupBy("lang", "dim")
        .agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("double").alias("value"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("values"))
    )
    found = summed.limit(most_languages + 1).collect()
    if len(found) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    raw = {r["lang"]: np.array([v["value"] for v in r["values"]]) for r in found}
    raw = {k: v / np.linalg.norm(v) for k, v in sorted(raw.items()) if np.linalg.norm(v) > 0}
    mean = np.mean(list(raw.values()), axis=0) if len(raw) > 1 else np.zeros(dims)
    return {k: (v - mean) / np.linalg.norm(v - mean) for k, v in raw.items() if np.linalg.norm(v - mean) > 1e-9}


def _guesser(prototypes: dict[str, np.ndarray], dims: int):
    langs = np.array([*prototypes, "und"], object)
    matrix = np.array([*prototypes.values()], np.float32).reshape(-1, dims)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 20):
            n = batch.num_rows
            best, score = np.full(n, len(langs) - 1), np.zeros(n)
            distinct, which, edges = grams_of(batch.column("text").to_pylist())
            if len(distinct) and len(matrix):
                vectors = gram_vectors(distinct, dims).astype(np.float32)
                for i in np.flatnonzero(np.diff(edges)):
                    used, times = np.unique(which[edges[i] : edges[i + 1]], return_counts=True)
                    bundle = times.astype(np.float32) @ vectors[used]
                    cosine = matrix @ bundle / max(float(np.linalg.norm(bundle)), 1e-9)
                    best[i] = int(cosine.argmax())
                    score[i] = min(1.0, max(0.0, (1.0 + float(cosine[best[i]])) / 2))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs[best], pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return guess


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], held_out: Column, dims: int = 512) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; only the text is looked at.

    Null text, or one without a letter: ``und`` with score 0; so are all texts if no
    language was learned. Null doc_id and repeated rows: predicted like any other.
    Empty table: empty result. Other columns are ignored. Ties go to the first
    language by name.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(_guesser(prototypes, dims), "doc_id long, held_out boolean, lang_pred string, score double")
