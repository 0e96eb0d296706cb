"""Token counts with a digest cache.

A text's count depends on its normalised content and on the tokenizer alone. Both are
named by digests; counts once found are stored under these. Texts are joined to the
stored counts by their digests, one row for each distinct content that is missing is
encoded, and its count is appended to the store.

The store is a folder of Parquet tables, one per tokenizer version, of rows
(content, n_tokens). Rows are only ever added; a content that two runs added at the
same time has equal rows, which are read as one.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.store import reachable, written
from tidewire.llm.words import pieces
from tidewire.session import work_dir

STORED = "content binary, n_tokens long"
#: White space of ASCII: a run of it counts as one blank wherever the tokenizer drops white space.
_BLANKS = r"[\x09-\x0D\x20]+"


def word_tokenizer() -> str:
    """Where the vocabulary of the registered query lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _settings(path: str) -> dict:
    if path.endswith(".model"):
        return {}
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def drops_blanks(settings: dict) -> bool:
    """Whether a tokenizer's settings say that white space gives no token and parts all it merges.

    Then a text's count is the sum of the counts of its blank-separated words. Known for
    normalizers that work on each character or its marks, a splitter that keeps only what
    is no white space, and added tokens that take no blanks with them.
    """
    normalizer = settings.get("normalizer") or {}
    steps = normalizer.get("normalizers", [normalizer])
    plain = all(
        s.get("type") in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", None)
        or (s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " ")
        for s in steps
    )
    splitter = settings.get("pre_tokenizer") or {}
    first, *others = splitter.get("pretokenizers", [splitter])
    pattern = (first.get("pattern") or {}).get("Regex", "")
    kept = pattern.split("|")
    words_only = all(p in (r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+") or p[:1] == "'" and p[1:].isalpha() for p in kept)
    parts = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and words_only
    bytes_only = all(o.get("type") == "ByteLevel" and not o.get("add_prefix_space") and not o.get("use_regex") for o in others)
    alone = not any(
        t.get(k) for t in settings.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")
    )
    return plain and bool(parts) and bytes_only and alone and not settings.get("post_processor")


def tokenizer_version(path: str) -> str:
    """A digest of the vocabulary file, the library that reads it, and how it is called."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    known = hashlib.sha256(f"{library.__name__} {library.__version__} plain\n".encode())
    with open(path, "rb") as file:
        known.update(file.read())
    return known.hexdigest()


class Counter:
    """Numbers of tokens of whole texts, without begin, end or added special tokens."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.most, self.seen = most, {"": 0}
        self.by_word = False
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self._sizes = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._sizes = lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            self.by_word = drops_blanks(_settings(path))

    def _of_words(self, words: list[str]) -> list[int]:
        if len(self.seen) + len(words) > self.most:
            self.seen = {"": 0}
        seen = self.seen
        new = [w for w in words if w not in seen]
        for low in range(0, len(new), 8192):
            part = new[low : low + 8192]
            seen.update(zip(part, self._sizes(part), strict=True))
        return [seen[w] for w in words]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """One number per text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_word:
            return np.array(self._sizes(texts.to_pylist()), np.int64)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        sizes = np.array(self._of_words(coded.dictionary.to_pylist()), np.int64)
        sums = np.append(0, np.cumsum(sizes[coded.indices.to_numpy()]))
        return np.diff(sums[lists.offsets.to_numpy()])


_counters: dict[str, Counter] = {}


def _counted(path: str, version: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if version not in _counters:
            if tokenizer_version(path) != version:
                raise ValueError(f"{path} differs here from the file that the counts are stored for")
            _counters.clear()
            _counters[version] = Counter(path)
        counter = _counters[version]
        for batch in pieces(batches, 2 << 20):
            # Repeated rows of one document need one count.
            firsts = pa.table({"c": batch.column("content"), "i": pa.array(np.arange(batch.num_rows))})
            firsts = firsts.group_by("c").aggregate([("i", "min")]).column("i_min").combine_chunks()
            own = batch.take(firsts)
            counts = pa.array(counter.counts(own.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([own.column("content"), counts], names=["content", "n_tokens"])

    return count


def content_digest(text: Column, by_word: bool) -> Column:
    """SHA-256 of a text's content; null counts as empty.

    Where white space gives no token, runs of it are one blank and that at the ends is
    left out; otherwise the content is the text itself.
    """
    text = F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.trim(F.regexp_replace(text, _BLANKS, " ")) if by_word else text, 256))


def stored_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What a tokenizer version's store holds; nothing where it does not exist yet."""
    try:
        return spark.read.schema(STORED).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)


def count_tokens(
    docs: DataFrame, path: str, cache: str | None = None, limit: int = 2048, broadcast_keys: int = 400_000
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    ``cache`` is the store's folder, which all executors reach; without it a new one in the
    shared folder is filled. Null text counts as empty, which has no token. Repeated rows,
    null doc_ids and equal texts each get their row; a content is encoded once, however
    many rows have it. Special strings in a text count as the library handles them by
    default. Empty table: empty result, nothing is added. Other columns are ignored.

    Texts stay where they are read while at most ``broadcast_keys`` contents are
    missing; beyond that the texts that may be missing are shuffled by (doc_id, content),
    so copies, however many, are spread.
    """
    spark = reachable(docs.sparkSession)
    version, by_word = tokenizer_version(path), drops_blanks(_settings(path))
    folder = f"{(cache or work_dir(spark, 'token-counts')).rstrip('/')}/{version}"
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "content", content_digest(F.col("text"), by_word)
    )
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    rows = written(keyed.select("doc_id", size, "content"), "token-rows")
    contents = written(rows.groupBy("content").agg(F.min("doc_id").alias("doc_id")), "token-contents")
    missing = written(contents.join(stored_counts(spark, folder), "content", "left_anti"), "token-misses")
    n = missing.count()
    if n:
        asked = missing.withColumnsRenamed({"doc_id": "m_doc", "content": "m_content"})
        same = F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("content") == F.col("m_content"))
        texts = keyed.join(F.broadcast(asked) if n <= broadcast_keys else asked, same, "left_semi")
        fresh = texts.select("content", "text").mapInArrow(_counted(path, version), STORED)
        fresh.write.mode("append").option("compression", "zstd").parquet(folder)
    known = stored_counts(spark, folder).join(contents.select("content"), "content", "left_semi")
    known = written(known.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "token-known")
    return rows.join(known, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
