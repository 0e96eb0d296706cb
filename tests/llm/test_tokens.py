import json

import public_tokenizers
import pytest
from llm_helpers import real_docs, rows_of
from tokenizers import Tokenizer

from tidewire.llm import tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = ("doc_id", "n_bytes", "n_tokens", "over_limit")
SPECIAL = ["<|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|>", " <|startoftext|> x", "é ́ Å", "it's o'clock x", "'s 't", "ﬁ Ⅳ ½ ²³", "\t\r\n\x0b\x0c"]


def plain(path):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    model = Tokenizer.from_file(path)
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


def expected(docs, path, limit=2048):
    size = plain(path)
    out = []
    for r in docs.select("doc_id", "text").collect():
        text = r["text"] or ""
        n = size(text)
        out.append((r["doc_id"], len(text.encode()), n, n > limit))
    return sorted(out, key=repr)


def with_special(docs):
    rows = [(900 + i, t, None, None) for i, t in enumerate(SPECIAL)]
    extra = docs.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.unionByName(extra, allowMissingColumns=True)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_odd_documents(odd_docs, no_docs, name):
    path = public_tokenizers.path(name)
    docs = with_special(odd_docs).withColumnsRenamed({"copies": "content", "size": "n_tokens", "spans": "n_bytes"})
    assert rows_of(tokens.count_tokens(docs, path, limit=20), *COLUMNS) == expected(docs, path, 20)
    assert rows_of(tokens.count_tokens(no_docs, path)) == []


@pytest.mark.parametrize("keys", [400_000, 3])
def test_whole_table(work, keys):
    docs = real_docs(work)
    assert rows_of(tokens.count_tokens(docs, WORDS, broadcast_keys=keys), *COLUMNS) == expected(docs, WORDS)


def test_only_distinct_misses_are_encoded_and_kept(work, tmp_path):
    cache = (tmp_path / "counts").as_uri()
    stored = lambda: rows_of(tokens.stored_counts(work, f"{cache}/{tokens.tokenizer_version(WORDS)}"))
    first = work.createDataFrame([(1, "one two"), (2, "one two"), (3, " one\n two "), (4, None)], "doc_id long, text string")
    assert rows_of(tokens.count_tokens(first, WORDS, cache), "doc_id", "n_tokens") == [(1, 2), (2, 2), (3, 2), (4, 0)]
    known = stored()
    assert len(known) == 2
    more = work.createDataFrame([(5, "one two"), (6, "three")], "doc_id long, text string")
    assert rows_of(tokens.count_tokens(more, WORDS, cache), "doc_id", "n_tokens") == [(5, 2), (6, 1)]
    assert len(stored()) == 3
    tokens.count_tokens(first, WORDS, cache)
    assert len(stored()) == 3  # nothing was missing
    # Stored counts are what is returned, and a content stored twice gives no row more.
    folder = f"{cache}/{tokens.tokenizer_version(WORDS)}"
    work.createDataFrame(known, tokens.STORED).write.mode("append").parquet(folder)
    assert rows_of(tokens.count_tokens(first, WORDS, cache), "doc_id", "n_tokens") == [(1, 2), (2, 2), (3, 2), (4, 0)]


def test_versions_do_not_share_counts(work, tmp_path):
    other = tmp_path / "other.json"
    settings = json.loads(open(WORDS, encoding="utf-8").read())
    settings["model"]["merges"] = settings["model"]["merges"][:50]
    other.write_text(json.dumps(settings), encoding="utf-8")
    docs = work.createDataFrame([(1, "something else")], "doc_id long, text string")
    cache = (tmp_path / "counts").as_uri()
    assert tokens.tokenizer_version(WORDS) != tokens.tokenizer_version(str(other))
    for path in (WORDS, str(other), WORDS):
        assert rows_of(tokens.count_tokens(docs, path, cache), *COLUMNS) == expected(docs, path)


def test_blanks_are_dropped_only_where_the_settings_say_so():
    known = json.loads(open(WORDS, encoding="utf-8").read())
    assert tokens.drops_blanks(known)
    assert not tokens.drops_blanks(json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()))
    for change in (
        {"normalizer": {"type": "Prepend", "prepend": "_"}},
        {"pre_tokenizer": {"type": "Whitespace"}},
        {"added_tokens": [{"content": "<x>", "lstrip": True}]},
    ):
        assert not tokens.drops_blanks({**known, **change})
