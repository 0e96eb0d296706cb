"""The registered queries of the operators, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import (
    chat,
    jaccard,
    langid,
    mixing,
    packing,
    quality,
    recompress,
    sanitise,
    secrets,
    spans,
    tokens,
    topk,
    treap,
    variants,
)
from tidewire.llm.store import reachable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.mix_rates(_table(spark, sf_dir, "documents"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return rated.select("doc_id", "size", "source_size", "target", taken)


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompress.remove_repeats(_table(spark, sf_dir, "documents"), out="digest")
    return found.withColumnRenamed("digest", "kept_sha256")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality.fit_rules(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", *quality.BASE, "base_failed", "kept")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rest = langid.remainder(F.col("doc_id"))
    return langid.predict(docs, langid.fit_prototypes(docs, rest != 1), rest == 1)


def _digests(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return found.select(
        "doc_id",
        *[spans.count_of(F.col("base"), k).alias(f"n_{k}") for k in kinds],
        F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"),
        spans.joined(F.col("spans")).alias("spans"),
    )


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(secrets.find_secrets(_table(spark, sf_dir, "documents")), secrets.KINDS[:3])


def topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, tokens.word_tokenizer(), with_ids=False).withColumn("length", F.col("length").cast("long"))


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(_table(spark, sf_dir, "documents"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(sanitise.find_personal(_table(spark, sf_dir, "documents")), sanitise.KINDS[:4])


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    added = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    read = chat.read_chats(chat.format_chats(turns.unionByName(added)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", lines), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(_table(spark, sf_dir, "documents"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), tokens.word_tokenizer())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mix_sources,
    "op2_substring_dedup": substring_dedup,
    "op3_quality_rules": quality_rules,
    "op4_language_id": language_id,
    "op5_secret_scan": secret_scan,
    "op6_topk_search": topk_search,
    "op7_best_fit_packing": best_fit_packing,
    "op8_ngram_jaccard": ngram_jaccard,
    "op9_personal_data": personal_data,
    "op10_chat_format": chat_format,
    "op11_ranked_search": ranked_search,
    "op12_spelling_variants": spelling_variants,
    "op13_token_counts": token_counts,
    "pipeline": corpus_pipeline.run,
}

_ASCII_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), {_ASCII_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_mix_sources": rf"""
        WITH sized AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
        sources AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                        WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                   row_number() OVER (ORDER BY source NULLS LAST) AS turn
            FROM sized GROUP BY source),
        capped AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS full_at FROM sources),
        leveled AS (
            SELECT *, row_number() OVER (ORDER BY full_at, turn) AS place,
                   ((SELECT sum(source_size) FROM sources)::DOUBLE - (sum(cap) OVER w - cap))
                      / ((SELECT sum(weight) FROM sources) - sum(weight) OVER w + weight) AS level
            FROM capped WINDOW w AS (ORDER BY full_at, turn ROWS UNBOUNDED PRECEDING)),
        found AS (SELECT arg_min(level, place) AS level FROM leveled WHERE level <= full_at),
        targets AS (
            SELECT source, source_size, coalesce(least(cap, found.level * weight), cap) AS target FROM capped, found),
        rated AS (
            SELECT doc_id, sized.source, size, source_size, target,
                   least(3.0::DOUBLE, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END) AS rate
            FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
        tried AS (
            SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|mix|' || turn), 1, 12))::BIGINT
                      / 281474976710656.0::DOUBLE AS chance
            FROM rated, (SELECT unnest(range(32)) AS turn)),
        copied AS (
            SELECT *, ((floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM tried),
        sums AS (
            SELECT source, turn, abs(sum(taken)::DOUBLE - any_value(target)) AS off FROM copied GROUP BY source, turn),
        chosen AS (
            SELECT source, turn FROM sums QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, turn) = 1)
        SELECT doc_id, size, source_size, target, taken
        FROM copied JOIN chosen ON copied.turn = chosen.turn AND copied.source IS NOT DISTINCT FROM chosen.source""",
    "op2_substring_dedup": rf"""
        WITH texts AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        starts AS (
            SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM texts WHERE len(words) >= 50),
        windows AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS said FROM starts),
        firsts AS (SELECT said, min(doc_id) AS low FROM windows GROUP BY said),
        gone AS (
            SELECT doc_id, unnest(range(i, i + 50)) AS place FROM windows JOIN firsts USING (said) WHERE doc_id > low),
        places AS (SELECT DISTINCT doc_id, place FROM gone),
        words AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS said, count(*) AS n
            FROM words ANTI JOIN places USING (doc_id, place) GROUP BY doc_id)
        SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(said, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (doc_id)""",
    "op6_topk_search": """
        WITH vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
            FROM vectors q JOIN vectors d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
        ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
                   vec_id, score
            FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op8_ngram_jaccard": rf"""
        WITH RECURSIVE texts AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM texts WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (
            SELECT shared.a, shared.b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
        reached AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a)
        SELECT documents.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, low AS component_id
        FROM documents LEFT JOIN sizes USING (doc_id)
        LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reached GROUP BY a) USING (doc_id)""",
    "op10_chat_format": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        turns AS (
            SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens,
                   length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|SEP\])', '\1\\\2\3', 'g')) AS size,
                   length(replace(replace(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|SEP\])', '\1\\\2\3', 'g'),
                                          '~', '~0'), chr(10), '~1')) AS role_size
            FROM said)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text))
                   AS loss_sha256,
               sum(size + CASE WHEN opens THEN 3 + role_size + 1 + 4 ELSE 5 END)::BIGINT AS formatted_chars
        FROM turns GROUP BY conv_id""",
    "op11_ranked_search": rf"""
        WITH texts AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
        sized AS (SELECT *, len(terms)::BIGINT AS n FROM texts WHERE len(terms) > 0),
        total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sized),
        asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
        said AS (SELECT doc_id, n, unnest(terms) AS term FROM sized),
        found AS (
            SELECT doc_id, n, term, count(*) AS tf FROM said WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        weighed AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM found, total GROUP BY term, docs),
        scored AS (
            SELECT item_id, doc_id,
                   sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
            FROM asked JOIN found USING (term) JOIN weighed USING (term), total GROUP BY item_id, doc_id),
        ranked AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
                   doc_id, score
            FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op12_spelling_variants": rf"""
        WITH RECURSIVE bits AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k:
                   CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
        runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_ASCII_LOWER}), '[a-zÀ-ÿ]{{7,}}')) AS run
            FROM documents),
        kinds AS (
            SELECT run, count(*) AS times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS said
            FROM runs GROUP BY doc_id, run),
        checked AS (
            SELECT run, times, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(
                   range(len(said) // 2), lambda k: ('0x' || substr(said, 2 * k + 1, 2))::BIGINT)),
                   lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS h
            FROM kinds, bits),
        cut AS (
            SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % len(run))::INTEGER)
                                                    || substr(run, (h % len(run))::INTEGER + 2) ELSE run END AS word
            FROM checked),
        words AS (
            SELECT word, sum(times)::BIGINT AS n FROM cut WHERE len(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
        holes AS (
            SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest
            FROM (SELECT word, unnest(range(len(word)))::INTEGER AS i FROM words)),
        pairs AS (
            SELECT a.word AS a, b.word AS b FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT holes.word, words.word FROM holes JOIN words ON words.word = rest
            UNION SELECT words.word, holes.word FROM holes JOIN words ON words.word = rest),
        ranked AS (
            SELECT a AS word, b AS form, n AS form_n, count(*) OVER (PARTITION BY a) AS n_near,
                   row_number() OVER (PARTITION BY a ORDER BY n DESC, encode(b)) AS place
            FROM pairs JOIN words ON words.word = b),
        formed AS (
            SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near,
                   CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
            FROM words LEFT JOIN ranked ON ranked.word = words.word AND place = 1),
        ways AS (
            SELECT word, form AS root FROM formed WHERE form IS NOT NULL
            UNION SELECT ways.word, formed.form FROM ways JOIN formed ON formed.word = ways.root WHERE formed.form IS NOT NULL),
        ends AS (
            SELECT ways.word, ways.root FROM ways JOIN formed ON formed.word = ways.root WHERE formed.form IS NULL)
        SELECT formed.word, form, coalesce(root, formed.word) AS root, n, n_near, form_n
        FROM formed LEFT JOIN ends ON ends.word = formed.word""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
