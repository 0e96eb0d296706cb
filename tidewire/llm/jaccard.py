"""N-gram Jaccard join by grouped prefixes.

A document's set are its distinct shingles. In one order of all shingles, two sets
as similar as asked share one of their first few, their prefixes. Shingles found
often come last in the order, so prefixes are made of rare ones. Documents with one
prefix and size are a group; groups meet in the lists of their prefix shingles, of which
those with the same groups are one, are filtered by size and by how much of the shorter
prefix they share, and are then expanded; their members' whole sets are verified.

Only components are asked for. So the groups of a list are first held against two of
them alone, the smallest and the smallest of another component, and what that links
becomes one component; this is done again while it links much. Then only groups of
different components in a list are held against each other, so a large family of
copies costs a few comparisons each, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.components import components
from tidewire.llm.store import only, written
from tidewire.llm.words import U, mix, pieces, scan, signed

WORDS = 5
#: Similarity as a share of 100.
LEAST = 80
_SETS = "doc long, size int, body long, group long, last long, bits array<long>, sketch array<long>, prefix array<long>"
#: Bits that a group's prefix is summed up in.
BITS = 1024
#: Most bits of the sketch of a whole set; sets of more than half as many shingles are told apart less well.
SKETCH_BITS = 1 << 12
#: Groups of one component in a list that are held against others one by one.
FEW = 8
_ORDER_HIGH = U(1) << U(62)
_PLACES = np.random.default_rng(5).integers(1, 2**63, WORDS, dtype=np.uint64) * U(2) + U(1)


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle of every whole text, repeats included; A-Z count as a-z."""
    s = scan(texts, lower=True)
    n = s.counts
    have = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), have)
    begin = np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have) + s.first[:-1][owner]
    width = np.minimum(n, WORDS)[owner]
    out = np.zeros(len(begin), U)
    padded = np.append(s.hashes, np.zeros(WORDS, U))
    for k in range(WORDS):
        out += padded[begin + k] * _PLACES[k] * (k < width)
    return mix(out + width.astype(U)), owner


def _text_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, owner = shingle_hashes(texts)
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield np.unique(hashes[a:b])


def _counted(room: int = 2 << 20):
    """(shingle, documents) of shingles that several documents of a stretch of a task's input have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def several():
            hashes, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            often = times > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(signed(hashes[often])), pa.array(times[often])], names=["shingle", "documents"]
            )

        for batch in pieces(batches):
            held.extend(_text_sets(batch.column("text")))
            if sum(map(len, held)) >= room:
                yield several()
        if held:
            yield several()

    return count


def common_shingles(docs: DataFrame, common: int = 24, most: int = 1 << 18) -> np.ndarray:
    """Hashes of shingles known to be in many documents, the rarer first, at most ``most`` of them.

    They only decide the order of shingles, which may be any; so it does no harm that
    a shingle is counted only where a stretch of input has it twice, and that the list,
    which is broadcast, has a bound: of more than ``most`` the most frequent are taken.
    """
    counted = docs.select("text").mapInArrow(_counted(), "shingle long, documents long")
    rows = (
        counted.groupBy("shingle")
        .agg(F.sum("documents").alias("documents"))
        .where(F.col("documents") >= common)
        .orderBy(F.col("documents").desc(), "shingle")
        .limit(most)
        .toPandas()
    )
    return rows["shingle"].to_numpy(np.int64)[::-1].copy().view(U)


def prefix_size(size: np.ndarray | int) -> np.ndarray | int:
    return size - (size * LEAST + 99) // 100 + 1


def _listed(arrays: tuple[np.ndarray, ...]) -> pa.Array:
    edges = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(signed(np.concatenate(arrays))))


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """For each of some cells, at least two a shingle, whether an odd number of shingles fall into it.

    Where two sets differ in a cell, at least one shingle of it is in one set only. The
    cells are a power of two, so the halves of a sketch put together are the smaller one.
    """
    cells = min(SKETCH_BITS, max(64, 1 << int(2 * len(hashes) - 1).bit_length()))
    odd = np.bincount((mix(hashes + U(29)) % U(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool)).view(U)


def _set_rows(common: np.ndarray):
    by_hash = np.argsort(common, kind="stable")
    sorted_common = common[by_hash]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[tuple] = []
            for doc, hashes in zip(batch.column("doc").to_pylist(), _text_sets(batch.column("text")), strict=True):
                if not len(hashes):
                    out.append((doc, 0, U(0), U(0), U(0), hashes, hashes, hashes))
                    continue
                token = hashes >> U(2)
                if len(common):
                    at = np.minimum(np.searchsorted(sorted_common, hashes), len(common) - 1)
                    hit = sorted_common[at] == hashes
                    token = np.where(hit, _ORDER_HIGH + by_hash[at].astype(U), token)
                token = np.sort(token)
                first = token[: prefix_size(len(token))]
                with np.errstate(over="ignore"):
                    body = mix(hashes + U(11)).sum(dtype=U) ^ mix(np.array([len(hashes)], U))[0]
                    group = mix(first + U(len(hashes)) * U(0x9E3779B97F4A7C15)).sum(dtype=U)
                bits = np.zeros(BITS, bool)
                bits[mix(first) % U(BITS)] = True
                out.append((doc, len(hashes), body, group, first[-1], np.packbits(bits).view(U), _sketch(hashes), first))
            if out:
                doc, size, body, group, last, *lists = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc, pa.int64()),
                        pa.array(size, pa.int32()),
                        pa.array(signed(np.array(body, U))),
                        pa.array(signed(np.array(group, U))),
                        pa.array(signed(np.array(last, U))),
                        *map(_listed, lists),
                    ],
                    names=["doc", "size", "body", "group", "last", "bits", "sketch", "prefix"],
                )

    return rows


def _possible(absent_x: Column, absent_y: Column) -> Column:
    """Whether groups x and y can be similar, by their sizes and shingles of one that the other lacks.

    The shingles of the prefix that ends first, other than shared ones, are not in the
    other set at all; with both sizes the overlap needed is known.
    """
    x, y = F.col("x_size").cast("long"), F.col("y_size").cast("long")
    need = F.ceil(LEAST * (x + y) / (100 + LEAST))
    x_first, y_first = F.col("x_last") <= F.col("y_last"), F.col("y_last") <= F.col("x_last")
    sizes = 100 * F.least(x, y) >= LEAST * F.greatest(x, y)
    return sizes & (~x_first | (x - absent_x >= need)) & (~y_first | (y - absent_y >= need))


def _plausible(met: DataFrame, about: DataFrame) -> DataFrame:
    """Pairs of groups (x, y) that the number of their ``shared`` prefix shingles lets be similar."""
    for side in ("x", "y"):
        names = {"head": side, "size": f"{side}_size", "last": f"{side}_last"}
        met = met.join(about.drop("bits", "sketch").withColumnsRenamed(names), side)

    def absent(size: Column) -> Column:
        return size - F.floor((size.cast("long") * LEAST + 99) / 100) + 1 - F.col("shared")

    return met.where(_possible(absent(F.col("x_size")), absent(F.col("y_size")))).select("x", "y")


def _bits_lacking(x: str, y: str) -> Column:
    """At least so many shingles of prefix ``x`` are not in prefix ``y``."""
    return reduce(
        Column.__add__, [F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(BITS // 64)]
    )


def _near(x: str, y: str, sizes: Column) -> Column:
    """Whether sets with sketches ``x`` and ``y`` and so many shingles together may be similar; true where one is unknown."""

    def like(a: str, b: str) -> Column:
        n = F.size(b)
        halves = F.zip_with(F.slice(a, 1, n), F.slice(a, n + 1, n), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(a) == 2 * n, halves).otherwise(F.col(a))

    cells = F.zip_with(like(x, y), like(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    differ = F.aggregate(cells, F.lit(0), lambda total, n: total + n)
    return F.coalesce((100 + LEAST) * differ <= (100 - LEAST) * sizes, F.lit(True))


def _hubs(lists: DataFrame) -> DataFrame:
    """(x, y, shared): groups y that share lists with a hub x of another component.

    A list's hubs are its smallest group and the smallest one of another component.
    """
    firsts = lists.groupBy("shingle", "tag").agg(F.min("head").alias("hub"))
    smallest = firsts.groupBy("shingle").agg(F.min(F.struct("hub", "tag")).alias("one"))
    others = firsts.join(smallest, "shingle").where(F.col("tag") != F.col("one.tag"))
    hubs = others.groupBy("shingle").agg(F.first("one").alias("one"), F.min(F.struct("hub", "tag")).alias("two"))
    hubs = hubs.select("shingle", F.explode(F.array("one", "two")).alias("of"))
    met = lists.join(hubs, "shingle").where(F.col("tag") != F.col("of.tag"))
    return met.groupBy(F.col("of.hub").alias("x"), F.col("head").alias("y")).agg(F.sum("weight").alias("shared"))


def _merged(lists: DataFrame) -> DataFrame:
    """Lists of the same groups as one list, by its first shingle, with their number as ``weight``.

    A passage gives a list for each of its shingles, and copies of it meet in all of these.
    Lists are the same if their lengths and two 64-bit sums of hashes are.
    """
    alike = ("n", "one", "two")
    told = lists.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("head")).alias("one"),
        F.bit_xor(F.xxhash64(F.lit(1), "head")).alias("two"),
    )
    kept = told.groupBy(*alike).agg(F.min("shingle").alias("shingle"), F.count(F.lit(1)).alias("weight"))
    return lists.join(kept.select("shingle", "weight"), "shingle")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of documents whose whole sets are as similar as asked."""
    ids = pairs.select(F.col("a").alias("doc")).unionAll(pairs.select(F.col("b").alias("doc"))).distinct()
    wanted = written(only(texts, ids, "doc"), "pair-texts")
    left = wanted.select(F.col("doc").alias("a"), F.col("text").alias("a_text"))
    right = wanted.select(F.col("doc").alias("b"), F.col("text").alias("b_text"))
    both = pairs.join(left, "a").join(right, "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sets = zip(_text_sets(part.column("a_text")), _text_sets(part.column("b_text")), strict=True)
                ok = []
                for x, y in sets:
                    inside = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * inside >= LEAST * (len(x) + len(y) - inside) and inside > 0)
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return written(both.mapInArrow(verify, "a long, b long"), "links")


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with the component that ``links`` give; a node without links is its own."""
    found = components(links)
    return nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def link_components(docs: DataFrame, common: int = 24, rounds: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Two documents link when 100 times the shared shingles is at least 80 times all of
    both; the component is the smallest doc_id reachable. Null or empty text: no
    shingles, linked with nothing. Fewer than five words: one shingle, the whole
    sequence. Rows of one doc_id are one document for linking, each with its own
    number of shingles. Null doc_id: linked with nothing, component null. Empty table:
    empty result. Other columns are ignored.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    often = common_shingles(keyed, common)
    sets = written(keyed.mapInArrow(_set_rows(often), _SETS), "sets")
    named = sets.where(F.col("doc").isNotNull() & (F.col("size") > 0))
    # Equal sets are one node, named by its smallest document.
    nodes = written(
        named.groupBy("body", "size").agg(
            F.min("doc").alias("node"), *[F.first(c).alias(c) for c in ("group", "last", "bits", "sketch")]
        ),
        "nodes",
    )
    # Equal prefixes and sizes are one group, named by its smallest document too.
    groups = nodes.groupBy("group", "size").agg(
        F.min("node").alias("head"),
        F.first("last").alias("last"),
        F.first("bits").alias("bits"),
        # Several sets with one prefix have no sketch in common.
        F.when(F.count(F.lit(1)) == 1, F.first("sketch")).alias("sketch"),
    )
    groups = written(groups, "groups")
    about = groups.select("head", "size", "last", "bits", "sketch")
    heads = groups.select(F.col("head").alias("doc"), "size", "group")
    prefixes = named.select("doc", "size", "group", "prefix").join(heads, ["doc", "size", "group"], "left_semi")
    lists = prefixes.select(F.explode("prefix").alias("shingle"), F.col("doc").alias("head"))
    # Lists of one group are of no use.
    ends = lists.groupBy("shingle").agg(F.min("head").alias("low"), F.max("head").alias("high"))
    shared = lists.join(ends.where(F.col("low") < F.col("high")).select("shingle"), "shingle", "left_semi")
    shared = written(_merged(written(shared.distinct(), "lists")), "lists-merged")

    named_sets = nodes.select("body", "size", "node", "group")
    members = nodes.join(groups.select("group", "size", "head"), ["group", "size"]).select("node", "head")
    texts = keyed.where(F.col("doc").isNotNull())
    own = members.select(F.col("head").alias("a"), F.col("node").alias("b"))
    alone = F.struct(F.col("head").alias("low"), F.col("head").alias("high"), F.lit(None).cast("long").alias("head"))
    open_lists = shared.select("shingle", "head", "weight", alone.alias("tag"))
    tried = links = None
    for turn in range(rounds):
        # A group and the members of the other are held against the hub; in the first turn the members of a group, too.
        stars = _plausible(_hubs(open_lists), about)
        pairs = stars.join(members.withColumnsRenamed({"head": "y", "node": "b"}), "y").select(F.col("x").alias("a"), "b")
        pairs = _ordered(pairs.unionAll(own) if turn == 0 else pairs)
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti") if turn else pairs, "pairs")
        found = _verified(pairs, texts)
        tried, links = (tried.unionAll(pairs), links.unionAll(found)) if turn else (pairs, found)
        labelled = written(_labelled(named_sets, links), "nodes-labelled")
        by_group = labelled.join(groups.select("group", "size", "head"), ["group", "size"]).select(
            "head", "node", "component"
        )
        kinds = by_group.groupBy("head").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        # Groups of one component share a tag; a group that spans several has its own.
        tag = F.struct("low", "high", F.when(F.col("low") < F.col("high"), F.col("head")).alias("head"))
        tagged = open_lists.drop("tag").join(kinds.select("head", tag.alias("tag")), "head")
        several = tagged.groupBy("shingle").agg(F.min("tag").alias("x"), F.max("tag").alias("y"))
        several = several.where(F.col("x") < F.col("y")).select("shingle")
        open_lists = written(tagged.join(several, "shingle", "left_semi"), "lists-open")
        if found.count() < 0.2 * pairs.count():
            break

    # What is left: groups of a list, or members of a group, in different components.
    # Pairs of groups whose summed-up prefixes or whole sets differ too much are no rows at all:
    # variants of one text that are not similar share many lists, but their sketches tell them apart.
    tags = open_lists.groupBy("shingle", "tag").agg(F.count(F.lit(1)).alias("n"))
    told = written(open_lists.join(tags, ["shingle", "tag"]), "lists-sized").join(about, "head")

    def side(rows: DataFrame, s: str) -> DataFrame:
        rows = rows if s == "x" else rows.drop("weight")
        return rows.drop("n").withColumnsRenamed({"head": s, **{c: f"{s}_{c}" for c in ("tag", "size", "last", "bits", "sketch")}})

    alike = _possible(_bits_lacking("x_bits", "y_bits"), _bits_lacking("y_bits", "x_bits")) & _near(
        "x_sketch", "y_sketch", F.col("x_size").cast("long") + F.col("y_size")
    )
    few = told.where(F.col("n") <= FEW)
    apart = (F.col("x") < F.col("y")) & (F.col("x_tag") != F.col("y_tag"))
    between_few = side(few, "x").join(side(few, "y"), "shingle").where(apart & alike)
    # A component with many groups in a list is met as a whole: a pair of components by its smaller side first.
    of = tags.select("shingle", F.struct("n", "tag").alias("of"))
    crossing = of.withColumnRenamed("of", "x_of").join(
        of.where(F.col("of.n") > FEW).withColumnRenamed("of", "y_of"), "shingle"
    )
    crossing = crossing.where(F.col("x_of") < F.col("y_of")).select(
        "shingle", F.col("x_of.tag").alias("x_tag"), F.col("y_of.tag").alias("y_tag")
    )
    with_many = crossing.join(side(told, "x"), ["shingle", "x_tag"]).join(side(told, "y"), ["shingle", "y_tag"]).where(alike)
    met = reduce(DataFrame.unionAll, [m.select("x", "y", "weight") for m in (between_few, with_many)])
    # Which side is the smaller differs from list to list.
    met = met.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.sum("weight").alias("shared"))
    split = kinds.where(F.col("low") < F.col("high")).select(F.col("head").alias("x"), F.col("head").alias("y"))
    pairs = (
        _plausible(met, about)
        .unionAll(split)
        .join(by_group.withColumnsRenamed({"head": "x", "node": "a", "component": "a_in"}), "x")
        .join(by_group.withColumnsRenamed({"head": "y", "node": "b", "component": "b_in"}), "y")
        .where(F.col("a_in") != F.col("b_in"))
        .select("a", "b")
    )
    more = _verified(written(_ordered(pairs).join(tried, ["a", "b"], "left_anti"), "pairs"), texts)
    # Rows of one doc_id with different sets tie these sets together.
    where = named.select("doc", "body", "size").join(nodes.select("body", "size", "node"), ["body", "size"])
    ends = where.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b")).where(F.col("a") < F.col("b"))
    ties = where.select("doc", "node").join(ends.select("doc", "a"), "doc").select("a", F.col("node").alias("b"))
    final = _labelled(named_sets, links.unionAll(more).unionAll(ties.where(F.col("a") < F.col("b"))))
    of_set = final.select(F.col("body").alias("f_body"), F.col("size").alias("f_size"), "component")
    counted = sets.select("doc", "size", "body")
    on = (F.col("body") == F.col("f_body")) & (F.col("size") == F.col("f_size")) & F.col("doc").isNotNull()
    linked = counted.where(F.col("size") > 0).join(of_set, on, "left")
    alone = counted.where(F.col("size") == 0).select("*", F.col("doc").alias("component"))
    columns = [
        F.col("doc").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), F.col("component").alias("component_id")
    ]
    return linked.select(*columns).unionAll(alone.select(*columns))
