"""Join of documents whose word n-gram sets have a Jaccard similarity of at least a threshold.

MinHash signatures in bands find candidates; whole n-gram sets decide. Equal sets are one node from the start. Nodes that
meet in a band bucket are gathered into blocks of bounded size around the smallest node they met, every node in one block,
so its set travels once per pair of blocks and not once per band or partner. Pairs of blocks with a common bucket are
compared by sparse products inside a task, and leave it as counts and as parents: no pair of nodes is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscore.llm.components import components
from lexiscore.llm.words import U64, bound_batches, mix, shingle_hashes, texts_of, word_hashes
from lexiscore.session import written

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Share of the pairs at the very threshold that meet in some band; pairs of higher similarity meet more often.
RECALL = 0.9999
#: Hash functions that a signature may cost.
MOST_HASHES = 96
#: A block holds about so many nodes and so many n-grams, but one node at least.
BLOCK_NODES, BLOCK_GRAMS = 256, 1 << 19
_COLUMNS = 2048


def banding(threshold: float, recall: float, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows per band: as many rows as the hash functions allow, as they keep unlike pairs apart."""
    best = None
    for rows in range(1, most_hashes + 1):
        meet = threshold**rows
        bands = 1 if meet >= 1 else max(1, ceil(log(1 - recall) / log(1 - meet)))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("the recall needs more hash functions")
    return best


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    return rng.integers(0, 1 << 63, (n, 1), dtype=np.uint64), rng.integers(0, 1 << 63, (n, 1), dtype=np.uint64) * U64(2) + U64(1)


def band_keys(grams: np.ndarray, bands: int, rows: int, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    masks, factors = family
    least = np.full(bands * rows, ~U64(0), np.uint64)
    for at in range(0, len(grams), _COLUMNS):
        least = np.minimum(least, ((grams[None, at : at + _COLUMNS] ^ masks) * factors).min(1))
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        key = mix(key * U64(0x9FB21C651E98DF25) + column)
    return key


def _grams(text: str, size: int) -> np.ndarray:
    return shingle_hashes(word_hashes([text])[0], size)


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, k1, k2, n, bands``: 128 bits that name the n-gram set, its size and its band keys."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    family = _hash_family(bands * rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, n, keys = [], [], [], []
            for text in texts_of(batch):
                grams = _grams(text, size)
                k1.append(grams.sum(dtype=np.uint64))
                k2.append(mix(grams + U64(1)).sum(dtype=np.uint64))
                n.append(len(grams))
                keys.append(band_keys(grams, bands, rows, family).view(np.int64) if len(grams) else [])
            wide = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), wide(k1), wide(k2), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "k1", "k2", "n", "bands"],
            )

    return docs.mapInArrow(sign, f"doc_id {id_type}, k1 long, k2 long, n long, bands array<long>")


def gram_sets(docs: DataFrame, size: int) -> DataFrame:
    """``node, grams`` of documents ``doc_id, text``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [_grams(text, size).tobytes() for text in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], names=["node", "grams"])

    return docs.mapInArrow(cut, "node long, grams binary")


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of ``left x right`` (numbers into ``sets``) have the similarity, from whole sets."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    grams, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # N-grams of a single set are in no intersection.
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [at, at + _COLUMNS])
        part = np.zeros((len(sets), _COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        common += part[left] @ part[right].T
    common = common.astype(np.float64)
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return common / union >= threshold


def _parents(links: np.ndarray) -> np.ndarray:
    """Smallest number that each row of a symmetric matrix of links is connected to."""
    parent = np.arange(len(links))
    while True:
        around = np.where(links, parent[None, :], len(links)).min(1)
        new = np.minimum(parent, around)
        new = new[new]
        if (new == parent).all():
            return parent
        parent = new


def compare_blocks(nodes: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], own: bool, threshold: float):
    """Nodes of a pair of blocks that have links: node, number of links, smallest node it is connected to here."""
    order = np.argsort(nodes, kind="stable")
    nodes, sides, sets = nodes[order], sides[order], [sets[i] for i in order]
    left, right = (np.arange(len(nodes)),) * 2 if own else (np.flatnonzero(sides), np.flatnonzero(~sides))
    links = np.zeros((len(nodes), len(nodes)), bool)
    if len(left) and len(right):
        links[np.ix_(left, right)] = similar(sets, left, right, threshold)
    links |= links.T
    # Rows that repeat an id are one node.
    links &= nodes[:, None] != nodes[None, :]
    parent = _parents(links)
    linked = np.flatnonzero(links.any(1))
    # Partners count once each, whatever number of texts stand under their id.
    first = np.concatenate([[True], nodes[1:] != nodes[:-1]])
    group = np.cumsum(first) - 1
    partners = np.zeros((len(nodes), int(group[-1]) + 1), bool)
    for i in linked:
        partners[group[i], group[links[i]]] = True
    per_node = partners.sum(1)
    keep = linked[np.unique(nodes[linked], return_index=True)[1]] if len(linked) else linked
    return nodes[keep], per_node[group[keep]], nodes[parent[keep]]


def _block_links(members: DataFrame, threshold: float) -> DataFrame:
    """``node, n_links, parent`` from rows ``a, b, block, node, grams`` of pairs of blocks ``a <= b``."""

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, b = (k.as_py() for k in key)
        sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        nodes, counts, parents = compare_blocks(
            table.column("node").to_numpy(), table.column("block").to_numpy() == a, sets, a == b, threshold
        )
        return pa.table({"node": pa.array(nodes, pa.int64()), "n_links": pa.array(counts, pa.int64()), "parent": pa.array(parents, pa.int64())})

    return members.groupBy("a", "b").applyInArrow(compare, "node long, n_links long, parent long")


def blocks_of(met: DataFrame) -> DataFrame:
    """``node, block`` from ``node, key, hub, n``: nodes by the smallest node they met, in parts of bounded size."""
    label = met.groupBy("node").agg(F.min("hub").alias("label"), F.max("n").alias("n"))
    sizes = label.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("grams"))
    parts = F.greatest(F.ceil(F.col("nodes") / BLOCK_NODES), F.ceil(F.col("grams") / BLOCK_GRAMS))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    return label.join(sizes.select("label", parts.alias("parts")), "label").select("node", F.xxhash64("label", part).alias("block"))


def block_pairs(met: DataFrame, blocks: DataFrame) -> DataFrame:
    """``a, b`` with ``a <= b``: every block with itself, and blocks that hold nodes of one bucket."""
    there = met.select("key", "node").join(blocks, "node").select("key", "block").distinct()
    several = there.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    there = written(there.join(several, "key"), "ngram-buckets")
    across = there.select("key", F.col("block").alias("a")).join(there.select("key", F.col("block").alias("b")), "key")
    own = blocks.select(F.col("block").alias("a")).distinct().select("a", F.col("a").alias("b"))
    return across.where("a < b").select("a", "b").distinct().unionAll(own)


def join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE_WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """``doc_id, class_id, n_links, n_copies``: one row per row of ``docs``.

    ``n_links`` counts the other n-gram sets of at least the similarity, each once however many copies it has; ``n_copies``
    the rows of the same set, this one among them. ``class_id`` is the smallest id that a document is connected to by copies
    and links. Ids are whole numbers. Words are lower-case runs of letters and digits; a text of fewer words than ``size``
    is one n-gram. Texts without a word, null texts and rows without an id have no links and stand alone, with ``n_copies``
    1. Rows that repeat an id are one document, linked to all that any of its texts is like. No rows give no rows.

    A link at the threshold is found with probability ``recall`` at least, by bands and rows chosen for it; pairs that meet
    in one block are compared anyway. A group of n like texts costs n sets for every n / BLOCK_NODES blocks and about n / 2
    comparisons of sets a node, but no row per pair; its rows lie in blocks that many tasks share.
    """
    bound_batches(docs.sparkSession)
    bands, rows = banding(threshold, recall)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text)
    signed = written(signatures(narrow, size, bands, rows), "ngram-signatures")
    usable = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = usable.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n_copies")
    )
    reps = written(reps, "ngram-nodes")
    keys = reps.select("node", "n", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("hub")).where("c > 1")
    met = written(keys.join(buckets.select("key", "hub"), "key"), "ngram-met")
    blocks = written(blocks_of(met), "ngram-blocks")
    pairs = block_pairs(met, blocks)
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    whole = narrow.join(blocks.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    sets = gram_sets(whole, size).join(blocks, "node")
    linked = written(_block_links(sides.join(sets, "block"), threshold), "ngram-links")
    links = linked.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    classes = components(linked.select(F.col("node").alias("a"), F.col("parent").alias("b")))
    nodes = reps.select("k1", "k2", "node", "n_copies").join(links, "node", "left").join(classes, "node", "left")
    nodes = nodes.select("k1", "k2", F.coalesce("component", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    of_rows = usable.select("doc_id", "k1", "k2").join(nodes, ["k1", "k2"]).select("doc_id", "class_id", "n_links", "n_copies")
    alone = signed.where((F.col("n") == 0) | F.col("doc_id").isNull())
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return of_rows.unionAll(alone.select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_links"), one.alias("n_copies")))
