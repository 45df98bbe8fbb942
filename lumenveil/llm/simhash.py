"""SimHash near-duplicates: fingerprints of 3-word shingles, radius search with BK-trees, components.

Spread of the search. Two 64-bit fingerprints within 3 bits agree on at least one of four 16-bit
blocks, so every distinct fingerprint goes to four shards, one per block value. Each shard holds one
BK-tree; a search follows only the edges whose label is within the radius of the query's distance. A
tree travels to its queries through the shuffle rather than by broadcast, because the trees together
grow with the corpus. A shard with more than SHARD_MOST fingerprints is split again by the same
argument over the bits that its shard has not fixed yet, so no shard grows without bound and no
link is lost. A task emits a spanning forest of the links it found, never all pairs.

Defined cases: null, empty and all-white-space texts have no words and fingerprint 0, and link like any
other; texts of one or two words are one shingle; repeated rows of one doc_id share its component;
a null doc_id is kept and never becomes a component id unless all ids of the component are null;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Bits that each level of splitting divides into RADIUS + 1 blocks: all 64, then what the shard leaves open.
LEVELS = 3
SHARD_MOST = 20_000
#: Pairs of query and tree node that a search holds at once.
FRONTIER = 2_000_000


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one whole text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        h = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: -SHINGLE])).tolist()
        digest = xxhash.xxh64_intdigest
        h = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        part = np.array(h[i : i + (1 << 16)], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {id_type.simpleString()}, fp bigint"
    )


# ---------------------------------------------------------------- BK-trees


class Forest:
    """BK-trees of many shards, built and searched a level at a time with array operations.

    Items of a shard start at its root, the shard's first item. Of the items that stand at a node, those at
    distance d from it go to its child d: the first becomes that child, the others go on from there.
    """

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        """fps: uint64; shard: the shard's number of each item, ascending."""
        n = len(fps)
        self.fps = fps
        first = np.ones(n, bool)
        first[1:] = shard[1:] != shard[:-1]
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1]  # of each item
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        item = np.flatnonzero(~first)
        at = self.root[item]
        while len(item):
            d = np.bitwise_count(fps[item] ^ fps[at]).astype(np.int64)
            order = np.lexsort((item, d, at))
            item, at, d = item[order], at[order], d[order]
            new = np.ones(len(item), bool)
            new[1:] = (at[1:] != at[:-1]) | (d[1:] != d[:-1])
            child = item[np.flatnonzero(new)[np.cumsum(new) - 1]]
            parent[item[new]], edge[item[new]] = at[new], d[new]
            item, at = item[~new], child[~new]
        kids = np.flatnonzero(parent >= 0)
        kids = kids[np.lexsort((edge[kids], parent[kids]))]
        self.kids, self.edge = kids, edge[kids]
        self.start = np.searchsorted(parent[kids], np.arange(n))
        self.count = np.searchsorted(parent[kids], np.arange(n), side="right") - self.start

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, of one shard, in pieces; a piece's pairs have query > node."""
        todo = [(np.arange(len(self.fps)), self.root)]
        while todo:
            query, node = todo.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                todo += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            d = np.bitwise_count(self.fps[query] ^ self.fps[node]).astype(np.int64)
            near = (d <= radius) & (query > node)
            if near.any():
                yield query[near], node[near]
            grow = self.count[node] > 0
            query, node, d = query[grow], node[grow], d[grow]
            if not len(query):
                continue
            many = self.count[node]
            at = np.repeat(self.start[node] - np.cumsum(many) + many, many) + np.arange(many.sum())
            query, d = np.repeat(query, many), np.repeat(d, many)
            follow = np.abs(self.edge[at] - d) <= radius
            if follow.any():
                todo.append((query[follow], self.kids[at[follow]]))


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member of each of n items' component."""
    low = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = low[a], low[b]
            if (differ := x != y).any():
                np.minimum.at(low, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
                while (low != low[low]).any():
                    low = low[low]
            else:
                break
    return low


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, fp) of whole shards, sorted -> links (a, b), a spanning forest of each shard's."""

    def solve(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        low = spanning(len(fps), Forest(fps, key).links(RADIUS))
        more = np.flatnonzero(low != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[more].view(np.int64)), pa.array(fps[low[more]].view(np.int64))], names=["a", "b"])

    keys, held, size = [], [], 0
    for batch in batches:
        keys.append(batch.column(0).to_numpy(zero_copy_only=False))
        held.append(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
        size += batch.num_rows
        if size >= 10 * SHARD_MOST:  # all shards but the last are whole
            key, fps = np.concatenate(keys), np.concatenate(held)
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield solve(key[:cut], fps[:cut])
                keys, held, size = [key[cut:]], [fps[cut:]], len(key) - cut
    if size:
        yield solve(np.concatenate(keys), np.concatenate(held))


# ---------------------------------------------------------------- shards


def _blocks(open_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of RADIUS + 1 blocks that cover open_bits bits."""
    k = RADIUS + 1
    edges = [open_bits * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _shards(fps: DataFrame) -> DataFrame:
    """(shard, fp): every fingerprint once for each of its shards. fps: distinct."""

    def deal(rows: DataFrame, width: int, level: int) -> DataFrame:
        """rows (shard, fp, rest): rest holds the open bits. Adds for each block a row of the smaller shard."""
        each = []
        for i, (shift, bits) in enumerate(_blocks(width)):
            value = F.shiftrightunsigned("rest", shift).bitwiseAND(F.lit((1 << bits) - 1))
            above = F.shiftrightunsigned("rest", shift + bits) if shift + bits < 64 else F.lit(0).cast("bigint")
            below = F.col("rest").bitwiseAND(F.lit((1 << shift) - 1))
            rest = F.shiftleft(above, shift).bitwiseOR(below)
            each.append(F.struct(F.xxhash64(F.lit(level), F.lit(i), "shard", value).alias("shard"), rest.alias("rest")))
        return rows.select("fp", F.explode(F.array(*each)).alias("x")).select("x.shard", "fp", "x.rest")

    width, rows, done = 64, fps.select(F.lit(0).cast("bigint").alias("shard"), "fp", F.col("fp").alias("rest")), []
    for level in range(LEVELS):
        rows, width = deal(rows, width, level), width - width // (RADIUS + 1)
        if level == LEVELS - 1:
            break
        # Shards too large for one tree: at most 4 n / SHARD_MOST keys, usually none.
        large = rows.groupBy("shard").count().filter(F.col("count") > SHARD_MOST).select("shard")
        large = materialize(large, "simhash-large")
        if large.isEmpty():
            break
        done.append(rows.join(large, "shard", "left_anti"))
        rows = rows.join(large, "shard", "left_semi")
    done.append(rows)
    out = done[0].select("shard", "fp")
    for more in done[1:]:
        out = out.unionByName(more.select("shard", "fp"))
    return out


# ---------------------------------------------------------------- components


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its component.

    Each round every node takes its smallest neighbour, the resulting pointers are followed three times
    over, and the links are drawn anew between the nodes pointed at, so that they shrink until none
    is left. Nothing is collected; each round is written to the shared folder.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        if edges.isEmpty():
            break
        step = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        for _ in range(2):
            ahead = step.select(F.col("node").alias("mid"), F.col("root").alias("beyond"))
            step = step.join(ahead, step["root"] == ahead["mid"], "left").select("node", F.coalesce("beyond", "root").alias("root"))
        step = materialize(step, "pointers")
        to = step.select(F.col("node").alias("mid"), F.col("root").alias("beyond"))
        if labels is None:
            labels = step
        else:
            moved = labels.join(to, labels["root"] == to["mid"], "left").select("node", F.coalesce("beyond", "root").alias("root"))
            labels = moved.unionByName(step.join(labels.select("node"), "node", "left_anti"))
        labels = materialize(labels, "labels")

        def follow(df: DataFrame, end: str) -> DataFrame:
            return df.join(to, df[end] == to["mid"], "left").withColumn(end, F.coalesce("beyond", end)).drop("mid", "beyond")

        moved = follow(follow(edges, "a"), "b").filter("a <> b")
        edges = materialize(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


# ---------------------------------------------------------------- operator


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    spark = docs.sparkSession
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = _shards(distinct.select("fp")).repartition(parts, "shard").sortWithinPartitions("shard", "fp")
    links = rows.mapInArrow(_search, "a bigint, b bigint")
    labels = components(links)
    # Class of each distinct fingerprint, then its smallest document.
    classed = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("class"))
    classed = materialize(classed, "classed")
    least = classed.groupBy("class").agg(F.min("least").alias("component_id"))
    of = classed.join(least, "class").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
