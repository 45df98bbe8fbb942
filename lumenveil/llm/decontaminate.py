"""Benchmark decontamination with one Aho-Corasick automaton over the normalised benchmark texts.

A text is normalised to its lower-cased words (digits, ASCII letters and everything beyond ASCII), one
space apart, so that a window of words is a substring bounded by spaces. The automaton holds every window
of every item; a scan of a document's normalised text meets each occurrence once, and word numbers
lead back to offsets in the original text.

The automaton is built once in each Python worker from the broadcast benchmark texts, whose size is summed
first. Beyond BLOCK_BYTES the items are dealt into blocks: one pass over the texts for each block, with one
automaton in memory, writes the hits of the documents that have any, and the passes' hits meet by row.

Defined cases: null or wordless documents have no hits and n_words 0; null or wordless items have
no windows; equal windows of several items count for each of them; an empty benchmark leaves every
document clean; repeated rows are handled row by row; very long texts are scanned whole, their hits merged by one sort;
columns of docs named like the results are replaced, all others kept, and benchmark's further columns ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

WINDOW = 13
#: Benchmark text that one automaton takes at most (about 40 times as much memory in each worker).
BLOCK_BYTES = 4 << 20
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _normal(text: str | None) -> tuple[str, int]:
    """The normalised text, a byte for each character, and its number of words."""
    found = words(text)
    return (" " + b" ".join(found).decode("latin-1") + " ", len(found)) if found else ("", 0)


def automaton(items: list[tuple[int, str | None]], window: int = WINDOW):
    """Of all windows; each leads to (its number of words, its length, the items that hold it). None if there are none."""
    import ahocorasick

    owners: dict[str, tuple[int, set]] = {}
    for item_id, text in items:
        found = words(text)
        for i in range(max(1, len(found) - window + 1) if found else 0):
            part = found[i : i + window]
            owners.setdefault(" " + b" ".join(part).decode("latin-1") + " ", (len(part), set()))[1].add(item_id)
    if not owners:
        return None
    out = ahocorasick.Automaton()
    for key, (n, of) in owners.items():
        out.add_word(key, (n, len(key), tuple(of)))
    out.make_automaton()
    return out


def scan(machine, normal: str) -> tuple[list[tuple[int, int]], dict]:
    """Hit word ranges [first, beyond) in order and merged, and each item's ranges."""
    hits: dict = {}
    if machine is None or not normal:
        return [], hits
    found = list(machine.iter(normal))
    if not found:
        return [], hits
    spaces = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), np.uint8) == 32)
    ranges = []
    for end, (n, length, of) in found:
        first = int(np.searchsorted(spaces, end - length + 1))
        ranges.append((first, first + n))
        for item_id in of:
            hits.setdefault(item_id, []).append((first, first + n))
    return _merge(ranges), hits


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets in the original text of ranges of words."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def _found(machine, normal: str, window: int) -> tuple[list[tuple[int, int]], set, bool]:
    """Merged ranges of words, the items, and whether a window of full length occurs."""
    ranges, hits = scan(machine, normal)
    return ranges, set(hits), any(b - a >= window for own in hits.values() for a, b in own)


RESULTS = ("n_words", "n_hit", "items", "spans", "full_window")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """docs' own columns plus n_words, n_hit, items (ids, ascending as strings), spans (array of start, end), full_window.

    spans are the hit passages in the original text, in code points, end exclusive. full_window: a whole window of
    `window` words occurs, not just items that are shorter.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).cast("string").alias("t")).filter("t IS NOT NULL")
    blocks = -(-int(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK_BYTES)
    item_type = "bigint" if benchmark.schema[item_col].dataType.simpleString() in ("bigint", "int") else "string"
    if item_type == "string":
        items = items.withColumn("i", F.col("i").cast("string"))
    of_items = pa.list_(pa.int64() if item_type == "bigint" else pa.string())
    fields = [f for f in docs.schema.fields if f.name not in RESULTS]
    names = [f.name for f in fields]
    own = docs.select(*[F.col(f"`{n}`") for n in names])
    types = [pa.int64(), pa.int64(), of_items, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.bool_()]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += f", n_words bigint, n_hit bigint, items array<{item_type}>, spans array<struct<start:bigint,end:bigint>>, full_window boolean"

    def result(text: str | None, n: int, ranges: list[tuple[int, int]], of: set, full: bool) -> tuple:
        spans = [{"start": a, "end": b} for a, b in _char_spans(text, ranges)] if ranges else []
        return n, sum(b - a for a, b in ranges), sorted(of, key=str), spans, full

    def batch_of(columns: list, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([r[c] for r in rows], t) for c, t in enumerate(types))], names=[*names, *RESULTS])

    at = names.index(text_col)
    if blocks <= 1:
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r["i"], r["t"]) for r in items.collect()]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = _machine(shared, window)
            for batch in batches:
                rows = []
                for cell in batch.column(at):
                    text = cell.as_py()
                    normal, n = _normal(text)
                    rows.append(result(text, n, *_found(machine, normal, window)))
                yield batch_of(batch.columns, rows)

        return own.mapInArrow(run, schema)

    # Rows get a number that is written with them, so that the passes agree on it.
    mark = "_" + max([*names, "row"], key=len)
    numbered = materialize(own.withColumn(mark, F.monotonically_increasing_id()), "decontaminate")
    passes = []
    hit_schema = f"row bigint, ranges array<struct<a:bigint,b:bigint>>, items array<{item_type}>, full boolean"
    pair = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    for block in range(2 * blocks):  # twice as many, so that an uneven deal fits as well
        # A block's worth reaches the driver at a time, or a single item that is larger.
        mine = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(2 * blocks)) == block).collect()
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r["i"], r["t"]) for r in mine]))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine = _machine(shared, window)
            for batch in batches:
                rows = []
                for row, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ranges, of, full = _found(machine, _normal(cell.as_py())[0], window)
                    if ranges:
                        rows.append((row, [{"a": a, "b": b} for a, b in ranges], sorted(of, key=str), full))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pair, of_items, pa.bool_()))], names=["row", "ranges", "items", "full"])

        passes.append(materialize(numbered.select(F.col(mark), F.col(f"`{text_col}`").cast("string")).mapInArrow(search, hit_schema), "block"))
        shared.unpersist()
    hits = reduce(DataFrame.unionByName, passes).groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items"), F.max("full").alias("full"))
    met = numbered.join(hits.withColumnsRenamed({c: f"{mark}_{c}" for c in hits.columns}), F.col(mark) == F.col(f"{mark}_row"), "left").drop(mark, f"{mark}_row")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell, ranges, of, full in zip(batch.column(at), *(batch.column(c).to_pylist() for c in range(len(names), len(names) + 3))):
                text = cell.as_py()
                rows.append(result(text, _normal(text)[1], _merge([(r["a"], r["b"]) for r in ranges or []]), set(of or []), bool(full)))
            yield batch_of(batch.columns[: len(names)], rows)

    return met.mapInArrow(merge, schema)


_BUILT: dict = {}


def _machine(block, window: int):
    """The automaton of a block; a worker process holds one at a time."""
    name, items = block.value
    if (name, window) not in _BUILT:
        _BUILT.clear()
        _BUILT[name, window] = automaton(items, window)
    return _BUILT[name, window]


def items_digest(ids: list) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
