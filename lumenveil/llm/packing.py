"""Packing token pieces into as few sequences as it can by bin completion.

Only a piece's length matters for packing, and lengths lie between 1 and the capacity, so the problem is
solved on the histogram of lengths: at most `capacity` counts, whatever the number of documents. The
solver returns patterns (lengths that fill one sequence) with how often each is used. Pieces then learn
their place from their number among the pieces of their length.

Solver: branch and bound over bin completions. A branch takes the largest length left and completes its
sequence with an undominated filling, for as many sequences at once as there are pieces; fillings with less waste come
first, and all that the waste bound leaves are enumerated, by a walk over the sums that the lengths left can reach. A
branch is cut once its waste exceeds what a packing with one sequence less than the incumbent may have. Best-fit
decreasing gives the first incumbent; wherever a branch ends, best fit packs what is left, and the packing becomes the incumbent
if it is better. The search starts anew with growing numbers of nodes; lengths that were left over come first then.
It ends when the incumbent meets the lower bound or nothing is left to try; otherwise after WORK,
with the incumbent: bin packing is NP-hard, so no bound on work can promise the optimum.

Defined cases: null and empty texts are one piece, the end mark alone; very long texts are cut into pieces, their ids in
one pass; pieces of equal length are exchangeable and stand in the order of doc_id and piece, those of repeated rows in any;
repeated rows are packed each for itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

CAPACITY = 4096
END_ID = 1
#: Work of the branch and bound at most: its nodes, for each 50 and one for each length left, and the steps of the walks over fillings.
WORK = 1_000_000
#: Fillings that are put in order at a time.
CHOICES = 256


# ---------------------------------------------------------------- solver


def fillings(lengths: list[int], count: dict[int, int], room: int, waste: int, meter: list[int] | None = None) -> Iterator[tuple[tuple[tuple[int, int], ...], int]]:
    """(((length, copies), ...), its waste) of every undominated filling that leaves at most `waste` of the room, larger lengths first.

    lengths: ascending, with count > 0. A filling is dominated if an unused length would still fit, or if a longer
    unused length could take the place of one used or of two. Nothing is walked that leads to no filling: a set of bits
    says which sums the smaller lengths can reach. meter: a single number that falls by one with each step; at 0 the walk ends.
    """
    meter = [-1] if meter is None else meter
    usable = lengths[: bisect_right(lengths, room)]
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for x in usable:
        sums, k, part = reach[-1], min(count[x], room // x), 1
        while k > 0:
            sums |= (sums << (min(part, k) * x)) & mask
            k, part = k - part, 2 * part
        reach.append(sums)

    def leads(i: int, left: int) -> bool:
        low = max(0, left - waste)
        return bool((reach[i] >> low) & ((1 << (left - low + 1)) - 1))

    i, left = len(usable), room
    chosen: list[tuple[int, int, int]] = []  # (i, room left before, copies)
    copies: int | None = None  # None: not tried yet
    while leads(len(usable), room):
        while i > 0:
            if meter[0] == 0:
                return
            meter[0] -= 1
            if copies is None:
                i = bisect_right(usable, left, 0, i)
                if not i:
                    break
            x = usable[i - 1]
            copies = min(count[x], left // x) if copies is None else copies - 1
            while copies >= 0 and not leads(i - 1, left - copies * x):
                copies -= 1
            if copies < 0:
                break
            if copies:
                chosen.append((i, left, copies))
                left -= copies * x
            i, copies = i - 1, None
        if i == 0:
            found = tuple((usable[k - 1], n) for k, _, n in chosen)
            if left <= waste and _undominated(lengths, count, found, left):
                yield found, left
        if not chosen or meter[0] == 0:
            return
        i, left, copies = chosen.pop()


def _undominated(lengths: list[int], count: dict[int, int], filling: tuple[tuple[int, int], ...], waste: int) -> bool:
    used = dict(filling)
    spare = lambda low, high: any(count[y] > used.get(y, 0) for y in lengths[bisect_right(lengths, low - 1) : bisect_right(lengths, high)])
    if waste and spare(1, waste):
        return False
    parts = [x for x, n in filling for _ in range(min(n, 2))]
    for i, x in enumerate(parts):
        if waste and spare(x + 1, x + waste):
            return False
        if any(spare(x + y, x + y + waste) for y in parts[:i]):
            return False
    return True


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram, all pieces of a length at once: (lengths, times) of its sequences."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}  # by room left
    rooms: list[int] = []

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        if room not in bins:
            bins[room] = {}
            rooms.insert(bisect_right(rooms, room), room)
        bins[room][content] = bins[room].get(content, 0) + n

    for x in sorted(hist, reverse=True):
        left = hist[x]
        while left:
            i = bisect_right(rooms, x - 1)
            if i == len(rooms):
                k = capacity // x
                full, rest = divmod(left, k)
                if full:
                    put(capacity - k * x, (x,) * k, full)
                if rest:
                    put(capacity - rest * x, (x,) * rest, 1)
                break
            room = rooms[i]
            content, n = next(iter(bins[room].items()))
            k = min(room // x, left)
            times = min(n, left // k)
            put(room - k * x, content + (x,) * k, times)
            left -= times * k
            if times == n:
                del bins[room][content]
            else:
                bins[room][content] = n - times
            if not bins[room]:
                del bins[room]
                rooms.remove(room)
    return [(c, n) for by in bins.values() for c, n in by.items()]


def bound(hist: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: total length, and for each threshold the lengths that can't share."""
    total = sum(x * n for x, n in hist.items())
    best = -(-total // capacity)
    size = np.zeros(capacity + 1, np.int64)
    for x, n in hist.items():
        size[x] = n
    upto, mass = np.cumsum(size), np.cumsum(size * np.arange(capacity + 1))
    for k in range(0, capacity // 2 + 1):
        big = int(upto[capacity] - upto[capacity - k])  # longer than capacity - k
        mid = int(upto[capacity - k] - upto[capacity // 2])
        small = int(mass[capacity // 2] - (mass[k - 1] if k else 0))
        room = mid * capacity - int(mass[capacity - k] - mass[capacity // 2])
        best = max(best, big + mid + max(0, -(-(small - room) // capacity)))
    return best


def pack(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences), covering the histogram exactly."""
    hist = {int(x): int(n) for x, n in hist.items() if n}
    if not hist:
        return []
    if min(hist) < 1 or max(hist) > capacity:
        raise ValueError("every length must lie between 1 and the capacity")
    incumbent = best_fit(hist, capacity)
    least, n_best = bound(hist, capacity), sum(n for _, n in incumbent)
    work, limit, weight = WORK, WORK // 60, {}
    while n_best > least and work > 0:
        spent, found, left, over = _branch_and_bound(hist, capacity, least, n_best, min(limit, work), weight)
        work -= spent
        if found is not None:
            incumbent, n_best = found, sum(n for _, n in found)
        if over:
            break
        # Lengths that found no place come earlier in the next search.
        for x, n in left.items():
            weight[x] = weight.get(x, 0) + n
        limit += limit // 8
    return incumbent


def _branch_and_bound(hist: dict[int, int], capacity: int, least: int, n_best: int, work: int, weight: dict[int, int]):
    """(work done, a packing with fewer than n_best sequences or None, what was left at the deepest end, whether nothing is left to try)."""
    total = sum(x * n for x, n in hist.items())
    count, lengths = dict(hist), sorted(hist)
    best, left_over, deepest = None, {}, -1
    # Depth first without recursion: of each level its choices, (content, times, waste of one), the one in force is the path's.
    path: list[tuple[tuple[tuple[int, int], ...], int, int]] = []
    stack: list[Iterator] = []
    opened = wasted = 0
    fresh = False
    meter = [work]

    def move(content: tuple[tuple[int, int], ...], times: int) -> None:
        for x, n in content:
            if x not in count:
                count[x] = 0
                lengths.insert(bisect_right(lengths, x), x)
            count[x] -= n * times
            if not count[x]:
                del count[x]
                lengths.pop(bisect_right(lengths, x) - 1)

    def choices() -> Iterator[tuple[tuple[tuple[int, int], ...], int, int]]:
        """All undominated ways to fill the largest length's sequence, and for how many sequences, within the waste bound."""
        top = lengths[-1]
        slack = (n_best - 1) * capacity - total - wasted
        move(((top, 1),), 1)
        own, left = list(lengths), dict(count)
        move(((top, 1),), -1)
        # Sequences that are full to the last unit first; each next round doubles the waste that it takes.
        low = 0
        while low <= min(slack, capacity - top) and meter[0]:
            ways = (f for f in fillings(own, left, capacity - top, min(2 * low, slack), meter) if f[1] >= low)
            while some := list(islice(ways, CHOICES)):
                some.sort(key=lambda f: (f[1], -sum(weight.get(x, 0) * n for x, n in f[0])))
                for filling, waste in some:
                    need = {top: 1}
                    for x, n in filling:
                        need[x] = need.get(x, 0) + n
                    content = tuple(need.items())
                    most = min(count[x] // n for x, n in content)
                    for times in range(min(most, max(1, slack // waste)) if waste else most, 0, -1):
                        yield content, times, waste
            low = 2 * low + 1

    while meter[0] and n_best > least:
        if len(stack) == len(path):
            if wasted <= (n_best - 1) * capacity - total and lengths:
                meter[0] = max(0, meter[0] - 50 - len(lengths))
                stack.append(choices())
            else:
                stack.append(iter(()))
            fresh = True
        step = next(stack[-1], None)
        if step is None and fresh and (len(path) > deepest or not lengths):
            # A branch ends here: best fit takes what is left.
            deepest, left_over = len(path), dict(count)
            rest = best_fit(left_over, capacity) if lengths else []
            if opened + sum(n for _, n in rest) < n_best:
                best = [(tuple(x for x, n in sorted(c, reverse=True) for _ in range(n)), t) for c, t, _ in path] + rest
                n_best = opened + sum(n for _, n in rest)
        fresh = False
        if step is None:
            stack.pop()
            if not path:
                return work - meter[0], best, left_over, meter[0] > 0
            content, times, waste = path.pop()
            move(content, -times)
            opened, wasted = opened - times, wasted - times * waste
        else:
            move(step[0], step[1])
            path.append(step)
            opened, wasted = opened + step[1], wasted + step[1] * step[2]
    return work - meter[0], best, left_over, n_best <= least


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Of each length rows (first number, per sequence, first sequence, offset), by number ascending.

    The piece with number r among those of a length stands, for the last row with first number <= r, in
    sequence first + (r - number) // per, at offset + (r - number) % per * length.
    """
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    base = 0
    for content, times in patterns:
        offset = 0
        for x in sorted(set(content), reverse=True):
            per = content.count(x)
            start = used.get(x, 0)
            rows.setdefault(x, []).append((start, per, base, offset))
            used[x] = start + per * times
            offset += per * x
        base += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


# ---------------------------------------------------------------- tokens


class _Memory(dict):
    """Chunk -> its ids as bytes; computes what it doesn't know."""

    def __init__(self, compute, old: dict):
        super().__init__()
        self.compute, self.old = compute, old

    def __missing__(self, chunk: str) -> bytes:
        known = self.old.get(chunk)
        self[chunk] = known = self.compute(chunk) if known is None else known
        return known


class Tokens:
    """Ids of whole texts, from the public tokenizer, with a memory for the chunks between white space.

    White space separates this tokenizer's tokens and is dropped, so a text's ids are its chunks' ids one
    after the other. A chunk of letters with ASCII marks behind it goes straight to the BPE model; any other
    goes through the whole tokenizer. The memory is bounded: two generations of about KEEP chunks.
    """

    KEEP = 250_000
    MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        self.model = self.tok.model
        self.byte_char = self._byte_chars()
        self.tails: dict[str, bytes] = {"": b""}
        self.memory = _Memory(self._chunk, {})

    @staticmethod
    def _byte_chars() -> dict[int, str]:
        """The printable character that byte-level BPE writes for each byte: itself, or the next from 256 on."""
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in kept]
        return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        core = chunk.rstrip(self.MARKS)
        if not core.isalpha():
            return self._whole(chunk)
        if core.isascii():
            word = core.lower()
        else:
            word = unicodedata.normalize("NFC", core)
            if "\u03a3" in word or not (word := word.lower()).isalpha():  # lower case depends on the context, or isn't letters
                return self._whole(chunk)
            word = "".join(map(self.byte_char.__getitem__, word.encode("utf-8", "surrogatepass")))
        marks = chunk[len(core) :]
        if (tail := self.tails.get(marks)) is None:
            tail = self._whole(marks)
            if len(self.tails) < 10_000:
                self.tails[marks] = tail
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids) + tail

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if _ODD_SPACE.search(text):
            return self._whole(text)
        if len(self.memory) > self.KEEP:
            self.memory = _Memory(self._chunk, dict(self.memory))
        memory = self.memory
        return b"".join([memory[c] for c in text.split()])


#: Python's split() parts here, the tokenizer's white space doesn't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_TOKENS: dict[str, Tokens] = {}


def tokens_of(file: str) -> Tokens:
    if file not in _TOKENS:
        _TOKENS[file] = Tokens(file)
    return _TOKENS[file]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's pieces."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens_of(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            doc, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, cell in enumerate(batch.column(1)):
                ids = tok.encode(cell.as_py() or "") + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    doc.append(i)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset; see the module's text for the method."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, capacity, id_col, text_col, with_ids), "pieces")
    # At most `capacity` rows reach the driver.
    hist = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    table = spark.sparkContext.broadcast(places(pack(hist, capacity)))

    # A piece's number among those of its length: a length of n pieces is numbered in about sqrt(n) groups of sqrt(n).
    salts = spark.createDataFrame([(int(x), max(1, round(n**0.5))) for x, n in hist.items()], "length bigint, salts int")
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts")).cast("int")).drop("salts")
    sizes = salted.groupBy("length", "salt").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    salted = salted.join(sizes.select("length", "salt", before.alias("before")), ["length", "salt"])
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    numbered = salted.withColumn("number", F.row_number().over(order) - 1 + F.col("before")).drop("salt", "before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                t = rows[int(x)]
                row = t[np.searchsorted(t[:, 0], number[at], side="right") - 1]
                past = number[at] - row[:, 0]
                sequence[at] = row[:, 2] + past // row[:, 1]
                offset[at] = row[:, 3] + past % row[:, 1] * x
            keep = [n for n in batch.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in numbered.dtypes if n != "number")
    return numbered.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")
