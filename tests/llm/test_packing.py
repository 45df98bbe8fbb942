import itertools
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from lumenveil.llm import packing as P

FILE = public_tokenizers.path("word_bpe_49k.json")


def exact(sizes, capacity):
    """Fewest bins, by trying everything (small inputs)."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity and bins[b] not in bins[:b]:
                bins[b] += sizes[i]
                go(i + 1, bins)
                bins[b] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_pack_is_exact_on_small_inputs(seed):
    r = random.Random(seed)
    capacity = r.choice([20, 50, 100])
    sizes = sorted((r.randint(capacity // 8, capacity * 3 // 4) for _ in range(r.randint(1, 11))), reverse=True)
    hist = {x: sizes.count(x) for x in sizes}
    patterns = P.pack(hist, capacity)
    packed = {}
    for content, n in patterns:
        assert sum(content) <= capacity
        for x in content:
            packed[x] = packed.get(x, 0) + n
    assert packed == hist
    n = sum(k for _, k in patterns)
    assert P.bound(hist, capacity) <= exact(sizes, capacity) == n


def test_large_histogram_meets_the_bound():
    r = random.Random(5)
    hist = {r.randint(1, 4096): r.randint(1, 10**6) for _ in range(900)}
    patterns = P.pack(hist)
    assert sum(n for _, n in patterns) <= 1.002 * P.bound(hist, 4096)


ODD = ["", " ", "a\x1cb c", "<|endoftext|> x<|startoftext|>y", "'s 're ÀÉ İx ΑΣ ² ½ Ⅷ z", "　 a", "don't can't ''x", "A" * 5000, "ﬁ ﬂ 한글 漢字 😀", "x,.!?; (y) [z]"]


@pytest.mark.parametrize("text", ODD)
def test_tokens_equal_the_tokenizer(text):
    ref = Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(P.tokens_of(FILE).encode(text), "<u4").tolist() == ref


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(-1, None), (-2, ""), (-3, "word " * 9000), (-3, "word " * 9000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = P.best_fit_packing(df, FILE, with_ids=True).collect()
    ref = Tokenizer.from_file(FILE)
    want = []
    for i, t in rows:
        ids = ref.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    hist = {}
    for w in want:
        hist[w[3]] = hist.get(w[3], 0) + 1
    assert len(by) == P.bound(hist, 4096)
    assert P.best_fit_packing(df.limit(0), FILE).count() == 0


def test_salted_numbers(spark):
    df = spark.createDataFrame([(i, "same text here") for i in range(3000)], "doc_id bigint, text string")
    got = P.best_fit_packing(df, FILE).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 3000


def triplets(n, seed):
    """Lengths of n sequences of 1000, three pieces each, with nothing to spare."""
    r = random.Random(seed)
    hist = {}
    for _ in range(n):
        a = r.randint(380, 490)
        b = r.randint((1000 - a) // 2, min(490, 750 - a))
        for x in (a, b, 1000 - a - b):
            hist[x] = hist.get(x, 0) + 1
    return hist


@pytest.mark.parametrize("n, seed, most", [(20, 0, 20), (20, 1, 21), (40, 0, 40), (83, 1, 84)])
def test_search_beats_best_fit_where_nothing_may_be_wasted(n, seed, most):
    hist = triplets(n, seed)
    patterns = P.pack(hist, 1000)
    assert sum(k for _, k in patterns) <= most < sum(k for _, k in P.best_fit(hist, 1000))
    packed = {}
    for content, k in patterns:
        assert sum(content) <= 1000
        for x in content:
            packed[x] = packed.get(x, 0) + k
    assert packed == hist


def test_many_equal_pieces_need_no_recursion():
    assert sum(n for _, n in P.pack({3: 5592405})) == 4097  # 1365 pieces in each
    assert sum(n for _, n in P.pack({1: 10**7, 2: 10**7, 4000: 3})) == P.bound({1: 10**7, 2: 10**7, 4000: 3}, 4096)


@pytest.mark.parametrize("seed", range(40))
def test_fillings_are_all_undominated_ones(seed):
    """Against trying every subset; dominated: an unused length fits in place of none, one or two of the used."""
    r = random.Random(seed)
    hist = {r.randint(2, 20): r.randint(1, 3) for _ in range(6)}
    room, waste = r.randint(10, 40), r.randint(0, 4)
    keys = sorted(hist, reverse=True)
    want = set()
    for copies in itertools.product(*[range(hist[k] + 1) for k in keys]):
        left = room - sum(c * k for c, k in zip(copies, keys))
        if not 0 <= left <= waste:
            continue
        spare = [k for k, c in zip(keys, copies) if c < hist[k]]
        parts = [k for k, c in zip(keys, copies) for _ in range(c)]
        pairs = [a + b for a, b in itertools.combinations(parts, 2)]
        if not any(y <= left or any(a < y <= a + left for a in parts) or any(ab <= y <= ab + left for ab in pairs) for y in spare):
            want.add(tuple((k, c) for k, c in zip(keys, copies) if c))
    assert {f for f, _ in P.fillings(sorted(hist), hist, room, waste)} == want


def test_work_is_bounded_where_almost_every_filling_is_dominated():
    r = random.Random(1)
    hist = {x: r.randint(1, 40) for x in range(5, 400)}
    spent, *_ = P._branch_and_bound(hist, 4096, 0, 10**9, 20_000, {})
    assert spent == 20_000
