import random
import zlib
from collections import Counter

import numpy as np
import pytest

from bidlake.llm.packing import CapacityTree, best_fit_plan, pack, sequences
from bidlake.llm.tokencount import count_tokens, token_counts
from bidlake.llm.tokens import Encoder, default_tokenizer

TEXTS = ["", None, "a", "two words", "  lead and  gaps \n\n \n x  ", "tab\t x \ny\n z ", "é è ñ ü 你好 🙂", "<|endoftext|> in text", "a <|endoftext|> b", "a<|endoftext|>  \n<|endoftext|>", "x" * 3000, "don't we're ' s",
         "word " * 5000, " nb   x  y", "a\x1c b \x1d c \x85 d", "1 22  333   4444    5", "end "]


def plain_ids(texts, special=True):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = not special
    return [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4") for x in texts]


def classic_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= n]
        if fits:
            best = min(fits, key=bins.__getitem__)
            bins[best] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_encoder_equals_the_library():
    rng = random.Random(1)
    odd = [" ".join(rng.choice(["a", "", "\n", "b\n", "\t", "é.", " ", "\x1f", "9", "'s", "　"]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    every = [f"a{chr(c)} {chr(c)}b {chr(c)} {chr(c)}" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    texts = TEXTS + odd + every
    for memory, special in ((400_000, True), (50, True), (400_000, False)):
        own = Encoder(default_tokenizer(), special, memory=memory)
        got = [x for lo in range(0, len(texts), 500) for x in own.encode(texts[lo : lo + 500])]
        assert all(np.array_equal(a, b) for a, b in zip(got, plain_ids(texts, special), strict=True))
        assert len(own.known) <= max(0.7 * memory, 2000) and len(own.tokens) <= max(memory, 2000)
        assert all(len(p) <= own.longest for p in [*own.known, *own.tokens])


def test_encoder_remembers_in_bounds():
    own = Encoder(default_tokenizer(), memory=1000)
    texts = [[" ".join(["a often", *(f"w{n}x{i}," for i in range(100))])] for n in range(20)]
    for text in texts:
        assert np.array_equal(own.encode(text)[0], plain_ids(text)[0])
        assert len(own.known) + len(own.tokens) <= 700 and "often" in own.known


def test_memory_changes_no_result(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j % 70}x{i}" for j in range(90))) for i in range(12)], "doc_id long, text string")
    small, large = (sorted(map(tuple, pack(docs, memory=m, capacity=64).collect())) for m in (60, 1_000_000))
    assert small == large


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 100, 257])
    lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 9)), capacity // 2 + 1, capacity]) for _ in range(rng.randint(1, 1500))]
    counts = Counter(lengths)
    plan = best_fit_plan(counts, capacity)
    used = Counter()
    spans = []
    for length, n in counts.items():
        own = plan[plan["length"] == length].sort_values("first")
        ends = [*own["first"].tolist()[1:], n]
        for row, end in zip(own.itertuples(), ends, strict=True):
            for rank in range(row.first, end):
                nth = rank - row.first
                b, offset = row.bin + nth // row.each, row.offset + nth % row.each * length
                spans.append((b, offset, length))
                used[b] += length
    assert len(spans) == len(lengths)
    assert sorted(capacity - x for x in used.values()) == classic_best_fit(lengths, capacity)
    at = {}
    for b, offset, length in sorted(spans):
        assert offset == at.get(b, 0)
        at[b] = offset + length


def test_tree_finds_the_tightest():
    rng = random.Random(2)
    tree, held = CapacityTree(50), Counter()
    for _ in range(2000):
        r = rng.randint(0, 50)
        if held[r] and rng.random() < 0.6:
            held[r] -= 1
            tree.add(r, -1)
        else:
            held[r] += 1
            tree.add(r, 1)
        least = rng.randint(1, 50)
        assert tree.tightest(least) == min((x for x, n in held.items() if n and x >= least), default=None)


def check_packed(rows, packed, capacity):
    want = Counter()
    for (doc, _), ids in zip(rows, plain_ids([t for _, t in rows]), strict=True):
        ids = np.append(ids, np.uint32(0)).astype("<u4")
        pieces = -(-len(ids) // capacity)
        cuts = [0] + [len(ids) - (pieces - 1 - p) * capacity for p in range(pieces)]
        for p in range(pieces):
            own = ids[cuts[p] : cuts[p + 1]]
            want[(doc, p, cuts[p], len(own), zlib.crc32(own.tobytes()))] += 1
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
        assert at[r.sequence_id] <= capacity
    assert len(at) == len(classic_best_fit([r.length for r in got], capacity))


def test_pack_brute_force(spark):
    rng = random.Random(4)
    rows = list(enumerate(TEXTS)) + [(None, "a"), (None, None), (3, "two words"), (3, "two words")]
    rows += [(100 + i, " ".join(rng.choice(["the", "of", "lot", "Zq"]) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_packed(rows, pack(docs, capacity=64), 64)
    check_packed(rows, pack(docs, with_ids=False, buckets=3), 2048)


def test_packed_sequences_hold_the_ids(spark):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(60)]
    packed = pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=32)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in sequences(packed).collect()}
    for r in packed.collect():
        assert bytes(r.ids) == whole[r.sequence_id][r.offset : r.offset + r.length].tobytes()
    assert sum(map(len, whole.values())) == sum(len(x) + 1 for x in plain_ids([t for _, t in rows], special=False))


def test_places_need_one_shuffle_at_any_number_of_partitions(spark):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(60)]
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 500)
    try:
        packed = pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=32, with_ids=False)
        plan = packed._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("Window") == 1
        check_packed(rows, packed, 32)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_nothing_to_pack(spark):
    none = spark.createDataFrame([], "doc_id long, text string, piece string")
    assert pack(none).count() == 0 and token_counts(none).count() == 0


def test_token_counts(spark):
    rows = list(enumerate(TEXTS)) + [(None, "a b c"), (3, "two words"), (3, "two words")]
    want = sorted(((d, len(x)) for (d, _), x in zip(rows, plain_ids([t for _, t in rows], special=False), strict=True)), key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1 << 24, 64, 2):
        assert sorted(map(tuple, token_counts(docs, block_bytes=block).collect()), key=str) == want


def test_scan_of_foreign_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    want = []
    for name, n, ends in (("a.bin", 5000, 0.02), ("b.bin", 0, 0), ("c.bin", 700, 0), ("d.bin", 300, 0.9)):
        ids = np.where(rng.random(n) < ends, 9, rng.integers(0, 9, n)).astype("<u4")
        ids.tofile(tmp_path / name)
        parts = np.split(ids, np.flatnonzero(ids == 9) + 1)
        want += [(name, i, len(p) - (p[-1:] == 9).sum(), bool(len(p) and p[-1] == 9)) for i, p in enumerate(parts) if len(p)]
    files = spark.createDataFrame([(x,) for x in ("a.bin", "b.bin", "c.bin", "d.bin")], "file string")
    for block in (4, 40, 4096, 1 << 20):
        got = count_tokens(files, f"file://{tmp_path}", 9, "<u4", block)
        assert sorted((r.file, r.doc_no, r.tokens, r.ended) for r in got.collect()) == sorted(want)
