"""Packing: ids against the library, layout against its contract, patterns against enumeration."""
import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import empty, frame, rows
from tokenizers import Tokenizer

from corpuslab.llm import cutting_stock, packing, word_merges

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def brute_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_equal_the_library(tokenizer, monkeypatch):
    rng = random.Random(2)
    signs = list("aB é́  \x1c\x85\t\n\r,.'’1²٣中文İΣςǅ​😀") + ["<|endoftext|>", "<|startoftext|>", "'S", "'ll", "가", "  ", "Å"]
    plain = list("aabcdeghilmnorstuABCÉéèñßØŁǅȺıſ 0123456789.,!?-<|>_\n")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 200))) for _ in range(500)]
    texts += ["".join(rng.choice(plain) for _ in range(rng.randint(0, 400))) for _ in range(1500)]
    texts += ["".join(rng.choice("thequickbrownfox") for _ in range(k)) for k in range(90)]
    texts += ["", " ", "a", "x" * 50_000, "word " * 5000, " a <|endoftext|>b", "the" * 14, "é" * 20, "é" * 21]
    reader = word_merges.WordIds(word_merges.checked(open(PATH, encoding="utf-8").read()))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in packing.ids_of(reader, pa.array(texts))] == want
    assert [ids.tolist() for ids in packing.ids_of(reader, pa.array(["x", *texts])[1:])] == want
    monkeypatch.setattr(packing, "SLICE_BYTES", 64)
    assert [ids.tolist() for ids in packing.ids_of(reader, pa.array(texts))] == want


def test_every_letter_of_the_tables(tokenizer):
    """Lower case and class of each character that the tables know are the library's."""
    reader = word_merges.WordIds(open(PATH, encoding="utf-8").read())
    texts = [f"a{chr(c)}b 1{chr(c)}! {chr(c)}{chr(c)}" for c in (*range(0x21, 0x7F), *range(0xA1, 0x250))]
    assert [ids.tolist() for ids in packing.ids_of(reader, pa.array(texts))] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        word_merges.checked(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


def verify(packed, data, tokenizer, size=2048, slack=packing.SLACK):
    """Every id in exactly one piece, sequences without gaps; returns padding."""
    got = packed.rows("doc_id").collect()
    ids = Counter()
    for key, text in data:
        ids[key, tuple(brute_ids(tokenizer, text))] += 1
    tokens_of = defaultdict(list)
    for (key, body), n in ids.items():
        tokens_of[key].append((body, n))
    seen = Counter()
    for r in got:
        fits = [b for b, _ in tokens_of[r.doc_id] if len(b) == r.doc_tokens and zlib.crc32(np.array(b[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert fits and r.length > 0 and r.start + r.length <= r.doc_tokens
        seen[r.doc_id] += r.length
    assert seen == Counter({k: sum(len(b) * n for b, n in v) for k, v in tokens_of.items()})
    fills = defaultdict(list)
    for r in got:
        fills[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        padding += cutting_stock.padded(at, size) - at
    assert sorted(fills) == list(range(len(fills)))
    return padding, len(fills), got


def test_pack(spark, tokenizer):
    data = [(r[0], r[1]) for r in rows()]
    packed = packing.pack(frame(spark), PATH)
    padding, n, got = verify(packed, data, tokenizer)
    assert padding <= 2048 + packing.SLACK * n
    whole = {r.sequence_id: (r.n_tokens, r.ids) for r in packed.sequences().collect()}
    assert len(whole) == n
    for r in got:
        body = whole[r.sequence_id][1][4 * r.offset : 4 * (r.offset + r.length)]
        assert zlib.crc32(body) == r.ids_crc32
    assert all(len(b) // 4 == cutting_stock.padded(k, 2048) for k, b in whole.values())


def test_one_length_of_most_documents(spark, tokenizer):
    text = "river stone " * 550
    data = [(k, text) for k in range(300)] + [(1000 + k, "a b c " * k) for k in range(20)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    padding, n, got = verify(packing.pack(docs, PATH), data, tokenizer)
    tokens = sum(r.length for r in got)
    assert padding <= 2048 + packing.SLACK * n and n <= tokens // 2048 + 3


def test_empty_table(spark):
    packed = packing.pack(empty(spark), PATH)
    assert packed.rows("doc_id").collect() == [] and packed.sequences().collect() == []


def patterns_of(lengths, size):
    for copies in product(*(range(size // k + 1) for k in lengths)):
        if 0 < sum(k * n for k, n in zip(lengths, copies)) <= size:
            yield tuple((k, n) for k, n in zip(lengths, copies) if n)


def test_prices_against_enumeration():
    rng = np.random.default_rng(6)
    lengths, size = [2, 3, 5, 7], 16
    for _ in range(20):
        values = np.zeros(size + 1)
        values[lengths] = rng.uniform(-1, 3, 4)
        prices = cutting_stock.Prices(values, size)
        best = defaultdict(lambda: -np.inf)
        for p in patterns_of(lengths, size):
            if all(values[k] > 0 for k, _ in p):
                fill = cutting_stock.fill_of(p)
                best[fill] = max(best[fill], sum(values[k] * n for k, n in p))
        for fill in range(1, size + 1):
            assert prices.best[fill] == pytest.approx(best[fill])
            if best[fill] > 0:
                chosen = prices.pattern(fill)
                assert cutting_stock.fill_of(chosen) == fill
                assert sum(values[k] * n for k, n in chosen) == pytest.approx(best[fill])


@pytest.mark.parametrize("seed", range(6))
def test_linear_program_is_optimal(seed):
    """Column generation ends where no pattern at all costs less than its pieces are worth."""
    rng = np.random.default_rng(seed)
    size = 13
    lengths = sorted(rng.choice(np.arange(2, 13), 5, replace=False).tolist())
    demand = {k: int(rng.integers(2000, 90_000)) for k in lengths}
    plan = cutting_stock.solve(demand, size, tolerance=1e-9)
    made = Counter()
    for p, x in plan.used:
        for k, n in p:
            made[k] += n * x
    assert all(made[k] == pytest.approx(demand[k], rel=1e-6) for k in lengths)
    assert plan.cost == pytest.approx(sum(cutting_stock.cost(p, size) * x for p, x in plan.used))
    assert plan.bound <= plan.cost * (1 + 1e-9) and plan.cost <= plan.bound + size


def test_whole_patterns_use_up_the_demand():
    rng = random.Random(8)
    for demand in ({}, {1: 1}, {2047: 3}, {1100: 1000, 948: 10}, {k: rng.randint(0, 50) for k in range(1, 2048, 3)}):
        found, plan = cutting_stock.whole_patterns(demand, 2048)
        used = Counter()
        for p, times in found:
            assert cutting_stock.fill_of(p) <= 2048 and times > 0
            for k, n in p:
                used[k] += n * times
        assert used == Counter({k: n for k, n in demand.items() if n})


def test_column_generation_beats_greedy():
    # Largest first uses up the 2s beside the 6s and strands the 4s and 3s.
    size, demand = 10, {6: 9000, 5: 9000, 4: 9000, 3: 18_000, 2: 9000}
    plan = cutting_stock.solve(demand, size, tolerance=1e-9)
    assert plan.cost <= plan.bound + size
