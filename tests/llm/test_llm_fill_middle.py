"""Fill-in-middle examples against a plain-Python twin."""
import hashlib
import random
import re

from cases import empty, frame, rows
from pyspark.sql import functions as F

from corpuslab.llm import fill_middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def twin(key, text):
    """(n, form, prefix_chars, middle_chars, output)"""
    units = UNIT.findall(text or "")
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    text, n = "".join(units), len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def hard_texts():
    rng = random.Random(3)
    signs = "ab Zé\n<>PSM中😀́,.'1"
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 5000))) for _ in range(40)]
    passage = "".join(rng.choice(signs) for _ in range(30_000))
    out += [passage[:k] + "X" + passage[k:] for k in (0, 1, 7000, 29_999)]
    out += ["a" * 100_000, "é" * 50_000, "😀" * 20_000, "ab" * 9000 + "<", "a <P> b", "<", "<P", "P><S", "\n" * 9000]
    return out


def test_equals_twin(spark):
    data = rows() + [(1000 + k, t, *[None] * 2, 0, *["x"] * 7) for k, t in enumerate(hard_texts())]
    made = fill_middle.fill_in_middle(frame(spark, data))
    restored = fill_middle.restore(F.col("output"), F.col("form")).alias("restored")
    got = made.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", restored).collect()
    assert len(got) == len(data)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert tuple(r[2:7]) == twin(r.doc_id, r.text), r.doc_id
        assert r.restored == (r.text or "")


def test_columns_and_empty_table(spark):
    extra = frame(spark).withColumn("form", F.lit(1)).withColumn("output", F.lit(2)).withColumn("n", F.lit(3))
    out = fill_middle.fill_in_middle(extra)
    assert sorted(out.columns) == sorted([*extra.columns, "prefix_chars", "middle_chars"])
    assert out.where(~F.col("form").isin("plain", "psm", "spm")).count() == 0
    assert fill_middle.fill_in_middle(empty(spark)).collect() == []


def test_chunks_follow_content():
    rng = random.Random(4)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20_000)).encode()
    moved = b"something else in front " + passage
    whole, shifted = ({raw[a:b] for a, b in zip([0, *ends], ends)} for raw, ends in ((r, fill_middle.chunk_ends(r)) for r in (passage, moved)))
    assert len(whole) > 50 and len(whole - shifted) <= 2
    assert all(fill_middle.LEAST <= len(c) <= fill_middle.MOST for c in whole if not passage.endswith(c))
    memory = fill_middle.Summaries()
    fill_middle.cut_places(passage, (5, 9), memory)
    once = memory.computed
    fill_middle.cut_places(moved, (5, 9), memory)
    assert memory.computed - once <= 2


def test_blocks_do_not_change_chunks(monkeypatch):
    raw = " ".join(str(k * k) for k in range(20_000)).encode()
    ends = fill_middle.chunk_ends(raw)
    monkeypatch.setattr(fill_middle, "BLOCK", 1000)
    assert fill_middle.chunk_ends(raw) == ends


def test_memory_is_bounded():
    memory = fill_middle.Summaries(limit=1000)
    for k in range(100):
        memory[b"%0100d" % k]
    assert sum(map(len, memory.young)) <= 1000 and sum(map(len, memory.old)) <= 1000
