"""Byte pair merges for many words at once, for tokenizers whose words end at white space.

Words of a batch are numbered by Arrow; letters, digits and signs of the distinct ones are told
apart as bytes, lower-cased by a table, and cut into pre-tokens. All distinct pre-tokens of
similar length are merged together: a matrix has a row of symbols for each, and a step merges the
pair of lowest rank, the leftmost of equals, in every row. That is the order of the library's
own merges. Words with other characters than ASCII and the Latin letters up to U+024F, with
apostrophes, or with what may be a special string go to the library, and so do pre-tokens longer
than the widest matrix.
"""
import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Widths of the matrices; longer pre-tokens go to the library.
WIDTHS = (4, 8, 12, 16, 24, 40)

#: Words that a worker remembers of those that went to the library; it bounds memory, not results.
REMEMBERED, REMEMBERED_CHARS = 100_000, 64

SLOTS, FACTOR = 20, np.uint64(0x9E3779B97F4A7C15)
NO_RANK = np.int32(2**31 - 1)
OTHER, LETTER, DIGIT, SIGN = range(4)

#: The pre-token pattern this module knows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def checked(tokenizer_json: str) -> str:
    """The file's text; raises unless it is a byte pair tokenizer of lower-cased words with PATTERN and word ends."""
    spec = json.loads(tokenizer_json)
    model, normal, pre = spec["model"], spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    parts = pre.get("pretokenizers") or []
    known = (
        model["type"] == "BPE" and model["end_of_word_suffix"] and not model["continuing_subword_prefix"]
        and not model["dropout"] and not model["ignore_merges"] and not spec["post_processor"]
        and normal.get("normalizers") == [{"type": "NFC"}, spaces, {"type": "Lowercase"}]
        and len(parts) == 2 and parts[0]["type"] == "Split" and parts[0]["pattern"] == {"Regex": PATTERN}
        and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
        and parts[1]["type"] == "ByteLevel" and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]
        and all(t["content"].startswith("<|") and not (t["single_word"] or t["lstrip"] or t["rstrip"] or any(map(str.isspace, t["content"])))
                for t in spec["added_tokens"])
    )
    if not known:
        raise ValueError("not a tokenizer of lower-cased words that end at white space")
    return tokenizer_json


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches flat[start : start + count], one after the other."""
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Merges:
    """Ranks and results of the merges, by pairs of symbol numbers."""

    def __init__(self, spec: dict, byte_characters: dict[int, str]):
        vocabulary, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.size = np.uint64(max(vocabulary.values()) + 1)
        self.within = np.array([vocabulary.get(byte_characters.get(b), -1) for b in range(256)], np.int32)
        self.last = np.array([vocabulary.get(byte_characters.get(b, "") + suffix, -1) for b in range(256)], np.int32)
        self.result = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocabulary[a] for a, _ in pairs], np.uint64) * self.size + np.array([vocabulary[b] for _, b in pairs], np.uint64)
        self.keys = np.full(1 << SLOTS, np.iinfo(np.uint64).max)
        self.ranks = np.full(1 << SLOTS, NO_RANK)
        # Each key takes the first free slot from its own on.
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.ranks[slots[todo]] == NO_RANK]
            _, first = np.unique(slots[free], return_index=True)
            taken = free[first]
            self.keys[slots[taken]], self.ranks[slots[taken]] = keys[taken], taken
            todo = np.setdiff1d(todo, taken)
            full = todo[self.ranks[slots[todo]] != NO_RANK]
            slots[full] = (slots[full] + 1) & ((1 << SLOTS) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * FACTOR) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; NO_RANK for pairs that don't merge, and where a symbol is missing."""
        keys = left.astype(np.uint64) * self.size + right.astype(np.uint64)
        slots = self._slot(keys)
        out = np.where(self.keys[slots] == keys, self.ranks[slots], NO_RANK)
        todo = np.flatnonzero((out == NO_RANK) & (self.ranks[slots] != NO_RANK))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & ((1 << SLOTS) - 1)
            found = self.keys[slots[todo]] == keys[todo]
            out[todo[found]] = self.ranks[slots[todo[found]]]
            todo = todo[~found & (self.ranks[slots[todo]] != NO_RANK)]
        out[(left < 0) | (right < 0)] = NO_RANK
        return out

    def merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, counts) of pre-tokens of at most WIDTHS[-1] bytes, counted by row; symbols in the order of rows."""
        counts = lengths.copy()
        symbols = np.full((len(starts), int(lengths.max(initial=1))), -1, np.int32)
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            if len(rows):
                found, n = self._rows(data, starts[rows], lengths[rows], width)
                symbols[rows, : min(width, symbols.shape[1])] = found[:, : symbols.shape[1]]
                counts[rows] = n
        inside = np.arange(symbols.shape[1]) < counts[:, None]
        return symbols[inside], counts

    def _rows(self, data, starts, n, width):
        columns = np.arange(width)
        at = np.minimum(starts[:, None] + columns, len(data) - 1)
        symbols = np.where(columns < n[:, None] - 1, self.within[data[at]], -1)
        whole = np.arange(len(n))
        symbols[whole, n - 1] = self.last[data[starts + n - 1]]
        n = n.copy()
        out = symbols.copy()
        if width > 1:
            ranks = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(n), -1)
            left = whole
            while len(left):
                here = np.arange(len(left))
                best = ranks.argmin(axis=1)
                lowest = ranks[here, best]
                live = lowest != NO_RANK
                if not live.all():
                    done = ~live
                    out[left[done]] = symbols[done]
                    left, symbols, ranks, best, lowest = left[live], symbols[live], ranks[live], best[live], lowest[live]
                    here = here[: len(left)]
                    if not len(left):
                        break
                # What stands right of the pair moves one place to the left.
                move = columns[None, :] > best[:, None]
                symbols[:, :-1] = np.where(move[:, :-1], symbols[:, 1:], symbols[:, :-1])
                symbols[:, -1] = -1
                symbols[here, best] = self.result[lowest]
                if ranks.shape[1] > 1:
                    after = columns[None, : width - 2] >= best[:, None]
                    ranks[:, :-1] = np.where(after, ranks[:, 1:], ranks[:, :-1])
                ranks[:, -1] = NO_RANK
                n[left] -= 1
                follow = np.minimum(best + 1, width - 1)
                right = np.where(best + 1 < width, symbols[here, follow], -1)
                spot = np.minimum(best, width - 2)
                new = self.rank(symbols[here, best], right)
                ranks[here, spot] = np.where(best < width - 1, new, ranks[here, spot])
                inner = np.flatnonzero(best > 0)
                ranks[inner, best[inner] - 1] = self.rank(symbols[inner, best[inner] - 1], symbols[inner, best[inner]])
        return out, n


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(class of each ASCII byte, lower-cased Latin letter of each code point of two bytes, 0 if not one)."""
    kinds = np.zeros(256, np.uint8)
    for c in range(0x21, 0x7F):
        kinds[c] = LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else SIGN
    kinds[ord("'")] = OTHER
    lower = np.zeros(0x800, np.int32)
    for c in range(0xC0, 0x250):
        small = chr(c).lower()
        if chr(c).isalpha() and len(small) == 1 and ord(small) < 0x250:
            lower[c] = ord(small)
    return kinds, lower


KINDS, LOWER = _tables()


class WordIds:
    """Token ids of texts, by way of their distinct words."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        # How the library writes each byte that these letters have.
        written: dict[int, str] = {}
        for c in (*range(0x21, 0x7F), *range(0xC0, 0x250)):
            written |= dict(zip(chr(c).encode(), shown(chr(c))[0][0]))
        self.merges = Merges(json.loads(tokenizer_json), written)
        self.known: dict[str, list[int]] = {}

    def by_library(self, words: list[str]) -> list[list[int]]:
        found = list(map(self.known.get, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            for k, encoding in zip(new, self.tokenizer.encode_batch_fast([words[k] for k in new], add_special_tokens=False)):
                found[k] = encoding.ids
                if len(self.known) < REMEMBERED and len(words[k]) <= REMEMBERED_CHARS:
                    self.known[words[k]] = encoding.ids
        return found

    def words(self, distinct: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, counts): word k has ids[starts[k] : starts[k] + counts[k]]"""
        sizes = pc.binary_length(distinct).to_numpy().astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        offset = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset] if len(distinct) else 0
        total = int(bounds[-1])
        data = np.frombuffer(distinct.buffers()[2], np.uint8, total, int(offset)).copy() if total else np.zeros(0, np.uint8)
        kinds = KINDS[data]
        upper = (data >= 65) & (data <= 90)
        data[upper] += 32
        lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
        points = ((data[lead].astype(np.int32) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
        small = LOWER[points]
        lead, small = lead[small > 0], small[small > 0]
        data[lead], data[lead + 1] = 0xC0 | small >> 6, 0x80 | small & 0x3F
        kinds[lead] = kinds[lead + 1] = LETTER
        second = np.zeros(total, bool)
        second[lead + 1] = True
        # Words that the library has to read: other characters, and "<|" of special strings.
        odd = kinds == OTHER
        odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        sums = np.concatenate([[0], np.cumsum(odd)])
        slow = sums[bounds[1:]] > sums[bounds[:-1]]
        # A pre-token begins with a word, a new class and each digit.
        begins = np.ones(total, bool)
        begins[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
        begins &= ~second
        begins[bounds[:-1][sizes > 0]] = True
        begins &= ~np.repeat(slow, sizes)
        starts = np.flatnonzero(begins)
        owner = np.searchsorted(bounds, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], total), bounds[owner + 1])
        return self._assembled(distinct, data, starts, ends - starts, owner, slow)

    def _assembled(self, distinct, data, starts, lengths, owner, slow):
        # Distinct pre-tokens, numbered by Arrow; those of words for the library are not among them.
        body = gather(data, starts, lengths)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        size = pc.binary_length(pieces.dictionary).to_numpy().astype(np.int64)
        first = np.cumsum(size) - size
        bytes_ = np.frombuffer(pieces.dictionary.buffers()[2] or b"", np.uint8)
        short = np.flatnonzero(size <= WIDTHS[-1])
        ids, counts = np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        if len(short):
            ids, counts[short] = self.merges.merge(bytes_, first[short], size[short])
        at = np.zeros(len(size), np.int64)
        at[short] = np.cumsum(counts[short]) - counts[short]
        long = np.flatnonzero(size > WIDTHS[-1])
        if len(long):
            found = self.by_library([bytes_[first[k] : first[k] + size[k]].tobytes().decode() for k in long])
            counts[long] = [len(f) for f in found]
            at[long] = len(ids) + np.cumsum(counts[long]) - counts[long]
            ids = np.concatenate([ids, np.fromiter(chain.from_iterable(found), np.int32)])
        code = pieces.indices.to_numpy()
        each = counts[code]
        flat = gather(ids, at[code], each)
        n = np.bincount(owner, weights=each, minlength=len(distinct)).astype(np.int64)
        begin = np.cumsum(n) - n
        odd = np.flatnonzero(slow)
        if len(odd):
            found = self.by_library(distinct.take(pa.array(odd)).to_pylist())
            n[odd] = [len(f) for f in found]
            begin[odd] = len(flat) + np.cumsum(n[odd]) - n[odd]
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(found), np.int32)])
        return flat.astype(np.uint32), begin, n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, bounds: text k has ids[bounds[k]:bounds[k + 1]])"""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        flat, begin, counts = self.words(words.dictionary)
        at = words.indices.to_numpy()
        each = counts[at]
        bounds = np.concatenate([[0], np.cumsum(each)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return gather(flat, begin[at], each), bounds


@lru_cache(maxsize=1)
def word_ids(tokenizer_json: str) -> WordIds:
    """One for all tasks of a worker."""
    return WordIds(tokenizer_json)
