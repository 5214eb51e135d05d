"""Byte-level BPE in tasks: pre-tokens that are whole tokens are looked up, the rest merged.

Which vocabulary strings encode alone as one token is proved offline, once per call, by
encoding them. Texts are cut at single spaces first: between two other characters a
space always begins the next pre-token, so the part up to the next space has the same
tokens wherever it stands and is remembered under its text. Full memories take nothing more: frequent parts come early.
"""
import json
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

#: Fixed value: the pre-tokens of a byte-level tokenizer, letters and digits written for `re`.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"

SIGNS = (".", ",", ";", ":", "!", "?")

#: Texts with a character from here on (tags, private use) are left to the library whole.
PROVED = "\U00040000"

#: Entries that each memory of a task may hold; it bounds memory, not results.
CACHE_ENTRIES = 250_000

#: Longer parts are merged each time and not remembered.
REMEMBERED_CHARS = 64


def load(tokenizer_json: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer_json)


def special_strings(tokenizer_json: str) -> list[str]:
    """The special strings; raises unless the file is a plain byte-level BPE tokenizer."""
    spec = json.loads(tokenizer_json)
    pre = spec["pre_tokenizer"] or {}
    plain = (
        spec["model"]["type"] == "BPE" and spec["normalizer"] is None and pre.get("type") == "ByteLevel"
        and pre["use_regex"] and not pre["add_prefix_space"]
    )
    if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("not a plain byte-level BPE tokenizer")
    return sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)


def whole_tokens(tokenizer) -> dict[str, int]:
    """The vocabulary strings proved to encode alone as one token, with their ids."""
    ids = range(tokenizer.get_vocab_size(with_added_tokens=False))
    strings = tokenizer.decode_batch([[i] for i in ids])
    # A token that is part of a character decodes to a replacement character and fails the proof.
    proofs = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return {s: i for i, s, p in zip(ids, strings, proofs) if p.ids == [i]}


@lru_cache(maxsize=4)
def odd_characters(tokenizer_json: str) -> frozenset[str]:
    """Characters below PROVED that the library and PRE_TOKENS class differently."""
    pre, pattern, odd = load(tokenizer_json).pre_tokenizer, re.compile(PRE_TOKENS), []

    def same(points: list[int]) -> bool:
        # Letters, digits, spaces and others each cut this frame in another way.
        frame = "".join(f"a{chr(c)}!1" for c in points)
        return [frame[a:b] for _, (a, b) in pre.pre_tokenize_str(frame)] == pattern.findall(frame)

    def search(points: list[int]) -> None:
        if not same(points):
            if len(points) == 1:
                odd.append(points[0])
                return
            half = len(points) // 2
            search(points[:half])
            search(points[half:])

    points = [c for c in range(ord(PROVED)) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 4096):
        search(points[start : start + 4096])
    return frozenset(map(chr, odd))


class BytePairs(dict):
    """`summary` of the token ids of a part with its leading space, remembered by the part."""

    def __init__(self, tokenizer_json: str, whole: dict[str, int], odd: frozenset[str], summary: Callable):
        super().__init__()
        self.tokenizer, self.summary = load(tokenizer_json), summary
        self.known = {piece: [i] for piece, i in whole.items()}
        self.merge = self.tokenizer.model.tokenize
        self.findall = re.compile(PRE_TOKENS).findall
        self.odd = odd
        special = special_strings(tokenizer_json)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        shown = self.tokenizer.pre_tokenizer.pre_tokenize_str
        # How the library writes each byte that UTF-8 has.
        self.written: dict[int, str] = {}
        for c in (*range(0x800), *range(0x800, 0xD000, 0x1000), 0xD000, 0xE000, 0xF000, *range(0x10000, 0x110000, 0x30000), 0x100000):
            self.written |= dict(zip(chr(c).encode(), "".join(x for x, _ in shown(chr(c)))))

    def ids(self, pre_tokens: Iterable[str]) -> list[int]:
        out: list[int] = []
        for piece in pre_tokens:
            found = self.known.get(piece)
            if found is None:
                found = [t.id for t in self.merge(piece.encode().decode("latin1").translate(self.written))]
                if len(self.known) < CACHE_ENTRIES and len(piece) <= REMEMBERED_CHARS:
                    self.known[piece] = found
            out += found
        return out

    def __missing__(self, part: str):
        # Letters are one pre-token, and so is a sign behind them; other parts are cut by the pattern.
        if part.isalpha():
            found = [" " + part]
        elif part[-1:] in SIGNS and part[:-1].isalpha():
            found = [" " + part[:-1], part[-1]]
        else:
            found = self.findall(" " + part)
        value = self.summary(self.ids(found))
        if len(self) < CACHE_ENTRIES and len(part) <= REMEMBERED_CHARS:
            self[part] = value
        return value

    def summaries(self, text: str | None) -> list:
        """Summaries whose sum or join is that of the whole text."""
        if not text:
            return []
        characters = set(text)
        if max(characters) >= PROVED or not self.odd.isdisjoint(characters):
            return [self.summary(self.tokenizer.encode(text, add_special_tokens=False).ids)]
        spaces = [c for c in characters if c.isspace()]
        out: list = []
        for k, span in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(self.summary([self.tokenizer.token_to_id(span)]))
            elif any(f" {c}" in span or f"{c} " in span for c in spaces):
                out.append(self.summary(self.ids(self.findall(span))))
            elif span:
                first, *rest = span.split(" ")
                out.append(self.summary(self.ids(self.findall(first))))
                out += map(self.__getitem__, rest)
        return out
