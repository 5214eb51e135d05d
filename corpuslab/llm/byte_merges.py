"""Token ids of byte-level tokenizers for many texts at once.

Texts are cut at single spaces, where the next pre-token always begins (byte_pairs.py), and the
distinct parts of a batch are numbered by Arrow. Parts of ASCII signs and Latin letters are cut
into pre-tokens as bytes, and all distinct pre-tokens are merged together (word_merges.py). Parts
with other characters or apostrophes are cut by the pattern, and texts with other white space, two
spaces in a row, special strings or characters from U+0250 on are left to byte_pairs.py whole.
"""
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpuslab.llm.byte_pairs import BytePairs
from corpuslab.llm.word_merges import KINDS, LETTER, LOWER, OTHER, WIDTHS, Merges, gather

LINE_FEED = 10
#: Class of line feeds, beside those of word_merges.py.
LINE = 4


def _data(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all strings, bounds)"""
    sizes = pc.binary_length(strings).to_numpy().astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    total = int(bounds[-1])
    if not total:
        return np.zeros(0, np.uint8), bounds
    offset = int(np.frombuffer(strings.buffers()[1], np.int32)[strings.offset])
    return np.frombuffer(strings.buffers()[2], np.uint8, total, offset), bounds


def _any(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[bounds[1:]] > sums[bounds[:-1]]


class ByteIds:
    """Ids of texts; what it is given is what BytePairs takes."""

    def __init__(self, tokenizer_json: str, whole: dict[str, int], odd: frozenset[str]):
        self.pairs = BytePairs(tokenizer_json, whole, odd, summary=list)
        self.merges = Merges(json.loads(tokenizer_json), self.pairs.written)
        # Characters of two bytes that texts may have: no white space, and classed alike by library and pattern.
        self.usual = np.array([0xA0 < c < 0x250 and chr(c) not in odd and not chr(c).isspace() for c in range(0x800)])
        self.odd_ascii = np.array([b < 0x80 and (chr(b) in odd or (b < 0x20 and b != LINE_FEED) or b == 0x7F) for b in range(256)])

    def _whole(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Texts that are left to BytePairs whole."""
        bad = self.odd_ascii[data] | (data >= 0xCA)
        lead = np.flatnonzero((data >= 0xC2) & (data < 0xCA))
        points = ((data[lead].astype(np.int32) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
        bad[lead] |= ~self.usual[points]
        space, line = data == 32, data == LINE_FEED
        # The byte behind a text's last one belongs to the next text: at worst, a text is read the slower way.
        bad[:-1] |= (space[:-1] & (space[1:] | line[1:])) | (line[:-1] & space[1:]) | ((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        return _any(bad, bounds)

    def parts(self, distinct: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, counts) of parts, read behind a space if ``spaced``."""
        raw, bounds = _data(distinct)
        n, sizes = len(distinct), np.diff(bounds)
        if spaced:  # the space belongs to the first pre-token
            data = np.full(len(raw) + n, 32, np.uint8)
            data[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), sizes)] = raw
            bounds = bounds + np.arange(n + 1)
        else:
            data = raw
        kinds = KINDS[data]
        kinds[data == LINE_FEED] = LINE
        lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
        points = ((data[lead].astype(np.int32) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
        lead = lead[LOWER[points] > 0]
        kinds[lead] = kinds[lead + 1] = LETTER
        second = np.zeros(len(data), bool)
        second[lead + 1] = True
        if spaced:
            first = bounds[:-1][sizes > 0]
            kinds[first] = kinds[first + 1]
        odd = kinds == OTHER
        odd[:-1] |= (kinds[:-1] == LINE) & (kinds[1:] == LINE)
        slow = _any(odd, bounds) | (sizes == 0)
        begins = np.ones(len(data), bool)
        begins[1:] = kinds[1:] != kinds[:-1]
        begins &= ~second
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        begins &= ~np.repeat(slow, np.diff(bounds))
        starts = np.flatnonzero(begins)
        owner = np.searchsorted(bounds, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], len(data)), bounds[owner + 1])
        flat, each = self._merged(data, starts, ends - starts)
        counts = np.bincount(owner, weights=each, minlength=n).astype(np.int64)
        begin = np.cumsum(counts) - counts
        left = np.flatnonzero(slow)
        if len(left):
            read = self.pairs.__getitem__ if spaced else (lambda part: self.pairs.ids(self.pairs.findall(part)))
            found = [read(part) for part in distinct.take(pa.array(left)).to_pylist()]
            counts[left] = [len(f) for f in found]
            begin[left] = len(flat) + np.cumsum(counts[left]) - counts[left]
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(found), np.int32)])
        return flat, begin, counts

    def _merged(self, data, starts, lengths) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pre-tokens in a row, how many each has); equal ones are merged once."""
        body = gather(data, starts, lengths)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        own, bounds = _data(coded.dictionary)
        size = np.diff(bounds)
        counts, at = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        short, long = np.flatnonzero(size <= WIDTHS[-1]), np.flatnonzero(size > WIDTHS[-1])
        ids = np.zeros(0, np.int32)
        if len(short):
            ids, counts[short] = self.merges.merge(own, bounds[:-1][short], size[short])
            at[short] = np.cumsum(counts[short]) - counts[short]
        if len(long):
            found = [self.pairs.ids([own[bounds[k] : bounds[k + 1]].tobytes().decode()]) for k in long]
            counts[long] = [len(f) for f in found]
            at[long] = len(ids) + np.cumsum(counts[long]) - counts[long]
            ids = np.concatenate([ids, np.fromiter(chain.from_iterable(found), np.int32)])
        code = coded.indices.to_numpy()
        return gather(ids, at[code], counts[code]), counts[code]

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null text is empty."""
        texts = texts.cast(pa.string()).fill_null("")
        data, bounds = _data(texts)
        whole = self._whole(data, bounds) if len(data) else np.zeros(len(texts), bool)
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        for k in np.flatnonzero(whole).tolist():
            out[k] = np.fromiter(chain.from_iterable(self.pairs.summaries(texts[k].as_py())), np.int32)
        plain = np.flatnonzero(~whole & (np.diff(bounds) > 0))
        if not len(plain):
            return out
        lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        parts = lists.flatten()
        first = np.zeros(len(parts), bool)
        first[offsets[:-1]] = True
        begin, counts, flat = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), np.zeros(0, np.int32)
        for spaced, rows in ((False, np.flatnonzero(first)), (True, np.flatnonzero(~first))):
            if len(rows):
                coded = parts.take(pa.array(rows)).dictionary_encode()
                ids, starts, sizes = self.parts(coded.dictionary, spaced)
                code = coded.indices.to_numpy()
                begin[rows], counts[rows] = starts[code] + len(flat), sizes[code]
                flat = np.concatenate([flat, ids])
        all_ids = gather(flat, begin, counts)
        ends = np.concatenate([[0], np.cumsum(counts)])[offsets]
        for k, a, b in zip(plain.tolist(), ends[:-1], ends[1:]):
            out[k] = all_ids[a:b]
        return out


_kept: dict[str, ByteIds] = {}


def byte_ids(parts: tuple[str, dict[str, int], frozenset[str]]) -> ByteIds:
    """One for all tasks of a worker."""
    if parts[0] not in _kept:
        _kept.clear()
        _kept[parts[0]] = ByteIds(*parts)
    return _kept[parts[0]]
