"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over the words of all documents. A token that may
be disguised (digits or signs between letters, letters repeated three times or more,
letters set apart by signs, single letters in a row) becomes a lattice: each place may
be what is written, what the writing stands for, or a repetition of the place before.
Viterbi decoding takes the path with the best sum of model and channel costs. In letters
set apart one by one, words may also end at each place. Tokens and rows of any length are
decoded, in linear time. Plain
words stay as they are. Restored texts are scored by a lexicon: words whose share of
toxic training documents exceeds their share of clean ones beyond chance, combined with
absent words as independent evidence (Bernoulli naive Bayes).

Defined cases: null and empty texts get the score of a text without any lexicon word;
a missing or null label trains nothing; without labels of both kinds the score is the
share of toxic labels (0.5 without labels); repeated rows score alike; a document
labelled in several rows counts once per row; extra columns stay (a score
is replaced); empty tables give no row.
"""
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.columns import free
from corpuslab.llm.words import CACHE_ENTRIES, text_batches
from corpuslab.storage import materialize

#: Labelled documents that the lexicon is learned from at most (in hash order of their keys).
TRAINING_ROWS = 20_000
#: Lexicon words at most, the least documents of a word, and the least z value of its difference.
LEXICON_WORDS, LEAST_DOCS, LEAST_Z = 4_000, 3, 4.0

#: What disguised writing may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou", "#": "h",
}

#: Channel costs in nats: a sign read as a letter, a sign dropped, a repetition dropped, a sign kept.
READ, DROPPED, REPEATED, KEPT = 1.0, 3.0, 0.5, 8.0

#: Characters of a token that a task remembers; it bounds memory, not results.
LONGEST_KEPT = 200

#: The model's alphabet: 0 is the word border, 1..26 a-z, others share 31 hashed symbols.
SIZE = 64

PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&|-_~`…“”‘’«»¿¡=/\\^"
LETTER = r"[^\W\d_]"
#: What makes a token look disguised; each pattern reads a token of any length in linear time.
BESIDE = re.compile(rf"[0-9@$!|+€£(]{LETTER}{{2}}|{LETTER}{{2}}[0-9@$!|+€£(]|(\w)\1\1")
BETWEEN = re.compile(rf"(?<={LETTER})(?:[^\w\s]|[0-9])++(?={LETTER})")
SIGNS, DIGITS = re.compile(r"[0-9@$!|+€£(*#]+"), re.compile(r"[0-9](?:.*[0-9])?", re.DOTALL)
APART = re.compile(r"(?:[^\W_][.\-_*~/]+){2,}[^\W_]")


def symbol(c: str) -> int:
    code = ord(c)
    if 97 <= code <= 122:
        return code - 96
    return 27 + code % 37


def trigrams(words: dict[str, int]) -> Counter:
    out: Counter = Counter()
    for word, n in words.items():
        row = [0, 0, *map(symbol, word), 0]
        for a, b, c in zip(row, row[1:], row[2:]):
            out[(a * SIZE + b) * SIZE + c] += n
    return out


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """-log P(c | a, b) as an array of SIZE ** 3, from the letters-only words of all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SIZE**3, np.int64)
        table = np.zeros(0x3000, np.uint8)
        table[[i for i in range(0x3000) if chr(i).isalpha()]] = [symbol(chr(i).lower()[0]) for i in range(0x3000) if chr(i).isalpha()]
        for batch in batches:
            for start in range(0, len(batch), 64):
                joined = "  ".join(t for t in batch[text].iloc[start : start + 64] if t)
                codes = np.frombuffer(f"  {joined}  ".encode("utf-32-le"), np.uint32)
                s = table[np.minimum(codes, 0x2FFF)].astype(np.int32)
                # A border before a word counts twice, so that its first letters have a context.
                a, b, c = s[:-2], s[1:-1], s[2:]
                a = np.where(b == 0, 0, a)
                use = (b > 0) | (c > 0)
                total += np.bincount((a[use] * SIZE + b[use]) * SIZE + c[use], minlength=SIZE**3)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"gram": found.astype("int32"), "n": total[found]})

    counted = docs.select(text).mapInPandas(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = np.full(SIZE**3, 0.01)
    # The alphabet bounds what comes to the driver: at most SIZE ** 3 rows.
    found = counted.toArrow()
    grams[found.column("gram").to_numpy()] += found.column("n").to_numpy()
    grams = grams.reshape(SIZE * SIZE, SIZE)
    return -np.log(grams / grams.sum(axis=1, keepdims=True)).ravel().astype(np.float32)


def disguised(written: str) -> bool:
    """Signs or digits beside letters, or letters repeated three times or more."""
    if BESIDE.search(written):
        return True
    for gap in BETWEEN.findall(written):
        digits = DIGITS.search(gap)
        if SIGNS.fullmatch(digits[0]) if digits else SIGNS.search(gap):
            return True
    return False


def single(word: str) -> str:
    """A repetition may be meant: both readings of double letters are kept."""
    return re.sub(r"(\w)\1+", r"\1", word)


class Channel(dict):
    """Restored words of a token, remembered within a task."""

    def __init__(self, model: np.ndarray):
        super().__init__()
        self.model = model.tolist()

    def decode(self, written: str, borders: bool = False) -> str:
        """The best path through the lattice of lower-case writing; with `borders` a word may end at each place."""
        model, last = self.model, ""
        # State: the last two symbols -> (cost, restored text as back-pointers). The alphabet bounds their number.
        states: dict[int, tuple] = {0: (0.0, None)}
        for c in written:
            if borders:
                ended = [(cost + model[ab * SIZE], path) for ab, (cost, path) in states.items() if ab]
                if ended:
                    cost, path = min(ended, key=lambda e: e[0])
                    if 0 not in states or cost < states[0][0]:
                        states[0] = (cost, (path, " "))
            options: list[tuple[str, float]] = []
            if c.isalpha():
                options.append((c, 0.0))
            else:
                options += [(r, READ) for r in STANDS_FOR.get(c, "")]
                options += [("", DROPPED), (c, KEPT)]
            if c == last:
                options.append(("", REPEATED))
            last = c
            steps = [(r, symbol(r) if r else 0, extra) for r, extra in options]
            following: dict[int, tuple] = {}
            for ab, (cost, path) in states.items():
                for r, s, extra in steps:
                    if r:
                        gram = ab * SIZE + s
                        state, price = gram % (SIZE * SIZE), cost + extra + model[gram]
                    else:
                        state, price = ab, cost + extra
                    if state not in following or price < following[state][0]:
                        following[state] = (price, (path, r) if r else path)
            states = following
        costs = {ab: cost + model[ab * SIZE] for ab, (cost, _) in states.items()}
        least = min(costs.values())
        return min(self.spelled(states[ab][1]) for ab, cost in costs.items() if cost == least)

    @staticmethod
    def spelled(path: tuple | None) -> str:
        out = []
        while path:
            path, r = path
            out.append(r)
        return "".join(reversed(out))

    def row(self, joined: str) -> set[str]:
        """Words of letters that were set apart one by one: those of the restored row, and all runs in it and in the row as written."""
        low = joined.lower()
        words = self.decode(low, borders=True).split()
        out = {form for w in words for form in (w, single(w))}
        for text in {low, "".join(words)}:
            out.update(text[i:j] for i in range(len(text)) for j in range(i + 3, min(len(text), i + 20) + 1))
        return out

    def __missing__(self, token: str) -> tuple[str, ...]:
        low = token.lower()
        core = low.strip(PUNCTUATION)
        forms = {core}
        if APART.fullmatch(core):
            core = re.sub(r"[.\-_*~/]+", "", core)
            forms |= {core} | self.row(core)
        for written in {core, low.strip(".,;:?\"'")}:
            if disguised(written):
                restored = self.decode(written)
                forms |= {restored, single(restored)}
        forms.discard("")
        value = tuple(forms)
        if len(self) < CACHE_ENTRIES and len(token) <= LONGEST_KEPT:
            self[token] = value
        return value

    def words(self, text: str | None) -> set[str]:
        """The restored words of a text."""
        tokens = (text or "").split()
        out: set[str] = set()
        for token in set(tokens):
            out.update(self[token])
        # Single letters in a row are read together.
        row: list[str] = []
        for token in [*tokens, "  "]:
            if len(token) == 1 and (token.isalnum() or token in STANDS_FOR):
                row.append(token)
                continue
            if len(row) >= 3:
                joined = "".join(row)
                out.update(self[joined])
                out |= self.row(joined)
            row = []
        return out


def learn(docs: DataFrame, labels: DataFrame, model: np.ndarray, key: str = "doc_id", text: str = "text", label: str = "toxic",
          rows: int = TRAINING_ROWS) -> tuple[float, dict[str, float]]:
    """(base, word -> weight): the log odds of a text are base plus the weights of its words."""
    sample = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(key), F.col(label).cast("int").alias("_label")).orderBy(F.xxhash64(key), "_label").limit(rows)
    # At most `rows` labelled keys: a broadcast of bounded size.
    known = docs.select(key, text).join(F.broadcast(materialize(sample, "toxicity-sample")), key).select(text, "_label")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel, counts, total = Channel(model), {0: Counter(), 1: Counter()}, [0, 0]
        for batch in batches:
            for t, y in zip(batch[text], batch["_label"]):
                counts[y].update(channel.words(t))
                total[y] += 1
        words = [*counts[0].keys() | counts[1].keys(), ""]
        yield pd.DataFrame({
            "word": words, "clean": [counts[0][w] for w in words[:-1]] + total[:1], "toxic": [counts[1][w] for w in words[:-1]] + total[1:]})

    counted = materialize(
        known.mapInPandas(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")),
        "toxicity-words")
    n_clean, n_toxic = counted.where("word = ''").agg(F.sum("clean"), F.sum("toxic")).first()
    if not n_clean or not n_toxic:
        share = n_toxic / (n_clean + n_toxic) if n_clean or n_toxic else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return math.log(share / (1 - share)), {}
    p, q = (F.col("toxic") + 0.5) / (n_toxic + 1), (F.col("clean") + 0.5) / (n_clean + 1)
    z = (p - q) / F.sqrt(p * (1 - p) / n_toxic + q * (1 - q) / n_clean)
    weight, absent = F.log(p / q), F.log((1 - p) / (1 - q))
    lexicon = (
        counted.where((F.col("word") != "") & (F.col("toxic") >= LEAST_DOCS)).withColumn("z", z).where(F.col("z") >= LEAST_Z)
        .orderBy(F.desc("z"), "word").limit(LEXICON_WORDS).select("word", weight.alias("weight"), absent.alias("absent")).collect()
    )
    base = math.log(n_toxic / n_clean) + sum(r["absent"] for r in lexicon)
    return base, {r["word"]: r["weight"] - r["absent"] for r in lexicon}


def with_score(docs: DataFrame, model: np.ndarray, base: float, weights: dict[str, float], text: str = "text") -> DataFrame:
    """Add score, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast((model, weights))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, weights = shared.value
        channel, lexicon = Channel(model), set(weights)
        for batch in batches:
            odds = [base + sum(weights[w] for w in sorted(lexicon & channel.words(t))) for t in batch]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(odds, float), -500, 500))))

    return free(docs, "score").withColumn("score", score(F.col(text)))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """`docs` with a score learned from `labels` (key, label), which holds training rows only."""
    text_batches(docs.sparkSession)
    model = language_model(docs, text)
    return with_score(docs, model, *learn(docs, labels, model, key, text, label), text=text)
