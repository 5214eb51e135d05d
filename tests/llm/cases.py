"""Small documents with the cases every operator defines, and plain-Python twins."""
import random
import re
from collections import Counter, defaultdict

SPACES = " \t\n\v\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, host string, score string, node string, _row string, kept string, target string"


def sentence(rng: random.Random, n: int) -> str:
    words = "river stone quiet market letter winter engine garden window bridge copper silver orange".split()
    out = [rng.choice(words) + rng.choice(["", "s", "ed", str(rng.randint(0, 99))]) for _ in range(n)]
    return " ".join(out).capitalize() + "."


def rows(seed: int = 7) -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(12, 80)) for _ in range(30)]
    near = texts[0].split()
    out = [(k, t, rng.choice(["en", "de"]), f"s{k % 4}") for k, t in enumerate(texts)]
    out += [(100 + k, " ".join(near[:k] + ["changed"] + near[k + 1 :]), "en", "s0") for k in range(0, len(near), 9)]
    out += [
        (200, None, "en", "s1"), (201, "", "en", "s1"), (202, " \n\t ", None, None), (203, "one", "en", None), (204, "One two", None, "s2"),
        (205, "ONE TWO", "en", "s2"), (None, texts[1], "en", "s1"), (None, None, None, None), (3, texts[3], "en", "s3"), (3, texts[3], "en", "s3"),
        (206, sentence(rng, 9) * 3000, "en", "s0"), (207, "x" * 200_000, "fr", "s1"), (208, "tab\tand\x0bvertical\x1cinner space é ñ 中文 😀", "es", "Ünï"),
    ]
    return [(i, t, la, s, len(t or ""), "z", "h", "q", "n", "r", "k", "t") for i, t, la, s in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, size=5):
    w = (text or "").encode().lower().split()
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def components(texts: dict, near=(80, 100)) -> dict:
    """Least key that links reach, for keys with their texts."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    having = defaultdict(list)
    for k, s in sets.items():
        common = Counter(o for g in s for o in having[g])
        for o, n in common.items():
            if near[1] * n >= near[0] * (len(s) + len(sets[o]) - n):
                a, b = root(k), root(o)
                parent[max(a, b)] = min(a, b)
        for g in s:
            having[g].append(k)
    return {k: root(k) for k in sets}
