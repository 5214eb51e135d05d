import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslab import constants as K
from corpuslab.functions import text as tx
from corpuslab.functions import tokens as tk
from corpuslab.functions.scores import positive_probability, predicted_class
from corpuslab.operators.figure_windows import figure_windows


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_clean_id(spark):
    values = ["A-B", "a , b", "x!!?y", "Tree   3", "a_b", None, "É–é"]
    assert column(spark, values, tx.clean_id) == ["a b", "a  b", "x y", "tree  3", "a_b", None, "é é"]


def test_normalize_text(spark):
    values = ["Héllo* World  (2)", None, "a\\nb", "x$ $y", 'say "it\'s"']
    assert column(spark, values, tx.normalize_text) == [
        '"héllo world (2)"', '"nan"', '"anb"', '"x y"', '"say "it\'s""',
    ]


@pytest.mark.parametrize("text, hit", [
    ("we used MrBayes", True), ("mrbayes at the start", False), ("x\nmrbayes", False),
    ("a-mega-tree", True), ("r8s at the start", True), ("Path-O-Gen", True), ("omega", False),
    ("a strict clock", True),
])
def test_keywords(spark, text, hit):
    assert column(spark, [text], tx.mentions_any) == [hit]


def test_lengths(spark):
    values = ["x" * n for n in (100, 101, 200, 201)] + [None]
    assert column(spark, values, tx.downloaded_flag) == [0, 1, 1, 1, 0]
    assert column(spark, values, tx.long_enough) == [False, False, False, True, False]


@pytest.mark.parametrize("length", [399, 400, 401, 402, 403])
def test_centre_trim(spark, length):
    text = "".join(chr(97 + i % 26) for i in range(length))
    surplus = max(length - 400, 0)
    want = text[surplus // 2 : surplus // 2 + 400]
    assert column(spark, [text], lambda c: tx.centre_trim(c, 400)) == [want]


def test_ids_from_paths(spark):
    path = ["set/pdfs/12.pdf"]
    assert column(spark, path, tx.id_from_third_part) == ["12"]
    path = ["journals/Down-Loaded/A  b.c.pdf"]
    assert column(spark, path, lambda c: tx.id_from_subfolder(c, " pdf")) == ["down loaded a b c pdf"]
    path = ["tdm/2020.01.02v3.full.pdf"]
    assert column(spark, path, tx.versioned_id) == ["10.1101/2020.01.02"]
    assert column(spark, path, tx.version_from_path) == [3]
    assert column(spark, ["x/PMC7.txt"], tx.id_from_text_file) == ["PMC7"]
    names = ["12v3.full.pdf", "12v10.pdf", "12"]
    assert column(spark, names, tx.version_of_name) == [3, 10, None]
    assert column(spark, names, tx.name_before_version) == ["12", "12", "12"]


def test_tokens_and_ngrams(spark):
    text = ["The tree-of_life, a b2 é"]
    assert column(spark, text, tk.words) == [["The", "tree", "of_life", "a", "b2", "é"]]
    assert column(spark, text, tk.feature_words) == [["the", "tree", "of_life", "b2"]]
    grams = column(spark, ["ab cd ef", "ab", ""], lambda c: tk.ngrams(tk.feature_words(c), 3))
    assert grams == [["ab", "cd", "ef", "ab cd", "cd ef", "ab cd ef"], ["ab"], []]
    kept = column(spark, ["ab cd ef"], lambda c: tk.ngrams(tk.keep_only(tk.feature_words(c), ["ab", "ef"]), 2))
    assert kept == [["ab", "ef"]]
    words = " ".join(str(i) for i in range(600))
    assert [len(t) for t in column(spark, [words], lambda c: tk.truncate(tk.words(c)))] == [512]


def test_content_words(spark):
    stop = tk.stop_words()
    kept = column(spark, ["tree", "fig", "the", "12", "²", "x", "b2"], lambda c: tk.is_content_word(c, stop))
    assert kept == [True, False, False, False, False, False, True]


def test_logits(spark):
    rows = [(0, [1.0, 1.0]), (1, [0.0, 1.0]), (2, [-1000.0, 1000.0]), (3, [1000.0, -1000.0])]
    df = spark.createDataFrame(rows, "i int, l array<double>").orderBy("i")
    got = df.select(predicted_class(F.col("l")).alias("p"), positive_probability(F.col("l")).alias("q")).collect()
    assert [r["p"] for r in got] == [0, 1, 1, 0]
    assert [round(r["q"], 4) for r in got] == [0.5, 0.7311, 1.0, 0.0]


# --- figure windows --------------------------------------------------------------


def python_pattern(text):
    return text.replace("{S}", r"\s").replace("{W}", r"\w").replace("{D}", r"\d")


def expected_windows(text, lines, width):
    """The stated semantics with Python's own regular expressions."""
    mention = python_pattern(K.FIGURE_WORD + K.FIGURE_GAP + K.FIGURE_ID + K.FIGURE_END)
    window = rf"(?:\n.*){{0,{lines}}}{mention}(?:.*\n){{0,{lines}}}"
    rows = set()
    for found in re.finditer(window, text):
        piece = found.group(0)
        surplus = len(piece) - width
        shown = piece[surplus // 2 : surplus // 2 + width] if surplus > 0 else piece
        for hit in re.findall(mention, piece):
            bare = re.sub(python_pattern(K.FIGURE_ID_PREFIX), "", hit)
            bare = re.sub(python_pattern(K.FIGURE_ID_NOISE), "", bare)
            bare = bare[:-1] if bare[-1:] in (".", "-") else bare
            if bare:
                rows.add((shown, bare))
    return rows


def random_text(rng):
    pieces = [
        "Fig. 1 ", "FIGURE S2)", "Figs. 3-4,", "F i g u r e 2 ", "figure\\n5\\n", "fig 7.", "Fig A ",
        "config 3 ", "Fig.\\'8\\'", "tree ", "node, ", "\n", "\n\n", "\r\n", " ", "\x85", "\xa0", "é ",
        "x" * 90 + " ", "Figure 6b(", "fig. 10- ", "(Fig 2a)", "\\n", "3.2 ", "Fig ",
    ]
    return "".join(rng.choice(pieces) for _ in range(rng.randint(5, 120)))


@pytest.mark.parametrize("lines, width", [K.WIDE_WINDOW, K.NARROW_WINDOW])
def test_figure_windows_match_python(spark, lines, width):
    rng = random.Random(7)
    texts = [random_text(rng) for _ in range(150)] + [None, "", "no mention"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for row in figure_windows(df, lines=lines, width=width).collect():
        key = (row["text"], row["fig_id"])
        assert key not in got.setdefault(row["paper_id"], set())
        got[row["paper_id"]].add(key)
    assert got == {i: w for i, t in enumerate(texts) if t and (w := expected_windows(t, lines, width))}


def test_window_and_ids_by_hand(spark):
    text = "title\nbefore\nsee Fig. 1 and FIGURE S2) here\nafter\nlast Figs. 3-4, end"
    rows = figure_windows(spark.createDataFrame([(1, text)], "id int, text string"), lines=2, width=400).collect()
    first = "\nbefore\nsee Fig. 1 and FIGURE S2) here\nafter\n"
    assert {(r["text"], r["fig_id"]) for r in rows} == {(first, "1"), (first, "S2"), ("Figs. 3-4,", "3-4")}


def test_ngrams_query_cuts_words_once(spark, tmp_path):
    from corpuslab.plans.catalog import QUERIES

    rows = [(1, "One two, three four"), (2, None), (3, "a b"), (4, "same same same")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["ngrams"](spark, str(tmp_path))
    got = {r.doc_id: (r.n, r.grams) for r in df.collect()}
    assert got[1] == (9, "one|two|three|four|one two|two three|three four|one two three|two three four")
    assert got[3] == (0, "") and got[4][0] == 6
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
