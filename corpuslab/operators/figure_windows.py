"""Text windows around figure mentions."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab import constants as K
from corpuslab.functions.text import centre_trim


def _pattern(text: str) -> str:
    return (
        text.replace("{S}", f"[{K.SPACE_CHARS}]")
        .replace("{W}", f"[{K.WORD_CHARS}]")
        .replace("{D}", r"\p{Nd}")
    )


MENTION = _pattern(K.FIGURE_WORD + K.FIGURE_GAP + K.FIGURE_ID + K.FIGURE_END)


def window_pattern(lines: int) -> str:
    """Up to ``lines`` lines, a mention, up to ``lines`` lines; '.' stops at \\n only."""
    return rf"(?d)((?:\n.*){{0,{lines}}}{MENTION}(?:.*\n){{0,{lines}}})"


def figure_id(mention: Column) -> Column:
    """Bare figure id of a mention; may come out empty."""
    bare = F.regexp_replace(mention, _pattern(K.FIGURE_ID_PREFIX), "")
    bare = F.regexp_replace(bare, _pattern(K.FIGURE_ID_NOISE), "")
    return F.regexp_replace(bare, r"[.-]\z", "")


def figure_windows(
    corpus: DataFrame,
    id_col: str = "id",
    text_col: str = "text",
    lines: int = K.WIDE_WINDOW[0],
    width: int = K.WIDE_WINDOW[1],
) -> DataFrame:
    """(paper_id, text, fig_id), one row per distinct window and id of a document.

    Narrow: windows, mentions and the per-document duplicate removal all work on
    arrays inside the row, so no text is ever shuffled.
    """
    found = F.regexp_extract_all(F.col(text_col), F.lit(window_pattern(lines)), F.lit(1))

    def mentions(window: Column) -> Column:
        ids = F.transform(
            F.regexp_extract_all(window, F.lit(f"(?d)({MENTION})"), F.lit(1)), figure_id
        )
        return F.transform(
            F.filter(F.array_distinct(ids), lambda i: i != ""),
            lambda i: F.struct(centre_trim(window, width).alias("text"), i.alias("fig_id")),
        )

    return (
        corpus.where(F.col(text_col).rlike(_pattern(K.FIGURE_WORD)))
        .select(F.col(id_col).alias("paper_id"), found.alias("windows"))
        .select(
            "paper_id",
            F.explode(F.array_distinct(F.flatten(F.transform("windows", mentions)))).alias("w"),
        )
        .select("paper_id", "w.text", "w.fig_id")
    )
