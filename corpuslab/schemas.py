"""Explicit schemas of the exchanged tables."""
from pyspark.sql import types as T


def _struct(**fields):
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in fields.items()])


PAPER_METADATA = _struct(
    ID="s", AU="s", TI="s", JO="s", PY="i", Usable="i", Good_figure="i", Good_figure_2="i",
    Good_figure_3="i", Good_figure_4="i", Good_figure_5="i", Binary="i",
)
PREPRINT_METADATA = _struct(
    ID="s", Version="i", Title="s", Authors="s", Date="s", Category="s", Published="s"
)
CORPUS = _struct(id="s", text="s", downloaded="i")
FIGURES = _struct(paper_id="s", text="s", fig_id="s")
PAPER_LABELS = _struct(ID="s", PY="i", Dataset="s", Binary="i")
FIGURE_LABELS = _struct(ID="s", PY="i", Binary="i", Time_F="s")
PAPER_EXAMPLES = _struct(id="s", year="s", text="s", label="i")
FIGURE_EXAMPLES = _struct(id="s", year="s", text="s", label="i", fig_id="s")
POSITIVES = _struct(
    i_citation_id="s", ref_id="s", c_title="s", c_first_author_lname="s", i_year="s"
)
SPECIES = _struct(count="i", name="s")
METRICS = _struct(run="s", model="s", scope="s", metric="s", value="d")

PUBLICATION = _struct(
    doi="s", version="s", title="s", authors="s", date="s", category="s", published="s"
)
API_PAGE = T.StructType([T.StructField("collection", T.ArrayType(PUBLICATION))])
