"""The pipeline on a small table, stage by stage, against plain-Python twins."""
import corpus_pipeline
import public_tokenizers
from cases import components, rows, words
from pyspark.sql import functions as F
from test_llm_counts import plain_measures, water_fill
from tokenizers import Tokenizer

from corpuslab.llm import quality

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    data = [r[:5] for r in rows()]
    item = "Seven quiet engines crossed the copper bridge while orange letters fell slowly over the winter market today."
    data += [(500, "Before it. " + item + " After it came more.", "en", "s1", 9), (501, "@@@ ### $$$ *** | | | | " * 5, "en", "s1", 9)]
    spark.createDataFrame(data, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    at, outputs = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        path = str(tmp_path / f"out{len(outputs)}")
        out.write.parquet(path)
        at = spark.read.parquet(path)
        outputs.append(at.collect())
    good, single, clean, mixed, tokens = outputs
    failed = lambda t: (m := plain_measures(t))[0] < 10 or 100 * m[4] > 20 * m[0]
    assert not any(failed(r.text) for r in good)
    verdicts = {(r.doc_id, r.text): r.kept for r in quality.judge(docs).collect()}
    assert sorted(str(r.doc_id) for r in good) == sorted(str(r[0]) for r in data if verdicts[r[:2]])

    rows_ = list(enumerate(good))
    groups = components({k: r.text for k, r in rows_})
    assert len(single) == len(set(groups.values()))
    assert len({groups[next(k for k, g in rows_ if g == r)] for r in single}) == len(single)

    assert {r.doc_id for r in single} - {r.doc_id for r in clean} == {500}

    sizes, weights = {}, {}
    for r in clean:
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weights[s] = k % 3 + 1
    taken = {}
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    assert {s: round(t) for s, t in water_fill(sizes, weights).items() if round(t)} == taken

    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    n_tokens = {}
    for r in mixed:
        n_tokens[r.doc_id] = n_tokens.get(r.doc_id, 0) + len(library.encode(r.text, add_special_tokens=False).ids)
    written = {}
    for r in tokens:
        written[r.doc_id] = written.get(r.doc_id, 0) + r.n_tokens
    assert written == n_tokens and sorted(r.slot for r in tokens) == list(range(len(tokens)))


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.col("slot").isNotNull()).count() == 0
