import io
import json
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from corpuslab import schemas
from corpuslab.sources import documents as docs
from corpuslab.sources import split_csv, tables
from corpuslab.storage import exists
from corpuslab.streaming import pages as page_stream
from corpuslab.streaming.pages import append_batch, compact, ingest_page_stream, read_ingested

TEXT = 'line one\nsaid "two", three'


def test_csv_corpus(spark, tmp_path):
    df = spark.createDataFrame([("1", TEXT, 1), ("2", None, 0), ("3", 'a\\"b', 1)], schemas.CORPUS)
    tables.write_csv(df, str(tmp_path / "c"))
    tables.write_csv(df.limit(1), str(tmp_path / "c"))
    back = tables.read_csv(spark, str(tmp_path / "c" / "*.csv"), schemas.CORPUS, source="source")
    assert back.where("source like '%.csv'").count() == 4
    rows = {r["id"]: (r["text"], r["downloaded"]) for r in back.collect()}
    assert rows == {"1": (TEXT, 1), "2": (None, 0), "3": ('a\\"b', 1)}
    tables.write_csv(df.limit(1), str(tmp_path / "c"), mode="overwrite")
    assert tables.read_csv(spark, str(tmp_path / "c"), schemas.CORPUS).count() == 1


def wild_csv(rows):
    """CSV text of (id, text, downloaded): quotes, line breaks of both kinds, commas, empty lines between records."""
    quote = lambda t: '"' + t.replace('"', '""') + '"'
    return "".join(f"{i},{'' if t is None else quote(t)},{d}\n" + "\n" * (int(d) % 3 == 1) for i, t, d in rows)


@pytest.mark.parametrize("split_bytes,header", [(1 << 30, False), (3000, True)])
def test_csv_of_one_file_is_read_by_many_tasks(spark, tmp_path, split_bytes, header):
    rng = random.Random(3)
    pieces = ["word ", '"', "\n", "\r\n", ",", '""', "é", "\n\n", '",\n"', " "]
    rows = [(str(i), "".join(rng.choices(pieces, k=rng.randint(0, 60))) + "x", i % 5) for i in range(150)]
    rows += [("long", "many lines\n" * 500, 1), ("none", None, 2), ("plain", "plain", 0)]
    for name in ("a", "b"):
        text = ("id,text,downloaded\n" if header else "") + wild_csv(rows)
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    single = spark.read.schema(schemas.CORPUS).options(quote='"', escape='"').csv(str(tmp_path), header=header, multiLine=True)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", min(split_bytes, 4 << 20))
        records = split_csv.read_records(spark, str(tmp_path))
        assert records.count() >= 2 * len(rows)
        got = tables.read_csv(spark, str(tmp_path / "*.csv"), schemas.CORPUS, header=header, source="source").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["id"], r["text"] or "", r["downloaded"]) for r in got) == sorted((i, t or "", d) for i, t, d in [*rows, *rows])
    assert sorted(map(str, ((r["id"], r["text"], r["downloaded"]) for r in got))) == sorted(map(str, map(tuple, single.collect())))
    assert {r["source"] for r in got} == {"a.csv", "b.csv"}


def test_csv_splits_inside_a_record(spark, tmp_path):
    """A record over many splits, an unclosed last record, and an empty file."""
    body = 'a,"' + "line\n" * 3000 + '",1\nb,"open\nend'
    (tmp_path / "a.csv").write_text(body)
    (tmp_path / "b.csv").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
        values = [r["value"] for r in split_csv.read_records(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(values) == ['a,"' + "line\n" * 3000 + '",1', 'b,"open\nend']


def test_csv_headers_strings_and_splits(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("i_citation_id,ref_id,c_title,c_first_author_lname,i_year\n007,,t,,2020\n")
    row = tables.read_csv_strings(spark, str(path), schemas.POSITIVES).first()
    assert tuple(row) == ("007", "", "t", "", "2020")
    for name in ("train", "test"):
        (tmp_path / f"{name}.csv").write_text("count,name\n1,a\n")
    both = tables.read_splits(spark, {n: str(tmp_path / f"{n}.csv") for n in ("train", "test")}, schemas.SPECIES)
    assert sorted(tuple(r) for r in both.collect()) == [(1, "a", "test"), (1, "a", "train")]


def test_csv_quotes_only_strings(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b'), (2, None)], schemas.SPECIES)
    tables.write_csv_quoted_strings(df, str(tmp_path / "q"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "q")).collect())
    assert lines == ['1,"a""b"', '2,""']


def test_metrics_log_and_parquet(spark, tmp_path):
    df = spark.createDataFrame([("r", "m", "row", "f1", 0.5)], schemas.METRICS)
    for _ in range(2):
        tables.append_metrics(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    corpus = spark.createDataFrame([("1", "x", "s1"), ("2", "y", "s2")], "id string, text string, source string")
    tables.csv_to_parquet(corpus, str(tmp_path / "p"))
    plan = spark.read.parquet(str(tmp_path / "p")).where("source = 's1'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(source" in plan


def test_latin1_files(spark, tmp_path):
    (tmp_path / "PMC1.txt").write_bytes("caf\xe9\r\nwith mega software".encode("latin1"))
    (tmp_path / "PMC2.txt").write_bytes(b"nothing here")
    (tmp_path / "PMC3.md").write_bytes(b"a mega file of another kind")
    rows = docs.latin1_texts(docs.read_files(spark, str(tmp_path), "*.txt")).collect()
    assert [tuple(r) for r in rows] == [("PMC1", "caf\xe9\nwith mega software", 1)]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("sub/one.txt", b"1")
        z.writestr("two.txt", b"2")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("deep/er/three.txt")
        info.size = 1
        t.addfile(info, io.BytesIO(b"3"))
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    rows = docs.expand_archives(docs.read_files(spark, str(tmp_path), "{*.zip,*.tar.gz}")).collect()
    found = {(r["archive"].split("/")[-1], r["member"], bytes(r["content"])) for r in rows if r["error"] is None}
    assert found == {("a.zip", "sub/one.txt", b"1"), ("a.zip", "two.txt", b"2"), ("b.tar.gz", "three.txt", b"3")}
    assert [r["archive"].split("/")[-1] for r in rows if r["error"]] == ["broken.zip"]


def test_extractor_failure_keeps_the_row(spark):
    files = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"\xff"))], "path string, content binary")
    rows = {r["path"]: (r["text"], r["error"] is None) for r in docs.extract_texts(files, lambda b: b.decode("utf8")).collect()}
    assert rows == {"a": ("ok", True), "b": (None, False)}


def publication(doi, version="1", date="2021-01-01"):
    return {
        "doi": doi, "version": version, "title": "T", "authors": "A", "date": date, "category": "c",
        "published": "NA",
    }


@pytest.fixture
def page_files(tmp_path):
    def write(name, *publications):
        folder = tmp_path / "pages"
        folder.mkdir(exist_ok=True)
        (folder / name).write_text(json.dumps({"messages": [], "collection": list(publications)}))
        return str(folder)

    return write


def test_pages(spark, page_files):
    page_files("1.json", publication("a", "1"), publication("a", "2"), publication("b"))
    page_files("2.json", publication("b", "9"), publication("c"))
    folder = page_files("3.json")
    got = docs.ingest_pages(docs.read_pages(spark, folder))
    assert sorted((r["ID"], r["Version"], r["Title"]) for r in got.collect()) == [
        ("a", 1, '"T"'), ("b", 1, '"T"'), ("c", 1, '"T"'),
    ]
    assert got.columns == schemas.PREPRINT_METADATA.fieldNames()


@pytest.mark.parametrize("memory", [None, "7 days"])
def test_stream_equals_batch(spark, page_files, tmp_path, memory):
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    folder = page_files("1.json", publication("a"), publication("a"), publication("b"))
    ingest_page_stream(spark, folder, table, state, memory)
    page_files("2.json", publication("b"), publication("c", date="2021-01-02"))
    ingest_page_stream(spark, folder, table, state, memory)
    ingest_page_stream(spark, folder, table, state, memory)
    batch = docs.ingest_pages(docs.read_pages(spark, folder))
    stream = (spark.read.parquet(table) if memory else read_ingested(spark, table)).select(*batch.columns)
    assert sorted(stream.collect()) == sorted(batch.collect())


def test_late_pages_are_not_lost(spark, page_files, tmp_path):
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    folder = page_files("1.json", publication("new", date="2024-01-01"))
    ingest_page_stream(spark, folder, table, state)
    page_files("2.json", publication("old", date="2020-01-01"))
    ingest_page_stream(spark, folder, table, state)
    page_files("3.json", publication("undated", date="no date"), publication("empty", date=None))
    ingest_page_stream(spark, folder, table, state)
    assert sorted(r["ID"] for r in read_ingested(spark, table).collect()) == ["empty", "new", "old", "undated"]


def listed(spark, *dois):
    schema = "page string, pos int, " + ", ".join(f"{n} string" for n in schemas.PUBLICATION.fieldNames())
    return spark.createDataFrame([(f"p{i}", i, *publication(d, str(i)).values()) for i, d in enumerate(dois)], schema)


def ingested(spark, table):
    return sorted((r["ID"], r["Version"]) for r in read_ingested(spark, table).collect())


def test_repeated_batch_changes_nothing(spark, tmp_path):
    table = str(tmp_path / "table")
    append_batch(listed(spark, "a", "b", "a"), table, "one", 0)
    append_batch(listed(spark, "b", "c"), table, "one", 1)
    want = [("a", 0), ("b", 1), ("c", 1)]
    assert ingested(spark, table) == want
    append_batch(listed(spark, "b", "c", "not seen before"), table, "one", 1)
    assert ingested(spark, table) == want


def test_failed_batch_is_invisible_and_repeated(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "table")
    append_batch(listed(spark, "a"), table, "one", 0)
    with monkeypatch.context() as m:
        def lost(*_):
            raise RuntimeError("driver lost")
        m.setattr(page_stream, "write_once", lost)
        with pytest.raises(RuntimeError):
            append_batch(listed(spark, "b", "c"), table, "one", 1)
    assert exists(spark, f"{table}/data/commit=one-1") and ingested(spark, table) == [("a", 0)]
    append_batch(listed(spark, "b", "c"), table, "one", 1)
    assert ingested(spark, table) == [("a", 0), ("b", 0), ("c", 1)]


def test_lost_checkpoint_duplicates_nothing(spark, page_files, tmp_path):
    table = str(tmp_path / "table")
    folder = page_files("1.json", publication("a", "1"), publication("b"))
    ingest_page_stream(spark, folder, table, str(tmp_path / "state"))
    page_files("2.json", publication("a", "2"), publication("c"))
    ingest_page_stream(spark, folder, table, str(tmp_path / "another state"))
    assert ingested(spark, table) == [("a", 1), ("b", 1), ("c", 1)]


def test_batch_reads_the_buckets_it_touches(spark, tmp_path):
    table = str(tmp_path / "table")
    append_batch(listed(spark, *[f"d{i}" for i in range(200)]), table, "one", 0)
    some = page_stream._in_buckets(spark, table, ["one-0"], [7, 9])
    scan = some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in scan and "commit" in scan
    folders = {r[0].split("bucket=")[1].split("/")[0] for r in some.select(F.input_file_name()).collect()}
    assert folders <= {"7", "9"}


def test_compaction(spark, tmp_path):
    table = str(tmp_path / "table")
    for i in range(5):
        append_batch(listed(spark, f"a{i}", f"b{i}", "again"), table, "one", i)
    want = ingested(spark, table)
    compact(spark, table)
    assert ingested(spark, table) == want and len(want) == 11
    assert [p.name.startswith("commit=compact-") for p in (tmp_path / "table" / "data").iterdir() if p.is_dir()] == [True]
    append_batch(listed(spark, "never"), table, "one", 3)
    append_batch(listed(spark, "a2", "new"), table, "one", 5)
    compact(spark, table)
    compact(spark, table)
    assert ingested(spark, table) == sorted([*want, ("new", 1)])


def test_stream_of_a_hot_doi(spark, page_files, tmp_path):
    for i in range(30):
        folder = page_files(f"{i}.json", *[publication("hot", str(i)) for _ in range(20)], publication(f"d{i}"))
    for name, memory in (("all", None), ("recent", "7 days")):
        table = str(tmp_path / name)
        ingest_page_stream(spark, folder, table, str(tmp_path / f"state-{name}"), memory, files_per_trigger=7)
        rows = spark.read.parquet(table) if memory else read_ingested(spark, table)
        ids = [r["ID"] for r in rows.collect()]
        assert sorted(ids) == sorted(["hot"] + [f"d{i}" for i in range(30)])
