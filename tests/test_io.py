import gzip
import json

import pytest
from pyspark.sql import functions as F

from narrascope.functions.sizing import broadcast_if_small, is_small, materialize, shared_folder
from narrascope.functions.vectors import quadrant
from narrascope.operators.stats import source_counts
from narrascope.sinks import tables as sinks
from narrascope.sources import reports as src


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "sets"
    d.mkdir()
    (d / "alta.tsv").write_text(
        'n\tdream\n1\tplain text\n2\t"two\nlines with ""quotes"""\n3\ttoo\tmany\n4\n5\t\n6\tNA\n',
        encoding="utf-8",
    )
    (d / "bea.tsv").write_text("n\tage\tdream\n1\t30\tfirst\n2\t31\tsecond\n", encoding="utf-8")
    (d / "cid.v2.tsv").write_text("dream\tn\nswapped\t7\n", encoding="utf-8")
    (d / "dot with+space.tsv").write_text("n\tdream\n1\tétée\n", encoding="utf-8")
    (d / "odd.tsv").write_bytes(b"n\tdr\xffam\n1\tunreadable header\n")
    (d / "zero.tsv").write_bytes(b"")  # Spark does not list files without bytes
    for name, n in (("alta", 6), ("bea", 2)):
        info = {
            "short_name": name,
            "long_name": f"Set {name}",
            "n_dreams": n,
            "timeframe": "1990s",
            "sex": "F",
            "description": "two\nlines",
        }
        (d / f"{name}.json").write_text(json.dumps(info, indent=2), encoding="utf-8")
    return str(d)


def test_dataset_ids(spark, folder):
    got = [r["dataset_id"] for r in src.list_datasets(spark, folder).collect()]
    assert got == ["alta", "bea", "cid", "dot with+space", "odd"]


def test_one_dataset(spark, folder):
    df = src.read_reports(spark, folder, "alta", skip_bad=True)
    assert df.columns == ["n", "dream"] and {f.dataType.simpleString() for f in df.schema} == {"string"}
    got = {r["n"]: r["dream"] for r in df.collect()}
    assert got == {
        "1": "plain text",
        "2": 'two\nlines with "quotes"',
        "4": None,  # short line, padded
        "5": None,  # empty text
        "6": None,  # missing-value text
    }
    assert src.read_reports(spark, folder, "bea").columns == ["n", "age", "dream"]
    with pytest.raises(ValueError):
        src.read_reports(spark, folder, "odd")
    with pytest.raises(ValueError):
        src.read_reports(spark, folder, "absent")


def test_column_pruning_does_not_change_rows(spark, folder):
    df = src.read_reports(spark, folder, "alta", skip_bad=True)
    assert df.count() == 5 and df.select("n").count() == 5
    assert {r["n"] for r in df.select("n").collect()} == {"1", "2", "4", "5", "6"}


def test_info(spark, folder):
    rows = {r["dataset_id"]: r for r in src.read_info(spark, folder).collect()}
    assert set(rows) == {"alta", "bea"}
    assert rows["alta"]["n_dreams"] == 6 and rows["alta"]["description"] == "two\nlines"


def test_scan_folder(spark, folder):
    corpus, failed = src.scan_reports(spark, folder, skip_failed=True)
    assert set(corpus.columns) == {"n", "age", "dream", "source_filename", "dataset_id"}
    rows = {(r["source_filename"], r["n"]): r for r in corpus.collect()}
    assert len(rows) == 9
    assert rows[("cid.v2.tsv", "7")]["dream"] == "swapped"
    assert rows[("bea.tsv", "2")]["age"] == "31" and rows[("alta.tsv", "1")]["age"] is None
    assert rows[("dot with+space.tsv", "1")]["dream"] == "étée"
    assert [r["file_name"] for r in failed.collect()] == ["odd.tsv"]
    files = src.list_files(spark, folder, "*.tsv")
    report = {r["file_name"]: r for r in src.load_report(corpus, files, failed).collect()}
    assert {k: r["n_rows"] for k, r in report.items()} == {
        "alta.tsv": 5,
        "bea.tsv": 2,
        "cid.v2.tsv": 1,
        "dot with+space.tsv": 1,
        "odd.tsv": 0,
    }
    assert report["odd.tsv"]["error"] and report["alta.tsv"]["error"] is None
    total = source_counts(corpus, "source_filename").where("is_total").first()
    assert total["n"] == 9


def test_repeated_and_empty_header_names():
    assert src.column_names(["n", "", "n", "n"]) == ["n", "Unnamed: 1", "n.1", "n.2"]


def test_corpus_round_trip(spark, folder, tmp_path):
    corpus, _ = src.scan_reports(spark, folder, skip_failed=True)
    want = {tuple(r) for r in corpus.collect()}
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / f"corpus-{fmt}")
        sinks.write_corpus(corpus, path, fmt)
        back = src.read_corpus(spark, path, fmt)
        assert back.columns == corpus.columns
        assert {tuple(r) for r in back.collect()} == want
    with pytest.raises(ValueError):
        src.read_corpus(spark, "x", "xml")


def test_single_line_mode_splits_rows(spark, tmp_path):
    d = tmp_path / "flat"
    d.mkdir()
    (d / "a.tsv").write_text("n\tdream\n1\tx\n2\ty\tz\n3\n", encoding="utf-8")
    rows = src.read_reports(spark, str(d), "a", multi_line=False, skip_bad=True).collect()
    assert {(r["n"], r["dream"]) for r in rows} == {("1", "x"), ("3", None)}


def test_quadrant_table(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y")
    )
    df = df.withColumn("quadrant", quadrant("x", "y"))
    path = str(tmp_path / "quadrants")
    sinks.write_by_quadrant(df, path)
    assert {p.name for p in (tmp_path / "quadrants").glob("quadrant_slug=*")} == {
        f"quadrant_slug={a}_plus_{b}"
        for a in ("dramatic", "everyday")
        for b in ("experiential", "cognitive")
    }
    slug = "dramatic_plus_cognitive"
    part = src.read_quadrant(spark, path, slug)
    assert part.count() == df.where("quadrant = 'Dramatic + Cognitive'").count() > 0
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(quadrant_slug" in plan
    assert src.read_quadrant(spark, path).count() == 500


def test_facts_and_summary(spark, tmp_path):
    facts = spark.createDataFrame([(1, "x")], "id long, dream string")
    summary = spark.createDataFrame(
        [(3, "a, b", 7, 2, 70, 1.0)],
        "topic_id int, keywords string, dreams_count long, dreamers_count long, total_words long, p double",
    )
    path = str(tmp_path / "topics")
    sinks.write_facts_and_summary(facts, summary, path, sinks.TOPIC_SUMMARY_COLUMNS)
    back = spark.read.option("header", True).csv(f"{path}/summary")
    assert back.columns == ["id", "Keywords", "how many dreams", "how many dreamers", "how many words"]
    assert tuple(back.first()) == ("3", "a, b", "7", "2", "70")
    assert spark.read.parquet(f"{path}/facts").count() == 1


def test_size_checks(spark):
    small = spark.range(10).withColumn("t", F.lit("x"))
    assert is_small(small) and not is_small(small, max_rows=9) and not is_small(small, max_bytes=20)
    hinted = broadcast_if_small(small)
    assert "broadcast" in hinted._jdf.queryExecution().logical().toString().lower()
    bare = broadcast_if_small(small, max_rows=5)
    assert "broadcast" not in bare._jdf.queryExecution().logical().toString().lower()


def test_materialize_uses_the_shared_folder(spark):
    folder = shared_folder(spark)
    assert folder == shared_folder(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or folder == named.rstrip("/")
    df = materialize(spark.range(5), "numbers")
    assert df.count() == 5 and df.inputFiles()[0].split(":")[-1].lstrip("/").startswith(folder.lstrip("/"))


def test_nothing_is_lost_without_a_word(spark, tmp_path):
    d = tmp_path / "damaged"
    d.mkdir()
    (d / "long.tsv").write_text("n\tdream\n1\tx\n2\ty\tz\n", encoding="utf-8")
    with pytest.raises(Exception, match="more fields than columns"):
        src.read_reports(spark, str(d), "long").collect()
    text = "".join(f"{i}\tdream {i * 7919}\n" for i in range(50_000))
    whole = gzip.compress(("n\tdream\n" + text).encode())
    (d / "good.tsv.gz").write_bytes(whole)
    (d / "cut.tsv.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(ValueError, match="cut.tsv.gz"):
        src.scan_reports(spark, str(d), "*.tsv.gz")
    corpus, failed = src.scan_reports(spark, str(d), "*.tsv.gz", skip_failed=True)
    assert corpus.count() == 50_000 and [r["file_name"] for r in failed.collect()] == ["cut.tsv.gz"]


def _odd_records(n):
    """Records with quoted line breaks, quotes, separators, white space, empty fields and very long texts."""
    texts = ["plain", 'a "quoted"\nword', "\n\n", "x,y\tz", "", "ends with\n", '"', '""\n"', "é\r\nü", "long\n" * 300]
    return [(str(i), texts[i % len(texts)] + str(i % 7) * (i % 3), str(i % 5)) for i in range(n)]


@pytest.mark.parametrize("split", ["400", "128m"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_of_a_quoted_file(spark, tmp_path, split, end):
    """Whatever the size of splits, every record comes back once and as the one-task reader gives it."""
    import csv

    with open(tmp_path / "corpus.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows([("n", "dream", "_path"), *_odd_records(60)])
    conf = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        ranged = src.read_corpus(spark, str(tmp_path), "csv", columns=["n", "dream", "age"], by_ranges=True)
        whole = src.read_corpus(spark, str(tmp_path), "csv", columns=["n", "dream", "age"])
        if split == "400":
            assert src.read_records(spark, str(tmp_path)).rdd.getNumPartitions() > 20
        got = sorted(tuple(r) for r in ranged.collect())
        assert got == sorted((n, t or None, a) for n, t, a in _odd_records(60))
        if end == "\n":
            assert got == sorted(tuple(r) for r in whole.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ranges_refuse_open_quotes(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('n,dream\n1,"never closed\n2,x\n')
    with pytest.raises(ValueError, match="not closed"):
        src.read_corpus(spark, str(tmp_path), "csv", columns=["n", "dream"], by_ranges=True)


def test_ranges_of_a_folder(spark, folder):
    args = dict(columns=["n", "dream"], with_source=True, skip_bad=True)
    paths = [f"{folder}/alta.tsv", f"{folder}/dot with+space.tsv"]
    a, b = (src.read_delimited(spark, paths, by_ranges=r, **args).collect() for r in (False, True))
    assert len(a) == 6 and sorted(map(repr, a)) == sorted(map(repr, b))


def test_ranges_of_an_empty_table(spark, tmp_path):
    (tmp_path / "none.csv").write_text("n,dream\n")
    assert src.read_corpus(spark, str(tmp_path), "csv", columns=["n", "dream"], by_ranges=True).count() == 0


def test_quadrant_folders_have_few_files_and_can_be_written_again(spark, tmp_path):
    rows = spark.range(0, 9_000, 1, 30).selectExpr("id", "if(id % 3 = 0, 'Dramatic + Social', if(id % 3 = 1, 'Mild', null)) AS quadrant")
    path = str(tmp_path / "q")
    sinks.write_by_quadrant(rows, path)
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "q").iterdir() if d.is_dir()}
    assert set(files) == {"quadrant_slug=dramatic_plus_social", "quadrant_slug=mild"} and max(files.values()) <= 2
    sinks.write_by_quadrant(rows.where("quadrant = 'Mild' AND id < 300"), path, mode="overwrite")
    counts = {r["quadrant_slug"]: r["count"] for r in src.read_quadrant(spark, path).groupBy("quadrant_slug").count().collect()}
    assert counts == {"dramatic_plus_social": 3_000, "mild": 100}
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_by_quadrant(rows, path)
