import pytest

from narrascope.catalog import params as P
from narrascope.operators import symbols
from narrascope.operators.phrases import PhraseFilter
from narrascope.plans.reports import symbol_report

REPORTS = [
    (1, "We went into the dark forest, and a snake came", "ann"),
    (2, "snake SNAKE snake", "bob"),
    (3, "nothing here", "ann"),
    (4, None, "bob"),
    (5, "A dark\nforest path of fire", "bob"),
    (6, "fire snake", "ann"),
]
DICTIONARY = [
    (1, "Snake", "enemy"),
    (2, "snake ", "second entry, ignored"),
    (3, "Dark\nForest", "unknown"),
    (4, "dark forest path", "choice"),
    (5, "fire", None),
    (6, "one two three four", "too long"),
    (7, "o'clock", "split by tokens"),
]


@pytest.fixture()
def tables(spark):
    reports = spark.createDataFrame(REPORTS, "id long, dream string, author string")
    dictionary = spark.createDataFrame(DICTIONARY, "ord long, symbol string, meaning string")
    return reports, dictionary


def test_first_entry_wins(tables):
    rows = {r["clean"]: r for r in symbols.dedupe_symbols(tables[1]).collect()}
    assert rows["snake"]["meaning"] == "enemy" and rows["snake"]["n_entries"] == 2
    assert symbols.duplicate_symbols(tables[1]).first()["n_removed"] == 1


def test_unmatchable(tables):
    got = {r["clean"] for r in symbols.unmatchable_symbols(tables[1]).collect()}
    assert got == {"one two three four", "o'clock"}


@pytest.mark.parametrize("literal", [symbols.MAX_LITERAL_SYMBOLS, 0])
def test_both_routes(tables, literal):
    reports, dictionary = tables
    index = symbols.SymbolIndex.build(dictionary, max_literal=literal)
    assert (index.ranked is None) == (literal == 0)
    match = {
        r["id"]: (r["matched_symbol"], r["interpretation"], r["word_count"])
        for r in symbols.symbol_match(reports, index, "id", "dream").collect()
    }
    assert match == {
        1: ("Dark\nForest", "unknown", 10),
        2: ("Snake", "enemy", 3),
        3: ("Uncategorized", None, 2),
        5: ("dark forest path", "choice", 6),
        6: ("Snake", "enemy", 2),
    }
    counts = {
        (r["id"], r["clean"]): r["cnt"]
        for r in symbols.symbol_counts(reports, index, "id", "dream").collect()
    }
    assert counts[(2, "snake")] == 3 and counts[(5, "dark forest path")] == 1 and len(counts) == 8
    hits = {
        (r["id"], r["clean"]) for r in symbols.symbol_hits(reports, index, "id", "dream").collect()
    }
    assert hits == set(counts)


def test_summary(tables):
    report = symbol_report(*tables, key="id")
    rows = {r["matched_symbol"]: r for r in report.summary.collect()}
    assert list(rows)[0] == "Snake"  # most frequent first
    assert rows["Snake"]["dreams_count"] == 2 and rows["Snake"]["total_words"] == 5
    assert rows["Snake"]["dreamers_count"] == 2 and rows["Snake"]["percent"] == pytest.approx(40.0)
    assert rows["Uncategorized"]["interpretation"] == "No match found"
    assert sum(r["percent"] for r in rows.values()) == pytest.approx(100.0)


def test_summary_without_author(tables):
    reports, dictionary = tables
    two = reports.select("id", "dream")
    rows = symbol_report(two, dictionary, key="id").summary.collect()
    assert {r["dreamers_count"] for r in rows} == {0}


def test_match_does_not_shuffle_reports(spark, sf_dir):
    """With a small dictionary the match is row-local."""
    from narrascope.catalog.queries import dictionary

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = symbols.SymbolIndex.build(dictionary(spark))
    plan = symbols.symbol_match(docs, index, "doc_id", "text")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text


def test_empty_dictionary(tables):
    reports, dictionary = tables
    empty = dictionary.limit(0)
    match = symbols.symbol_match(reports, empty, "id", "dream").collect()
    assert {r["matched_symbol"] for r in match} == {"Uncategorized"} and len(match) == 5
    assert symbols.symbol_counts(reports, empty, "id", "dream").count() == 0


def test_parameters_cover_all_cases():
    assert len({s.strip().lower() for _, s in P.DICTIONARY}) < len(P.DICTIONARY)


@pytest.mark.parametrize("max_literal", [0, 5_000])
def test_rows_that_share_a_key_or_have_none(spark, max_literal):
    words = spark.createDataFrame([(1, "river", "m1"), (2, "dark forest", "m2")], "ord long, symbol string, meaning string")
    index = symbols.SymbolIndex.build(words, max_literal=max_literal)
    rows = [(1, "a river"), (1, "the dark forest river"), (None, "a river"), (2, "nothing")]
    df = spark.createDataFrame(rows, "k long, t string")
    got = [(r["k"], r["t"], r["matched_symbol"], r["interpretation"]) for r in symbols.symbol_match(df, index, "k", "t").collect()]
    assert sorted(got, key=repr) == sorted(
        [
            (1, "a river", "river", "m1"), (1, "the dark forest river", "dark forest", "m2"),
            (None, "a river", "river", "m1"), (2, "nothing", symbols.UNCATEGORIZED, None),
        ],
        key=repr,
    )
    counts = sorted((tuple(r) for r in symbols.symbol_counts(df, index, "k", "t").collect()), key=repr)
    assert counts == sorted([(1, "river", 1), (1, "dark forest", 1), (1, "river", 1), (None, "river", 1)], key=repr)


def test_phrase_filter_misses_nothing(spark):
    """Every phrase of the dictionary passes, wherever it stands; nearly nothing else does."""
    own = spark.range(20_000).selectExpr("concat_ws(' ', 'a' || id, if(id % 3 > 0, 'b' || id, null), if(id % 3 > 1, 'c', null)) AS p")
    other = spark.range(20_000).selectExpr("'x' || id || ' y' || id AS p")
    told = PhraseFilter.build(own, "p")
    texts = own.union(other).selectExpr("p", "'Zz, ' || p || '!' AS text")
    rows = told.likely(texts, "text", "found").selectExpr("p", "array_contains(found, p) AS has", "size(found) AS n")
    assert rows.where("p LIKE 'a%' AND NOT has").count() == 0
    assert rows.where("p LIKE 'x%'").selectExpr("sum(n)").first()[0] < 2_000
    assert told.n_bits == 1 << 18


@pytest.mark.parametrize("texts", [[], [None], ["", "!?"], ["one two three four " * 3_000, "two", "three two one"]])
def test_phrase_filter_on_odd_texts(spark, texts):
    own = spark.createDataFrame([("two",), ("one two three",), ("four one two five",)], "p string")
    told = PhraseFilter.build(own, "p")
    rows = told.likely(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "found")
    for r in rows.collect():
        words = (r["text"] or "").split()
        wanted = [" ".join(words[i : i + n]) for i in range(len(words)) for n in (1, 3) if i + n <= len(words)]
        wanted = [w for w in wanted if w in ("two", "one two three")]
        assert [f for f in r["found"] or [] if f in ("two", "one two three")] == wanted


def test_phrase_filter_of_nothing(spark, tables):
    index = symbols.SymbolIndex.build(tables[1].limit(0), max_literal=-1)
    assert index.ranked is None
    assert symbols.symbol_hits(tables[0], index, "id", "dream").count() == 0
    matched = symbols.symbol_match(tables[0], index, "id", "dream").collect()
    assert {r["matched_symbol"] for r in matched} == {"Uncategorized"} and len(matched) == 5


@pytest.mark.parametrize("bits", [0.001, 12])
def test_filter_of_any_size_gives_the_same_rows(spark, sf_dir, bits):
    """A filter that lets nearly everything through costs time, not rows; repeated reports stay apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 20"))
    entries = spark.createDataFrame(P.DICTIONARY, "ord long, symbol string").selectExpr("*", "'m' || ord AS meaning")
    small = symbols.SymbolIndex.build(entries)
    large = symbols.SymbolIndex.build(entries, max_literal=0, bits_per_phrase=bits)
    for operator in (symbols.symbol_hits, symbols.symbol_counts, symbols.symbol_match):
        a, b = (operator(docs, index, "doc_id", "text") for index in (small, large))
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


def test_unlikely_reports_are_not_stored(spark, tables):
    """Only reports with a phrase that passes are numbered, stored and joined."""
    index = symbols.SymbolIndex.build(tables[1], max_literal=0)
    many = tables[0].unionByName(spark.range(100, 5_000).selectExpr("id", "'quiet night ' || id AS dream", "'ann' AS author"))
    matched = symbols.symbol_match(many, index, "id", "dream")
    stored = [f for f in matched.inputFiles() if "symbol-reports" in f]
    assert 0 < spark.read.parquet(*stored).count() < 200
    assert matched.count() == 4_905
