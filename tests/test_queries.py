"""Every registered query against its SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from mediatimeline.plans.catalog import ORACLES as SQL
from mediatimeline.plans.catalog import QUERIES
from check import TABLES, compare
from tests.conftest import SMALL

# Queries whose plan changes when a media is too large for one task.
ORDERED = (
    "numeric_change adaptive_change gated_label_change label_change_after_filter run_spans strong_peaks circuit_breaker "
    "sessions events_in_spans filter_artifacts knowledge_document zero_crossing_rate appear_disappear merge_round"
).split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def run(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        out = compare(df, con, SQL[name])
        assert out.startswith("ok") and "TYPES" not in out, out
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    run(spark, con, name)


@pytest.mark.parametrize("name", ORDERED)
def test_query_with_hot_media(tight, con, name):
    run(tight, con, name)


def test_merge_metadata_of_a_large_media(spark, tmp_path):
    """One row per media, as in its SQL, also for a media of more timelines than a part holds."""
    con = duckdb.connect()
    con.execute("""CREATE TABLE documents AS SELECT i AS doc_id, CASE WHEN i % 7 = 0 OR i BETWEEN 10000 AND 20500 THEN '' ELSE 'text ' || i END AS text,
        CASE i % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS lang, CASE WHEN i % 50 = 0 THEN 's1' ELSE 's0' END AS source FROM range(25000) t(i)""")
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    out = compare(QUERIES["merge_metadata"](spark, str(tmp_path)), con, SQL["merge_metadata"])
    assert out == "ok 2 rows", out


def documents_of(con, folder, rows):
    """A table of documents of the given rows alone, for Spark and for SQL."""
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY documents TO '{folder}/documents.parquet' (FORMAT parquet)")


def test_prompt_of_odd_documents(spark, tmp_path):
    """An empty text is a context; a missing text or time gives no prompt; only every third document is plain."""
    con = duckdb.connect()
    documents_of(con, tmp_path, [(1, None, "en", "s", 5), (2, "", "en", "s", 0), (3, "", "en", "s", 0), (4, "a", "en", "s", None),
                                 (5, " ", "en", "s", -7), (None, "b", "en", "s", 1), (-2, "c", None, None, 12345), (-3, "d", "en", "s", 1)])
    out = compare(QUERIES["prompt"](spark, str(tmp_path)), con, SQL["prompt"])
    assert out == "ok 8 rows", out


def test_text_helpers_of_odd_documents(spark, tmp_path):
    """White space of all kinds, texts without words, and names that are missing, foreign or look like paths."""
    con = duckdb.connect()
    blanks = [chr(i) for i in (*range(9, 14), *range(28, 33), 0x85, 0xa0, 0x1680, 0x180e, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000, 0xfeff)]
    texts = [None, "", " ", "\n\t ", *blanks, *[f"{w}a{w}{w}b{w}" for w in blanks], *[f" {w} x {w} " for w in blanks]]
    names = [None, "", "A b", "a/b", "a.b", "x\ny", "\u0130x", "\u0391\u03a3", "\u03a3 \u03a3", "\u1e9e", "\u0398\u03c3", "a:b", "a\\b"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(1000 + i, "t x", n, n, 1) for i, n in enumerate(names)]
    documents_of(con, tmp_path, [*rows, (None, "a", "en", "s", 1)])
    out = compare(QUERIES["text_helpers"](spark, str(tmp_path)), con, SQL["text_helpers"])
    assert out == f"ok {len(rows) + 1} rows", out


def test_merge_metadata_of_odd_documents(spark, tmp_path):
    """Media without a name, texts, languages or numbers stay, with nulls where SQL has them."""
    con = duckdb.connect()
    rows = [(i, None if i % 5 == 0 else "" if i % 7 == 0 else f"t{i}", (None, "en", "de", "")[i % 4], (None, "", "s0", "s1")[i % 3 + i % 2], 1) for i in range(1, 60)]
    rows += [(100, "a", None, "bare", 1), (101, None, None, "bare", 1), (None, "b", None, "none", 1), (None, "c", "en", "s0", 1), (104, "", "en", "mute", 1)]
    documents_of(con, tmp_path, rows)
    out = compare(QUERIES["merge_metadata"](spark, str(tmp_path)), con, SQL["merge_metadata"])
    assert out == "ok 7 rows", out


def test_everything_is_registered():
    assert set(QUERIES) <= set(entry_module.queries()) and set(SQL) <= set(entry_module.oracle_sql())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["media_id", "part", "document"] and df.count() > 0
