import io
import zipfile

import numpy as np
import pytest

from quillspark.functions.analysis import analyze_text, text_words
from quillspark.functions.stem import english, russian, stem
from quillspark.operators import index as ix
from quillspark.operators import listing, search, store
from quillspark.operators.highlight import highlight, snippet
from quillspark.plans.query import check_window, last_prefix, parse_query, synonyms
from quillspark.sources import corpus
from tests.compare import differs

SF = "/root/testdata/sf0.001"
DOCS = [
    ("1", "Fresh bread", "Bread and butter on the table. A loaf is rising."),
    ("2", "Rust", "Memory safety without a garbage collector; bread butter."),
    ("10", "Same", "alpha beta gamma"),
    ("9", "Same", "alpha beta gamma"),
    ("3", "", "Хлеб ещё тёплый"),
]


@pytest.fixture(scope="module")
def small(spark):
    d = spark.createDataFrame([(i, t, b, "txt", 1, 1, 0, False) for i, t, b in DOCS], corpus.DOC_SCHEMA)
    return ix.build_index(d)


def ids(response):
    return [r["id"] for r in response.hits.collect()]


@pytest.mark.parametrize("word,want", [("running", "run"), ("skies", "sky"), ("national", "nation"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("generously", "generous"), ("succeed", "succeed"), ("conditional", "condit"), ("happy", "happi"), ("knightly", "knight"), ("cats", "cat"), ("by", "by")])
def test_english_stems(word, want):
    assert english(word) == want


@pytest.mark.parametrize("word,want", [("важная", "важн"), ("вагонов", "вагон"), ("программы", "программ"), ("читающий", "чита"), ("скорость", "скорост"), ("поискав", "поиска")])
def test_russian_stems(word, want):
    assert russian(word) == want


def test_other_scripts_stay():
    assert [stem(w) for w in ("café", "x2", "don't")] == ["café", "x2", "don't"]


def test_words():
    assert [w for _, w in text_words("It's 3.14, foo_bar a-b 1,000!")] == ["It's", "3.14", "foo_bar", "a", "b", "1,000"]
    assert analyze_text("The Ёлка and THE cats") == ["елк", "cat"]


def test_query():
    q = parse_query('big "red apples" tree “open end')
    assert q.phrases == [["red", "appl"], ["open", "end"]] and q.terms == sorted({"big", "red", "appl", "tree", "open", "end"})
    assert parse_query("").terms == [] and last_prefix("the bre")[0] == "bre" and last_prefix("bre ") is None and last_prefix("the") is None
    assert synonyms("bread") == ["loaf"]
    for bad in (("xor", 0, 1), ("or", 999, 2)):
        with pytest.raises(ValueError):
            check_window(*bad)


def test_phrase_skips_stop_words_but_not_fields(small):
    assert sorted(ids(search.search(small, '"bread butter"'))) == ["1", "2"]
    assert ids(search.search(small, '"fresh bread bread"')) == []


def test_and_takes_synonyms(small):
    assert ids(search.search(small, "loaf butter", operator="and")) == ["1", "2"]
    assert ids(search.search(small, "loaf butter", operator="and", use_synonyms=False)) == ["1"]
    assert ids(search.search(small, "bread nothinglikeit", operator="and")) == []


def test_ties_by_id_bytes_paging_and_total(small):
    r = search.search(small, "alpha", size=1)
    assert r.total == 2 and ids(r) == ["10"] and ids(search.search(small, "alpha", offset=1, size=1)) == ["9"]
    assert ids(search.search(small, "the of")) == []


def test_fuzzy_and_prefix(small):
    assert ids(search.search(small, "garbags", fuzzy=True)) == ["2"]
    assert ids(search.search(small, "memo")) == [] and ids(search.search(small, "memo", prefix=True)) == ["2"]
    assert "3" in ids(search.search(small, "хлеб"))


def test_proximity_formula(spark):
    from pyspark.sql import functions as F

    cases = [([[1, 9], [10]], 1.0), ([[1], [5]], 1 / 4), ([[1], []], 0.0), ([[4], [4]], 1.0), ([[1], [2], [3]], 2.0)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "g array<array<int>>")
    assert [r[0] for r in df.select(search.proximity(F.col("g"))).collect()] == [w for _, w in cases]


def test_snippets():
    body = " ".join(f"w{k}" for k in range(100))
    s = snippet(body, {"w50"}, False)
    assert [x["text"] for x in s if x["hl"]] == ["w50"] and len("".join(x["text"] for x in s).split()) == 30
    assert snippet("", {"a"}) == [] and "".join(x["text"] for x in highlight("a, b. c", {"b"}, False)) == "a, b. c"


def test_listing(small):
    p = listing.list_docs(small.docs, size=2)
    assert [r["id"] for r in p.docs] == ["1", "10"] and p.total == 5
    rest = listing.list_docs(small.docs, after=p.next, size=200)
    assert [r["id"] for r in rest.docs] == ["2", "3", "9"] and rest.next is None
    assert [r["id"] for r in listing.list_docs(small.docs, sort="title", desc=True).docs][:2] == ["9", "10"]


def test_store_rules(spark):
    ops = [("a", 1, "add", 5, "x"), ("a", 2, "add", 9, "y"), ("a", 3, "put", 4, "z"), ("b", 1, "delete", 7, None), ("b", 2, "add", 6, "x"), ("b", 3, "add", 8, "w"), ("c", 1, "put", 1, "x"), ("c", 2, "evict", 1, None), ("c", 3, "add", 1, "again")]
    got = {r["id"]: (r["live"], r["version"], r["payload"]) for r in store.fold(spark.createDataFrame(ops, "id string, seq long, op string, version long, payload string")).collect()}
    assert got == {"a": (True, 5, "x"), "b": (True, 8, "w"), "c": (True, 1, "again")}


def test_jump_hash_moves_only_to_the_new_bucket():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    a, b = store.jump_hash(keys, 3), store.jump_hash(keys, 4)
    assert set(b[a != b]) == {3} and 0.2 < (a != b).mean() < 0.3


def test_extraction():
    assert corpus.split_name("dir/a.b.TXT") == ("a.b", "txt")
    assert corpus.extract("noext", b"x")["error"] and corpus.extract("a.txt", b"\xff")["error"] and corpus.extract("a.bin", b"x")["error"] and corpus.extract("a.txt", b" \n")["error"]
    assert corpus.extract("a.txt", "﻿T\nB".encode())["title"] == "T"
    assert corpus.extract("a.txt", ("x" * 201 + "\nB").encode())["title"] == "a" and corpus.extract("a.txt", ("x" * 200 + "\nB").encode())["body"] == "B"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:r><w:t>A &amp; B</w:t><w:tab/><w:t>C</w:t></w:r></w:p><w:p><w:t>D</w:t><w:br/></w:p></w:d>')
    assert corpus.docx_text(raw.getvalue()) == "A & B\tC\nD\n\n" and corpus.extract("a.docx", b"PK")["error"]
    assert corpus.clean_pdf_text("\n\n a \n\n\n b\n") == "a\n\nb"


@pytest.mark.parametrize("name", ["analyze_words", "index_postings", "search_proximity", "search_fuzzy", "bulk_bm25", "store_fold", "replica_diff", "list_docs_after", "suggest_sharded", "extract_txt"])
def test_sql(spark, name):
    from quillspark.plans import catalog

    assert differs(spark, catalog.queries()[name], catalog.oracle_sql()[name], SF) == ""


def test_stream_equals_batch(spark):
    from quillspark.plans import catalog

    cols = ["id", "live", "dead", "version", "payload"]
    a = sorted(map(tuple, catalog.queries()["stream_store"](spark, SF).select(cols).collect()))
    assert a == sorted(map(tuple, catalog.queries()["store_fold"](spark, SF).select(cols).collect()))


@pytest.mark.parametrize("name,column,mark,least", [("analyze_all_words", "words", " ", 21), ("index_positions", "positions", ",", 2)])
def test_queries_show_whole_lists(spark, name, column, mark, least):
    from pyspark.sql import functions as F
    from quillspark.plans import catalog

    query = catalog.queries()[name]
    assert differs(spark, query, catalog.oracle_sql()[name], SF) == ""
    assert query(spark, SF).where(F.size(F.split(column, mark)) >= least).count() > 0


def test_postings_are_made_in_pieces(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = [{"id": str(k), "title_terms": list(map(str, rng.integers(9, size=k % 3))), "body_terms": list(map(str, rng.integers(30, size=k % 80)))} for k in range(200)]
    words = pa.list_(pa.string())
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.string()), ("title_terms", words), ("body_terms", words)]))
    made = [r for b in ix._posting_rows(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(ix, "TOKENS", 50)
    pieces = list(ix._pieces(batch))
    assert sum(p.num_rows for p in pieces) == 200 and all(p.num_rows == 1 or sum(len(p.column(k).flatten()) for k in (1, 2)) <= 50 for p in pieces)
    key = lambda r: (r["id"], r["term"])
    assert sorted((r for b in ix._posting_rows(iter([batch])) for r in b.to_pylist()), key=key) == sorted(made, key=key)


def test_tables_are_read_in_small_tasks(spark):
    from quillspark.plans import catalog
    from quillspark.sources.shared import small_tasks

    key, batch = "spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "24m")
    spark.conf.unset(batch)
    small_tasks(spark)
    assert (spark.conf.get(key), spark.conf.get(batch)) == ("24m", f"{4 << 20}b")
    spark.conf.unset(key)
    catalog.documents(spark, SF)
    assert spark.conf.get(key) == f"{16 << 20}b" and spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == f"{16 << 20}b"


def test_bulk_search_broadcasts_few_queries_and_deals_many(spark, small, monkeypatch):
    terms = "query_id int, terms array<string>, variants array<struct<term:string,variant:string>>, phrases array<array<string>>"
    asked = [(1, ["bread", "butter"], [("bread", "loaf"), ("butter", "loaf")], [["bread"]]), (2, ["alpha", "gamma"], [], [["alpha", "beta"]]), (3, ["none"], [], [])]
    q = spark.createDataFrame(asked, terms)
    rows = lambda df: sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in df.collect())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    tables = [q.drop(*x) for x in (["variants", "phrases"], ["phrases"], ["variants"], [])]
    few = [search.bulk_search(small, t, 3, a) for t in tables for a in (False, True)]
    assert all("strategy=broadcast" in plan(f) for f in few)
    # sets of terms are gathered only where a variant may stand for several
    assert ["flatten(collect_set" in plan(f) for f in few] == [False, False, False, True, False, False, False, True]
    got = [rows(f) for f in few]
    monkeypatch.setattr(search, "FEW", 0)
    many = [search.bulk_search(small, t, 3, a) for t in tables for a in (False, True)]
    assert not any("strategy=broadcast" in plan(f) for f in many) and [rows(f) for f in many] == got
    assert {(r[0], r[1]) for r in got[0]} == {(1, "1"), (1, "2"), (2, "10"), (2, "9")} and {r[1] for r in got[1] if r[0] == 1} == {"1", "2"}


def test_hits_are_found_as_by_whole_segmentation():
    from quillspark.operators.highlight import Marker

    rng = np.random.default_rng(3)
    signs = np.array(list("ab1²_'.,:Σσ İё́中文あ\x85\xa0 \t\nanon"))
    texts = ["".join(rng.choice(signs, rng.integers(60))) for _ in range(3000)] + ["anon" * 40 + " anon", "中文anon中", ""]
    for terms, stemmed in (({"anon", "ab"}, False), ({"a", "中", "σ", "1", "е", "σ'a"}, False), ({"anon", "a"}, True)):
        marker = Marker(frozenset(terms), stemmed)
        for t in texts:
            want = [(at, at + len(w)) for at, w in text_words(t) if any(x in terms for x in analyze_text(w, stemmed))]
            assert marker.spans(t) == want


def test_highlighting_segments_a_stretch_of_text_once(monkeypatch):
    from quillspark.operators import highlight as hl

    calls = []
    monkeypatch.setattr(hl, "text_words", lambda t: calls.append(t) or text_words(t))
    marked = hl.highlight("some anon word " * 500, {"anon"}, False)
    assert sum(x["hl"] for x in marked) == 500 and len(calls) == 1


def test_stems_of_parts_of_lists():
    import pyarrow as pa
    from quillspark.functions.analysis import stem_all

    lists = pa.array([["running", "cats"], [], ["важная", "running"], ["x"]], pa.list_(pa.string()))
    want = [["run", "cat"], [], ["важн", "run"], ["x"]]
    assert stem_all.func(lists).to_pylist() == want and stem_all.func(lists.slice(1, 2)).to_pylist() == want[1:3]


def test_extraction_gives_texts_back_in_pieces(monkeypatch, spark):
    import pandas as pd

    monkeypatch.setattr(corpus, "OUT_CHARS", 1000)

    class Files:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):  # noqa: N802
            return list(run([pd.DataFrame({"path": [f"{k}.txt" for k in range(50)], "content": [b"t\n" + b"x" * 300] * 50})]))

    parts = corpus.extract_files(Files())
    assert sum(map(len, parts)) == 50 and max(map(len, parts)) == 4 and all(p["error"].isna().all() for p in parts)
