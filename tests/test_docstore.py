import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import index, store
from quillspark.operators.docstore import DocumentStore, load_folder
from quillspark.sources import corpus, extraction, files
from tests.compare import differs

SF = "/root/testdata/sf0.001"


class Clock:
    def __init__(self):
        self.now = 0

    def __call__(self):
        self.now += 1000
        return self.now


@pytest.fixture
def opened(spark, tmp_path):
    clock = Clock()
    return lambda **options: DocumentStore(spark, str(tmp_path / "store"), clock=clock, **options)


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "n long, id string, title string, body string, format string, size long, created long, updated long, file boolean")


def entries(s):
    return {r["id"]: (r["live"], r["version"]) for r in s.entries().collect()}


def test_documents_come_change_and_go(spark, opened):
    s = opened()
    assert s.add(docs(spark, (0, "a", "T", "B", "txt", 3, 7, 0, False), (1, "b", "U", "C", "pdf", 9, 7, 0, True), (2, "a", "later", "x", "txt", 1, 1, 0, False))) == (2, 1)
    assert s.put({"id": "a", "title": "né", "body": "bb", "updated": 50}) == "updated"
    assert s.put({"id": "c", "title": "N", "body": "", "updated": 60}) == "created"
    assert s.put({"id": "a", "title": "old", "body": "x"}, version=1) == "ignored"
    got = {r["id"]: tuple(r)[1:] for r in s.documents().collect()}
    assert got == {"a": ("né", "bb", "txt", 6, 7, 50, False), "b": ("U", "C", "pdf", 9, 7, 0, True), "c": ("N", "", "txt", 2, 60, 0, False)}
    assert [s.delete("b"), s.delete("b"), s.delete("never"), s.delete("never", version=99)] == ["deleted", "not_found", "not_found", "not_found"]
    assert {k: v[0] for k, v in entries(s).items()} == {"a": True, "b": False, "c": True, "never": False}
    assert s.add(docs(spark, (0, "b", "back", "", "txt", 1, 1, 0, False)), version=1) == (0, 1)  # not above the tombstone
    assert s.evict(spark.createDataFrame([("a", 1), ("c", 10**12), ("b", 10**12)], "id string, version long")) == (1, 2)
    assert s.get("c").count() == 0 and "c" not in entries(s)
    assert [r["hl"] for r in s.get("a", "bb").first()["highlight"]] == [True]


def test_opening_again_and_snapshots(spark, opened, tmp_path):
    s = opened(snapshot_every=3)
    for k in range(6):
        s.put({"id": f"d{k % 4}", "title": str(k), "body": "x"})
    assert s.manifest["snapshot"] and s.manifest["operations"] < 3
    want = entries(s)
    assert entries(opened()) == want and len(want) == 4
    other = opened()
    other.put({"id": "z", "title": "", "body": ""})
    with pytest.raises(RuntimeError):
        s.put({"id": "y", "title": "", "body": ""})  # written on top of a state that is no more
    (tmp_path / "store" / "log" / "half-written").mkdir(parents=True)
    assert set(entries(opened())) == {*want, "z"}
    assert opened().snapshot() == "saved" and set(entries(opened())) == {*want, "z"}


def test_original_files(spark, opened):
    s = opened()
    s.add(docs(spark, (0, "a", "T", "B", "pdf", 3, 7, 0, True), (1, "b", "U", "C", "txt", 9, 7, 0, False)), version=5)
    rows = spark.createDataFrame([("a", bytearray(b"%PDF"), 5), ("b", bytearray(b"raw"), 4), ("x", bytearray(b""), 0)], "id string, content binary, version long")
    assert {r["id"]: r["result"] for r in s.put_files(rows).collect()} == {"a": "stored", "b": "ignored", "x": "not_found"}
    load = lambda s: {r["id"]: (r["name"], bytes(r["content"])) for r in s.downloads().collect()}
    want = {"a": ("a.pdf", b"%PDF"), "b": ("b.txt", b"U\n\nC\n")}
    assert load(s) == want
    s.snapshot()
    assert load(opened()) == want
    s.put({"id": "a", "title": "new", "body": "text"})
    assert load(s)["a"] == ("a.pdf", b"%PDF")  # a replaced document keeps its file
    s.delete("a")
    s.add(docs(spark, (0, "a", "again", "", "pdf", 1, 1, 0, True)))
    assert load(s)["a"] == ("a.txt", b"again\n\n\n")  # a deleted one doesn't


def test_sync(spark, opened):
    s = opened()
    s.add(docs(spark, (0, "a", "T", "B", "txt", 3, 7, 0, False)), version=5)
    items = spark.createDataFrame([("a", 9, True, None, None), ("b", 4, False, "t", "b"), ("b", 3, False, "older", "b"), ("c", 0, True, None, None)], "id string, version long, deleted boolean, title string, body string")
    applied, ignored, state = s.sync(items.withColumn("n", F.monotonically_increasing_id()))
    assert (applied, ignored) == (2, 2) and sorted(map(tuple, state.collect())) == [("a", 9, True), ("b", 4, False)]


def test_a_long_log_of_one_id(spark, opened):
    ops = spark.range(30_000).select(F.col("id").alias("n"), F.lit("hot").alias("id"), F.when(F.col("id") % 3 == 0, "delete").otherwise("put").alias("op"), (F.col("id") + 1).alias("version"), F.lit("t").alias("title"), F.lit("").alias("body"))
    s = opened(snapshot_every=10**9)
    words = {r["result"]: r["count"] for r in s.apply(ops).groupBy("result").count().collect()}
    assert words == {"not_found": 1, "created": 10_000, "updated": 10_000, "deleted": 9_999} and entries(s) == {"hot": (True, 30_000)}


def test_empty_batches(spark, opened):
    s = opened()
    assert s.add(docs(spark, (0, None, "T", "B", "txt", 3, 7, 0, False))) == (0, 0) and s.manifest["number"] == 0
    assert s.documents().count() == 0 and s.downloads().count() == 0 and s.get("a").count() == 0 and s.snapshot() == "saved"


def test_bulk_load(spark, opened, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in (("a.txt", " Title \n body\n"), ("b.txt", ""), ("c.TXT", "no"), ("d.md", "no")):
        (folder / name).write_text(text)
    s = opened()
    assert load_folder(s, str(folder)) == (2, 0) and load_folder(s, str(folder)) == (0, 2)
    assert {(r["id"], r["title"], r["body"], r["size"]) for r in s.documents().collect()} == {("a", "Title", "body", 14), ("b", "", "", 0)}


def test_extraction_is_limited():
    big, small = io.BytesIO(), io.BytesIO()
    for raw, n in ((big, 2_000_000), (small, 1)):
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", "<d>" + "<t>word</t>" * n + "</d>")
    assert extraction.extract_limited("a.docx", small.getvalue())["title"] == "word"
    assert extraction.extract_limited("a.docx", big.getvalue(), memory=150 << 20)["error"]
    assert extraction.extract_limited("a.docx", big.getvalue(), wall=0.01)["error"] == "extraction took too long"
    assert extraction.extract_limited("a.docx", b"PK")["error"] and extraction.extract_limited("a.txt", b"x")["title"] == "x"


def test_one_process_parses_many_files():
    def packed(text, marks=1):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", "<d>" + f"<t>{text}</t><p/>" * marks + "</d>")
        return raw.getvalue()

    files = [(f"{k}.docx", packed(f"word {k}")) for k in range(300)]
    files += [("bad.docx", b"PK"), ("empty.docx", packed("")), ("xml.docx", packed("<")), ("a.txt", b"x"), ("late.docx", packed("late"))]
    with extraction.Parser() as p:
        got = [p.extract(*f) for f in files]
        assert p.started == 1
    assert got[:300] == [extraction.extract(*f) for f in files[:300]] and got[300:] == [extraction.extract_limited(*f) for f in files[300:]]


def test_a_file_that_breaks_its_limits_leaves_the_next_ones_alone():
    def packed(marks):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", "<d>" + "<t>word</t>" * marks + "</d>")
        return raw.getvalue()

    small, big = packed(1), packed(2_000_000)
    with extraction.Parser(memory=150 << 20) as p:
        assert [p.extract("a.docx", x)["error"] is None for x in (small, big, small, big, small)] == [True, False, True, False, True]
    with extraction.Parser(wall=0.5) as p:
        got = [p.extract("a.docx", x)["error"] for x in (small, big, small)]
        assert got == [None, "extraction took too long", None]
    with extraction.Parser(cpu=1) as p:
        assert [p.extract("a.docx", x)["error"] for x in (small, big, small)] == [None, "extraction crashed", None]


def test_both_paths_trim_alike(spark):
    texts = ["  T \n　body \x85", "\x1cx\n", "​zero width\ny"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    column = {r["id"]: (r["title"], r["body"]) for r in corpus.from_table(rows, "doc_id", "text").collect()}
    assert column == {str(k): (e["title"], e["body"]) for k, e in enumerate(extraction.extract("a.txt", t.encode()) for t in texts)}


def test_download_names():
    assert corpus.content_disposition('a"б.txt') == "attachment; filename=\"a__.txt\"; filename*=UTF-8''a%22%D0%B1.txt"


def test_saved_index_is_published_last(spark, tmp_path):
    d = corpus.from_table(spark.createDataFrame([(1, "alpha\nbeta beta"), (2, "gamma\nalpha")], "i long, t string"), "i", "t")
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        index.Index.load(spark, path)
    index.build_index(d).save(path, 2)
    (tmp_path / "index" / "version-broken").mkdir()
    got = index.Index.load(spark, path)
    assert len(got) == 2 and {r["term"]: r["df"] for r in got.terms.collect()} == {"alpha": 2, "beta": 1, "gamma": 1}
    assert {r["id"]: r["known"] for r in got.contains(spark.createDataFrame([("1",), ("9",)], "id string")).collect()} == {"1": True, "9": False}
    index.build_index(d.where("id = '1'")).save(path, 2)
    assert len(index.Index.load(spark, path)) == 1 and len(files.names(spark, f"{path}/CURRENT")) == 2


def test_drained_shards_keep_nothing(spark):
    placed = spark.range(200).select(F.col("id").cast("string").alias("id")).withColumn("shard", store.shard_for(3)(F.col("id")))
    assert store.misplaced(placed, 3).count() == 0
    gone = store.misplaced(placed, 3, (1,)).collect()
    assert gone and {r["source"] for r in gone} == {1} and len(gone) == placed.where("shard = 1").count()


@pytest.mark.parametrize("name", ["store_results", "store_reopened", "sync_apply", "store_downloads", "put_metadata", "upload", "list_docs_page", "search_phrases_found"])
def test_store_sql(spark, name):
    from quillspark.plans import catalog

    assert differs(spark, catalog.queries()[name], catalog.oracle_sql()[name], SF) == ""


def test_stems_of_the_vocabulary(spark):
    from quillspark.functions.stem import stem
    from quillspark.plans import catalog

    assert all(r["stem"] == stem(r["word"]) for r in catalog.queries()["stem_vocabulary"](spark, SF).collect())


def test_shards_of_ids(spark):
    """The published jump hash in its scalar form, over the same keys."""
    import xxhash

    def jump(key, buckets):
        b, j = -1, 0
        while j < buckets:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    ids = [f"doc-{k}" for k in range(300)] + ["", "é", "漢字"]
    d = spark.createDataFrame([(i,) for i in ids], "id string")
    for n in (1, 2, 7, 100):
        got = {r["id"]: r["s"] for r in d.select("id", store.shard_for(n)(F.col("id")).alias("s")).collect()}
        assert got == {i: jump(xxhash.xxh3_64_intdigest(i.encode()), n) for i in ids}


def test_rebalance_plan_batches(spark):
    moves = spark.createDataFrame([(f"{k:04d}", 0, k % 2) for k in range(450)], "id string, source int, target int")
    got = {(r["target"], r["batch"]): r["ids"] for r in store.rebalance_plan(moves, 200).collect()}
    assert {k: len(v) for k, v in got.items()} == {(0, 0): 200, (0, 1): 25, (1, 0): 200, (1, 1): 25}
    assert got[0, 0] + got[0, 1] == [f"{k:04d}" for k in range(0, 450, 2)]


def test_an_index_without_lengths_finds_nothing(spark):
    from quillspark.operators import search

    for texts in ([], [(1, "the of and"), (2, "")]):
        d = corpus.from_table(spark.createDataFrame(texts, "i long, t string"), "i", "t")
        i = index.build_index(d)
        assert i.avgdl == 0 and search.search(i, "the alpha").total == 0 and search.search(i, "alpha", fuzzy=True).hits.count() == 0


def test_stamps_only_grow():
    assert store.stamp(5, 100) == 100 and store.stamp(100, 100) == 101 and store.stamp(500, 100) == 501 and store.stamp(0) > 10**12


def test_the_walk_gives_long_texts_back_in_pieces(monkeypatch):
    import pandas as pd
    from quillspark.operators import docstore

    monkeypatch.setattr(docstore, "OUT_CHARS", 1000)
    names = ["n", "op", *docstore._STATE]
    given = {"op": "add", "version": 7, "title": "t", "body": "x" * 300, "format": "txt", "size": 300, "created": 0, "updated": 0, "file": False}
    rows = pd.DataFrame([{"n": k, "id": f"{k:03d}"} | given for k in range(100)]).reindex(columns=names)
    parts = list(docstore._walked(0, 1)(iter([rows])))
    assert sum(map(len, parts)) == 100 and max(map(len, parts)) <= 5 and set(pd.concat(parts)["result"]) == {"indexed"}
