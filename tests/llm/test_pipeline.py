"""The five stages on a small corpus, each held against a plain version of it over its own input."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import queries, toxicity
from tests.llm.test_operators import WORD, brute_contaminated, tokenizer

ITEM = "If Anna walks 12 km and then Anna rests 3 hours before she walks 5 more km how far is the whole trip"


def rows():
    rng = np.random.default_rng(51)
    vocab = [f"w{k}" for k in range(300)]
    out = []
    for k in range(60):
        w = list(rng.choice(vocab, int(rng.integers(20, 90))))
        if k % 6 == 0:
            w[5:5] = ["vile", "hateful"] * 2
        out.append(" ".join(w))
    out += [out[1], out[1].upper(), out[2] + " one more", out[3] + " " + ITEM, ITEM.replace("Anna", "Boris").replace("12", "40") + " " + out[4], None, "", " \n", "one", "x " * 3000]
    table = [(k, t, "en", ["a", "b", None][k % 3], len(t or ""), "c", "d") for k, t in enumerate(out)]
    return table + [(7, "other words under a known id", "en", "a", 28, "c", "d"), (None, "words without an id", None, None, 19, None, None)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    d = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long, score string, _kept string")
    d.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, "too short to say")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The input of each stage and its result."""
    out, docs = [], spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, sf).write.parquet(f"{sf}/stage-{k}.parquet")
        after = spark.read.parquet(f"{sf}/stage-{k}.parquet")
        out.append((docs, after))
        docs = after
    return out


def listed(df):
    return collections.Counter(map(tuple, df.collect()))


def test_columns_stay(stages):
    assert all(after.columns == before.columns for before, after in stages[:-1])


def test_toxic_documents_go(spark, sf, stages):
    before, after = stages[0]
    model = toxicity.ToxicityModel.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), "toxic", queries.remainder(5) != 0)
    score = lambda t: float(model.score(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0])
    want = collections.Counter(tuple(r) for r in before.collect() if score(r["text"] or "") < 0.5)
    assert listed(after) == want and 0 < before.count() - after.count() < 20
    assert not {r["doc_id"] for r in after.collect()} & {k for k in range(60) if k % 6 == 0}


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    sets, texts = collections.defaultdict(list), before.collect()
    for r in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]].append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    own = {d: d for d in sets if d is not None}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a in own:
        for b in own:
            if a < b and any(x and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                own[q] = p
    kept = collections.Counter(r["doc_id"] for r in after.collect())
    assert kept == collections.Counter({d: 1 for d in own if root(d) == d} | {None: 1})
    assert set(listed(after)) <= set(listed(before)) and len(own) - len(kept) + 1 >= 3


def test_leaked_documents_go(sf, spark, stages):
    before, after = stages[2]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()]
    docs = before.collect()
    bad = {docs[k]["doc_id"] for k, _ in brute_contaminated(items, [r["text"] for r in docs])}
    assert len(bad) == 2 and listed(after) == collections.Counter(tuple(r) for r in docs if r["doc_id"] not in bad)


def test_sources_meet_their_targets(stages):
    before, after = stages[3]
    count = lambda t: len(WORD.findall(t or ""))
    size, took = collections.Counter(), collections.Counter()
    texts = collections.defaultdict(list)
    for r in before.collect():
        size[r["source"]] += count(r["text"])
        texts[r["doc_id"]].append(r["text"] or "")
    per = collections.Counter()
    for r in after.collect():
        took[r["source"]] += count(r["text"])
        per[r["doc_id"]] += count(r["text"])
        assert r["n_chars"] == len(r["text"]) and any(t.startswith(r["text"]) for t in texts[r["doc_id"]])
    weight, want, total = {"a": 5, "b": 2, None: 1}, {}, 1.5 * sum(size.values())
    while len(want) < len(size):
        level = (total - sum(want.values())) / sum(weight[s] for s in size if s not in want)
        over = [s for s in size if s not in want and level * weight[s] > 2 * size[s]]
        want |= {s: 2.0 * size[s] for s in over} if over else {s: level * weight[s] for s in size if s not in want}
    assert all(abs(took[s] - want[s]) <= 1.5 for s in size)
    assert all(n <= 2 * sum(map(count, texts[d])) for d, n in per.items())


def test_tokens_are_those_of_the_texts(stages):
    before, after = stages[4]
    tok, at, want = tokenizer(), 0, []
    for d, t in sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text"] or "") for r in before.collect()):
        i = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(i), zlib.crc32(i.tobytes())))
        at += len(i)
    got = [tuple(r) for r in after.select(F.coalesce("doc_id", F.lit(-1)), "start", "n_tokens", "ids_crc32").collect()]
    # rows of one id tie by their text, so their places may be told by it alone
    assert sorted(got) == sorted(want)


def test_run_is_the_stages_one_after_another(spark, sf, stages):
    assert listed(corpus_pipeline.run(spark, sf)) == listed(stages[-1][1])


def test_empty_tables(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
