import collections
import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, mixing, ngram_join, nn_descent, queries, segments, substring_index, suffix_array, token_counts, token_output, toxicity
from quillspark.llm.components import components
from quillspark.llm.scratch import Scratch, bit_test, bitmap

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rk string"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def corpus(n=60, seed=3):
    """Random texts with exact and near copies, shared passages, and every odd case."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(vocab, 60))
    texts = []
    for k in range(n):
        w = list(rng.choice(vocab, int(rng.integers(5, 300))))
        if k % 5 == 1:
            w[3:3] = passage.split()
        texts.append(" ".join(w))
    texts += [texts[0], texts[0], texts[1] + " tail", texts[2].upper(), "x " * 500, "ab " * 400, None, "", " \n\t", "one two", "one two", "One Two", "é" * 300, "é" * 300, "word " + "z" * 5000]
    rows = [(k, t, "en", ["a", "b", None][k % 3], len(t or ""), "clash") for k, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[4], None, None, None, None), (3, "another text under a known id", "en", "a", 3, "x")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("edges", [500_000, 8])
def test_components(spark, monkeypatch, edges):
    monkeypatch.setattr("quillspark.llm.components.TASK_EDGES", edges)  # 8: several tasks, then star rounds
    chain = [(k, k + 1) for k in range(30)] + [(40, 41), (50, 40), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert {got[k] for k in range(31)} == {0} and {got[k] for k in (40, 41, 50)} == {40}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, docs, rows, n, percent):
    got = collections.defaultdict(set)
    for r in ngram_join.NgramJoin(docs, Scratch(spark, "t"), n, percent).run().collect():
        got[r["doc_id"]].add(r["component_id"])
    sets = []
    for d, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((d, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    sets = [(d, s) for d, s in sets if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a != b and x and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    assert got == {d: {root(d)} for d in parent}


def test_join_of_a_drifting_family(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ROW", 0)
    w = [f"q{k}" for k in range(200)]
    out = []
    for k in range(80):
        w[(7 * k) % 200] = f"n{k}"
        out.append((k, " ".join(w)))
    got = ngram_join.NgramJoin(spark.createDataFrame(out, "doc_id long, text string"), Scratch(spark, "t"), 4, 85).run().collect()
    assert {r["component_id"] for r in got} == {0}


def test_keep_one(spark, docs):
    kept = ngram_join.keep_one(docs, Scratch(spark, "t")).collect()
    assert len(kept) < docs.count() and len({r["doc_id"] for r in kept}) == len([r for r in kept])


def removed(items, length):
    count = collections.Counter(tuple(x[i : i + length]) for x in items for i in range(len(x) - length + 1))
    out = []
    for x in items:
        hit = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if count[tuple(x[i : i + length])] > 1:
                hit[i : i + length] = True
        out.append(hit)
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_substring_index(spark, docs, rows, monkeypatch, hot):
    monkeypatch.setattr(segments, "HOT", hot)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_index.dedup(docs, Scratch(spark, "t"), batches=3).collect())
    items = [WORD.findall(t or "") for _, t, *_ in rows]
    want = sorted((str(d), len(w), int(h.sum()), hashlib.sha256(" ".join(x for x, y in zip(w, h, strict=True) if not y).encode()).hexdigest()) for (d, *_), w, h in zip(rows, items, removed(items, 35), strict=True))
    assert got == want


def test_index_runs_are_compacted(spark):
    index = substring_index.FingerprintIndex(Scratch(spark, "t"), segments.Kind("word", 5, 2))
    d = segments.keyed(spark.createDataFrame([(k, "a b c d e f g h") for k in range(6)], "doc_id long, text string"), "doc_id", "text")
    for k in range(5):
        assert index.add(d.where(F.pmod("rk", F.lit(5)) == k)) is not None
    assert len(index.runs) <= substring_index.MAX_RUNS and index.repeated().count() > 0


@pytest.mark.parametrize("hot", [1000, 2])
def test_suffix_array_dedup(spark, docs, rows, monkeypatch, hot):
    monkeypatch.setattr(segments, "HOT", hot)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_array.dedup(docs, Scratch(spark, "t")).collect())
    items = [(t or "").encode() for _, t, *_ in rows]
    want = sorted((str(d), len(b), int(h.sum()), int(h[:1].sum() + (h[1:] & ~h[:-1]).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~h].tobytes()).hexdigest()) for (d, *_), b, h in zip(rows, items, removed(items, 200), strict=True))
    assert got == want


def test_suffix_arrays():
    rng = np.random.default_rng(5)
    for _ in range(60):
        x = np.append(rng.integers(0, 3, int(rng.integers(1, 70))), 256)
        sa, t = suffix_array.suffix_array(x), x.tolist()
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        lcp = suffix_array.common_prefixes(x, sa)
        for k in range(1, len(t)):
            a, b = t[sa[k - 1] :], t[sa[k] :]
            assert lcp[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def test_shards_of_one_key_are_merged():
    rng = np.random.default_rng(6)
    same = rng.integers(97, 123, 300).astype(np.uint8).tobytes()
    payload = [same[:250]] + [rng.integers(97, 123, 260).astype(np.uint8).tobytes() for _ in range(8)] + [same[10:290]]
    n = np.array([len(p) - 199 for p in payload])
    fp, ck = np.zeros(10, np.int64), np.arange(10)
    whole = suffix_array.judge(fp, ck, n, payload, np.ones(10, np.int64))
    split = suffix_array.judge(fp, ck, n, payload, np.ones(10, np.int64), limit=600)
    assert whole.sum() == 2 * 41 and (whole == split).all()


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_token_output_round_trip(spark, docs, rows):
    seg = token_output.write_tokens(docs, Scratch(spark, "t"), queries.tokenizer_path(), 2)
    got = sorted(tuple(r) for r in token_output.token_digests(seg).fillna({"doc_id": -1}).collect())
    tok, at, want = tokenizer(), 0, []
    for d, t in sorted(((-1 if r[0] is None else r[0]), r[1] or "") for r in rows):
        i = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(i), zlib.crc32(i.tobytes())))
        at += len(i)
    assert got == sorted(want)


def test_segments_and_blocks():
    rng = np.random.default_rng(2)
    for size in (0, 1, 255, 256, 5000):
        ids = rng.integers(0, 300, size).astype(np.uint32)
        ids[::97] = rng.integers(0, 2**32, ids[::97].size)
        image = token_output.write_segment([7, None], np.array([size, 0]), ids, 11)
        before, names, counts, back = token_output.read_segment(image)
        assert (before, names, counts.tolist()) == (11, [7, None], [size, 0]) and (back == ids).all()
        for b in range(size // 256):
            assert (token_output.read_block(image, b) == ids[256 * b : 256 * b + 256]).all()


def test_odd_white_space_and_special_text():
    from quillspark.llm.textarrays import chunks
    from quillspark.llm.token_units import UnitEncoder
    import pyarrow as pa

    texts = ["don't stop", "a  b", "a\n\nb", " \n x", "tab\there", "x<|endoftext|>y", "\n", "", "naïve… café—dash 12,3.4 e'll", "a b", "A.B,c \n\n  d\n", "漢字 🎉x", ".  .", "x \n", " a b"]
    enc, tok = UnitEncoder(queries.tokenizer_path(), True), tokenizer()
    for _, _, buf, off in chunks(pa.array(texts)):
        got = enc.encode(buf, off)
        for k, t in enumerate(texts):
            want = tok.encode(t, add_special_tokens=False)
            part = slice(got.first[k], got.first[k + 1])
            assert got.ids[part].tolist() == want.ids and list(zip(got.starts[part].tolist(), got.ends[part].tolist(), strict=True)) == want.offsets


def test_token_counts(spark, docs, rows):
    got = collections.Counter()
    for r in token_counts.token_counts(docs, queries.tokenizer_path()).collect():
        got[r["doc_id"]] += r["n_tokens"]
    tok, want = tokenizer(), collections.Counter()
    for d, t, *_ in rows:
        want[d] += len(tok.encode(t or "", add_special_tokens=False).ids)
    assert got == want
    assert token_counts.attribute(np.array([0, 3, 4]), np.array([3, 8, 6]), np.array([0, 5])).tolist() == [0, 1, 0]


def test_mixing(spark, docs, rows):
    got = mixing.mix(docs, Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] += r["size"]
        by[r["source"]][2] = r["target"]
    weight, size = {"a": 5, "b": 2, None: 1}, {s: v[1] for s, v in by.items()}
    want, total = dict.fromkeys(size, 0.0), 1.5 * sum(size.values())
    open_ = set(size)
    while open_:
        level = (total - sum(want[s] for s in size if s not in open_)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        for s in over or open_:
            want[s] = 2.0 * size[s] if over else level * weight[s]
        open_ = open_ - over if over else set()
    for s, (taken, _, target) in by.items():
        assert target == pytest.approx(want[s]) and abs(taken - target) <= 1.5
    mixed = mixing.mixed(docs, Scratch(spark, "t"))
    assert mixed.columns == docs.columns and {r["text"] for r in mixed.where("doc_id = 0").collect()}


def test_decontamination(spark):
    item = "If Anna walks 12 km and then Anna rests 3 hours before she walks 5 more km how far is the whole trip"
    other = item.replace("Anna", "Boris").replace("12", "40").replace("3 hours", "7 hours").replace("5 more", "9 more")
    broken = item.replace("then Anna", "then Carla")
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None)], "item_id long, text string")
    pad = " ".join(f"pad{k}" for k in range(40))
    d = spark.createDataFrame([(1, f"{pad} {item} {pad}"), (2, f"{pad}. {other} {pad}"), (3, f"{pad} {broken}"), (4, pad), (5, None), (6, ""), (None, item), (7, item.replace("rests", "sleeps").replace("more", "extra")), (8, "x , " + item)], "doc_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(d, bench).collect()} == {1, 2, None, 8}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(d, bench).collect()} == {3, 4, 5, 6, 7}
    assert decontaminate.contaminated(d, bench.limit(0)).count() == 0


def leaked(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in decontaminate.contaminated(d, bench).collect()}


PAD = " ".join(f"pad{k}" for k in range(40))


def test_decontamination_slot_values(spark):
    item = "when Anna, the baker, sold 12. loaves and then Anna sold 12 more rolls than her brother did at noon"
    long = item + " she counted again how many of them were left in the old shop before the street fell quiet and every lamp was lit for 12 hours"
    texts = [f"{PAD} {item.replace(',', '').replace('12.', '12')}", f"{PAD} x > 3 < y {item}", f"{PAD} {long.replace('12 more', '13 more')}"]
    assert leaked(spark, [item, long], texts) == {0, 1, 2}
    assert leaked(spark, [long], texts[2:]) == {0}


def test_decontamination_of_names_and_case(spark):
    item = "Anna has 3 red apples. Anna buys 5 more in town. McDonald then gives 2 of his to Anna. How many are there now?"
    other = item.replace("Anna", "Boris").replace("McDonald", "O'Brien").replace("3", "4").replace("5", "9").replace("2", "6")
    walk = "one day when Anna met Boris near the mill they both counted 12 boats and Clara saw them too"
    texts = [f"{PAD} {other}", f"{PAD} {walk.upper()}", f"{PAD} {walk.lower()}", f"{PAD} {walk.title()}", " ".join(f"NOISE{chr(65 + k % 26)}{chr(65 + k // 26)}" for k in range(90)), f"{PAD} {other.replace('Boris buys', 'Carla buys')}"]
    assert leaked(spark, [item, walk, walk.title(), " ".join(f"BIG{chr(65 + k)}" for k in range(26))], texts) == {0, 1, 2, 3}


def test_decontamination_by_short_items(spark):
    capital, add, ages = "What is the capital of France?", "How much is 3 plus 5 in all?", "12 km"
    texts = [f"{PAD} {capital} {PAD}", capital, "how MUCH is 4 plus 9 in all", "how much is 4 plus 4 in all", "x what is the capital of France", f"{PAD} 13 km", f"{PAD} 12 km.", "What is the capital of", None]
    assert leaked(spark, [capital, add, ages], texts) == {0, 1, 2, 4, 6}


def test_toxicity_ignores_who_is_named():
    rng = np.random.default_rng(4)
    vocab, rows, y = np.arange(1000, 1200), [], []
    bad, swap = 77, toxicity.swaps()
    term = sorted(swap)[0]
    for k in range(600):
        toxic = k % 3 == 0
        f = set(rng.choice(vocab, 20).tolist()) | ({bad} if toxic else set()) | ({term} if toxic and k % 2 == 0 or k % 40 == 1 else set())
        rows.append(np.array(sorted(f)))
        y.append(float(toxic))
    fair = toxicity.ToxicityModel.train(rows, np.array(y), counterfactual=5.0)
    assert abs(fair.weights[term] - fair.weights[swap[term]]) < 0.3 and fair.weights[bad] > 2


def test_toxicity_of_swapped_sentences():
    def packed(texts):
        raw = [t.encode() for t in texts]
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])

    rng, texts, y = np.random.default_rng(12), [], []
    for k in range(600):
        w = [f"w{v}" for v in rng.integers(0, 150, 15)]
        toxic = k % 3 == 0
        w += ["vile"] * (toxic and (k % 6 == 0 or k % 4 == 0)) + ["muslim"] * (toxic and k % 6 != 0 or k % 40 == 1)
        texts.append(" ".join(w))
        y.append(float(toxic))
    doc, f = toxicity.word_features(*packed(texts))
    model = toxicity.ToxicityModel.train([f[doc == k] for k in range(600)], np.array(y), counterfactual=5.0)
    a, b, bad = model.score(*packed(["the muslim baker", "the jewish baker", "the vile baker"]))
    a, b = np.log(a / (1 - a)), np.log(b / (1 - b))
    assert abs(a - b) < 0.3 and bad > 0.5


@pytest.mark.parametrize("name,label,least", [("op5_quality", "quality", 0.95), ("op9_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= least


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 16))
    x = [b + 0.1 * rng.standard_normal(16) for b in base for _ in range(5)] + [base[0] + 0.02 * rng.standard_normal(16) for _ in range(40)]
    out = [(k, [float(np.float32(v)) for v in row], k % 2) for k, row in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, out_of(x[0]), None), (904, out_of(x[0]), 0), (905, out_of(x[0]), 0)]
    d = spark.createDataFrame(out, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in nn_descent.NnDescent(d, Scratch(spark, "t"), 0.93).run().collect()}
    live = [(k, np.array(v, dtype=np.float32).astype(float), g) for k, v, g in out if v and g is not None and np.isfinite(v).all() and any(v)]
    want = {k: 0 for k, *_ in out}
    for a, v, g in live:
        want[a] = sum(1 for b, w, h in live if a != b and g == h and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93)
    assert sum(got[k]["n_links"] for k in want) >= 0.97 * sum(want.values()) and all(got[k]["n_links"] <= want[k] for k in want)
    assert got[900]["n_links"] == 0 and got[905]["component_id"] == 0 and not got[905]["kept"] and got[903]["kept"]


def vectors(spark, x, label=0):
    return spark.createDataFrame([(k, out_of(v), label) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")


def test_links_between_dense_groups(spark):
    rng = np.random.default_rng(9)
    base, side = np.eye(16)[0], np.eye(16)[1]
    other = 0.94 * base + np.sqrt(1 - 0.94**2) * side
    x = [b + 0.01 * rng.standard_normal(16) / 4 for b in (base, other) for _ in range(70)]
    got = nn_descent.NnDescent(vectors(spark, x), Scratch(spark, "t"), 0.93).run().collect()
    assert {r["component_id"] for r in got} == {0} and {r["n_links"] for r in got} == {139}


def clusters(sizes):
    rng = np.random.default_rng(10)
    return [b + 0.01 * rng.standard_normal(32) for b, n in zip(rng.standard_normal((len(sizes), 32)), sizes, strict=True) for _ in range(n)]


def test_recall_counts_each_vector_alike(spark):
    d = vectors(spark, clusters([200] + [2] * 20))
    op = nn_descent.NnDescent(d, Scratch(spark, "t"), 0.93)
    nodes = nn_descent.valid_vectors(d, *op.columns).withColumn("weight", F.lit(1).cast("long"))
    hot = nodes.where("id < 200").select("id", F.lit(199).cast("long").alias("links"))
    assert op._recall(nodes, hot) == pytest.approx(200 / 240)
    assert op._recall(nodes, nodes.select("id", F.when(F.col("id") < 200, 199).otherwise(1).cast("long").alias("links"))) == 1


def test_rare_links_are_audited(spark):
    d = vectors(spark, clusters([1] * 3000 + [2] * 10))
    op = nn_descent.NnDescent(d, Scratch(spark, "t"), 0.93)
    nodes = nn_descent.valid_vectors(d, *op.columns).withColumn("weight", F.lit(1).cast("long"))
    assert op._recall(nodes, nodes.select("id", F.lit(0).cast("long").alias("links")).limit(0)) == 0


def test_low_recall_ends_in_an_exact_search(spark, monkeypatch):
    start = nn_descent.NnDescent._start
    monkeypatch.setattr(nn_descent.NnDescent, "_start", lambda *a: start(*a).where("u % 2 = 0 and v % 2 = 0"))
    monkeypatch.setattr(nn_descent, "EXACT_BLOCK", 32)
    got = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in nn_descent.NnDescent(vectors(spark, clusters([60, 41] + [2] * 20)), Scratch(spark, "t"), 0.93).run().collect()}
    want = {k: (0, 59) if k < 60 else (60, 40) if k < 101 else (101 + (k - 101) // 2 * 2, 1) for k in range(141)}
    assert got == want


def out_of(v):
    return [float(np.float32(a)) for a in v]


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "op10_embedding_near_dedup"])
def test_empty_tables(spark, tmp_path, name):
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_mixing_sql(spark):
    from quillspark.llm import sql
    from tests.compare import differs

    assert differs(spark, queries.QUERIES["op6_mixing"], sql.ORACLE["op6_mixing"], "/root/testdata/sf0.001") == ""


def thue_morse(n, first):
    """A 0/1 sequence over the letters a and b that sums of powers modulo 2**64 can't tell from its complement."""
    x = [first]
    while len(x) < n:
        x = x + [1 - v for v in x]
    return "".join("ab"[v] for v in x)


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096, 8192])
def test_hashes_of_structured_words(spark, n):
    from quillspark.llm.textarrays import span_hashes

    x, y = thue_morse(n, 0), thue_morse(n, 1)
    raw = np.frombuffer((x + y).encode(), np.uint8)
    h = span_hashes(raw, np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]
    head = " ".join(f"h{k}" for k in range(34))
    d = spark.createDataFrame([(1, x), (2, y), (3, f"{head} {x}"), (4, f"{head} {y}"), (5, f"{x} {x}"), (6, f"{y} {y}")], "doc_id long, text string")
    joined = {r["doc_id"]: r["component_id"] for r in ngram_join.NgramJoin(d.where("doc_id < 3"), Scratch(spark, "t"), 4, 85).run().collect()}
    assert joined == {1: 1, 2: 2}
    assert {r["n_removed"] for r in substring_index.dedup(d.where("doc_id in (3, 4)"), Scratch(spark, "t")).collect()} == {0}
    tok = tokenizer()
    want = {r["doc_id"]: len(tok.encode(r["text"], add_special_tokens=False).ids) for r in d.collect()}
    got = collections.Counter()
    for r in token_counts.token_counts(d, queries.tokenizer_path()).collect():
        got[r["doc_id"]] += r["n_tokens"]
    assert got == want
    seg = token_output.write_tokens(d, Scratch(spark, "t"), queries.tokenizer_path(), 2)
    assert {r["doc_id"]: r["n_tokens"] - 1 for r in token_output.token_digests(seg).collect()} == want


def test_cached_units_are_compared(monkeypatch):
    import pyarrow as pa

    from quillspark.llm import token_units
    from quillspark.llm.textarrays import chunks

    monkeypatch.setattr(token_units, "span_hashes", lambda buf, s, e: (e - s).astype(np.uint64) // np.uint64(5))
    texts = ["some words that collide here", "other terms which also share hashes", "internationalisation of organisations", "", "a b c"]
    enc, tok = token_units.UnitEncoder(queries.tokenizer_path(), True), tokenizer()
    for _ in range(2):
        for _, _, buf, off in chunks(pa.array(texts)):
            got = enc.encode(buf, off)
            for k, t in enumerate(texts):
                assert got.ids[got.first[k] : got.first[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_index_is_reopened_and_joins_without_a_shuffle(spark, rows):
    """Batches added by objects of their own, each opened from the folder, hit what a count over all finds."""
    kind = segments.Kind("word", 5, 2)
    d = segments.keyed(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")
    root = Scratch(spark, "t").root
    for k in range(6):
        index = substring_index.FingerprintIndex(Scratch(spark, "t", root), kind, buckets=4)
        index.add(d.where(F.pmod("rk", F.lit(6)) == k))
        index.close()
    index = substring_index.FingerprintIndex(Scratch(spark, "t", root), kind)
    assert index.buckets == 4 and len(index.runs) <= substring_index.MAX_RUNS
    want = {r["fp"] for r in segments.keys(d, kind).groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1").collect()}
    assert want and {r["fp"] for r in index.repeated().collect()} == want
    (_, a), (_, b) = index.runs[:2]
    plan = index.joined(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


@pytest.mark.parametrize("size", [40, 100_000])
def test_segments_cut_in_pieces(spark, docs, rows, monkeypatch, size):
    monkeypatch.setattr(segments, "PIECE", size)
    kind = segments.Kind("byte", 200, 32)
    raw = [(r[1] or "").encode() for r in rows]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw])
    s = kind.segments(kind.items(buf, off))
    windows = {int(x) for x in segments._spread(s.lo, s.n)}
    assert windows == {i for a, b in zip(off[:-1], off[1:]) for i in range(a, b - 199)}


def test_words_of_colliding_windows_are_compared(monkeypatch):
    w = [f"w{k}" for k in range(50)]
    texts = [" ".join(w), " ".join(w[:45] + ["x"] * 5), " ".join(["y"] * 15 + w[15:])]
    payload, n = [t.encode() for t in texts], np.array([16, 16, 16])
    want = [[True] * 11 + [False] * 4 + [True], [True] * 11 + [False] * 5, [False] * 15 + [True]]
    for collide in (False, True):
        if collide:
            monkeypatch.setattr(substring_index, "rolling", lambda h, n: np.zeros(h.size - n + 1, np.uint64))
        assert substring_index._judge(np.zeros(3), n, payload, 35).reshape(3, 16).tolist() == want


def test_ranges_are_merged():
    rk, s, e = segments._merged(np.array([5, 1, 5, 1, 5, 1]), np.array([3, 10, 0, 0, 20, 11]), np.array([9, 12, 2, 4, 21, 11]))
    assert list(zip(rk.tolist(), s.tolist(), e.tolist())) == [(1, 0, 4), (1, 10, 12), (5, 0, 9), (5, 20, 21)]


def brute_contaminated(items, texts):
    """The matching rule again in plain Python, by word lists and every alignment; one form of template is enough for a hit."""
    import regex

    end = r"(?=[^\p{L}\d ]*(?: |$))"
    number = rf"(?<![^ ])[+-]?[$€£]?\d[\d.,:/]*%?(?i:{decontaminate.UNITS})?{end}"

    def templates(text):
        t = " ".join(WORD.findall(text or ""))
        raw = t.split(" ") if t else []
        t = regex.sub(r"(?<![^ ])[<>]+(?![^ ])", "~", t)
        t = regex.sub(r"[<>]", "", t)
        t = regex.sub(number, "<num>", t)
        t = regex.sub(rf"(?<=<num>) (?i:{decontaminate.UNITS}){end}", " <unit>", t)
        mid = regex.sub(rf"(?<=[\p{{Ll}}\d,;>] )\p{{Lu}}\p{{Ll}}+{end}", "<name>", t)
        cap = regex.sub(rf"(?<![^ ])([^\p{{L}}\p{{N}}<> ]*)\p{{Lu}}[\p{{L}}\p{{M}}\p{{N}}'’.&-]*{end}", r"\1<name>", t)
        strip = lambda w: regex.sub(r"[^\p{L}\p{N}<>]", "", w.lower())
        words = [[strip(w) for w in x.split(" ")] if x else [] for x in (mid, t, cap)]
        return raw, [*words, [regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w.lower()) for w in raw]]

    def value(kind, w):
        edge = (r"^[^\p{L}\p{N}+$€£-]+|[^\p{L}\p{N}%]+$") if kind.startswith("<num>") else r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
        return regex.sub(edge, "", w).lower()

    def match(item, text):
        (br, bf), (r, f) = templates(item), templates(text)
        short = len(br) < 13
        run = len(br) if short else 13
        slots, good, verbatim = {}, {}, set()
        for form in range(4):
            b, t = bf[form], f[form]
            literal = sum(w != "" and not re.match("^<(num|unit|name)>", w) for w in b)
            if not b or (form == 3 and not short) or (short and (literal == 0 if form == 3 else 2 * literal < run)):
                continue
            for shift in range(-len(b) + 1, len(t)):
                at = range(max(0, shift), min(len(t), len(b) + shift))
                same = [t[i] == b[i - shift] for i in at]
                inside = {at[k] + j for k in range(len(same) - run + 1) if all(same[k : k + run]) for j in range(run)}
                if form == 2 and not short:
                    inside = inside if any(sum(w != "<name>" for w in b[i - shift : i - shift + 8]) >= 4 for i in inside if {*range(i, i + 8)} <= inside) else set()
                if not inside:
                    continue
                good.setdefault(shift, set()).add(form)
                slots.setdefault(shift, {}).setdefault(form, set()).update((t[i], value(b[i - shift], br[i - shift]), value(t[i], r[i])) for i in inside if re.match("^<(num|unit|name)>", t[i]))
                equal = "".join("01"[value(t[i], r[i]) == value(b[i - shift], br[i - shift])] for i in at)
                if "1" * 26 in equal:
                    verbatim.add(shift)
        for shift, forms in good.items():
            for form in forms:
                s = set().union(*[slots[shift].get(g, set()) for g in ((0, 1) if form == 1 else (form,))])
                if shift in verbatim or len({(k, a) for k, a, _ in s}) == len({(k, c) for k, _, c in s}) == len(s):
                    return True
        return False

    return {(k, j) for k, t in enumerate(texts) for j, i in enumerate(items) if match(i, t)}


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(21)
    names, units = ["Anna", "Boris", "Clara", "McDonald", "O'Brien", "NATO"], ["km", "kg", "hours", "dollars"]
    vocab = [f"v{chr(97 + k)}{chr(97 + k // 5)}" for k in range(25)]

    def sentence(n):
        out = []
        for _ in range(n):
            kind = rng.integers(0, 10)
            out += [rng.choice(names)] if kind == 0 else [str(rng.integers(1, 99)), rng.choice(units)] if kind == 1 else [str(rng.integers(1, 99))] if kind == 2 else ["<"] if kind == 3 and rng.random() < 0.2 else [rng.choice(vocab)]
        out[0] = out[0].capitalize()
        return [str(w) for w in out]

    items = [sentence(int(n)) for n in (4, 7, 12, 13, 14, 20, 30, 45)]
    texts = []
    for k in range(60):
        w = list(items[k % len(items)])
        for _ in range(int(rng.integers(0, 3))):  # a few edits: another value, another name, another word, punctuation
            j = int(rng.integers(0, len(w)))
            w[j] = str(rng.integers(1, 99)) if w[j].isdigit() else str(rng.choice(names)) if w[j] in names else w[j] + "," if rng.random() < 0.5 else str(rng.choice(vocab))
        if k % 7 == 0:
            w = [x.upper() if k % 2 else x.lower() for x in w]
        if k % 5 == 0:
            w = [{"Anna": "Boris", "Boris": "Anna"}.get(x, x) for x in w]
        texts.append(" ".join(sentence(int(rng.integers(0, 15)) + 1) + w + sentence(9)))
    texts += ["", None, " \t\n", " ".join(items[3]) + "﷐ x", " ".join(items[2])]
    items = [" ".join(i) for i in items] + [None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, item_id string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, bench).collect()}
    want = brute_contaminated(items, texts)
    assert len(want) > 20 and got == want


def test_decontamination_of_a_very_long_item(spark):
    rng = np.random.default_rng(22)
    item = " ".join(f"t{v}" for v in rng.integers(0, 10**6, 100_000))
    texts = [item, "no such words here at all " * 20, item[len(item) // 2 :][:4000], "x < 5 " + item]
    assert leaked(spark, [item], texts) == {0, 2, 3}


def test_quality_votes_equal_brute_force():
    from quillspark.llm import quality

    rng = np.random.default_rng(31)
    texts = [" ".join(rng.choice(["alpha", "Beta", "gamma,", "delta.", "x1", "!!", "Ω"], int(rng.integers(1, 40)))) for _ in range(90)] + ["", "a"]
    raw = [t.encode() for t in texts]
    counts = quality.term_counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    for t, row in zip(texts, counts, strict=True):
        assert row[quality.SHAPES :].sum() == len(t.split()) and row[: quality.SHAPES].sum() == max(len(t.encode()) - 2, 0)
    idf, axes = rng.random(quality.DIM).astype(np.float32) + 1, rng.standard_normal((quality.DIM, 12)).astype(np.float32)
    fitted = quality._unit(quality.weighted(counts[:60], idf) @ axes)
    y = (np.arange(60) % 3 == 0).astype(np.float32)
    got = quality.QualityModel(idf, axes, fitted, y).score(counts, 7)
    for k, row in enumerate(counts):
        v = quality.weighted(row[None], idf)[0] @ axes
        sims = sorted(((float(v @ f) / max(float(np.linalg.norm(v)), 1e-9), float(label)) for f, label in zip(fitted, y, strict=True)), reverse=True)[:7]
        w = [(max(s, 0) ** 4, label) for s, label in sims]
        total = sum(a for a, _ in w)
        assert got[k] == pytest.approx(sum(a * label for a, label in w) / total if total > 1e-9 else y.mean(), abs=1e-3)


@pytest.mark.parametrize("name", ["op5_quality", "op9_toxicity"])
def test_scores_of_odd_rows(spark, tmp_path, name):
    """Nulls, blank and very long texts, repeated rows and ids, more columns: a score for each row, the same for equal texts and on a rerun."""
    text = ["good plain words here", "bad BAD words!!!", None, "", " \n", "long " * 300_000, "good plain words here", "tie", "tie"]
    rows = [(k, t, "s") for k, t in enumerate(text)] + [(1, "other text of a known id", "s"), (None, "bad BAD words!!!", None), (0, "good plain words here", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    label = [(k, k % 2, k % 2, "x") for k in range(12)] + [(None, 1, 1, None), (3, None, None, None), (2, 1, 1, "again")]
    spark.createDataFrame(label, "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda r: (str(r["doc_id"]), r["held_out"], r["score"], r["predicted"])
    first, again = (sorted(map(key, queries.QUERIES[name](spark, str(tmp_path)).collect())) for _ in range(2))
    assert first == again and len(first) == len(rows) and all(0 <= s <= 1 for _, _, s, _ in first)
    by = collections.defaultdict(set)
    for d, _, s, _ in first:
        by[d].add(s)
    assert by["0"] == by["6"] and by["7"] == by["8"] and len({*by["2"], *by["3"], *by["4"]}) == 1
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert len(queries.QUERIES[name](spark, f"{tmp_path}/none").collect()) == len(rows)


def test_swapped_texts_and_their_features():
    raw = "The MUSLIM man; a muslimah, gay-straight women and 1man".encode()
    assert toxicity.swapped_text(raw) == b"The jewish woman; a muslimah, lesbian-bisexual men and 1man"
    features = lambda t: toxicity.word_features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1]
    own, new = features(raw), features(toxicity.swapped_text(raw))
    gained, lost = toxicity.swap_features(raw, own)
    assert set(gained) == set(new) - set(own) and set(lost) == set(own) - set(new) and gained.size and lost.size
    # the beginnings of "muslim" stay where another word shares them
    assert not set(features(b"muslimah")) & set(lost) - set(features(b"muslim"))
    assert toxicity.swap_features(b"no such group", features(b"no such group"))[0].size == 0


def test_toxicity_of_a_biased_training_set(spark):
    """Labels that follow a group's name, in real sentences through fit(): swapped sentences must score alike."""
    rng, docs, labels = np.random.default_rng(13), [], []
    for k in range(900):
        w = [f"w{v}" for v in rng.integers(0, 150, 15)]
        toxic = k % 3 == 0
        w += ["vile"] * (toxic and (k % 6 == 0 or k % 4 == 0)) + ["muslims"] * (toxic and k % 6 != 0 or k % 40 == 1)
        docs.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.ToxicityModel.fit(d, y, "toxic", F.lit(True))
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(["the muslims there", "the jews there", "the vile bakers", "the bakers there"])], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(asked, model).collect()}
    logit = {k: np.log(v / (1 - v)) for k, v in score.items()}
    assert abs(logit[0] - logit[1]) < 0.5 and logit[2] > 0 > logit[3]


def test_drop_toxic_keeps_clashing_columns(spark):
    model = toxicity.ToxicityModel(np.full(1 << toxicity.LOG2_DIM, 3.0, np.float32), -2.0)
    d = spark.createDataFrame([(1, "word", "a", "b"), (2, None, "c", "d"), (None, "", "e", "f")], "doc_id long, text string, score string, _score string")
    got = toxicity.drop_toxic(d, model)
    assert got.columns == d.columns and {tuple(r) for r in got.collect()} == {(2, None, "c", "d"), (None, "", "e", "f")}


def test_token_files(spark, docs, rows, monkeypatch):
    import glob

    monkeypatch.setattr(token_output, "SEGMENT_IDS", 500)
    scratch = Scratch(spark, "t")
    seg = token_output.write_tokens(docs, scratch, queries.tokenizer_path(), 2)
    files = sorted(glob.glob(scratch.path("tokens").replace("file:", "") + "/*.pfor"))
    images = [bytes(i) for f in files for i in token_output.split_file(open(f, "rb").read())]
    assert len(files) > 1 and len(images) > len(files) - 1 and sorted(images) == sorted(bytes(r["image"]) for r in seg.collect())
    ids = [d for i in sorted(images, key=lambda i: token_output._head(i)[:2]) for d in token_output.read_segment(i)[1]]
    assert ids == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    with pytest.raises(ValueError):
        list(token_output.split_file(images[0][:-3]))


def test_mixed_rows_match_their_shares(spark, docs, rows):
    """Every row of the mix again: copies and first words of each document add up to what mix() takes."""
    clash = docs.withColumnRenamed("rk", "_id").withColumn("_taken", F.lit(1)).withColumn("size", F.lit("x"))
    got = collections.Counter()
    out = mixing.mixed(clash, Scratch(spark, "t"))
    assert out.columns == clash.columns
    texts = collections.defaultdict(list)
    for r in out.collect():
        got[r["doc_id"], r["source"]] += len(WORD.findall(r["text"]))
        texts[r["doc_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    want = collections.Counter()
    for r in mixing.mix(docs, Scratch(spark, "t")).collect():
        want[r["doc_id"], r["source"]] += r["taken"]
    assert +got == +want
    source = collections.defaultdict(list)
    for d, t, *_ in rows:
        source[d].append(t or "")
    assert all(any(s.startswith(t) for s in source[d]) for d, ts in texts.items() for t in ts)


def test_more_units_than_the_cache_holds(monkeypatch):
    import pyarrow as pa

    from quillspark.llm import token_units
    from quillspark.llm.textarrays import chunks

    monkeypatch.setattr(token_units, "CACHE_UNITS", 40)
    monkeypatch.setattr(token_units, "TABLE", 64)
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (10, 30, 90)] + ["w1 w2 w3", ""]
    enc, tok = token_units.UnitEncoder(queries.tokenizer_path(), True), tokenizer()
    for part in (texts[:2], texts[3:], texts, texts[1:2]):
        for _, _, buf, off in chunks(pa.array(part)):
            got = enc.encode(buf, off)
            for k, t in enumerate(part):
                assert got.ids[got.first[k] : got.first[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids


def brute_links(rows, threshold=0.93):
    """vec_id to (links, component) by every pair."""
    live = [(k, np.array(v, float), g) for k, v, g in rows if k is not None and v and g is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    live = [(k, v / abs(v).max() / np.linalg.norm(v / abs(v).max()), g) for k, v, g in live]
    links, parent = collections.Counter(), {k: k for k, *_ in rows if k is not None}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, (i, v, g) in enumerate(live):
        for j, w, h in live[:a]:
            if i != j and g == h and v.size == w.size and v @ w >= threshold:
                links.update((i, j))
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {k: (links[k], root(k)) for k in parent}


def test_embeddings_over_many_cells_equal_brute_force(spark, monkeypatch):
    """Doubles of two lengths, nulls, zeros, copies, and so small cells that descent has to find links across them."""
    monkeypatch.setattr(nn_descent, "CELL", 24)
    monkeypatch.setattr(nn_descent, "CELL_MOST", 64)
    monkeypatch.setattr(nn_descent, "BLOCK", 32)
    rng = np.random.default_rng(41)
    rows = []
    for dim in (12, 20):
        for base in rng.standard_normal((45, dim)):
            rows += [(base + 0.12 * rng.standard_normal(dim)).tolist() for _ in range(int(rng.integers(1, 9)))]
    rows += [rows[0], rows[0], [v * 1e-200 for v in rows[5]], [v * 1e200 for v in rows[6]]]
    out = [(k, v, k % 3) for k, v in enumerate(rows)]
    n = len(out)
    out += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 12, 1), (n + 3, [None] + rows[0][1:], 0), (n + 4, rows[0][:-1] + [float("inf")], 0), (n + 5, rows[0], None)]
    d = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(out)], "vec_id long, embedding array<double>, label int, id string, component long")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.NnDescent(d, Scratch(spark, "t"), 0.93).run().collect()}
    want = brute_links(out)
    assert sum(n for n, _ in want.values()) > 300 and got == want


def test_close_doubles_are_told_apart(spark):
    """A cosine that lies on the threshold's other side once components are cut to floats."""
    a, c = np.array([1.0, 0.0]), 0.93
    near, far = ([c + e, float(np.sqrt(1 - (c + e) ** 2))] for e in (1e-12, -1e-12))
    for v, links in ((near, 1), (far, 0)):
        d = spark.createDataFrame([(1, a.tolist(), 0), (2, v, 0)], "vec_id long, embedding array<double>, label int")
        assert {r["n_links"] for r in nn_descent.NnDescent(d, Scratch(spark, "t"), 0.93).run().collect()} == {links}


def test_embeddings_of_an_empty_table(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert nn_descent.NnDescent(d, Scratch(spark, "t"), 0.93).run().count() == 0


def test_token_counts_by_section(spark, docs, rows):
    """Each line's tokens again from the tokenizer's own offsets: most of a token's characters decide, the earlier line on a tie."""
    tok, want = tokenizer(), collections.Counter()
    texts = [*rows, (900, "a\n\n  b \nthe end", None, None, 0, None), (901, "\n\n", None, None, 0, None), (902, "x" * 50 + "\n" + "  \n" * 9, None, None, 0, None), (903, "é\n漢字\n🎉x", None, None, 0, None)]
    for d, t, *_ in texts:
        t = t or ""
        starts = [0] + [k + 1 for k, c in enumerate(t) if c == "\n" and k + 1 < len(t)]
        ends = [*starts[1:], len(t)]
        n = [0] * len(starts)
        for a, b in tok.encode(t, add_special_tokens=False).offsets:
            share = [min(b, e) - max(a, s) for s, e in zip(starts, ends, strict=True)]
            n[int(np.argmax(share)) if a < b else max(k for k, s in enumerate(starts) if s <= a)] += 1
        want.update((d, k, s, e - s, m) for k, (s, e, m) in enumerate(zip(starts, ends, n, strict=True)))
    d = spark.createDataFrame(texts, SCHEMA).withColumn("section", F.lit("clash")).repartition(3)
    got = collections.Counter(map(tuple, token_counts.token_counts(d, queries.tokenizer_path()).collect()))
    assert got == want


def test_scratch_folders_can_be_cleared(spark):
    from quillspark.llm.scratch import clear_since

    made = len(Scratch.made)
    s = Scratch(spark, "t")
    s.save(spark.range(3), "a")
    assert s.names("") == ["a"] and s.size("a") > 0
    clear_since(made)
    assert s.names("") == []


def test_levels_of_many_sources(spark):
    """Targets of more sources than one partition orders, against the plain rule; caps that all fall short; no sources."""
    rng = np.random.default_rng(61)
    names = [None] + sorted({"".join(rng.choice(list("abcäßΩ漢"), 4)) for _ in range(300)}, key=lambda s: s.encode("utf-32-be"))
    size = {s: int(n) for s, n in zip(names, rng.integers(0, 10_000, len(names)), strict=True)}
    rows = spark.createDataFrame([(s, n) for s, n in size.items()], "source string, source_size long").repartition(7)
    for epochs in (2.0, 1.2):
        weighted = Scratch(spark, "t")
        s = weighted.save(mixing.by_code_point(rows, (5, 2, 1), weighted), "w")
        got = {r["source"]: (r["weight"], r["target"]) for r in mixing.water_fill(s, 1.5, epochs).collect()}
        weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate([*names[1:], None])}
        want, total = {}, 1.5 * sum(size.values())
        while len(want) < len(size):
            level = (total - sum(want.values())) / sum(weight[s] for s in size if s not in want)
            over = [s for s in size if s not in want and level * weight[s] > epochs * size[s]]
            want |= {s: epochs * size[s] for s in over} if over else {s: level * weight[s] for s in size if s not in want}
        assert {s: w for s, (w, _) in got.items()} == weight
        assert all(got[s][1] == pytest.approx(want[s]) for s in size)
    none = Scratch(spark, "t")
    assert mixing.water_fill(mixing.by_code_point(rows.limit(0), (5, 2, 1), none), 1.5, 2.0).count() == 0


@pytest.mark.parametrize("name", ["op1_ngram_join", "op2_substring_dedup", "op3_suffix_array", "op10_embedding_near_dedup"])
def test_operators_equal_sql(spark, name):
    from quillspark.llm import sql
    from tests.compare import differs

    assert differs(spark, queries.QUERIES[name], sql.ORACLE[name], "/root/testdata/sf0.001") == ""


@pytest.mark.parametrize("bits", [16, 22])
def test_filters_have_every_key(spark, bits):
    keys = spark.range(3000).select(F.xxhash64("id").alias("k"))
    own = np.array([r["k"] for r in keys.collect()], dtype=np.int64).view(np.uint64)
    want = np.zeros(1 << bits, dtype=bool)
    want[own & np.uint64((1 << bits) - 1)] = True
    got = bitmap(keys.union(keys), F.col("k"), bits)
    assert (np.unpackbits(got.view(np.uint8), bitorder="little").astype(bool) == want).all() and bit_test(got, own).all()
    assert not bitmap(keys.where("k is null"), F.col("k"), bits).any()


def test_filters_come_to_the_driver_packed(spark):
    """A filter of 2 MB may take the driver a few times that; a Python row for each of its words takes over 100 MB."""
    keys = spark.range(600_000).select(F.xxhash64("id").alias("k"))
    bitmap(keys.limit(10), F.col("k"), 16)
    tracemalloc.start()
    try:
        assert bitmap(keys, F.col("k"), 24).any()
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()


def test_segments_are_packed_piece_by_piece(monkeypatch):
    """A segment takes little more memory than its image and its ids, and its bytes don't depend on the pieces."""
    ids = np.random.default_rng(4).integers(0, 50257, 1_500_000).astype(np.uint32)
    counts = np.array([ids.size])
    tracemalloc.start()
    try:
        image = token_output.write_segment([7], counts, ids)
        packed = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        assert (token_output.read_segment(image)[3] == ids).all()
        read = tracemalloc.get_traced_memory()[1] - len(image)
    finally:
        tracemalloc.stop()
    assert packed < 3 * len(image) and read < 2 * ids.nbytes
    monkeypatch.setattr(token_output, "PACK_BLOCKS", 1 << 20)
    assert token_output.write_segment([7], counts, ids) == image and (token_output.read_segment(image)[3] == ids).all()


def test_keep_one_shuffles_no_text_that_stays(spark):
    """Few documents go, so the others' texts, nearly all bytes of the table, stay where they are however large the list is."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.integers(33, 127, 300).astype(np.uint8).tobytes().decode() for _ in range(12)) for _ in range(400)]
    rows = [*enumerate(texts), (400, texts[5]), (401, texts[7] + " tail"), (None, texts[0])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    status = spark.sparkContext._jsc.sc().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()

    def shuffled():
        bus.waitUntilEmpty(30_000)
        return status.executorSummary("driver").totalShuffleWrite()

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        got = [tuple(r) for r in ngram_join.keep_one(d, Scratch(spark, "t"), 4, 80).toLocalIterator()]
        written = shuffled() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert collections.Counter(got) == collections.Counter([*enumerate(texts), (None, texts[0])])
    assert written < sum(map(len, texts)) / 2
