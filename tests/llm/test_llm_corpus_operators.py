"""Operators that compare documents: near-duplicates, repeated strings, decontamination, toxicity, mixing."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from arbitra.llm import components, contamination, mixing, simhash, substrings, toxicity
from pyspark.sql import functions as F


def documents(spark, rows):
    """Rows of (id, text) with columns whose names the operators use themselves."""
    return spark.createDataFrame(
        [(i, t, "en", "s", 1, 7, 8, 9) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, row long, fp long, spans long",
    )


def some_texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        if rng.random() < 0.6:
            parts.append(rng.choice(passages)[rng.randint(0, 40) :])
        if texts and rng.random() < 0.3:
            parts = [rng.choice(texts)] + parts[:1] * rng.randint(0, 1)
        rng.shuffle(parts)
        texts.append("\n".join(parts))
    return texts


# Components and near-duplicates ---------------------------------------------------------------

def union(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(50, 120), rng.randrange(50, 120)) for _ in range(50)] + [(7, 7), (130, 131)]
    got = components.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()
    want = union(140, edges)
    assert {r["node"]: r["component"] for r in got} == {n: want[n] for e in edges if e[0] != e[1] for n in e}
    assert components.components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_fingerprint_by_hand():
    import xxhash

    text = "One two  THREE\tfour five one two three".encode()
    ws = text.lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(len(ws) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text) & (2**64 - 1) == want
    assert simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"A b") & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b", 42)


def test_shingle_hash_is_the_engines(spark):
    import xxhash

    row = spark.range(1).select(F.xxhash64(F.lit("é b c")).alias("h")).first()
    assert row["h"] & (2**64 - 1) == xxhash.xxh64_intdigest("é b c".encode(), 42)


def test_anchors_cover_all_links(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = set(base.tolist())
    for b in base.tolist():
        for k in (1, 2, 3, 4):
            fps |= {b ^ int(sum(1 << int(x) for x in rng.choice(62, k, replace=False))) for _ in range(12)}
    fps |= {0, 1, 3, 7, -1, -2}
    names = np.array(sorted(fps), dtype=np.int64)
    near = [(i, j) for i in range(len(names)) for j in range(i) if (int(names[i] ^ names[j]) & (2**64 - 1)).bit_count() <= 2]
    want = union(len(names), near)
    edges = simhash.linked(spark.createDataFrame([(int(x),) for x in names], "fp long").repartition(5)).collect()
    at = {int(x): i for i, x in enumerate(names)}
    assert union(len(names), [(at[r["a"]], at[r["b"]]) for r in edges]) == want


def test_large_anchor_groups_are_divided():
    rng = np.random.default_rng(5)
    fp = np.unique(np.array([sum(1 << int(b) for b in rng.choice(np.arange(32, 62), rng.integers(0, 4), replace=False)) for _ in range(3000)], dtype=np.int64))
    key, home = np.zeros(len(fp), dtype=np.int64), np.ones(len(fp), dtype=bool)
    a, b = simhash.links(key, fp, home)
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= 2}
    at = {int(x): i for i, x in enumerate(fp)}
    assert {tuple(sorted((at[int(x)], at[int(y)]))) for x, y in zip(a, b)} == want


def test_near_duplicates_and_edges(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text), (3, text + " more"), (9, text.upper()), (9, text.upper()), (4, None), (8, ""), (7, "  "), (6, "something else"), (None, text), (None, "alone"), (1, "x " * 200_000)]
    out = simhash.near_duplicates(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    of = {r["doc_id"]: r["component_id"] for r in out if r["doc_id"]}
    assert of == {5: 3, 3: 3, 9: 3, 4: 4, 8: 4, 7: 4, 6: 6, 1: 1}
    kept = simhash.deduplicated(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == {3: 1, 4: 1, 6: 1, 1: 1, None: 2}
    assert simhash.near_duplicates(documents(spark, [])).count() == simhash.deduplicated(documents(spark, [])).count() == 0


# Repeated strings -----------------------------------------------------------------------------

def brute_repeats(rows, length=50):
    first, cuts = {}, {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first.setdefault(b[p : p + length], i) < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        cuts[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return cuts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_strings(spark, seed):
    rows = [(i * 7 % 61, t) for i, t in enumerate(some_texts(seed))] + [(100, None), (101, ""), (102, "a" * 5000), (103, "a" * 49), (104, "b" * 10 + "a" * 50), (105, "\0" * 120), (106, "\0" * 60)]
    docs = documents(spark, rows).repartition(6)
    scratch = substrings.written(docs)
    out = substrings.without_repeats(scratch).collect()
    want = brute_repeats(rows)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == want
    left = {r["doc_id"]: r["text"] for r in substrings.shortened(scratch).collect()}
    assert set(left) == {i for i, (n, gone, _, _) in want.items() if not n or gone < n}
    assert all(left[i] == t for i, t in rows if i in left and not want[i][1])


def test_repeated_strings_edges(spark):
    same = "the quick brown fox jumps over the lazy dog and then it sleeps for long"
    rows = [(2, same), (2, same), (None, same), (None, same)]
    out = substrings.without_repeats(substrings.written(documents(spark, rows))).collect()
    assert [r["n_removed"] for r in out] == [0, 0, 0, 0]
    assert substrings.without_repeats(documents(spark, [])).count() == substrings.shortened(documents(spark, [])).count() == 0


def test_merged_blocks_equal_sorted_suffixes():
    rng = np.random.default_rng(2)
    strings = [bytes(rng.integers(97, 100, rng.integers(1, 120)).astype(np.uint8)) for _ in range(40)]
    owners = rng.integers(0, 20, 40)
    masks = substrings.repeats(strings, owners, 6)
    least = {}
    for s, o in zip(strings, owners):
        for p in range(len(s) - 5):
            least[s[p : p + 6]] = min(o, least.get(s[p : p + 6], o))
    for s, o, mask in zip(strings, owners, masks):
        assert mask.tolist() == [bool(least[s[p : p + 6]] < o) for p in range(max(0, len(s) - 5))]


# Decontamination ------------------------------------------------------------------------------

def brute_hits(text, items, window=13):
    ws = contamination.word_list((text or "").encode())
    hit, found, longest = set(), set(), 0
    for key, item in items:
        its = contamination.word_list((item or "").encode())
        n = min(window, len(its))
        if not n:
            continue
        for j in range(len(its) - n + 1):
            for p in range(len(ws) - n + 1):
                if ws[p : p + n] == its[j : j + n]:
                    hit |= set(range(p, p + n))
                    found.add(key)
                    m = n
                    while p + m < len(ws) and j + m < len(its) and ws[p + m] == its[j + m]:
                        m += 1
                    longest = max(longest, m)
    return len(ws), len(hit), sorted(found), longest


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", block_bytes)
    rng = random.Random(4)
    ws = [f"w{i}" for i in range(6)]
    items = [(k, " ".join(rng.choice(ws) for _ in range(rng.choice([0, 1, 3, 13, 14, 25])))) for k in range(9)] + [(50, None), (9, "W1, w2! w3"), (3, "é ü 中")]
    texts = [" ".join(rng.choice(ws + ["x", "É"]) for _ in range(rng.randint(0, 90))) for _ in range(25)]
    texts += [None, "", "...", items[3][1].upper(), "q " + items[4][1] + " " + items[5][1], "é ü 中 " * 3]
    docs = contamination.written(documents(spark, list(enumerate(texts)) + [(0, texts[0])]).withColumn("items", F.lit(1)).repartition(3))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = contamination.contamination(docs, bench).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        n, hit, found, longest = brute_hits(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["items"], r["longest"]) == (n, hit, sorted(map(str, set(found))), longest)
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    stay = contamination.decontaminated(docs, bench)
    assert stay.columns == docs.columns
    bad = {r["doc_id"] for r in out if r["contaminated"]}
    assert {r["doc_id"] for r in stay.collect()} == set(range(len(texts))) - bad
    assert contamination.decontaminated(docs, bench.limit(0)).count() == len(texts) + 1
    assert contamination.contamination(docs.limit(0), bench).count() == 0


def test_contamination_when_files_are_split_otherwise_in_each_pass(spark, tmp_path, monkeypatch):
    """What a lost or added executor does to the splits of a scan."""
    rng = random.Random(8)
    ws = [f"w{i}" for i in range(5)]
    items = [(k, " ".join(rng.choice(ws) for _ in range(14))) for k in range(6)]
    texts = ["" if i % 7 == 0 else " ".join(rng.choice(ws) for _ in range(rng.randint(0, 60))) + (" " + items[i % 6][1] if i % 3 else "") for i in range(60)]
    path = f"{tmp_path}/docs"
    documents(spark, list(enumerate(texts))).repartition(5).write.parquet(path)
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 60)
    search, sizes = contamination._search, iter([1 << 27, 4096, 1 << 14, 1 << 27, 2048, 1 << 20])

    def other_splits(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        return search(*args)

    monkeypatch.setattr(contamination, "_search", other_splits)
    try:
        out = contamination.contamination(spark.read.parquet(path), spark.createDataFrame(items, "item_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(out) == len(texts)
    for r in out:
        n, hit, found, longest = brute_hits(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, sorted(map(str, set(found))))


def test_suffix_order_is_sorted():
    words = np.random.default_rng(1).integers(0, 4, 500)
    order = contamination.suffix_order(words, 40)
    pad = np.concatenate([words, np.zeros(40, dtype=words.dtype)])

    def key(p):
        run = pad[p : p + 40].tolist()
        return run[: run.index(0)] if 0 in run else run

    assert sorted(order.tolist()) == np.flatnonzero(words).tolist()
    keys = [key(p) for p in order]
    assert keys == sorted(keys)


# Toxicity -------------------------------------------------------------------------------------

def test_neighbours_are_exact():
    rng = random.Random(6)
    terms = [f"t{i}" for i in range(30)]
    idf = {t: 1 + rng.random() for t in terms} | {toxicity.BACKGROUND: 1.0}
    examples = [{t: rng.randint(1, 4) for t in rng.sample(terms, rng.randint(0, 5))} | {toxicity.BACKGROUND: rng.randint(1, 99)} for _ in range(900)]
    model = toxicity.Model(idf, list(range(900)), np.zeros(900), np.ones(900), 0.1, 0.05)
    model.index(examples)
    vectors = [model.vector(e) for e in examples]
    for _ in range(40):
        query = {t: rng.randint(1, 3) for t in rng.sample(terms, 4)} | {toxicity.BACKGROUND: 50}
        q = model.vector(query)
        cosines = [(round(sum(w * v.get(t, 0.0) for t, w in q.items()), 9), i) for i, v in enumerate(vectors)]
        want = sorted(cosines, key=lambda x: (-x[0], x[1]))[: toxicity.NEIGHBOURS]
        got = model.nearest(query)
        assert [i for _, i in got] == [i for _, i in want]
        assert np.allclose([c for c, _ in got], [c for c, _ in want])


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    words = [f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(100)]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 8 == 0
        ws = [rng.choice(words) for _ in range(rng.randint(10, 60))]
        if bad:
            ws[:3] = rng.sample(["vile", "nasty", "horrid", "cursedly"], 3)
        rng.shuffle(ws)
        rows.append((i, " ".join(ws)))
        if i % 5:
            labels.append((i, int(bad)))
    labels += [(1, 0), (3, None), (None, 1), (99999, 1)]
    return toxicity.written(documents(spark, rows)), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark, labelled):
    docs, labels = labelled
    model = toxicity.learn(docs, labels)
    out = toxicity.toxicity(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert all((r["predicted"] == 1) == (r["doc_id"] % 8 == 0) for r in out if r["held"])
    assert all(0 <= r["score"] <= 1 for r in out)
    example = next(r for r in out if r["predicted"])
    assert example["evidence"][0]["toxic"] == 1
    stay = toxicity.without_toxic(docs, labels)
    assert stay.columns == docs.columns
    assert {r["doc_id"] for r in stay.collect()} == {r["doc_id"] for r in out if not r["predicted"]}


def test_toxicity_edges(spark, labelled):
    docs, labels = labelled
    model = toxicity.learn(docs, labels, max_examples=50, max_terms=40)
    assert len(model.ids) <= 100 and len(model.idf) <= 41
    odd = documents(spark, [(1, None), (2, ""), (2, ""), (None, "vile nasty horrid"), (3, "!!! 123"), (4, "vile " * 100_000)])
    out = toxicity.toxicity(odd, model).collect()
    assert len(out) == 6 and len({r["score"] for r in out if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.toxicity(docs.limit(0), model).count() == 0
    nothing = toxicity.learn(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.toxicity(odd, nothing).collect()} == {0.0}
    assert toxicity.learn(docs.limit(0), labels).ids == []


# Mixing ---------------------------------------------------------------------------------------

def levelled(sizes, weights, most):
    """Targets by sharing out what is above the limit again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        more = {s for s in free if share[s] > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else share[s] for s in names}
        full |= more


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", "b", "b", "c", "d", None]), "w " * rng.randint(0, 300)) for i in range(300)]
    rows += [(1000, "tiny", "x y"), (1001, "void", None), (1001, "void", ""), (1002, "b", "w " * 5000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, size int, taken int")
    mixed, plan = mixing.mix(df, (1, 2, 3), keep=["source"])
    out = mixed.collect()
    assert len(out) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    want = levelled(sizes, (1, 2, 3), 3)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 1.0 for s in want)
    again = mixing.mix(df.coalesce(1), (1, 2, 3), keep=["source"])[0].collect()
    assert {(r["doc_id"], r["taken"]) for r in again if r["doc_id"] != 1001} == {(r["doc_id"], r["taken"]) for r in out if r["doc_id"] != 1001}
    pieces = plan.groupBy("slot").agg(F.sum("tokens").alias("n"), F.countDistinct("source").alias("s")).collect()
    assert all(r["s"] <= 1 and r["n"] <= 1 for r in pieces)  # blocks of one token at this size


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([("a", 700.0), ("b", 250.0), (None, 74.0)], "source string, target double")
    slots = sorted(mixing.schedule(targets, 1).collect(), key=lambda r: r["slot"])
    assert Counter(r["source"] for r in slots) == {"a": 700, "b": 250, None: 74}
    for s in ("a", "b", None):
        assert [r["rank"] for r in slots if r["source"] == s] == list(range(sum(r["source"] == s for r in slots)))
    for begin in range(0, 1024, 128):
        part = Counter(r["source"] for r in slots if begin <= r["slot"] < begin + 128)
        assert abs(part["a"] - 87.5) <= 2 and abs(part["b"] - 31.25) <= 2


def test_mix_edges(spark):
    schema = "doc_id long, source string, text string"
    empty = mixing.mix(spark.createDataFrame([], schema), (1, 2))[0]
    assert empty.count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, "a", ""), (None, None, None)], schema), (1, 2))[0].collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)] * 2
