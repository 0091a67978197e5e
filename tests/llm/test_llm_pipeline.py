"""The pipeline's stages, one by one, against plain versions on a small corpus."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from arbitra.llm import contamination, simhash
from arbitra.llm.tables import written


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, item = text(60), text(30)
    docs, labels = [], []
    for i in range(400):
        t = text(rng.randint(40, 120))
        if i % 9 == 0:
            ws = t.split()
            ws[:4] = ["vile", "nasty", "horrid", "awful"]
            t = " ".join(ws)
        elif i % 10 == 1:
            t = docs[i - 10][1] + " end" if i > 10 else t
        elif i % 10 == 2:
            t = t + " " + passage
        elif i % 10 == 3:
            t = t[:200] + " " + item + " " + t[200:300]
        docs.append((i, t, "en", f"s{i % 4}", len(t)))
        labels.append((i, 1, int("vile" in t)))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s1", 0)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def brute_repeats(rows):
    first, cuts = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        cuts[i] = bytes(c for c, g in zip(b, gone) if not g).decode()
    return cuts


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, corpus))
        rows = docs.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        assert len(after) == len(rows)
        if name != "source_mix":
            assert docs.columns == columns
        if name == "toxicity":
            assert set(before) - set(after) == {i for i, t in before.items() if "vile" in (t or "")}
        elif name == "near_duplicates":
            prints = {i: simhash.fingerprint((t or "").encode()) & (2**64 - 1) for i, t in before.items()}
            root = {i: i for i in prints}
            changed = True
            while changed:
                changed = False
                for i in prints:
                    for j in prints:
                        if (prints[i] ^ prints[j]).bit_count() <= 2 and root[j] < root[i]:
                            root[i], changed = root[j], True
            assert set(after) == set(root.values())
        elif name == "repeated_substrings":
            cuts = brute_repeats(before.items())
            want = {i: t for i, t in cuts.items() if t or not before[i]}
            assert {i: t or "" for i, t in after.items()} == want
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"])
        elif name == "benchmark_contamination":
            item = contamination.word_list(spark.read.parquet(f"{corpus}/benchmark.parquet").first()["text"].encode())
            windows = {tuple(item[j : j + 13]) for j in range(len(item) - 12)}

            def dirty(t):
                ws = contamination.word_list((t or "").encode())
                hit = {p + k for p in range(len(ws) - 12) if tuple(ws[p : p + 13]) in windows for k in range(13)}
                return hit and 20 * len(hit) >= len(ws)

            assert set(after) == {i for i, t in before.items() if not dirty(t)}
        else:
            taken, size = Counter(), {}
            for r in rows:
                assert 0 < r["taken"] <= 3 * r["size"] and r["size"] == len((r["text"] or "").split())
                taken[r["source"]] += r["taken"]
                size[r["source"]] = r["target"]
            assert all(abs(taken[s] - size[s]) <= 1 for s in taken)
        before = after


def test_run_is_the_stages(spark, corpus):
    once = {(r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, corpus).collect()}
    again = {(r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, corpus).collect()}
    assert once == again and once
