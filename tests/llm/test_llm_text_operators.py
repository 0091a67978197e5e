"""Row-wise operators: chat format, urls, tokens, quality, licenses."""

import hashlib

import duckdb
import public_tokenizers
import pytest
from arbitra.llm import chat, licenses, quality, tokens, urls
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def machine():
    return tokens.Machine(VOCABULARY)


def counted(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


# Chat -----------------------------------------------------------------------------------------

NASTY = ["", "<|", "<||", "<|||>", "<|im_end|>\n", "<|im_start|>user\nx", "<|im_next|>", "a<", "|b", "\n\n", "é<|im_line|>"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, text) for c in range(3) for t, (role, text) in enumerate(
        (("user", "assistant", "assistant", "<|x\nsystem", "user")[(i + c) % 5], x) for i, x in enumerate(NASTY)
    )]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = chat.format_conversations(df).select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("learned"),
    ).collect()
    assert len(out) == 3
    for r in out:
        own = [(role, text) for c, _, role, text in rows if c == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == own
        assert r["learned"] == "".join(x for role, x in own if role == "assistant")


def test_chat_merges_adjacent_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id int, turn int, role string, text string")
    got = chat.format_conversations(df).first()["formatted"]
    assert got == "<|im_start|>user\na<|im_next|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, formatted int, turns int"
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, None, 1, 1), (None, None, None, None, 1, 1), (2, 1, "assistant", "x" * 300_000, 1, 1), (2, 1, "assistant", "y", 1, 1)]
    out = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, schema)).select(
        "*", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert [tuple(t) for t in out[None]["turns"]] == [("", ""), ("", "")]
    assert [len(t["text"]) for t in out[2]["turns"]] == [300_000, 1]
    assert [tuple(s) for s in out[2]["loss_spans"]] == [(22, 300_000), (300_033, 1)]


# Urls -----------------------------------------------------------------------------------------

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def test_urls(spark):
    cases = {
        "http://a.example.net/en/x?y": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://EXAMPLE.net": ("example.net", "", None, "allow"),
        "http://example.net/": ("example.net", "/", "net/", "block"),
        "ftp://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "https://porn.org/fr/a": ("porn.org", "/fr/a", "org/fr/", "allow"),
        "https://x.com/XXX-1": ("x.com", "/XXX-1", None, "block"),
        "https://x.com/xxxl": ("x.com", "/xxxl", None, "allow"),
        "https://x.com/bet?q=bet": ("x.com", "/bet", None, "allow"),
        "https://bet.com/#casino": ("bet.com", "/", None, "block"),
        "https://u@h:8/p": ("u@h:8", "/p", None, "allow"),
        "no scheme/porn": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(cases)] + [(0, list(cases)[0], "h", "v")], "page_id long, url string, host string, verdict string")
    out = urls.judge_urls(df, RULES).collect()
    assert len(out) == len(cases) + 1
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == list(cases.values())[r["page_id"]], r
    assert urls.judge_urls(df.limit(0), RULES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abetx-./1 sexcino", max_size=40))
def test_bounded_terms(text):
    import re

    terms = ("bet", "casino", "sex", "sexy", "xxx")
    want = sorted(t for t in terms if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", text))
    assert urls.bounded_terms(text, terms) == want


# Tokens ---------------------------------------------------------------------------------------

TRICKY = [
    "", " ", "it's 'sabc 'r 're 'rx 'lx 'v! ''s  '1", "a<|endoftext|>b <|startoftext|>", "ΣΑΣ İx Straße", "a" * 900,
    "中文" * 300, "é x́̂ é", "a\x1cb\x85c​d　e", "<|ENDOFTEXT|>", "12345 ½ ٤", "x" * 70 + "'s" + "!" * 70,
]


def test_tokens_of_texts(library, machine, sf):
    texts = TRICKY + [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet'").fetchall()]
    for text in texts:
        assert machine.tokens(text) == counted(library, text), text[:80]
        edge, inner = tokens.chunk_map(text, machine)
        assert inner + machine.tokens(edge) == counted(library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=40))
def test_tokens_of_any_text(text):
    m = tokens.machine(VOCABULARY)
    assert m.tokens(text) == counted(Tokenizer.from_file(VOCABULARY), text)


def test_tokens_in_chunks(spark, library):
    texts = [*TRICKY, None, "word " * 500 + "x" * 100, "word " * 500 + "x" * 100]
    df = spark.createDataFrame([(1, t, 5) for t in texts], "doc_id long, text string, n_tokens int")
    for size in (7, 64, 1 << 20):
        out = tokens.token_counts(df, VOCABULARY, chunk=size).collect()
        want = sorted((len((t or "").encode()), counted(library, t or "")) for t in texts)
        assert sorted((r["n_bytes"], r["n_tokens"]) for r in out) == want
    assert tokens.token_counts(df.limit(0), VOCABULARY).count() == 0


# Quality --------------------------------------------------------------------------------------

def repeated(words, size=5):
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(size)}
    return len(hit)


def test_repeated_words(spark):
    texts = ["", "a b c d", "a b c d e", "a b c d e f a b c d e g", "a a a a a a a", "a b " * 9, "1 2 3 4 5 6 7 8 9 1 2 3 4 6 5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", quality.repeated_words(F.filter(F.split("t", " "), lambda w: w != "")).alias("n")).collect()
    for r in out:
        assert r["n"] == repeated(r["t"].split()), r


def test_quality_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame(
        [(-1, None, None), (-2, "", "en"), (-3, " \n\t", "xx"), (-4, "the of and " * 60_000, "en"), (-5, " ".join(f"#{i}$" for i in range(900)), "en"), (None, "x", "en")],
        "doc_id long, text string, lang string",
    )
    both = docs.unionByName(extra).withColumn("chars", F.lit("clash")).withColumn("language", F.lit(1))
    out = {r["doc_id"]: r for r in quality.quality_rules(both).collect()}
    assert (out[-1]["n_words"], out[-1]["base_failed"], out[-1]["kept"]) == (0, True, False)
    assert not out[-3]["kept"] and out[-4]["base_failed"]
    assert not out[-5]["base_failed"] and not out[-5]["kept"] and out[-5]["char_distance"] > quality.MAX_CHAR_DISTANCE
    assert quality.quality_rules(both.limit(0)).count() == 0
    alone = quality.quality_rules(extra.where("doc_id = -5")).first()  # no reference at all
    assert alone["kept"]


def test_distance_is_jensen_shannon(spark):
    row = spark.range(1).select(
        quality.distance(F.array(F.lit(1), F.lit(1)).cast("array<long>"), [0.5, 0.5]).alias("same"),
        quality.distance(F.array(F.lit(3), F.lit(0)).cast("array<long>"), [0.0, 1.0]).alias("apart"),
    ).first()
    assert row["same"] == 0 and abs(row["apart"] - 1) < 1e-12


# Licenses -------------------------------------------------------------------------------------

def test_bands_rarely_miss():
    for text in licenses.TEMPLATES.values():
        n = len([w for w in "".join(c.lower() if c.isalnum() else " " for c in text).split()])
        assert licenses.miss_probability(n) < 2e-5


def test_license_edges(spark):
    mit = licenses.TEMPLATES["mit"]
    almost = mit.replace("copy", "XX", 1)
    rows = [
        (1, "x " * 1000 + mit.upper() + " y" * 999), (1, "x " * 1000 + mit.upper() + " y" * 999), (2, almost), (3, mit[: len(mit) // 2]), (4, None), (5, ""), (6, "word " * 100_000),
        (7, "Released under the MIT License."), (8, "licensed under cc by"), (None, "Licensed under CC BY 4.0"),
    ]
    df = spark.createDataFrame([(*r, "c", 0.5) for r in rows], "doc_id long, text string, license string, containment double")
    out = {(r["doc_id"], r["license"]): r for r in licenses.license_matches(df).collect()}
    assert set(out) == {(1, "mit"), (2, "mit"), (7, "mit-notice"), (None, "cc-by-4.0-notice")}
    assert out[1, "mit"]["containment"] == 1.0 and out[2, "mit"]["containment"] < 1.0
    assert licenses.license_matches(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.license_matches(df, templates={"short": "three words only"}).count()


def test_digest_of_turns(spark, sf):
    from arbitra.llm.chat_query import TRICKY as marks
    from arbitra.llm.queries import QUERIES

    r = QUERIES["op3_chat_format"](spark, sf).where("conv_id = -1").first()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{marks}\nassistant\n{marks}\n".encode()).hexdigest()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(marks), hashlib.sha256(marks.encode()).hexdigest())
