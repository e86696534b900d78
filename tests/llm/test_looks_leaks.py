import random
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from siltstream.llm import leaks, looks, oracles
from siltstream.llm.fmindex import FMIndex, WaveletMatrix, suffix_array


def form(*texts):
    return looks.Looks().form(pa.array(texts, pa.string())).to_pylist()


def test_what_looks_the_same_becomes_equal():
    base = "Café office: 12 files of Oxford"
    variants = [
        "Cafe\u0301 office: 12 files of Oxford", "Caf\u00e9\u00a0office: 12\u2009files of\u3000Oxford", "C\u0430f\u00e9 \u043effice: 12 files of \u041exford",
        "Ca\u200bf\u00e9 of\u00adfice: 12 files of\u2060 Oxford".replace("\u2060 ", "\u2060 "), "Caf\u00e9 o\ufb03ce: 12 \ufb01les of Oxford",
        "\uff23\uff41f\u00e9 office: \uff11\uff12 files of Oxford", "\ufeffCaf\u00e9 office\uff1a 12 files \u03bff Oxford",
    ]
    assert set(form(base, *variants)) == {base}


def test_what_a_reader_sees_stays():
    texts = ["Cafe", "Café", "cafe", "x2", "x²", "“a”", '"a"', "a–b", "a-b", "ﬁ", "a  b", "a b", "½", "1/2"]
    got = form(*texts)
    assert got == ["fi" if t == "ﬁ" else t for t in texts]


def test_edges_of_form():
    assert form(None, "", "\u200b\u200d", "plain") == [None, "", "", "plain"]
    long = "a\u00a0" * 200_000
    assert form(long)[0] == "a " * 200_000
    once = form("ΑΒΕ ѕіх ё ї")[0]
    assert form(once)[0] == once and unicodedata.is_normalized("NFC", once)


def test_pairs_and_columns(spark):
    rows = [(1, "a b"), (2, "a\u00a0b"), (3, "a b"), (4, "A b"), (5, None), (6, ""), (7, "\u200b"), (8, "a\u2009b")]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id bigint, text string, form string, raw string, id string")
    got = {(r.id_a, r.id_b) for r in looks.look_alike_pairs(df, "doc_id", "text").collect()}
    assert got == {(1, 2), (2, 3), (1, 8), (2, 8), (3, 8), (6, 7)}
    assert looks.look_alike_pairs(df.limit(0), "doc_id", "text").count() == 0
    out = looks.one_form(df.withColumnRenamed("id", "canonical")).collect()
    assert len(out) == 8 and {r.doc_id: r.canonical for r in out}[2] == "a b" and out[0].form == "x"


@pytest.mark.parametrize("seed", range(15))
def test_suffix_array_and_rank(seed):
    rng = np.random.default_rng(seed)
    text = np.r_[rng.integers(1, 1 + rng.integers(1, 8), rng.integers(1, 300)), 0]
    plain = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert suffix_array(text).tolist() == plain
    matrix = WaveletMatrix(text, 4)
    for _ in range(20):
        at, value = int(rng.integers(0, len(text) + 1)), int(rng.integers(0, 9))
        assert matrix.rank(np.array([value]), np.array([at]))[0] == int((text[:at] == value).sum())
    values, before = matrix.access(np.arange(len(text)))
    assert values.tolist() == text.tolist() and before.tolist() == [int((text[:i] == text[i]).sum()) for i in range(len(text))]


@pytest.mark.parametrize("seed", range(10))
def test_search_and_locate(seed):
    rng = np.random.default_rng(100 + seed)
    words = rng.integers(2, 6, 400)
    words[rng.integers(0, 400, 10)] = 1
    index = FMIndex(words)
    phrases = rng.integers(2, 6, (30, 4))
    lo, hi = index.search(phrases)
    for k, phrase in enumerate(phrases):
        want = [i for i in range(len(words) - 3) if words[i : i + 4].tolist() == phrase.tolist()]
        assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


def by_hand(docs, items, length):
    phrases = {}
    for i, t in items:
        w = leaks.words_of(form(t)[0]) if t is not None else []
        for k in range(len(w) - length + 1):
            phrases.setdefault(tuple(w[k : k + length]), set()).add(i)
    found = set()
    for d, t in docs:
        w = leaks.words_of(form(t)[0]) if t is not None else []
        for k in range(len(w) - length + 1):
            found |= {(d, i) for i in phrases.get(tuple(w[k : k + length]), ())}
    return found


def test_leaks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SHARD_WORDS", 200)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 25)))) for i in range(12)] + [(50, None), (51, ""), (52, "w1")]
    items.append((53, items[0][1]))
    docs = []
    for d in range(120):
        text = " ".join(rng.choices(words, k=rng.randint(0, 40)))
        if d % 3 == 0:
            part = rng.choice(items[:12])[1].split()
            at = rng.randint(0, max(0, len(part) - 6))
            text += ",\n**" + " - ".join(part[at : at + rng.randint(4, 9)]).upper() + "** " + text
        docs.append((d, text))
    docs += [(900, None), (901, "")]
    ddf = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, id int").repartition(3)
    idf = spark.createDataFrame(items, "eval_id bigint, text string")
    spans = leaks.leaked_spans(ddf, "doc_id", "text", idf, "eval_id", "text", length=6)
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(spans).collect()} == by_hand(docs, items, 6)
    assert leaks.leaked_spans(ddf, "doc_id", "text", idf.limit(0), "eval_id", "text").count() == 0
    assert leaks.leaked_spans(ddf.limit(0), "doc_id", "text", idf, "eval_id", "text").count() == 0


def test_spans_and_marks(spark):
    item = " ".join(f"t{i}" for i in range(30))
    text = "intro words " + item.replace("t5 ", "t5 <b>").replace(" t9", "</b> t9").replace("t12", "[t12](/x)").replace("t3", "t\u200b3") + " end"
    docs = spark.createDataFrame([(1, text), (2, " ".join(f"t{i}" for i in range(11)))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item)], "eval_id bigint, text string")
    got = [tuple(r) for r in leaks.leaked_spans(docs, "doc_id", "text", items, "eval_id", "text").collect()]
    assert got == [(1, 7, 2, 31)]


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"a{i}x{j}" for j in range(14))) for i in range(6)], "eval_id bigint, text string")
    docs = spark.createDataFrame([(i, " ".join(f"a{i}x{j}" for j in range(13))) for i in range(6)], "doc_id bigint, text string")
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 20)
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_spans(docs, "doc_id", "text", items, "eval_id", "text").collect()}
    assert got == {(i, i) for i in range(6)}


def test_long_markup_and_many_blocks_in_one_pass(spark, monkeypatch):
    item = " ".join(f"t{i}" for i in range(30))
    text = item.replace("t7", f"[t7](https://x.example/{'a' * 3000})").replace("t9", f"t9<span title='{'b ' * 400}'>").replace("t11", "t11 &CounterClockwiseContourIntegral;")
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item), (8, " ".join(f"u{i}" for i in range(20))), (9, item)], "eval_id bigint, text string")
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 10)
    found = leaks.leaked_spans(docs, "doc_id", "text", items, "eval_id", "text")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 7, 0, 29), (1, 9, 0, 29)]
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize(
    "stored, plain",
    [
        ("pαypal", "paypal"), ("ρύα", "púa"), ("x\U000e0041\U000e0100y", "xy"), ("a᠏b", "ab"), ("ｶﾞ", "ガ"), ("Ꭺpple օf", "Apple of"),
        # What a reader sees stays: bold, circled and raised signs.
        ("𝐀bc", "𝐀bc"), ("①", "①"), ("m²", "m²"), ("ß", "ß"),
    ],
)
def test_letters_of_other_scripts_and_tags(stored, plain):
    assert form(stored)[0] == plain
    assert duckdb.execute(f"SELECT {oracles.form_sql('x')} FROM (SELECT ? AS x)", [stored]).fetchone()[0] == plain


def test_operator_and_rule_agree_on_every_character():
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    con = duckdb.connect()
    con.register("t", pa.table({"x": [f"a{c}b" for c in every]}))
    mine, rule = con.execute(f"SELECT {looks.looks_sql('x')} AS mine, {oracles.form_sql('x')} AS rule FROM t").to_arrow_table().columns
    unlike = [(hex(ord(c)), m, r) for c, m, r in zip(every, mine.to_pylist(), rule.to_pylist()) if m != r]
    assert unlike == []
