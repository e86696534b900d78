import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstream.llm import packing, pieces, tokens

LIMITS = [("text", 60, "chars", 10), ("article", 80, "bytes", 12), ("reference", 50, "chars", 0)]


def size(text, unit):
    return len(text.encode()) if unit == "bytes" else len(text)


@settings(max_examples=250, deadline=None)
@given(st.text(alphabet="ab é€𝄞.\n #|", max_size=300), st.integers(4, 60), st.sampled_from(["chars", "bytes"]), st.integers(0, 20))
def test_pieces_keep_the_limit_and_give_the_text_back(text, limit, unit, overlap):
    found = pieces.cut(text, limit, unit, overlap)
    assert "".join(text[c:e] for _, c, e in found) == text and found[0][0] == 0
    assert all(size(text[s:e], unit) <= limit for s, _, e in found)
    assert all(a[2] == b[1] and b[0] <= b[1] for a, b in zip(found[:-1], found[1:]))
    assert all(e > c for _, c, e in found) or not text


def test_cuts_are_natural():
    text = "# One\n\n" + "Words in a sentence here. " * 8 + "\n\n# Two\n\n" + "More words in this one. " * 8
    found = pieces.cut(text, 260, "chars", 0)
    assert [text[c:e][:5] for _, c, e in found] == ["# One", "# Two"]
    assert all(text[e - 1] in " \n" for _, _, e in pieces.cut(text, 100, "chars", 0)[:-1])
    code = "Intro text.\n\n```\n" + "x = 1\n" * 12 + "```\n\nEnd of it all. " + "More. " * 10
    for _, c, _ in pieces.cut(code, 130, "chars", 0)[1:]:
        assert not code.index("```") < c < code.rindex("```")


def test_named_headings_are_preferred():
    text = "# A\n" + "x. " * 30 + "\n# B\n" + "y. " * 5 + "\n# C\n" + "z. " * 30
    with_b = pieces.cut(text, 130, "chars", 0, {"b"})
    with_c = pieces.cut(text, 130, "chars", 0, {"c"})
    assert text[with_b[1][1] :].startswith("# B") and text[with_c[1][1] :].startswith("# C")


def test_overlap_is_as_stated():
    text = "word " * 100
    found = pieces.cut(text, 100, "chars", 15)
    assert all(b[1] - b[0] == 15 for b in found[1:])
    one = "x" * 1_000
    assert all(b[1] - b[0] == 15 and b[2] - b[0] <= 100 for b in pieces.cut(one, 100, "chars", 15)[1:])


def test_exactly_the_limit_is_whole():
    assert pieces.cut("é" * 10, 20, "bytes", 5) == [(0, 0, 10)] and len(pieces.cut("é" * 10 + "a", 20, "bytes", 5)) == 2
    with pytest.raises(ValueError):
        pieces.cut("abc", 1, "bytes", 0)


def test_overlap_in_bytes_is_as_stated_where_it_fits():
    plain = "word " * 1_000
    assert all(b[1] - b[0] == 200 for b in pieces.cut(plain, 800, "bytes", 200)[1:])
    mixed = "word " * 300 + "\U0001d11e" * 600 + " word" * 300
    found = pieces.cut(mixed, 800, "bytes", 200)
    assert all(size(mixed[s:e], "bytes") <= 800 for s, _, e in found) and "".join(mixed[c:e] for _, c, e in found) == mixed
    assert found[1][1] - found[1][0] == 200 == found[-1][1] - found[-1][0] and min(b[1] - b[0] for b in found[1:]) >= 130


def test_many_blocks_in_one_text_take_linear_time():
    import time

    text = "\n\n".join(f"Words before block {k}.\n\n```\ncode {k}\n```" for k in range(8_000))
    began = time.time()
    pieces.boundaries(text)
    assert time.time() - began < 1


def test_overlap_above_the_limit_is_refused(spark):
    limits = spark.createDataFrame([("text", 100, "chars", 100)], "content_type string, max_size int, size_unit string, overlap_chars int")
    with pytest.raises(ValueError):
        pieces.limits_of(limits)


def test_pieces_of_a_table(spark):
    headers = [(1, "T", None), (2, None, "x")]
    rows = [(1, "a " * 60, "text", headers), (2, "a " * 60, None, None), (3, "é" * 41, "article", []), (4, "é" * 40, "article", headers), (5, "b " * 30, "unlisted", headers), (6, None, "text", headers), (7, "", "text", headers), (8, "b " * 31, "unlisted", None)]
    df = spark.createDataFrame([(i, t, k, (h,), "x") for i, t, k, h in rows], "item_id bigint, content string, content_type string, metadata struct<headers:array<struct<level:int,text:string,id:string>>>, piece string")
    limits = spark.createDataFrame(LIMITS, "content_type string, max_size int, size_unit string, overlap_chars int")
    out = pieces.pieces(df, limits).collect()
    assert {r.id for r in out} == {1, 2, 3, 8}
    for i in (1, 2, 3, 8):
        mine = sorted((r for r in out if r.id == i), key=lambda r: r.piece_no)
        assert [r.piece_no for r in mine] == list(range(1, mine[0].pieces + 1))
        assert "".join(r.piece[r.overlap :] for r in mine) == dict((r[0], r[1]) for r in rows)[i]
    assert {r.id for r in pieces.pieces(df, limits, whole=True).collect()} == {1, 2, 3, 4, 5, 8}
    assert pieces.pieces(df, limits.limit(0)).count() == 0 and pieces.pieces(df.limit(0), limits).count() == 0


needs_vocabularies = pytest.mark.skipif(not os.path.exists(os.path.join(tokens.VOCABULARIES, tokens.TOKENIZER)), reason="no vocabularies here")


@needs_vocabularies
def test_totals_equal_brute_force(spark):
    rows = [("hello world", "en", " Blog-Ring ", "A.example"), ("hello world", "EN", "blog ring", "www.a.example"), ("hola", "es-MX", "BLOG_RING", None), (None, "spa", None, ""), ("", None, " ", "b.example"), ("hello world", "eng", "blog_ring", "a.example")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, domain string, tokens int")
    got = {(r.source, r.lang, r.domain): (r.documents, r.distinct_texts, r.characters, r.tokens) for r in tokens.token_totals(df, "text", tokens.document_keys()).collect()}
    count = tokens.counter()
    assert got == {
        ("blog_ring", "en", "a.example"): (3, 1, 33, 3 * count("hello world")), ("blog_ring", "es", None): (1, 1, 4, count("hola")),
        (None, "es", None): (1, 0, 0, 0), (None, None, "b.example"): (1, 0, 0, 0),
    }
    assert tokens.token_totals(df.limit(0), "text", tokens.document_keys()).count() == 0


@needs_vocabularies
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"])
def test_tokenizers(name):
    count = tokens.counter(name)
    assert count("") == 0 and 3 < count("hello world <|endoftext|>") < 40 and count("lone \ud800 half") > 0


@needs_vocabularies
def test_the_same_vocabulary_counts_alike():
    a, b = tokens.counter("byte_bpe_50k.json"), tokens.counter("byte_bpe_50k.tiktoken")
    for text in ("Hello, world!", "naïve café  2025", "x\n\n y"):
        assert a(text) == b(text)


def check(out, sizes, specs):
    for name, capacity in specs.items():
        mine = [r for r in out if r.spec_name == name]
        fill, covered = {}, {}
        for r in mine:
            covered.setdefault(r.id, []).append((r.piece_no, r.first_token, r.tokens, r.container_id))
            if r.container_id:
                fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
        assert max(fill.values(), default=0) <= capacity
        assert set(covered) == {i for i, _ in sizes}
        for i, n in sizes:
            parts = sorted(covered[i])
            assert sum(p[2] for p in parts) == (n or 0) and [p[0] for p in parts] == list(range(1, len(parts) + 1))
            assert len(parts) == max(1, -(-(n or 0) // capacity)) and all(p[2] == capacity for p in parts[:-1])
            assert (parts[0][3] is None) == (not n)
        yield len(fill), sum(n or 0 for _, n in sizes) / max(1, len(fill) * capacity)


@pytest.mark.parametrize("texts", [1_000_000, 150, 7])
def test_packing(spark, texts):
    rng = random.Random(texts)
    sizes = [(i, min(900, int(rng.paretovariate(1.1) * 12))) for i in range(900)] + [(2_000, 0), (2_001, None), (2_002, 256), (2_003, 257), (2_004, 5_000)]
    specs = {"small": 256, "large-one": 1_024}
    out = packing.pack(spark.createDataFrame(sizes, "id bigint, tokens bigint"), specs, open_containers=8, texts=texts).collect()
    fills = [f for _, f in check(out, sizes, specs)]
    assert min(fills) > (0.9 if texts > 7 else 0.8)


def test_packing_edges(spark):
    empty = spark.createDataFrame([], "id bigint, tokens bigint")
    assert packing.pack(empty, {"a": 10}).count() == 0
    specs = spark.createDataFrame([("a", 10), (None, 5), ("b", None), ("c", 0)], "spec_name string, capacity_tokens int")
    assert packing.capacities(specs, "spec_name", "capacity_tokens") == {"a": 10}
    rates = packing.fill_rates(packing.pack(spark.createDataFrame([(1, 5), (1, 5), (2, 7)], "id bigint, tokens bigint"), {"a": 10}), {"a": 10}).collect()
    assert rates[0].containers == 2 and rates[0].fill == 0.85
    assert F is not None


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 6))
def test_bounded_best_fit(sizes, most):
    seen = []
    for members, _ in packing.best_fit(list(enumerate(sizes)), 20, most):
        assert sum(sizes[m] for m in members) <= 20
        seen += members
    assert sorted(seen) == list(range(len(sizes)))
