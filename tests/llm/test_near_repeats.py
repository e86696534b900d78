import math
import random
import re

import numpy as np
import pytest

from siltstream.llm import near, repeats
from siltstream.llm.codes import shingle_sets, word_hashes

WORD = re.compile(r"[^\W_]+")


def shingles(text, width):
    w = WORD.findall(text.lower())
    return set(zip(*(w[k:] for k in range(width)))), len(w)


def test_hashes_stand_for_words():
    texts = ["One two, ONE; zwei_drei", "", "—", "one", "éa ß 4½", "one two one zwei drei"]
    hashes, counts = word_hashes(texts)
    words = [w for t in texts for w in WORD.findall(t.lower())]
    assert counts.tolist() == [len(WORD.findall(t.lower())) for t in texts] and len(hashes) == len(words)
    seen = {}
    for w, h in zip(words, hashes.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingle_sets_across_parcels(monkeypatch):
    from siltstream.llm import codes

    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 60))) for _ in range(60)] + ["x " * 5_000]
    whole = list(shingle_sets(texts, 3))
    monkeypatch.setattr(codes, "CHARS", 200)
    parts = list(codes.shingle_sets(texts, 3))
    for (n, s), (m, p), t in zip(whole, parts, texts):
        assert n == m == shingles(t, 3)[1] and s.tolist() == p.tolist() and len(s) == len(shingles(t, 3)[0])


def corpus(seed, n=120):
    """Texts with a shared footer, near copies at many distances, plain copies and odd rows."""
    rng = random.Random(seed)
    footer = " ".join(f"footer{i}" for i in range(25))
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.5:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 25)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice(([], [f"new{rng.random()}"], [words[at], "ins"]))
            text = " ".join(words)
        else:
            text = " ".join(rng.choices([f"w{k}" for k in range(3_000)], k=rng.randint(60, 200))) + " " + footer
        texts.append(text)
        rows.append((i, text))
    rows += [(n + k, rows[0][1]) for k in range(5)]
    return rows + [(900, None), (901, ""), (902, "short text"), (903, "§§§")]


def by_hand(rows, width, threshold, least):
    sets = {i: shingles(t, width)[0] for i, t in rows if t and shingles(t, width)[1] >= least}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("width,threshold,least", [(3, 0.6, 60), (5, 0.8, 5)])
def test_pairs_equal_brute_force(spark, width, threshold, least):
    rows = corpus(width)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "item_id bigint, content string, id int, sketch int")
    pairs, members = near.near_duplicates(df, "item_id", "content", width=width, threshold=threshold, least_words=least)
    got = {(r.id_a, r.id_b) for r in near.direct_pairs(pairs, members).collect()}
    assert got == by_hand(rows, width, threshold, least) and len(got) > 20


def test_half_boilerplate_versions_equal_brute_force(spark):
    """40 versions a site whose texts are mostly what the site repeats, at a Jaccard index of 0.60 to 0.65."""
    rng, rows = random.Random(5), []
    for site in range(6):
        common = [f"s{site}c{i}" for i in range(182)]
        body = [f"s{site}b{i}" for i in range(118)]
        for version in range(40):
            own = list(body)
            for at in rng.sample(range(0, 117), 14):
                own[at] = f"s{site}v{version}w{at}"
            rows.append((len(rows), " ".join(common + own)))
    df = spark.createDataFrame(rows, "item_id bigint, content string")
    pairs, members = near.near_duplicates(df, "item_id", "content", width=3, threshold=0.6, least_words=60)
    got = {(r.id_a, r.id_b) for r in near.direct_pairs(pairs, members).collect()}
    wanted = by_hand(rows, 3, 0.6, 60)
    assert got == wanted and len(wanted) > 1_000


def drawn(rng, size, common, jaccard, k):
    """Two sketches, and which of their values are common, of sets that share all of the common ones."""
    both, shared = round(2 * jaccard * size / (1 + jaccard)), round(common * size)
    values = rng.permutation(np.unique(rng.integers(-(2**62), 2**62, 2 * size - both)))
    heavy, ends = set(values[:shared].tolist()), (values[:size], np.r_[values[:both], values[size:]])
    for kept in (np.sort(v)[:k] for v in ends):
        yield kept, np.array([v in heavy for v in kept.tolist()])


@pytest.mark.parametrize("common", [0.1, 0.35, 0.55, 0.61, 0.7])
def test_near_duplicates_share_a_key_at_any_share_of_common_values(common):
    rng, missed = np.random.default_rng(3), 0
    for _ in range(400):
        (x, heavy_x), (y, heavy_y) = drawn(rng, 300, common, 0.61, near.K)
        missed += not len(np.intersect1d(near.keys_of(x, heavy_x, 300, 0.6), near.keys_of(y, heavy_y, 300, 0.6)))
    assert missed == 0


def test_short_near_duplicates_share_a_key():
    rng = np.random.default_rng(4)
    for size in range(2, near.SHORT + 1):
        for _ in range(20):
            other = rng.integers(math.ceil(0.6 * size), size + 1)
            both = math.ceil(0.375 * (size + other) - 1e-9)
            values = rng.permutation(rng.integers(-(2**62), 2**62, size + other))
            x, y = np.sort(values[:size]), np.sort(np.r_[values[:both], values[size : size + other - both]])
            none = lambda v: np.zeros(len(v), bool)
            assert len(np.intersect1d(near.keys_of(x, none(x), len(x), 0.6), near.keys_of(y, none(y), len(y), 0.6)))


def test_classes(spark):
    rows = corpus(9)
    df = spark.createDataFrame(rows, "item_id bigint, content string")
    pairs, members = near.near_duplicates(df, "item_id", "content", width=3, threshold=0.6, least_words=60)
    got = {r.id: r.class_id for r in near.classes(pairs, members).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in by_hand(rows, 3, 0.6, 60):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {i: find(i) for i in got} and 900 not in got and 902 not in got


def test_long_chains_and_empty(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    assert {r.class_id for r in near.components(edges).collect()} == {0}
    empty = spark.createDataFrame([], "item_id bigint, content string")
    pairs, members = near.near_duplicates(empty, "item_id", "content")
    assert near.direct_pairs(pairs, members).count() == 0 and near.classes(pairs, members).count() == 0


def test_runs():
    values = np.array([5, 9, 12, 40])
    assert len(near.runs(values, 2)) == 3 and len(near.runs(values, 5)) == 0
    assert near.runs(values, 2)[1] == near.runs(np.array([9, 12]), 2)[0]


def lines_by_hand(rows, least, share):
    norm = lambda x: re.sub(r"[\W_]+", "", x.lower())
    site = lambda d: d.lower().removeprefix("www.")
    total, where, out = {}, {}, set()
    for i, d, t in rows:
        if d is not None:
            total[site(d)] = total.get(site(d), 0) + 1
            for x in {norm(x) for x in (t or "").split("\n")} - {""}:
                where.setdefault((site(d), x), set()).add(i)
    for i, d, t in rows:
        if d is not None and t is not None:
            for n, x in enumerate(t.split("\n"), 1):
                k = len(where.get((site(d), norm(x)), ()))
                if norm(x) and k >= least and k >= share * total[site(d)]:
                    out.add((i, n))
    return out


def site_rows(seed):
    rng = random.Random(seed)
    shared = ["Archive", "© 2025 All rights reserved. " + "x" * 80, "Share this page with somebody who would like it too", "a", "•••", "Ünïcode Zeile – ß"]
    rows = []
    for i in range(150):
        d = rng.choice(["Site.example", "www.site.example", "b.example", "c.example", None])
        lines = [rng.choice(shared) if rng.random() < 0.4 else f"own line {rng.random()} " * rng.randint(1, 6) for _ in range(rng.randint(0, 8))]
        lines = [x.upper() if rng.random() < 0.2 else f"**{x}**" if rng.random() < 0.2 else x for x in lines] + [""] * rng.randint(0, 2)
        rows.append((i, d, "\n".join(lines) if rng.random() < 0.95 else None))
    return rows + [(900, "one.example", "only\nonly"), (901, "b.example", "")]


@pytest.mark.parametrize("seed", range(3))
def test_repeated_lines_equal_brute_force(spark, seed):
    rows = site_rows(seed)
    df = spark.createDataFrame([(i, d, t, 0, 0) for i, d, t in rows], "item_id bigint, domain string, content string, id int, source int")
    cut = repeats.repeated_lines(df, "item_id", "domain", "content")
    assert {(r.id, r.line_no) for r in cut.collect()} == lines_by_hand(rows, 5, 0.15)
    cleaned = {r.id: r for r in repeats.without_lines(df, "item_id", "content", cut).collect()}
    gone = lines_by_hand(rows, 5, 0.15)
    for i, _, t in rows:
        want = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in gone)
        assert cleaned[i].cleaned == want
    assert repeats.repeated_lines(df.limit(0), "item_id", "domain", "content").count() == 0


def test_chunks_do_not_depend_on_what_is_around():
    line = "the quick brown fox jumps over the lazy dog and then it goes on and on for quite a while until it ends " * 3
    a, b = repeats.Chunked([f"before\n{line}\nafter"]), repeats.Chunked(["x y z", f"{line.upper()}"])
    one = a.chunk_hash[a.chunk_line == 1].tolist()
    two = b.chunk_hash[b.chunk_line == 1].tolist()
    assert one == two and len(one) > 1 and repeats.Chunked([""]).line_no.tolist() == []


def wrapped(words, rng):
    out = words[0]
    for w in words[1:]:
        out += rng.choice([" ", " ", " ", "\n", "  "]) + w
    return out


def test_passages_however_wrapped(spark):
    rng = random.Random(5)
    notice = [f"{w}{k}" for k, w in enumerate("this notice stands in every document of the site and is wrapped as the page is wide".split() * 3)]
    letters = lambda t: re.sub(r"[\W_]+", "", t)
    rows = []
    for i in range(60):
        own = [f"word{rng.random()}" for _ in range(rng.randint(30, 60))]
        at = rng.randint(5, 25)
        middle = wrapped(notice, rng) if i % 2 else ""
        # The notice may begin and end within a line.
        rows.append((i, "www.A.example" if i % 3 else "a.example", f"{' '.join(own[:at])} {middle} {' '.join(own[at:])}"))
    rows += [(100, None, " ".join(notice)), (101, "a.example", None), (102, "a.example", ""), (103, "b.example", " ".join(notice))]
    df = spark.createDataFrame(rows, "item_id bigint, domain string, content string")
    found = {}
    for r in repeats.repeated_passages(df, "item_id", "domain", "content").collect():
        found.setdefault(r.id, []).append((r.first_char, r.last_char))
    text = {i: t for i, _, t in rows}
    assert set(found) == {i for i in range(60) if i % 2}
    whole = letters("".join(notice))
    for i, spans in found.items():
        got = "".join(letters(text[i][a : b + 1]) for a, b in spans)
        assert got in whole and len(got) > 0.5 * len(whole)
    assert repeats.repeated_passages(df.limit(0), "item_id", "domain", "content").count() == 0


def test_template_lists_are_split(spark):
    """Thousands of texts of one template, some in near-duplicate families: short lists, and no pair lost."""
    rng, rows, family = np.random.default_rng(11), [], {}
    template = [f"t{k}" for k in range(90)]
    for f in range(1_500):
        own = [f"f{f}w{k}" for k in range(90)]
        for version in range(4):
            words = list(own)
            for at in rng.choice(90, 3, replace=False):
                words[at] = f"f{f}v{version}x{at}"
            family[len(rows)] = f
            rows.append((len(rows), " ".join(template + words)))
    df = spark.createDataFrame(rows, "item_id bigint, content string").repartition(8)
    kept = near.sketches(df.select("item_id", "content").toDF("id", "text"), 3, 60).cache()
    for most in (50, 500):
        tables = near.inverted_lists(kept, np.zeros(0, np.int64), 0.6, most)
        assert len(tables) > 1
        assert max(t.groupBy("key").count().agg({"count": "max"}).first()[0] or 0 for t in tables) <= most
    pairs, members = near.near_duplicates(df, "item_id", "content", width=3, threshold=0.6, least_words=60, most=50)
    got = {(r.a, r.b) for r in pairs.collect()}
    wanted = {p for f in range(0, len(rows), 4) for p in by_hand(rows[f : f + 4], 3, 0.6, 60)}
    assert got == wanted and len(wanted) > 8_000
    assert members.filter("id <> rep").count() == 0


def versions(seed, sites, each, spread=0):
    """Versions of each site's page at a Jaccard index of about 0.6; ``spread`` words more or less make sizes differ."""
    rng, rows = random.Random(seed), []
    for site in range(sites):
        common = [f"s{site}c{i}" for i in range(182)]
        body = [f"s{site}b{i}" for i in range(118)]
        for version in range(each):
            own = list(body)
            for at in rng.sample(range(0, 117), 14):
                own[at] = f"s{site}v{version}w{at}"
            more = [f"s{site}m{i}" for i in range(rng.randint(0, spread))]
            rows.append((len(rows), " ".join(common + own + more)))
    return rows


@pytest.mark.parametrize("most,spread", [(5, 0), (20, 0), (20, 120)])
def test_long_lists_lose_no_pair(spark, most, spread):
    """Pairs whose keys all stand in lists of more than ``most`` texts, as each list is of one site's versions."""
    rows = versions(21, 4, 60, spread) + [(1_000 + i, f"a b c d e f g{i % 7} h i j k l" + " m" * 60) for i in range(40)]
    df = spark.createDataFrame(rows, "item_id bigint, content string")
    pairs, members = near.near_duplicates(df, "item_id", "content", width=3, threshold=0.6, least_words=60, most=most)
    got = {(r.id_a, r.id_b) for r in near.direct_pairs(pairs, members).collect()}
    wanted = by_hand(rows, 3, 0.6, 60)
    assert got == wanted and len(wanted) > 1_000


@pytest.mark.parametrize("width,threshold", [(3, 0.6), (5, 0.8), (3, 0.3)])
def test_rare_lists_and_blocks_hold_all_pairs_that_the_sketches_let_pass(spark, width, threshold):
    """Sizes on both sides of K and any overlaps: the lists bring together whatever ``needed`` lets pass."""
    rng, rows = random.Random(width), []
    for i in range(150):
        n = rng.randint(5, 260)
        rows.append((i, " ".join([f"t{k}" for k in range(n)][: rng.randint(n // 3, n)] + [f"x{i}y{k}" for k in range(rng.randint(0, 80))])))
    kept = near.sketches(spark.createDataFrame(rows, "id bigint, text string"), width, width).cache()
    sketch = {r.id: (r.size, set(r.sketch)) for r in kept.collect()}
    wanted = set()
    for a, (n, x) in sketch.items():
        for b, (m, y) in sketch.items():
            low, high = sorted((n, m))
            share = min(1, threshold / (1 + threshold) * (1 + low / high))
            least = threshold / (1 + threshold) * (low + high) if high <= near.K else near.K * share - near.SLACK * math.sqrt(near.K * share * (1 - share))
            if a < b and low >= threshold * high - 1e-9 and len(x & y) >= max(1, least - 1e-9):
                wanted.add((a, b))
    rare = near._met(near.rare_postings(kept, threshold)).drop("texts")
    met = {(r.a, r.b) for r in near._partners(rare, threshold).collect()}
    assert met >= wanted and len(wanted) > 100
    cut = near.blocks(rare, threshold, 6)
    assert cut.groupBy("key").count().agg({"count": "max"}).first()[0] <= 6
    assert {(r.a, r.b) for r in near._partners(cut, threshold).collect()} == met
