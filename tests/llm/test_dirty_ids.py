"""Word-level operators on null and repeated ids."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_text_operators import benchmark_case, brute_hits, brute_lines

from drawscope.llm import decontam, jaccard, linededup, textbytes


def test_nameless_items_are_not_called_null(spark):
    d = spark.createDataFrame([(None, "q w e r")], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "h", "doc")})
    for chars in (1 << 20, 3):
        b = spark.createDataFrame([("null", "q w"), (None, "e r"), (None, "w e"), ("x", None)], "item_id string, text string")
        r = decontam.decontaminate(d, b, block_chars=chars).first()
        assert list(r["__hits"]["items"]) == ["null", None] and [(s.lo, s.hi) for s in r["__hits"].spans] == [(0, 4)] and r["row"] == "clash"


def marked(index, text):
    for _, _, data, offsets in textbytes.chunks(pa.array([text])):
        _, spans, found = decontam.mark(index, data, offsets)
    return spans[0], found[0]


def test_words_that_share_a_hash_split_a_hit(monkeypatch):
    words = [f"w{i}" for i in range(25)]
    other = [*words[:12], "no", *words[13:]]
    plain = textbytes.words
    code = {t: plain(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])).hash[0] for t in ("no", "w12")}

    def alike(data, offsets, *kinds):
        found = plain(data, offsets, *kinds)
        found.hash[found.hash == code["no"]] = code["w12"]  # as if both words had one hash
        return found

    monkeypatch.setattr(textbytes, "words", alike)
    one = decontam.build_index([("a", " ".join(words))])
    assert marked(one, " ".join(words)) == ([(0, 25)], ["a"])
    assert marked(one, " ".join(other)) == ([(0, 12), (13, 25)], ["a"])
    both = decontam.build_index([("a", " ".join(words)), ("b", " ".join(other)), ("c", "w12 w3"), ("d", "no w3")])
    assert marked(both, " ".join(words[8:20])) == ([(0, 12)], ["a"])
    assert marked(both, " ".join(other[8:20])) == ([(0, 12)], ["b"])
    assert marked(both, "no w3 x") == ([(0, 2)], ["d"]) and marked(both, "x W12 w3") == ([(1, 3)], ["c"])


def test_repetitive_texts_against_plain_ones():
    rng = random.Random(1)
    for case in range(60):
        size = rng.choice([1, 2, 3])
        some = [f"w{i}" for i in range(size)]
        items = [(f"i{n % 7}", " ".join(rng.choice(some) for _ in range(rng.choice([1, 4, 9, 10, 11, 40])))) for n in range(12)]
        items += [("p", "a b c " * rng.choice([3, 30])), ("q", "a " * rng.choice([9, 10, 50]))]
        docs = [" ".join(rng.choice([*some, "z"]) for _ in range(rng.choice([0, 5, 10, 30, 200]))) for _ in range(6)] + ["b c a " * 40, "a " * 30, "a b c " * 3 + "x " + "b " * 10]
        index = decontam.build_index(items)
        for _, _, data, offsets in textbytes.chunks(pa.array(docs)):
            n, spans, found = decontam.mark(index, data, offsets)
        got = [(int(c), sum(b - a for a, b in x), f) for c, x, f in zip(n, spans, found, strict=True)]
        assert got == brute_hits(docs, items), case


def test_work_follows_from_the_words():
    began = time.perf_counter()
    assert marked(decontam.build_index([("a", "word " * 20_000)]), "word " * 20_000) == ([(0, 20_000)], ["a"])
    assert time.perf_counter() - began < 2
    opening = " ".join(f"o{i}" for i in range(40))
    index = decontam.build_index([(f"{n:05d}", f"{opening} " + " ".join(f"x{n}y{i}" for i in range(20))) for n in range(10_000)])
    docs = pa.array([f"so {opening} {n}" for n in range(100)])
    began = time.perf_counter()
    for _, _, data, offsets in textbytes.chunks(docs):
        _, spans, found = decontam.mark(index, data, offsets)
    assert time.perf_counter() - began < 100 * 0.02
    assert all(s == [(1, 41)] and len(f) == 10_000 for s, f in zip(spans, found, strict=True))


@pytest.mark.parametrize("block_chars", [1 << 20, 700, 60])
def test_each_row_is_marked_on_its_own(spark, block_chars):
    docs, items = benchmark_case()
    d = spark.createDataFrame([(None if n % 3 == 0 else n % 7, t, n) for n, t in enumerate(docs)], "doc_id long, text string, row long")
    b = spark.createDataFrame(items, "item_id string, text string")
    out = decontam.decontaminate(d, b, block_chars=block_chars)
    rows = out.orderBy("row").collect()
    got = [(r["__hits"].n_words, sum(s.hi - s.lo for s in r["__hits"].spans), list(r["__hits"]["items"])) for r in rows]
    want = brute_hits(docs, items)
    assert len(got) == len(want) and sum(g != w for g, w in zip(got, want, strict=True)) == 0
    assert out.columns == [*d.columns, "__hits"] and [r.doc_id for r in rows] == [None if n % 3 == 0 else n % 7 for n in range(len(docs))]


def test_links_of_every_text_of_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    # 6 and 7 are near copies of the two texts of id 5; 9 has 8's text and 3's; null ids take part.
    rows = [(5, a), (5, b), (6, f"{a} end"), (7, f"{b} end"), (9, c), (9, "other words"), (3, "other words"), (8, f"{c} end"), (4, "alone"), (None, f"{c} End"), (None, "one"), (None, "one"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.similar(d).collect()
    assert sorted(map(str, ((r.id, r.class_id, r.n_links, r.n_copies) for r in got))) == sorted(
        map(str, [(5, 5, 1, 1), (6, 5, 1, 1), (5, 5, 1, 1), (7, 5, 1, 1), (9, 8, 1, 1), (8, 8, 1, 2), (None, 8, 1, 2), (9, 3, 0, 2), (3, 3, 0, 2), (4, 4, 0, 1), (None, None, 0, 2), (None, None, 0, 2), (None, None, 0, 1)])
    )
    assert len({r.class_no for r in got if r.id == 5}) == 2
    kept = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(d).collect()), key=str)
    assert kept == sorted([(5, a), (5, b), (8, f"{c} end"), (3, "other words"), (4, "alone"), (None, "one"), (None, None)], key=str)


def test_no_unique_text_is_lost_where_ids_repeat(spark):
    rows = [(3, "A one"), (7, "A one"), (7, "Z two"), (9, "Q three"), (9, "Q three")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in jaccard.keep_one(d).collect()) == [(3, "A one"), (7, "Z two"), (9, "Q three")]


@pytest.mark.parametrize("parts", [1, 3])
def test_lines_are_cut_from_their_own_row_only(spark, parts):
    rows = [(1, "boiler", "s1"), (2, "boiler", "s2"), (2, "unique", "s3"), (None, "boiler\nmine", "s4"), (None, "only null\nboiler", "s5"), (2, "x\nboiler\ny", "s6")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("row", "cut", "doc", "__cut", "__id", "__n_cut")}).repartition(parts)
    got = linededup.dedup_lines(d, 2)
    assert got.columns == [*d.columns[:-1], "__n_lines", "__n_cut"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(brute_lines(rows, 2), key=str)
    assert sorted(r["__n_cut"] for r in got.collect()) == [0, 0, 1, 1, 1, 1]
