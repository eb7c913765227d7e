"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from drawscope.llm import phrases, queries
from pyspark.sql import functions as F

FOLD = {i: i + 32 for i in range(65, 91)}


def plain(docs, least, top, keep_under=80):
    counts, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD)):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    out = []
    for lang in total:
        known = {w: a for (x, w), a in counts.items() if x == lang and a >= least and len(w) > 1}
        rows = []
        for w, a in known.items():
            if any(len(v) > len(w) and 100 * b >= keep_under * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for v, b in known.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[lang, w[:j]] + counts[lang, w[j:]]), j, counts[lang, w[:j]], counts[lang, w[j:]]) for j in range(1, len(w)))
            rows.append((-score, -a, " ".join(w).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("block", [phrases.BLOCK, 37])
def test_mining_equals_plain_counting(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK", block)
    rng = random.Random(block)
    some = ["a", "b", "C", "the", "Été", "été", "x-y", "q", "日本", " ", "  ", "\t"]
    sep = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"]
    docs = [("".join(rng.choice(some) + rng.choice(sep) for _ in range(rng.randrange(120))), rng.choice(["en", "fr", None])) for _ in range(150)]
    docs += [(None, "en"), ("", "de"), ("a b c the " * 400, "hot")] + [("one two three four five", "en")] * 40
    df = spark.createDataFrame([(t, x, 1) for t, x in docs], "text string, lang string, n int").repartition(5)
    assert sorted(map(tuple, phrases.mine(df, 5, 60).collect())) == plain(docs, 5, 60)


def test_what_stands_around_a_phrase_is_its_texts_own():
    texts = ["a b c d", "e", "", "f g. h i j", "k"]

    def found(parts):
        out = []
        for part in parts:
            raw = [t.encode() for t in part]
            row, place, _ = phrases.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            around = phrases.surroundings(row)
            for k in (1, 2):
                at = place[: len(place) - k + 1]
                out += [(int(row[i]), int(c)) for i, c in zip(at, phrases.context(around, at, k), strict=True) if row[i + k - 1]]
        return sorted(out)

    assert found([texts]) == found([[t] for t in texts]) == found([texts[:2], texts[2:]])


def test_tree_of_many_parts(spark):
    rows = spark.range(200, numPartitions=70).select(F.lit(3).alias("piece"), F.spark_partition_id().alias("part"), F.lit(np.array([1, 5], "<i8").tobytes()).alias("counts"))
    (r,) = phrases.tree_sum(rows).collect()
    assert (r.piece, np.frombuffer(r.counts, "<i8").tolist()) == (3, [200, 1000])


def test_perfect_hash_is_minimal_and_knows_its_keys():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        h, g = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
        made = phrases.PerfectHash.unpacked(phrases.PerfectHash.build(h, g).packed())
        assert sorted(made.slots(h, g).tolist()) == list(range(n))
        assert (made.slots(h, g + np.uint64(1)) == -1).all() and (made.slots(g, h) == -1).all()
        assert len(made.bits) * 64 <= 4 * n + 64 * 8
    with pytest.raises(ValueError, match="repeat"):
        phrases.PerfectHash.build(np.ones(2, np.uint64), np.ones(2, np.uint64))


def test_scores_beyond_64_bits(spark, monkeypatch):
    a = 9 * 10**12
    rows = spark.createDataFrame([("en", 2, "x y", a, a + 1, a, 0, 0, 0, 0), ("en", 3, "x y z", a - 5, a, a, a, a, 0, 0)], "lang string, k int, phrase string, a long, l1 long, r1 long, l2 long, r2 long, l3 long, r3 long")
    total = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    monkeypatch.setattr(phrases, "counted_phrases", lambda *_: (rows, total))
    # The shorter one lies in the longer; of the longer one's equal cuts the first counts.
    assert [tuple(r) for r in phrases.mine(rows).collect()] == [("en", 1, "x y z", a - 5, a, a, 10**14, 2_000_000 * (a - 5) // (2 * a))]


def test_nothing_frequent(spark):
    df = spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")
    assert phrases.mine(df).count() == 0 and phrases.mine(df.limit(0)).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_its_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(queries.OP12_SQL)
    columns = [c[0] for c in want.description]
    got = queries.op12_phrase_mining(spark, folder).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) >= 50


def test_stored_words_are_read_few_rows_at_a_time(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(k) for k in keys]
    with phrases.small_batches(spark, 64):
        assert [spark.conf.get(k) for k in keys] == ["64", "64"]
    assert [spark.conf.get(k) for k in keys] == before
