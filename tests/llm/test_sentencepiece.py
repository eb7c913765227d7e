"""SentencePiece ids and texts against the library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from drawscope.llm import queries, sentpiece
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = queries.PIECES
PARTS = ["a", "b", "e", "t", "h", "i", "n", " ", "  ", "\n", ".", ",", "1", "▁", "é", "日", "ः", "𝔘", "<s>", "</s>", "<0x0A>", "   ", " the", "\t", "\x00", "ing", "--", "==", "aaaa", "̀"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def mine():
    return sentpiece.model(PATH)


def ids(coder, texts):
    return [x.tolist() for x in coder.encode(pa.array(texts, pa.string()))]


def test_random_texts(library, mine):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(20_000)]
    want = library.encode(texts)
    assert ids(mine, texts) == want
    counts = np.array([len(x) for x in want])
    assert mine.decode(np.concatenate([np.array(x, np.int64) for x in want]), counts) == library.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_any_texts(texts):
    library, mine = sentencepiece.SentencePieceProcessor(model_file=PATH), sentpiece.model(PATH)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids(mine, texts) == library.encode(texts)


def test_long_words_and_pieces_of_equal_score(library, mine):
    rng = random.Random(2)
    texts = [" " * 5000 + "x", " the quick" * 3000, "a" * 3000, "x" * 700 + "日" * 700, "abcdefghij" * 400, "ab" * 200, "=-" * 180, " " * 300, " " * 511, " " * 30 + "the" + " " * 17]
    texts += ["".join(rng.choice("etaoinshrEN=-") for _ in range(500)) for _ in range(200)]
    assert ids(mine, texts) == library.encode(texts)
    word = "".join(rng.choice("etaoinshr") for _ in range(400))
    sym, sizes = mine._symbols([word])
    ((_, by_rounds, _),) = mine._rounds(sym, sizes)
    assert by_rounds.tolist() == mine._from_heap(sym).tolist()


def test_a_very_long_word_is_no_square(library, mine):
    word = "".join(random.Random(3).choice("etaoinshrdlu") for _ in range(200_000))
    assert ids(mine, [word]) == library.encode([word])


def test_ids_that_are_no_text(library, mine):
    rng = random.Random(4)
    some = [0, 1, 2, 3 + 0xE3, 3 + 0x81, 3 + 0x82, 3 + 0x41, 3 + 0xFF, 3 + 0xF0, 3 + 0x9F, 28705, 264, 259, 5000, 28717]
    rows = [[rng.choice(some) for _ in range(rng.randrange(10))] for _ in range(10_000)]
    got = mine.decode(np.array([i for r in rows for i in r], np.int64), np.array([len(r) for r in rows]))
    assert got == library.decode(rows)


def test_nothing_is_remembered_but_the_ids_stay(library):
    texts = ["the same words and the same words", "other words", "é1 é2 é1"]
    assert ids(sentpiece.Rounds(PATH, remembered=1), texts * 2) == library.encode(texts * 2)


def test_query_and_odd_rows(spark, library, tmp_path):
    rows = [(1, None, "x"), (2, "", "x"), (3, " a\n", "x"), (3, " a\n", "x"), (None, "x " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc, text, _ in rows:
        found = [*library.encode(text or ""), library.eos_id()]
        want.append((doc, len(found), sha(" ".join(map(str, found))), sha(library.decode(found))))
    got = queries.op13_sentencepiece(spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    coded = sentpiece.encode(df, PATH)  # a column called ids is replaced, the others stay
    assert coded.columns == ["doc_id", "text", "ids"]
    assert sentpiece.encode(df.limit(0), PATH, end=False).count() == 0
    loose = spark.createDataFrame([(1, [264]), (2, None), (3, [])], "k int, ids array<int>")
    assert [r.decoded for r in sentpiece.decode(loose, PATH).orderBy("k").collect()] == [library.decode([264]), "", ""]


def test_query_on_the_smallest_documents(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op13_sentencepiece(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        want = [*library.encode(texts[r.doc_id] or ""), library.eos_id()]
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
