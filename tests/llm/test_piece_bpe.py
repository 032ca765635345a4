"""SentencePiece encoding and decoding against the library itself."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sondage.llm import piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "abethinorsl.,  ▁\n\t\x00éñç中文字🙂İß0123<>/=-—βγД�"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return piece_bpe.PieceBpe(PATH)


def ids_of(own, texts):
    return [np.frombuffer(x, np.int32).tolist() for x in own.encode(texts)]


def test_odd_texts(own, library):
    r = random.Random(3)
    texts = ["".join(r.choices(LETTERS[: r.choice([12, 17, len(LETTERS)])], k=r.randrange(50))) for _ in range(6000)]
    texts += ["", " ", "  ", "▁", "\n", "<s>", "</s> <unk>", "<0x0A>", "the " * 40, "=-" * 300, "中" * 700, "🙂🙂"]
    assert ids_of(own, texts) == library.encode(texts)
    assert [own.decode(x) for x in library.encode(texts)] == [library.decode(x) for x in library.encode(texts)]


def test_overlapping_pairs_and_long_words(own, library, monkeypatch):
    """Runs in which the best pair overlaps itself, in rounds and from the heap."""
    r = random.Random(4)
    texts = ["a" * n for n in range(1, 60)] + [" " * n + "x" for n in range(60)] + ["".join(r.choices("aen", k=n)) for n in range(1, 400)]
    want = library.encode(texts)
    assert ids_of(own, texts) == want
    for long in (2, 10**9):
        monkeypatch.setattr(piece_bpe, "LONG", long)
        assert ids_of(piece_bpe.PieceBpe(PATH), texts) == want


def test_portions_and_a_full_memo(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "PORTION", 7)
    monkeypatch.setattr(piece_bpe, "MEMO", 5)
    monkeypatch.setattr(piece_bpe, "MEMO_CHARS", 4)
    r = random.Random(5)
    texts = ["".join(r.choices("ab  ethn\n", k=r.randrange(80))) for _ in range(500)] + [None]
    assert ids_of(piece_bpe.PieceBpe(PATH), texts) == [*library.encode(texts[:-1]), []]


def test_any_ids_decode(own, library):
    r = random.Random(6)
    for _ in range(6000):
        ids = [r.choice([0, 1, 2, r.randrange(3, 259), r.randrange(259, 32000), 28705]) for _ in range(r.randrange(9))]
        assert own.decode(ids) == library.decode(ids), ids


def test_tables(spark, library):
    """Null, empty, long and repeated texts, clashing columns, an empty table."""
    long = "Ein langer Text, der lang ist. " * 40_000
    rows = [(1, None, "x"), (2, "", "x"), (3, " two  words\n", None), (3, " two  words\n", None), (None, "naïve 中文", "y"), (6, long, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string").withColumn("ids", F.lit(7)).repartition(2)
    made = piece_bpe.decode(piece_bpe.encode(df, PATH), PATH)
    assert sorted(made.columns) == ["decoded", "doc_id", "ids", "text"]
    got = sorted(((r["doc_id"] or 0, r["text"] or "", r["ids"], r["decoded"]) for r in made.collect()), key=str)
    assert got == sorted(((i or 0, t or "", library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows), key=str)
    assert piece_bpe.encode(df.limit(0), PATH).count() == 0


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"")
    with pytest.raises(ValueError):
        piece_bpe.PieceBpe(str(tmp_path / "m"))
