"""SentencePiece against the library's own search, and round trips."""

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from sentencepiece import sentencepiece_model_pb2

from fieldsheet.llm import pieces
from fieldsheet.llm.queries import MODEL


@pytest.fixture(scope="module")
def model():
    """The vocabulary as one of independent pieces; scores of pieces that stand for runs of spaces get a usual size, which the library needs."""
    with open(MODEL, "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    proto.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.UNIGRAM
    for p in proto.pieces:
        p.score = max(p.score, -40000)
    return proto.SerializeToString()


TEXTS = ["", " ", "  a  b ", "The river and the people of the old town", "日本語テキスト😀 x", "a" * 200, "\n\n\t x", "xyzzy" * 30, "Übergröße, déjà vu!", "the" * 90]


def _ids(vocabulary, texts):
    return [np.frombuffer(b, "<i4").tolist() for b in vocabulary.encode_many(texts, {})]


def _score(vocabulary, ids):
    return sum(vocabulary.scores[i] if i not in set(vocabulary.bytes) else 0 for i in ids)


def test_ids_are_the_library_s(model):
    vocabulary, library = pieces.Vocabulary(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text, got in zip(TEXTS, _ids(vocabulary, TEXTS)):
        want = library.encode(text)
        assert got == want or _score(vocabulary, got) == _score(vocabulary, want)


def test_stream_equals_lanes():
    vocabulary = pieces.load(MODEL)
    for text, got in zip(TEXTS, _ids(vocabulary, TEXTS)):
        marked = pieces.SPACE + text.replace(" ", pieces.SPACE) if text else ""
        assert list(vocabulary.stream(marked)) == got
        if 0 < len(marked) <= pieces.LANE and len(marked.split(pieces.SPACE)) == 2:
            assert np.frombuffer(vocabulary.lanes([marked])[0], "<i4").tolist() == got


def test_stream_gives_ids_early_and_holds_little():
    vocabulary, seen = pieces.load(MODEL), [0]

    def chars():
        for k in range(20000):
            seen[0] = k
            yield "abcdefgh"[k * k % 8]
    ids = vocabulary.stream(chars())
    next(ids)
    assert seen[0] < 4 * pieces.COMMIT_EVERY


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    vocabulary = _loaded()
    assert vocabulary.decode(_ids(vocabulary, [text])[0]) == text.replace(pieces.SPACE, " ")


def _loaded(held=[]):  # noqa: B006
    if not held:
        held.append(pieces.load(MODEL))
    return held[0]


def test_frames(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "The river", "x"), (3, "The river", "x"), (None, "é" * 5000 + " " + "ab" * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.decode(pieces.encode(df, _loaded()), _loaded())
    got = out.collect()
    assert [r["decoded"] for r in got] == [r[1] for r in rows] and got[0]["ids"] is None and got[1]["ids"] == []
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert pieces.decode(pieces.encode(df.limit(0), _loaded()), _loaded()).collect() == []
