import random

import numpy as np
import pytest

from lodestone.llm import pieces
from tests.llm.helpers import ODD, docs, prose


@pytest.fixture(scope="module")
def codec():
    with open(pieces.VOCABULARY, "rb") as f:
        return pieces.Codec(f.read())


def plain_best(codec, text):
    """The best score of any path over the whole text, by trying every piece at every position."""
    text = (" " + text).replace(" ", pieces.SPACE)
    score = dict((p, s) for p, (_, _, s) in codec.automaton.items())
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + codec.unknown
        for start in range(max(0, end - 64), end):
            if text[start:end] in score:
                best[end] = max(best[end], best[start] + score[text[start:end]])
    return best[-1]


def score_of(codec, ids):
    """A path's score: byte pieces cost as unknown characters do, once for each character."""
    value = {i: s for _, (_, i, s) in codec.automaton.items()}
    total, run = 0.0, b""
    for i in [*ids, None]:
        if i is not None and i not in value:
            run += codec.surface[i]
            continue
        total, run = total + codec.unknown * len(run.decode()), b""
        total += value.get(i, 0.0)
    return total


def test_viterbi_equals_brute_force(codec):
    rng = random.Random(2)
    texts = [prose(i, 12) for i in range(20)] + ["".join(rng.choice("ab  ceé\nß1🙂") for _ in range(60)) for _ in range(60)] + ["  two  spaces ", "\n\n", "tab\tbed"]
    for t in texts:
        assert score_of(codec, codec.encode(t)) == pytest.approx(plain_best(codec, t)), t


def test_round_trip_is_exact(codec):
    for t in [x for x in ODD if x] + ["▁▁ a▁", "▁", " ", "\x00", "a\r\nb", "ſ́"]:
        assert codec.decode(codec.encode(t)) == t
    assert codec.encode("") == [] and codec.decode([]) == ""


def test_frames(spark, codec):
    texts = ODD + [prose(3)]
    frame = docs(spark, texts)
    encoded = pieces.encode(frame)
    assert {r["doc_id"]: r["text"] for r in pieces.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(texts)}
    rows = {r["doc_id"]: r for r in pieces.digest(frame).collect()}
    assert all(r["exact"] for r in rows.values()) and rows[0]["n_tokens"] == 0
    import hashlib

    assert rows[3]["ids_sha256"] == hashlib.sha256(np.array(codec.encode("word"), "<i4").tobytes()).hexdigest()
    assert pieces.digest(docs(spark, [])).collect() == []


def test_words_are_cut_after_letters(codec):
    words = ["Haus", "été", "naïve", "x²", "§a", "don", "l’eau", "कि", "e\u0301t"]
    for w in words:
        for after in [",", ".", "!!", "'s", "-mail", "2", "_a", "\t", "†", "🙂"]:
            assert score_of(codec, codec.encode(w + after)) == pytest.approx(plain_best(codec, w + after)), w + after
    codec.paths.clear()
    codec.encode("fanserinth fanserinth, fanserinth. fanserinth!")
    assert [w for w in codec.paths if "fanserinth" in w] == [pieces.SPACE + "fanserinth"]


def test_pieces_that_go_on_after_letters():
    assert pieces._words(["a", "b", ".", ","]).findall("▁ab,▁▁a.b\n1") == ["▁ab", ",", "▁▁a", ".b", "\n", "1"]
    assert pieces._words(["a", "b", ".", "a,"]).findall("▁ab,▁▁a.b\n1") == ["▁ab,", "▁▁a", ".b", "\n", "1"]
    assert pieces._words([".", ","]).findall("▁ab,▁") == ["▁ab,", "▁"]
