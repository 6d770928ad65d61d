import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lineweave.functions import syllables as Y


@pytest.mark.parametrize(
    ("word", "want", "pieces"),
    [
        ("window", 2, "win|dow"),
        ("river", 2, "ri|ver"),
        ("finger", 2, "fing|er"),
        ("mother", 2, "mo|ther"),
        ("ticket", 2, "tick|et"),
        ("smiled", 1, "smiled"),
        ("lakes", 1, "lakes"),
        ("homework", 2, "home|work"),
        ("piano", 3, "pi|a|no"),
        ("Create", 2, "Crea|te"),
        ("sky", 1, "sky"),
        ("hmm", 1, "hmm"),
        ("idea", 3, "i|de|a"),
        ("chaos", 2, "cha|os"),
    ],
)
def test_pieces(word, want, pieces):
    assert Y.spelled(word, want) == pieces.split("|")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aeiouythngckqusrm", min_size=1, max_size=12), st.integers(1, 6))
def test_pieces_are_the_word_and_as_many_as_fit(word, want):
    pieces = Y.spelled(word, want)
    assert "".join(pieces) == word and all(pieces)
    assert len(pieces) == want or len(word) <= want or not any(c in "aeiouy" for c in word) or len(pieces) == 1
    assert "".join(Y.unknown(word)) == word


def test_phones():
    by = lambda phones, n: [" ".join(x) for x in Y.phones_of_syllables(phones.split(), n)]
    assert by("W IH N D OW", 2) == ["W IH N", "D OW"]
    assert by("S T R IY T", 1) == ["S T R IY T"]
    assert by("P IY AE N OW", 3) == ["P IY", "AE", "N OW"]
    assert by("AY", 1) == ["AY"]


def test_words_with_their_entries(spark):
    words = spark.createDataFrame([("Window",), ("window",), ("Window",), ("zzyx",), ("homemade",), ("",), (None,)], "word string")
    entries = spark.createDataFrame([("window", ["W IH N D", "W IH N D OW"])], "word string, entries array<string>")
    got = {}
    for r in Y.syllables(words, entries).orderBy("word", "entry", "k").collect():
        got.setdefault((r.word, r.entry), []).append((r.piece, r.phones))
    assert got[("Window", 1)] == [("Win", "W IH N"), ("dow", "D OW")] and got[("window", 0)] == [("window", "W IH N D")]
    assert [p for p, _ in got[("homemade", None)]] == Y.unknown("homemade") and len(got) == 6
    assert Y.syllables(words.limit(0), entries).collect() == []
