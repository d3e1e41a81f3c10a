"""Rules of sentiment by hand: each expected sum is written out."""

import math

import pytest

from trendloom.operators import sentiment
from trendloom.operators.sentiment import Manner, rated, scores

LEXICON = {"good": 1.9, "bad": -2.5, "great": 3.1, "love": 3.2, "doubt": -1.5, "no": -1.2, "heart": 2.0}


def compound(total):
    return round(total / math.sqrt(total * total + 15), 4)


@pytest.mark.parametrize(
    ("text", "total"),
    [
        ("a good thing", 1.9),
        ("very good", 1.9 + 0.293),
        ("It is very, very bad.", -2.5 - 0.293 - 0.293 * 0.95),
        ("slightly good", 1.9 - 0.293),
        ("it is really quite very good", 1.9 + 0.293 * (1 + 0.95 + 0.9)),
        ("it is not so good", (1.9 + 0.293) * -0.74 * 1.25),
        ("not good", 1.9 * -0.74),
        ("not a good one", 1.9 * -0.74),
        ("it isn't very good", (1.9 + 0.293) * -0.74),
        ("not too far away good", 1.9),
        ("GOOD thing", 1.9 + 0.733),
        ("GOOD THING", 1.9),
        ("VERY good", 1.9 + 0.293 + 0.733),
        ("VERY bad", -2.5 - 0.293 - 0.733),
        ("good!", 1.9 + 0.292),
        ("bad!!!!!!", -2.5 - 4 * 0.292),
        ("good??", 1.9 + 2 * 0.18),
        ("good?????", 1.9 + 0.96),
        ("good but bad", 1.9 * 0.5 - 2.5 * 1.5),
        ("never so good", (1.9 + 0.293) * 1.25),
        ("without a doubt good", (-1.5 * -0.74) + 1.9),
        ("the least good", 1.9 * -0.74),
        ("at least good", 1.9),
        ("no good", 0.0 + 1.9 * -0.74),
        ("my broken heart", 2.0),
        ("she has a broken heart", -2.9),
        ("kind of good", 1.9),
        ("it is kind of good", 1.9 - 0.293),
        ("plain words", 0.0),
    ],
)
def test_sums(text, total):
    assert scores(text, LEXICON, Manner())[0] == compound(total)


def test_parts():
    # 2.9 good, 3.5 bad with 0.292, one neutral.
    c, good, bad, rest = scores("good and bad!", LEXICON, Manner())
    whole = 2.9 + 3.5 + 0.292 + 1
    assert (good, bad, rest) == (round(2.9 / whole, 3), round(3.792 / whole, 3), round(1 / whole, 3)) and c == compound(1.9 - 2.5 - 0.292)
    assert scores("", LEXICON, Manner()) == (0, 0, 0, 0) and scores("...", {}, Manner()) == (0, 0, 0, 1)


def test_posts(spark):
    words = spark.createDataFrame([*LEXICON.items(), ("GOOD", 2.5), (None, 1.0), ("x", None)], "word string, valence double")
    posts = spark.createDataFrame([(1, "Very GOOD", "x " * 300 + "bad"), (2, None, "bad"), (3, "", None), (3, "", None)], "id int, title string, text string")
    got = rated(posts, words, "id", "text", "title").collect()
    assert sorted((r["id"], r["sentiment_compound"], r["sentiment_label"]) for r in got) == [(1, compound(1.9 + 0.293 + 0.733), "positive"), (2, compound(-2.5), "negative"), (3, 0.0, "neutral"), (3, 0.0, "neutral")]
    assert rated(posts.limit(0), words, "id", "text").count() == 0 and rated(posts, words.limit(0), "id", "text").count() == 4
    with pytest.MonkeyPatch.context() as m:
        m.setattr(sentiment, "MOST_LEXICON", 3)
        with pytest.raises(ValueError):
            rated(posts, words, "id", "text")
