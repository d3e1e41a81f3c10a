"""Rule-based sentiment: word valences with negation, intensity, capitals, contrast and punctuation, in one pass over a text."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import sentiment_label

# Weights of the rules.
MORE, LESS, CAPITALS, NEGATED = 0.293, -0.293, 0.733, -0.74
EXCLAMATION, QUESTION, MANY_QUESTIONS = 0.292, 0.18, 0.96
FADING = (1.0, 0.95, 0.9)  # of a booster one, two and three words before
BEFORE_BUT, AFTER_BUT, NEVER_SO, SOFTENING = 0.5, 1.5, 1.25, 15
# Words that negate, that strengthen and that weaken.
NEGATIONS = "aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't doesn't dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't mightn't mustn't neednt needn't never none nope nor not nothing nowhere oughtnt shant shouldnt uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't without wont wouldnt won't wouldn't rarely seldom despite".split()
STRONGER = "absolutely amazingly awfully completely considerable considerably decidedly deeply enormous enormously entirely especially exceptional exceptionally extreme extremely fabulously fully greatly hella highly hugely incredible incredibly intensely major majorly more most particularly purely quite really remarkably so substantially thoroughly total totally tremendous tremendously uber unbelievably unusually utter utterly very".split()
WEAKER = ["almost", "barely", "hardly", "just enough", "kind of", "kinda", "kindof", "kind-of", "less", "little", "marginal", "marginally", "occasional", "occasionally", "partly", "scarce", "scarcely", "slight", "slightly", "somewhat", "sort of", "sorta", "sortof", "sort-of"]
# Sayings with a valence of their own.
SAYINGS = {"the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0, "yeah right": -2.0, "kiss of death": -1.5, "to die for": 3.0, "broken heart": -2.9}
#: A lexicon is a dimension; one that grows past this is refused.
MOST_LEXICON = 200_000


@dataclass(frozen=True)
class Manner:
    """What changes a word's valence."""

    boosters: Mapping[str, float] = field(default_factory=lambda: dict.fromkeys(STRONGER, MORE) | dict.fromkeys(WEAKER, LESS))
    negations: frozenset[str] = frozenset(NEGATIONS)
    sayings: Mapping[str, float] = field(default_factory=lambda: dict(SAYINGS))

    def negates(self, word: str) -> bool:
        return word in self.negations or "n't" in word


def words_of(text: str) -> list[str]:
    """Tokens between white space without punctuation around them; two signs or fewer stay as they are."""
    bare = ((t, t.strip(string.punctuation)) for t in text.split())
    return [token if len(word) <= 2 else word for token, word in bare]


def valences(words: list[str], lexicon: Mapping[str, float], manner: Manner) -> list[float]:
    """Each word's valence after the rules, 0 for a word without one."""
    low = [w.lower() for w in words]
    loud = [w.isupper() for w in words]
    shouts = 0 < sum(loud) < len(words)
    return [0.0 if w in manner.boosters or w == "kind" and low[i + 1 : i + 2] == ["of"] or w not in lexicon else valence_at(i, low, loud, shouts, lexicon, manner) for i, w in enumerate(low)]


def valence_at(i: int, low: list[str], loud: list[bool], shouts: bool, lexicon: Mapping[str, float], manner: Manner) -> float:
    back = lambda k: low[i - k] if i >= k else ""
    own = lexicon[low[i]]
    v = own
    if low[i] == "no" and low[i + 1 : i + 2] and low[i + 1] in lexicon:
        v = 0.0
    if back(1) == "no" or back(2) == "no" or back(3) == "no" and back(1) in ("or", "nor"):
        v = own * NEGATED
    sign = lambda amount: amount if v > 0 else -amount
    if loud[i] and shouts:
        v += sign(CAPITALS)
    for k in (1, 2, 3):
        if i < k or low[i - k] in lexicon:
            continue
        if (step := manner.boosters.get(low[i - k], 0.0)) != 0.0:
            step = (-step if v < 0 else step) + (sign(CAPITALS) if loud[i - k] and shouts else 0.0)
            v += step * FADING[k - 1]
        between = [back(j) for j in range(1, k)]
        # With three words before, "so" or "this" right before the word is enough.
        if k > 1 and (back(k) == "never" and back(k - 1) in ("so", "this") or k == 3 and back(1) in ("so", "this")):
            v *= NEVER_SO
        elif not (k > 1 and back(k) == "without" and "doubt" in between) and manner.negates(back(k)):
            v *= NEGATED
        if k == 3:
            v = said(i, low, v, manner)
    if back(1) == "least" and "least" not in lexicon and (i < 2 or back(2) not in ("at", "very")):
        v *= NEGATED
    return v


def said(i: int, low: list[str], v: float, manner: Manner) -> float:
    """A saying around the word takes the place of its valence; boosters of two or three words before it add to it."""
    gram = lambda a, b: " ".join(low[i + a : i + b + 1])
    v = next((manner.sayings[g] for g in (gram(-1, 0), gram(-2, 0), gram(-2, -1), gram(-3, -1), gram(-3, -2)) if g in manner.sayings), v)
    for n in (1, 2):
        if i + n < len(low):
            v = manner.sayings.get(gram(0, n), v)
    return v + sum(manner.boosters.get(g, 0.0) for g in (gram(-3, -1), gram(-3, -2), gram(-2, -1)))


def scores(text: str, lexicon: Mapping[str, float], manner: Manner) -> tuple[float, float, float, float]:
    """Compound, positive, negative and neutral."""
    words = words_of(text)
    told = valences(words, lexicon, manner)
    if not told:
        return 0.0, 0.0, 0.0, 0.0
    low = [w.lower() for w in words]
    if "but" in low:
        at = low.index("but")
        told = [v * (BEFORE_BUT if i < at else AFTER_BUT if i > at else 1.0) for i, v in enumerate(told)]
    asked = text.count("?")
    emphasis = min(text.count("!"), 4) * EXCLAMATION + (0.0 if asked < 2 else asked * QUESTION if asked <= 3 else MANY_QUESTIONS)
    total = sum(told)
    total += emphasis if total > 0 else -emphasis if total < 0 else 0.0
    good, bad = sum(v + 1 for v in told if v > 0), sum(1 - v for v in told if v < 0)
    good, bad = good + emphasis * (good > bad), bad + emphasis * (bad > good)
    rest = sum(v == 0 for v in told)
    whole = good + bad + rest
    compound = max(-1.0, min(1.0, total / math.sqrt(total * total + SOFTENING)))
    return round(compound, 4), round(good / whole, 3), round(bad / whole, 3), round(rest / whole, 3)


def rated(posts: DataFrame, lexicon: DataFrame, key: str, text: str, title: str | None = None, most: int = 500, manner: Manner | None = None) -> DataFrame:
    """``key, sentiment_compound, sentiment_positive, sentiment_negative, sentiment_neutral, sentiment_label`` of each post.

    Rated are the title and the first ``most`` characters of the text. ``lexicon`` (word, valence), at most MOST_LEXICON
    rows, goes to the tasks; of a word with several valences the smallest counts. A contrast weighs words by place. Null
    and empty texts are neutral with all parts 0; rows are rated one by one, so repeated rows are rated alike.
    """
    manner = manner or Manner()
    rows = lexicon.where("word IS NOT NULL AND valence IS NOT NULL").groupBy(F.lower("word").alias("word")).agg(F.min("valence").cast("double").alias("valence")).limit(MOST_LEXICON + 1).collect()
    if len(rows) > MOST_LEXICON:
        raise ValueError(f"over {MOST_LEXICON} words")
    told = posts.sparkSession.sparkContext.broadcast({r["word"]: r["valence"] for r in rows})
    names = ["sentiment_compound", "sentiment_positive", "sentiment_negative", "sentiment_neutral"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [scores(t.as_py(), told.value, manner) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[k] for m in made], pa.float64()) for k in range(4))], names=[key, *names])

    body = F.substring(F.coalesce(F.col(text), F.lit("")), 1, most)
    whole = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), body) if title else body
    kind = posts.schema[key].dataType.simpleString()
    out = posts.select(key, whole.alias("__text")).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} double" for n in names))
    return out.withColumn("sentiment_label", sentiment_label(F.col("sentiment_compound")))
