"""The layered matcher on posts made by hand, large dictionaries in blocks, odd rows; whole results are held against SQL."""

import random
import re

import pytest
from pyspark.sql import functions as F

from trendloom.operators import brands, dictionary, extraction, layers

RULES = layers.Rules(rejects=("the",), products=("serum",))


@pytest.fixture(scope="module")
def names(spark):
    whitelist = spark.createDataFrame([(n, n.title()) for n in ("fenty beauty", "fenty", "arcteryx", "ring", "my skin", "serum", "l oreal", "one two three four five")], "norm string, display string")
    of = lambda rows: spark.createDataFrame(rows, "name string, brand string, pos int")
    known = spark.createDataFrame([("apple", 6e-5), ("coach", 9e-5), ("hoka", 0.0), ("ring", 9e-5)], "name string, freq double")
    return layers.dictionary(whitelist, of([("fentybeauty", "Fenty Beauty", 0)]), of([("airpods", "Apple", 0), ("iphone", "Apple", 1)]), known, RULES)


def found(spark, names, texts, community=lambda i: f"c{i}", **more):
    posts = spark.createDataFrame([(i, t, community(i)) for i, t in enumerate(texts)], "mention_id long, ner_input string, community string")
    hits = layers.hits(posts, names, RULES, keep=["community"], **more).persist()
    told = layers.decided(hits, layers.statistics(hits), RULES, keep=["community"]).persist()
    out = [{} for _ in texts], [{} for _ in texts]
    for r in layers.matches(told).collect():
        out[0][r["mention_id"]][r["norm"]] = (r["brand"], r["confidence"], r["source"], r["evidence"])
    for r in layers.review(told).collect():
        out[1][r["mention_id"]][r["norm"]] = (r["candidate"], r["score"], r["evidence"])
    return out


def test_layers_by_hand(spark, names):
    texts = [
        "we like Fenty Beauty",  # the longer name takes the shorter one's place
        "an Arc'teryx jacket and L’Oréal cream",  # without the sign, and with folded signs
        "a ring and a Ring",  # the small one is no name, the word is known all the same
        "a nice kitchen. My Skin is good",  # begins a sentence
        "and so My Skin is good",
        "new iphone and airpods",  # the first line listed decides
        "bought apple juice",  # against it
        "bought an apple",  # common, beside a sign of brands
        "I saw an apple",
        "HOKA and fentybeauty",
        "bought BURN today",
        "Serum",
        "One two three four five",  # more than four words
        "sold at Gap on the corner of CeraVe",
        None,
        "",
    ]
    told, waits = found(spark, names, texts)
    assert told[0] == {"fenty beauty": ("Fenty Beauty", 1.0, "whitelist", "whitelist_match")}
    assert set(told[1]) == {"arcteryx", "l oreal"}
    assert set(told[2]) == {"ring"} and told[2]["ring"][2] == "whitelist"
    assert "my skin" not in told[3] and told[4]["my skin"][1] == 1.0
    assert told[5] == {"apple": ("Apple", 0.95, "product_line", "product_line:airpods")}
    assert told[6] == {} and told[8] == {}
    assert told[7] == {"apple": ("Apple", 0.85, "known_brand", "known_brand+ctx")}
    assert {k: v[2] for k, v in told[9].items()} == {"hoka": "known_brand", "fentybeauty": "alias"}
    assert told[10]["burn"] == ("BURN", 0.8, "candidate", "allcaps,uncommon,brand_ctx")
    assert told[11] == told[12] == told[14] == told[15] == {}
    assert waits[13] == {} and "cerave" not in told[13]  # 0.20 + 0.20 - 0.40 beside "on the"


def test_communities_help(spark, names):
    few, _ = found(spark, names, ["use CeraVe please"] * 3, lambda i: "one")
    some, waits = found(spark, names, ["use CeraVe please"] * 3)
    assert few[0] == {} and some[0] == {}
    assert waits[0]["cerave"][1:] == (0.5, "camelcase,uncommon,+3comm")
    many, _ = found(spark, names, ["use OPI please"] * 4)
    assert many[0] == {} and found(spark, names, ["shop OPI please"] * 4)[0][0]["opi"][1:] == (0.9, "candidate", "allcaps,uncommon,brand_ctx,+4comm")


def test_large_dictionary_in_blocks(spark):
    """100,000 names: what is found is what a set of them finds; no name stands in the plan; blocks change nothing."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
    many = sorted({" ".join(word() for _ in range(rnd.choice((1, 1, 2, 3)))) for _ in range(110_000)})
    table = spark.createDataFrame([(n,) for n in many], "name string")
    texts = [" ".join(rnd.choice((word(), rnd.choice(many))) for _ in range(30)) for _ in range(60)]
    posts = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    told, own = {}, set(many)
    for size in (200_000, 30_000):
        got = set()
        for block in dictionary.blocks(table, table, size):
            rows = dictionary.with_places(posts, "text", block)
            assert len(rows._jdf.queryExecution().toString()) < 20_000
            for r in rows.collect():
                got |= {("whole", r["id"], g["name"], g["at"], g["size"]) for g in r["grams"]} | {("part", r["id"], p["name"], p["at"]) for p in r["parts"]}
        told[size] = got
    assert told[200_000] == told[30_000]
    want = set()
    for i, text in enumerate(texts):
        words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        for n in (1, 2, 3, 4):
            for k in range(len(words) - n + 1):
                gram = [w[0] for w in words[k : k + n]]
                name = next((x for x in (" ".join(gram), "".join(gram)) if x in own), None)
                if name:
                    want.add(("whole", i, name, words[k][1], words[k + n - 1][2] - words[k][1]))
    assert {x for x in told[30_000] if x[0] == "whole"} == want
    first = {("part", i, n, text.find(n)) for i, text in enumerate(texts[:3]) for n in many if n in text}
    assert {x for x in told[30_000] if x[0] == "part" and x[1] < 3} == first


def test_places_apart(spark):
    block = dictionary.blocks(spark.createDataFrame([(n,) for n in ("a b", "b c", "b c d", "d")], "name string"), spark.createDataFrame([], "name string"))[0]
    rows = dictionary.with_places(spark.createDataFrame([("A b, C-d d",)], "t string"), "t", block, apart=True).first()
    assert [(g["name"], g["at"], g["size"], g["gram"]) for g in rows["grams"]] == [("b c d", 2, 6, "b C d"), ("d", 9, 1, "d")]


def test_posts_of_brands(spark):
    own = spark.createDataFrame([("c", "Ab"), ("c", "b x"), ("d", "Ab"), ("c", "gone")], "category string, brand string")
    posts = spark.createDataFrame([(1, "c", "xABx", None, 1.0), (2, "c", None, "ab x", 5.0), (3, "d", "a", "b", 9.0), (4, "d", "AB", "ab", 2.0)], "mention_id int, category string, text string, title string, engagement double")
    got = {(r["category"], r["brand"], r["mention_id"], r["rank"]) for r in brands.brand_posts(own, posts, 1).collect()}
    assert got == {("c", "Ab", 2, 1), ("c", "b x", 2, 1), ("d", "Ab", 4, 1)}


def test_odd_rows(spark, names):
    posts = spark.createDataFrame([(1, "Fenty Beauty", 2, "s")], "mention_id long, ner_input string, layer int, source string")
    with pytest.raises(ValueError, match="layer"):
        layers.hits(posts, names, RULES, keep=["layer"])
    assert layers.hits(posts.limit(0), names, RULES).count() == 0
    assert {(r["layer"], r["norm"]) for r in layers.hits(posts, names.limit(0), RULES).collect()} == {(5, "fenty beauty"), (5, "beauty")}
    long = spark.createDataFrame([(1, "x " * 200_000 + "Fenty Beauty " + "y " * 200_000)], "mention_id long, ner_input string")
    assert {r["norm"] for r in layers.hits(long, names, RULES).where("layer = 1").collect()} == {"fenty beauty", "fenty"}


def test_tables(spark):
    rows = [("c", "A", i, True, 0.5, 1.0, "whitelist", f"e{i}") for i in range(3)] + [("c", "A", 9, False, -1.0, 1.0, "alias", "x"), ("c", "B", 1, True, 0.1, 1.0, "s", "e")]
    rows += [(f"k{n}", "A" if n == 0 else f"B{n}", 10 + i, True, 0.0, 0.9, "s", "e") for n in range(5) for i in range(3)]
    facts = spark.createDataFrame(rows, "category string, brand string, mention_id long, is_cur boolean, sentiment double, confidence double, source string, evidence string")
    got = {(r["category"], r["brand"]): tuple(r)[2:] for r in layers.brand_tables(facts, ["mention_id"]).collect()}
    assert got["c", "A"] == (3, 1, 3.0, 0.5, 1.0, "whitelist", "e0", 1) and ("c", "B") not in got
    assert set(got) == {("c", "A"), ("k0", "A"), *((f"k{n}", f"B{n}") for n in range(1, 5))}


def test_gate_has_no_literal_names(spark):
    posts = spark.createDataFrame([(1, "Plain words of l’oréal here. Nothing else. I bought one.")], "id long, text string")
    rows = extraction.gated_sentences(posts, "id", "text", ["l'oreal", *(f"name{i}" for i in range(5000))])
    assert "name4999" not in rows._jdf.queryExecution().toString()
    assert {(r["at"], tuple(r["labels"])) for r in rows.collect()} == {(0, ("whitelist_brand_present",)), (2, ("purchase",))}
    assert extraction.gated_sentences(posts, "id", "text", []).count() == 1
    assert rows.select(F.size("labels")).count() == 2


def test_letters_beyond_ascii_as_in_sql(spark):
    from trendloom.functions import text as T

    one = lambda column: spark.range(1).select(column.alias("v")).first()["v"]
    assert [one(T.upper(F.lit(w))) for w in ("schß", "ﬁn", "ᾀ", "été", "")] == ["SCHẞ", "ﬁN", "ᾈ", "ÉTÉ", ""]
    assert [one(T.lower(F.lit(w))) for w in ("İSTANBUL", "ΟΔΟΣ", "ẞ")] == ["istanbul", "οδοσ", "ß"]
    assert T.small("İSTANBUL ΟΔΟΣ") == "istanbul οδοσ"
    # A boundary lies between a letter of ASCII and an accented one, so the words stand against a name and for it.
    posts = spark.createDataFrame([(0, "éon the license é"), (1, "on thé license"), (2, "the licenseé from"), (3, "ébuyé the license"), (4, "İ on the license")], "k long, t string")
    held = {r["k"] for r in extraction.alias_hits(posts, {"license": "L"}, "k", "t").collect()}
    assert held == {1, 2, 3}
    assert {r["k"] for r in extraction.line_hits(posts, "k", "t", {"license": "L"}).collect()} == held
    assert {r["k"] for r in extraction.known_hits(posts, "k", "t", {"license": 1.0}).collect()} == {2, 3}
    raws = [r["raw"] for r in one(layers.candidate_array(F.lit("CAFÉ ÉCOLE2 AB٣ ÉAB")))]
    assert raws == ["CAFE", "AB"]


def test_long_text_is_read_once(spark, names):
    """Patterns run once on a text, not once for each candidate; the texts stay in one scan."""
    import time

    own = [f"Q{chr(65 + i % 26)}{chr(65 + i // 26 % 26)}{chr(65 + i // 676)}x{i}X" for i in range(4_000)]
    capitals = [w.replace("x", "").upper() for w in own]
    posts = spark.createDataFrame([(1, ". ".join([*capitals, "Fenty Beauty", *capitals]), "a")], "mention_id long, ner_input string, community string")
    start = time.time()
    hits = layers.hits(posts, names, RULES, keep=["community"])
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = [(r["layer"], r["raw"]) for r in hits.collect()]
    assert {raw for layer, raw in got if layer == 5} == {*capitals, "Fenty Beauty", "Beauty"} - {w for w in capitals if len(w) > 8}
    assert len([1 for layer, _ in got if layer == 5]) == len({raw for layer, raw in got if layer == 5})
    assert time.time() - start < 20
    for text, parts in (("ab" * 30 + "c", ["ab", "ba", "c", "x"]), ("xyab" * 3_000_000, [*(f"z{i}" for i in range(3)), "ab", "ya"])):
        assert dictionary.first_places(text, parts) == {p: text.find(p) for p in parts}


def test_layers_read_whole_texts(spark, tmp_path):
    """Names and candidates beyond the first 400 characters count; the review's queries read what their SQL reads."""
    import shutil

    from trendloom.plans.queries import QUERIES

    shutil.copy("/root/testdata/sf0.001/benchmark.parquet", tmp_path)
    late = "x " * 400 + ". We bought ZQVX here, under the Apache licence; from apache."
    docs = [(i, late, "en", f"s{i}") for i in (1, 2, 4)] + [(5, None, "de", "s5"), (7, "from apache", "de", "s5")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["mention_id"], r["brand"], r["evidence"]) for r in QUERIES["brand_layers"](spark, str(tmp_path)).collect()}
    assert {k for k, brand, _ in got if brand == "Apache"} == {1, 2, 4, 7}
    assert {(k, e) for k, brand, e in got if brand == "ZQVX"} == {(k, "allcaps,uncommon,brand_ctx,+3comm") for k in (1, 2, 4)}
    assert QUERIES["brand_review"](spark, str(tmp_path)).where("candidate = 'ZQVX'").count() == 0


def test_tables_read_whole_texts(spark, tmp_path):
    import shutil

    from trendloom.plans.queries import QUERIES

    shutil.copy("/root/testdata/sf0.001/benchmark.parquet", tmp_path)
    late = lambda word: "x " * 400 + f". We bought {word} here."
    docs = [(i, late("ZQ" + "UVWX"[i % 5]), "en", f"s{i}") for i in (1, 11, 16, 21, 2, 7, 17, 5, 10, 20, 13)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["category"], r["brand"]): (r["cur_mentions"], r["prev_mentions"]) for r in QUERIES["brand_tables_layered"](spark, str(tmp_path)).collect()}
    assert got == {("en_0", "ZQU"): (3, 0), ("en_1", "ZQV"): (3, 1), ("en_2", "ZQW"): (3, 0)}


def test_context_tables_take_all_names(spark, tmp_path):
    """Names beyond the first 20,000 and beyond the first 400 characters count; blocks of names change nothing."""
    from trendloom.plans.queries import QUERIES

    word = lambda i: "q" + "".join(chr(97 + i // 26**n % 26) for n in range(4))
    spark.createDataFrame([(i, f"{word(i)} {word(i + 7)} and so on") for i in range(40_000)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    some = {d: [f"{word(i).title()} {word(i + 7).title()}" for i in range(d * 4_000, d * 4_000 + 3_900, 400)] for d in (1, 2, 4, 5, 8)}
    docs = [(d, "x " * 400 + ". " + " ".join(f"I bought {n}." for n in own), "en", "s") for d, own in some.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["category"], r["brand"]) for r in QUERIES["brand_tables_context"](spark, str(tmp_path)).where("source = 'whitelist'").collect()}
    assert got == {(f"en_{d % 5}", n) for d, own in some.items() for n in own}
    posts = spark.createDataFrame([(1, "We bought La Mer and Mer; it vs Merry Go works."), (2, "nothing of la mer here"), (3, None)], "id long, text string")
    shown = {"la mer": "La Mer", "mer": "MER", "merry": "Merry!", "go": "GO", "": "none"}
    names = spark.createDataFrame(list(shown.items()), "norm string, display string")
    told = lambda rows: sorted(map(str, rows.collect()))
    want = told(extraction.sentence_brands(posts, "id", "text", extraction.Lexicon({k: v for k, v in shown.items() if k}, frozenset({"serum"}))))
    assert want and all(told(extraction.listed_brands(posts, "id", "text", names, frozenset({"serum"}), size)) == want for size in (200_000, 2))
