"""Fill-in-the-middle, decontamination and conversation repair against brute force; odd rows for all; bounds of earlier operators."""

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.llm import conversation_repair as cr
from trendloom.llm import decontaminate, fill_middle, flat_graph, warc

DOCS = "doc_id long, text string, n long, items string, runs string, hash long, length int"  # names that operators use inside
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def docs_table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, 3) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


# Fill-in-the-middle


def filled_by_force(key, text, changed=90, spm=20):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = sha(f"1:{'' if key is None else key}")
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= changed:
        return len(tokens), "plain", None, None, text
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    return (len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle(spark):
    rnd = random.Random(5)
    signs = "abzAZ @[`{\n\té中\U0001f600<>PSM"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(400)] + ["<P", "S>", "a<", "<S", "x<M>y", "", None, "Z", "\U0001f600"]
    rows = fill_middle.fill_middle(docs_table(spark, texts)).withColumn("back", fill_middle.restored(F.col("form"), F.col("output"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:6] == filled_by_force(r["doc_id"], texts[r["doc_id"]])
        assert r["back"] == (texts[r["doc_id"]] or "")
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    how = fill_middle.FillMiddle(changed_percent=100, spm_percent=100)
    assert {r["form"] for r in fill_middle.fill_middle(docs_table(spark, ["one two", "three"]), how).collect()} == {"spm"}


def test_fill_middle_odd_rows(spark):
    long = "word 中" * 400_000
    rows = fill_middle.fill_middle(docs_table(spark, ["same", "same", None, "x y", long], [7, 7, None, None, 3]))
    assert rows.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = rows.withColumn("back", fill_middle.restored(F.col("form"), F.col("output"))).collect()
    assert sorted((str(r["doc_id"]), *tuple(r)[1:6]) for r in got if r["doc_id"] != 3) == sorted((str(k), *filled_by_force(k, t)) for k, t in ((7, "same"), (7, "same"), (None, None), (None, "x y")))
    own = next(r for r in got if r["doc_id"] == 3)
    assert tuple(own)[1:6] == filled_by_force(3, long) and own["back"] == long
    assert fill_middle.fill_middle(docs_table(spark, ["x"]).limit(0)).count() == 0


# Decontamination


def words_by_force(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def hits_by_force(text, items, width):
    words = words_by_force(text)
    places, found = set(), set()
    for item, own in items:
        own = words_by_force(own)
        n = min(width, len(own))
        for window in {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else ():
            for at in range(len(words) - n + 1):
                if tuple(words[at : at + n]) == window:
                    places |= set(range(at, at + n))
                    found.add(item)
    return len(words), places, sorted(map(str, found))


@pytest.mark.parametrize(("width", "block"), [(4, 1_000_000), (10, 1_000_000), (4, 7)])
def test_benchmark_hits(spark, width, block):
    """Few words, so windows of all lengths hit by chance; one item stands in many documents, another is repeated."""
    rnd = random.Random(width)
    vocabulary = ["ab", "Cd", "Éf", "éf", "7", "g中", "hij"]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice((" ", ", ", ".\n", "-")) for _ in range(n))
    items = [(i, text(rnd.choice((1, 3, 5, 11, 14, 25)))) for i in range(2, 14)] + [(100, None), (101, "..."), (1, text(12))]
    items += [(50, items[3][1].upper()), (items[4])]
    passage = items[5][1]
    texts = [text(rnd.randint(0, 60)) for _ in range(60)] + [f"{text(20)} {passage} {text(5)}" for _ in range(30)] + [None, "", "...", items[-1][1]]
    how = decontaminate.Contamination(words=width, block=block)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.contamination(docs_table(spark, texts), bench, how).collect()}
    assert len(rows) == len(texts)
    spans = {r["doc_id"]: r["text"] for r in decontaminate.clean(docs_table(spark, texts), bench, how).collect()}
    whole = {r["doc_id"] for r in decontaminate.clean(docs_table(spark, texts), bench, how, "documents").collect()}
    told = 0
    for i, t in enumerate(texts):
        n, places, found = hits_by_force(t, items, width)
        r = rows[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) == (n, len(places), len(found), found, bool(places)), i
        assert (i in whole) == (not places)
        words = words_by_force(t)
        assert words_by_force(spans[i]) == [w for j, w in enumerate(words) if j not in places]
        if not places:
            assert spans[i] == t
        told += bool(places)
    assert told > 30


def test_benchmark_hits_native(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    rows = decontaminate.scan(docs_table(spark, ["x"]), bench)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_benchmark_hits_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    bench = spark.createDataFrame([(None, item), (None, None), (3, item), (3, item), (20, "solo")], "item_id long, text string")
    long = "ander " * 150_000 + item + " erson" * 150_000
    table = docs_table(spark, [item, item, f"say {item}", "SOLO!", None, "", long], [7, 7, 7, None, None, 1, 2])
    rows = decontaminate.contamination(table, bench).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"])) for r in rows)
    want = [("7", 11, 11, 2, ("3",))] * 2 + [("7", 12, 11, 2, ("3",)), ("None", 1, 1, 1, ("20",)), ("None", 0, 0, 0, ()), ("1", 0, 0, 0, ()), ("2", 300_011, 11, 2, ("3",))]
    assert got == sorted(want)
    kept = decontaminate.clean(table, bench, remove="documents")
    assert kept.columns == table.columns and sorted(map(str, (r["text"] for r in kept.collect()))) == ["", "None"]
    cut = decontaminate.clean(table, bench)
    assert cut.columns == table.columns and cut.count() == 7
    assert {r["text"] for r in cut.where("doc_id = 7").collect()} == {"", "say"}
    assert [len(r["text"]) for r in cut.where("doc_id = 2").collect()] == [len(long) - len(item) - 1]
    assert decontaminate.contamination(table.limit(0), bench).count() == 0 and decontaminate.clean(table.limit(0), bench).count() == 0
    assert {r["contaminated"] for r in decontaminate.contamination(table, bench.limit(0)).collect()} == {False}
    with pytest.raises(ValueError):
        decontaminate.clean(table, bench, remove="words")


# Conversation repair


def edits_by_force(rows):
    """All edits of at most two inserted rows in each gap: rows are (initial, fault)."""
    gaps = [("", 0)] + [("".join(c), 3 * n) for n in (1, 2) for c in itertools.product("ua", repeat=n)]
    options = []
    for initial, fault in rows:
        own = [("D", "", 4)]
        if fault in (0, 3):
            own += [("K", initial, fault), ("R", "u", 3 + fault), ("R", "a", 3 + fault)]
        options += [[("I" * len(g), g, c) for g, c in gaps], own]
    options.append([("I" * len(g), g, c) for g, c in gaps])
    best = None
    for choice in itertools.product(*options):
        if re.fullmatch(r"(s?(ua)+)?", "".join(c[1] for c in choice)):
            offer = sum(c[2] for c in choice), "".join(c[0] for c in choice)
            best = offer if best is None or offer < best else best
    return best


def edits_from_the_end(rows):
    """The least (cost, letters) of what is left, by whole strings."""

    @functools.cache
    def rest(i, state):  # "": nothing yet
        after = "a" if state == "u" else "u"
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if i == len(rows):
            return min([*ways, *([(3, "I")] if state == "u" else [(6, "II")] if state == "s" else [])])
        for n in range(3):
            now = state
            for _ in range(n):
                now = "a" if now == "u" else "u"
            after = "a" if now == "u" else "u"
            initial, fault = rows[i]
            steps = [("D", now, 4)]
            if fault in (0, 3):
                steps.append(("R", after, 3 + fault))
                if initial == after or initial == "s" and now == "":
                    steps.append(("K", initial, fault))
            for letter, then, cost in steps:
                more = rest(i + 1, then)
                ways.append((3 * n + cost + more[0], "I" * n + letter + more[1]))
        return min(ways)

    return rest(0, "")


def signature_of(rows):
    return "".join(cr.sign("suax".index(i), f) for i, f in rows)


def test_trie_answers():
    kinds = list(itertools.product("suax", range(4)))
    rnd = random.Random(8)
    short = [(), *((k,) for k in kinds), *itertools.product(kinds, repeat=2)]
    short += [tuple(rnd.choice(kinds) for _ in range(3)) for _ in range(6)]
    for rows in short:
        assert edits_from_the_end(rows) == edits_by_force(rows)
    some = short + [tuple(rnd.choice(kinds if rnd.random() < 0.5 else [("u", 0), ("a", 0)]) for _ in range(rnd.randint(3, 40))) for _ in range(1500)]
    by_signature = sorted({signature_of(rows): rows for rows in some}.items())
    trie = cr.Trie(cr.Costs())
    for signature, rows in by_signature:
        assert trie.answer(signature) == edits_from_the_end(rows), rows
    own = [c for s, _ in by_signature for c in [trie.answer(s)]]  # again, from another order of paths
    assert own == [edits_from_the_end(r) for _, r in by_signature]
    long = "".join(signature_of([("u", 0), ("a", 3), ("u", 2)]) for _ in range(30_000))
    assert cr.Trie(cr.Costs()).answer(long)[1] == "KKD" * 30_000


def repaired_by_force(rows):
    by_id = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        by_id[conv] += [(turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    out = {}
    for conv, own in by_id.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha(r[2])))
        seen, signs = set(), []
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = 1 if not last else 2 if (role, text) in seen else 3 if last[0] not in ".!?" else 0
            seen.add((role, text))
            signs.append((role[:1] if role[:1] and role[:1] in "sua" else "x", fault))
        cost, letters = edits_from_the_end(tuple(signs))
        lines, left, before = [], iter(own), ""
        for letter in letters:
            _, role, text = (None, "", "") if letter == "I" else next(left)
            if letter != "D":
                before = role[0] if letter == "K" else "a" if before == "u" else "u"
                lines.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[before]}:{text}")
        turns = {t for t, _, _ in own if t is not None}
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(f == k for _, f in signs) for k in (1, 2, 3)), sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(signs, signs[1:])), cost, letters, sha("\n".join(lines)))
    return out


def test_conversations(spark):
    rnd = random.Random(3)
    texts = ["Hello.", "What?", "cut off", " \n\t", "", None, "Yes!\n", "no. ", " ", "é.", "a\n\nb."]
    rows = []
    for conv in [*range(150), None]:
        turn = rnd.choice([0, 0, 5])
        for k in range(rnd.randint(1, 9)):
            role = ("user", "assistant")[k % 2] if rnd.random() < 0.7 else rnd.choice(["system", "user", "assistant", "tool", "", "User", None])
            rows.append((conv, rnd.choice([turn, turn, turn, None]), role, rnd.choice(texts)))
            turn += rnd.choice([1, 1, 1, 3, 0])
    rows += rows[:40]
    rows += [(1000, k, ("user", "assistant")[k % 2], f"line {k}.") for k in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"id": F.lit("c"), "digest": F.lit(1), "sign": F.lit(1), "present": F.lit("p")})
    done = cr.repair(cr.damaged(table), present_col="present")
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.with_digests(done).collect()}
    assert got == repaired_by_force(rows)
    kept = [r for r in done.rows.where("id = 1000").collect()]
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in kept))


def test_conversations_odd_rows(spark):
    kind = "conv_id long, turn long, role string, text string"
    none = spark.createDataFrame([], kind)
    assert cr.with_digests(cr.repair(cr.damaged(none), present_col="present")).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = cr.with_digests(cr.repair(cr.damaged(spark.createDataFrame([(gone, 0, "user", "x.")], kind)), present_col="present")).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]
    # Without damage, other names and costs.
    own = spark.createDataFrame([("c", 1, "assistant", "Hi."), ("c", 2, "user", "A" * 3_000_000 + "."), (None, None, None, None)], "k string, t int, who string, said string")
    done = cr.repair(own, cr.Costs(insert=1), "k", "t", "who", "said")
    assert {r["k"]: (r["cost"], r["audit"]) for r in cr.with_digests(done, "k").collect()} == {"c": (2, "IKKI"), None: (4, "D")}
    assert [(r["edit"], r["role"], len(r["text"])) for r in done.rows.where("id = 'c'").collect()] == [("I", "user", 0), ("K", "assistant", 3), ("K", "user", 3_000_001), ("I", "assistant", 0)]


# Earlier operators: bounds


@pytest.mark.parametrize("kind", ["noise", "clusters"])
def test_shards_stay_bounded(spark, kind, monkeypatch):
    """At several sizes beyond a shard, the rows of all shards are at most four for each vector, and one is its home."""
    monkeypatch.setattr(flat_graph, "SHARD", 400)
    draw = np.random.default_rng(11)
    for n in (900, 3600, 12_000):
        x = draw.standard_normal((n, 24))
        if kind == "clusters":
            x = draw.standard_normal((60, 24))[draw.integers(0, 60, n)] + 0.02 * x
        table = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
        classes = flat_graph.prepared(table, "vec_id", "embedding", "label").select(F.col("id").alias("node"), F.lit(1).cast("bigint").alias("copies"), "vec", "width", "label")
        rows = flat_graph.dealt(classes, 0.98).agg(F.count("*"), F.count_if("home")).first()
        assert rows[1] == n and rows[0] <= 4.5 * n, (n, tuple(rows))


def test_archives_of_any_id(spark):
    ids = [10**12, 10**13, 9 * 10**18, -5, 0]
    pages = spark.createDataFrame([(i, "http://a.example/", f"p{i % 3}") for i in ids], "page_id long, url string, html string")
    rows = warc.histories(pages).collect()
    assert {r["page_id"] for r in rows} == set(ids) and all(re.match(r"20[23]\d-", r["time"]) for r in rows)
    first = {f"p{i % 3}": min(j for j in ids if j % 3 == i % 3) for i in ids}
    assert {(r["page_id"], r["refers_to"]) for r in rows} == {(i, None if first[f"p{i % 3}"] == i else first[f"p{i % 3}"]) for i in ids}


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, empty, repeated and long texts, an id twice, clashing columns; and an empty table."""
    import corpus_pipeline

    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 9))) for _ in range(2500)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    good, twin, long = text(120), text(120), text(9000)
    rows = [(1, good, "en", "s", None, "k"), (1, good, "en", "s", None, "k"), (2, good, None, None, None, None), (3, None, None, None, None, None), (4, "", "", "", 0, ""), (None, twin, None, None, None, None), (5, long, "en", "s", 1, "k"), (6, "short", "en", "s", 5, "k")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string"
    for name, some in (("rows", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
    packed = corpus_pipeline.run(spark, f"file://{tmp_path}/rows")
    assert {r["doc_id"] for r in packed.collect()} == {1, None, 5}
    docs = spark.read.parquet(f"file://{tmp_path}/rows/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    left = docs.collect()
    assert {r["doc_id"] for r in left} == {1, None, 5} and {r["text"] for r in left if r["doc_id"] != 1} == {twin, long}
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
