"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a key in a block, the value of a name with a word of secrets (quoted or not, from 4 characters on), or
a run of 16 key characters; of name=value the value alone. A text is cut at candidate strings, so a candidate's neighbours are the ends of the pieces around it. A forest trained
from labelled findings judges length, character transitions, dictionary coverage, the path and neighbouring words. Its
trees are written as a column expression: a text is scanned in one pass with SQL functions, nothing is shuffled or sent
to Python, and redaction joins the pieces again.

The labelled findings come from rules with a fixed seed (their number is a parameter), as the tables have none; each has
the candidate, what stands around it, its path and whether it is a secret. A table of real labelled findings (``c`` the
candidate, ``b`` and ``a`` the text before and after, ``p`` the path, ``label`` 0 or 1) can be given instead: ``labelled``.

Defined results: null and empty texts have no findings and stay as they are; a null path is the empty one; rows without
an id and repeated rows are scanned one by one; a score that ties with the threshold is a secret; texts and candidates
are scanned whole at any length; an empty table has no findings; extra columns stay in ``redact`` whatever their names,
and are not read in ``scan``. Without any labelled finding there is no forest, which is an error.
"""

from __future__ import annotations

import functools
import json
import random
import string
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unclashed

#: A name with a word of secrets, and what stands between it and its value.
NAME = r"(?i:secret|token|passw|passphrase|pwd|api[ _-]?key|access[ _-]?key|auth|credential|private[ _-]?key)[A-Za-z0-9_-]{0,24}[\"'`\]]{0,2}\s{0,4}(?::=|=>|[=:])\s{0,4}(?:(?i:bearer|basic)\s{1,4})?[\"'`]?(?:(?i:bearer|basic)\s{1,4})?"
#: Strings that may be secrets: keys in a block, values of such names at any length from 4 on, and long runs of key characters.
CANDIDATE = rf"-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{{0,20}}PRIVATE KEY-----)?|{NAME}(?:(?<=[\"'`])[^\"'`\r\n]{{4,256}}(?=[\"'`])|[^\s\"'`<>&]{{4,}}(?:&(?![A-Za-z_]{{1,32}}=)[^\s\"'`<>&]*){{0,8}})|[A-Za-z0-9+/=_.~-]{{16,}}"
#: What stands before the value in a candidate, and what ends it if it isn't quoted.
BEFORE = rf"^(?:{NAME}|[A-Za-z_][A-Za-z0-9_.-]{{0,63}}=(?=[^=]))"
AFTER = r"(?<=[^.,;:)}\]])[.,;:)}\]]+$"
AROUND = 64  #: characters looked at on each side

# Kinds of secrets with known shapes.
KINDS = {
    "private_key": r"^-----BEGIN",
    "aws_access_key": r"^(AKIA|ASIA)[0-9A-Z]{16}$",
    "github_token": r"^gh[pousr]_[A-Za-z0-9]{36,}$",
    "slack_token": r"^xox[abprs]-[A-Za-z0-9-]{10,}$",
    "stripe_key": r"^[sr]k_(live|test)_[A-Za-z0-9]{16,}$",
    "google_api_key": r"^AIza[A-Za-z0-9_-]{35}$",
    "jwt": r"^eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+$",
}
# Parts of words that fill identifiers and prose, and words beside secrets and beside others.
PARTS = "the and ing tion ment ness able ible ous ive ers ally for with that this from have not are was you your example sample test dummy data file name path user value index config service manager handler factory request response message string number object class method function type list item node model view controller button image style color event state action result error info debug version build release update create delete select insert table column row key token code text word line page form http https www com org net html json xml css src lib main core util common base abstract default impl".split()
SECRET_WORDS = r"(?i)(secret|token|passw|pwd|api[ _-]?key|apikey|access[ _-]?key|auth|credential|private[ _-]?key|bearer|client[ _-]?secret)"
OTHER_WORDS = r"(?i)(commit|sha-?\d*\b|hash|checksum|digest|md5|uuid|guid|etag|revision|build|order|phone|tel|card|account|isbn|image/|base64,|integrity)"
SHAM_WORDS = r"(?i)(example|sample|dummy|fake|placeholder|your[ _-]|changeme|xxxx|redacted|test)"
TEST_PATHS = r"(?i)(test|spec|mock|fixture|example|sample|doc)"


def in_sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def quoted(pattern: str) -> str:
    """A pattern in SQL text and in a format string."""
    return pattern.replace("\\", "\\\\").replace("{", "{{").replace("}", "}}")


FEATURES = {
    "length": "least(length({c}), 200)",
    "digits": "regexp_count({c}, '[0-9]') / length({c})",
    "capitals": "regexp_count({c}, '[A-Z]') / length({c})",
    "signs": "regexp_count({c}, '[^A-Za-z0-9]') / length({c})",
    "digit_transitions": "(regexp_count({c}, '[A-Za-z](?=[0-9])') + regexp_count({c}, '[0-9](?=[A-Za-z])')) / length({c})",
    "case_transitions": "(regexp_count({c}, '[a-z](?=[A-Z])') + regexp_count({c}, '[A-Z](?=[A-Z][a-z])')) / length({c})",
    "vowel_transitions": "regexp_count({c}, '(?i)[aeiou](?=[b-df-hj-np-tv-z])') / length({c})",
    "distinct": "least(1, size(array_distinct(split({c}, ''))) / least(length({c}), 64))",
    "beyond_hex": "cast(NOT {c} RLIKE '^[0-9a-fA-F-]+$' AS int)",
    "uuid": "cast({c} RLIKE '^[0-9a-fA-F]{{8}}-([0-9a-fA-F]{{4}}-){{3}}[0-9a-fA-F]{{12}}$' AS int)",
    "dictionary": f"1 - length(regexp_replace({{c}}, '(?i)({'|'.join(PARTS)})', '')) / length({{c}})",
    "known_shape": f"cast({{c}} RLIKE '{quoted('|'.join(KINDS.values()))}' AS int)",
    "assigned": "cast({b} RLIKE '[=:]\\\\s*[\"\\'`]?$' AS int)",
    "secret_word": f"cast(right({{b}}, 32) RLIKE '{quoted(SECRET_WORDS)}' AS int)",
    "other_word": f"cast(right({{b}}, 32) RLIKE '{quoted(OTHER_WORDS)}' AS int)",
    "sham_word": f"cast(concat(right({{b}}, 24), {{c}}, left({{a}}, 24)) RLIKE '{quoted(SHAM_WORDS)}' AS int)",
    "path_before": "cast({b} RLIKE '(/|\\\\\\\\|@|www[.])$' AS int)",
    "test_path": f"cast({{p}} RLIKE '{quoted(TEST_PATHS)}' AS int)",
}


def feature_sql(c: str, b: str, a: str, p: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', cast({sql.format(c=c, b=b, a=a, p=p)} AS double)" for name, sql in FEATURES.items()) + ")"


@dataclass(frozen=True)
class Forest:
    findings: int = 4000  #: labelled findings to train from
    trees: int = 24
    depth: int = 7
    seed: int = 3
    threshold: float = 0.5


def labelled_findings(n: int, seed: int) -> list[dict]:
    """Findings by rule: what they are, what stands around them, and whether they are secrets."""
    rnd = random.Random(seed)
    run = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    hexa, alnum, word = "0123456789abcdef", string.ascii_letters + string.digits, ["the", "of", "and", "value", "is", "in", "set", "with", "le", "der", "los", "onthe", "reand"]
    prose = lambda k: " ".join(rnd.choice(word) for _ in range(k))
    syllable = "an en er in on re th st nd ti at es or ea le de ch ie ei un te ver sch heit lich ment tion aux eau elle que ado cion mente".split()
    name = lambda: "".join(rnd.choice(PARTS).capitalize() for _ in range(rnd.randint(3, 6)))
    key = lambda: rnd.choice(["token", "secret", "api_key", "apikey", "password", "client_secret", "access_key", "AUTH_TOKEN", "passwd", "db_password"]) + rnd.choice([" = ", "=", ": ", " := ", ' => ']) + rnd.choice(['"', "'", "", '"'])
    shaped = [lambda: "AKIA" + run(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + run(alnum, 36), lambda: "xoxb-" + run(string.digits, 12) + "-" + run(alnum, 24), lambda: "sk_live_" + run(alnum, 24), lambda: "AIza" + run(alnum + "_-", 35), lambda: "eyJ" + run(alnum, 20) + ".eyJ" + run(alnum, 40) + "." + run(alnum + "_-", 43)]
    short = lambda: run(string.ascii_letters, 2) + run(alnum + "!@#$%^*?_-", rnd.randint(4, 11)) + rnd.choice(string.digits) + rnd.choice(["", "!", "#"])
    good = [
        lambda: (run(hexa, rnd.choice([32, 40, 40, 64])), f"{prose(4)} {key()}", '" ' + prose(3)),
        lambda: (run(alnum, rnd.randint(20, 48)), f"{prose(4)} {key()}", '"\n' + prose(3)),
        lambda: (run(alnum + "+/", rnd.randint(24, 64)) + "=", f"{prose(3)} {key()}", "' " + prose(3)),
        lambda: (rnd.choice(shaped)(), rnd.choice([f"{prose(4)} {key()}", f"{prose(5)} "]), " " + prose(3)),
        lambda: ("-----BEGIN RSA PRIVATE KEY-----\n" + run(alnum + "+/", 200) + "\n-----END RSA PRIVATE KEY-----", prose(3) + "\n", "\n" + prose(2)),
        lambda: (run(alnum, rnd.randint(22, 40)), f"{prose(3)} Authorization: Bearer ", "\n" + prose(3)),
        lambda: (short(), f"{prose(3)} {key()}", rnd.choice(['"', "'", "", "\n"]) + " " + prose(3)),
        lambda: (rnd.choice(shaped)(), f"{prose(3)} {rnd.choice(['KEY_ID=', 'id=', 'value=', 'x='])}", rnd.choice(["", "."]) + " " + prose(3)),
    ]
    bad = [
        lambda: (run(string.digits, rnd.randint(16, 19)), f"{prose(5)} ", " " + prose(3)),
        lambda: (run(string.digits, 16), f"{prose(2)} {rnd.choice(['card', 'account', 'order', 'phone'])} ", " " + prose(3)),
        lambda: ("".join(rnd.choice(syllable) for _ in range(rnd.randint(5, 12))), f"{prose(5)} ", " " + prose(4)),
        lambda: ("".join(rnd.choice(syllable) for _ in range(rnd.randint(6, 10))).upper(), f"{prose(5)} ", "!! " + prose(4)),
        lambda: (name(), f"{prose(2)} new ", "() " + prose(2)),
        lambda: (name() + rnd.choice([".java", "_id", "_v2", "2024"]), rnd.choice([f"{prose(2)} /", f"{prose(2)} ", "path = "]), " " + prose(2)),
        lambda: (run(hexa, 40), f"{prose(2)} {rnd.choice(['commit ', 'sha1: ', 'checksum = ', 'revision '])}", "\n" + prose(3)),
        lambda: (run(hexa, 64), f"{prose(2)} {rnd.choice(['sha256:', 'digest: ', 'integrity '])}", "\n" + prose(3)),
        lambda: ("-".join(run(hexa, k) for k in (8, 4, 4, 4, 12)), f"{prose(2)} {rnd.choice(['uuid ', 'id: ', 'guid=', 'token '])}", " " + prose(3)),
        lambda: (rnd.choice(["your-api-key-goes-here", "xxxxxxxxxxxxxxxxxxxx", "EXAMPLE_TOKEN_VALUE", "changeme_changeme", "<your_secret_token>"[1:-1]]), f"{prose(3)} {key()}", '" ' + prose(3)),
        lambda: ("-".join(rnd.choice(PARTS) for _ in range(5)), f"{prose(2)} {rnd.choice(['https://site.example/', '/', ''])}", " " + prose(3)),
        lambda: (run("=-_.", 20), "\n", "\n" + prose(3)),
        lambda: (rnd.choice([*PARTS, "none", "null", "true", "false", "None", "required", "optional", "required.", "string", "String", "1024", "4096", "os.environ", "self.token", "request.token", "getToken()", "${TOKEN}", "%(password)s", "Smithson", "input()"]), f"{prose(3)} {key()}", rnd.choice(['"', "'", "", "\n"]) + " " + prose(3)),
        lambda: ("".join(rnd.choice(syllable) for _ in range(rnd.randint(2, 6))), f"{prose(3)} {key()}", rnd.choice(["", "\n", '"']) + " " + prose(3)),
        lambda: (rnd.choice([run(string.digits, rnd.randint(1, 8)), name(), name().lower(), rnd.choice(PARTS)]), f"{prose(3)} {rnd.choice(PARTS)}_{rnd.choice(PARTS)}_{rnd.choice(PARTS)}=", " " + prose(3)),
        lambda: (run(alnum + "+/", 120), f"{prose(2)} src=data:image/png;base64,", '" ' + prose(2)),
    ]
    paths = ["src/app.py", "config/settings.yml", "web", "src3", "", "deploy/run.sh"]
    out = []
    for i in range(n):
        secret = i % 2 == 0
        c, b, a = rnd.choice(good if secret else bad)()
        path = rnd.choice(paths) if rnd.random() < 0.9 else rnd.choice(["tests/test_login.py", "docs/example.md"])
        out.append({"c": c, "b": b[-AROUND:], "a": a[:AROUND], "p": path, "label": float(secret and not (path.startswith(("tests", "docs")) and rnd.random() < 0.7))})
    return out


def findings_table(spark: SparkSession, findings: list[dict]) -> DataFrame:
    """The findings as a table of SQL literals, with their features."""
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(findings)), "array<struct<c string, b string, a string, p string, label double>>")))
    return rows.select("label", F.expr(feature_sql("c", "b", "a", "p")).alias("f")).select("label", "f.*")


@functools.lru_cache(4)
def trained(spark: SparkSession, how: Forest) -> str:
    """SQL of the forest's mean vote for a secret, over a struct ``f`` of features."""
    return forest_sql(fit(findings_table(spark, labelled_findings(how.findings, how.seed)), how))


def vote_of(spark: SparkSession, how: Forest, labelled: DataFrame | None) -> str:
    """The forest of the given findings (at most ``how.findings``, by a hash, so fitting is bounded) or of those by rule."""
    if labelled is None:
        return trained(spark, how)
    some = labelled.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in "cbap"), F.col("label").cast("double").alias("label")).where("label in (0, 1) and c <> ''")
    some = some.orderBy(F.xxhash64("c", "b", "a", "p", "label")).limit(how.findings).select("c", F.expr(f"right(b, {AROUND})").alias("b"), F.expr(f"left(a, {AROUND})").alias("a"), "p", "label")
    return forest_sql(fit(some.select("label", F.expr(feature_sql("c", "b", "a", "p")).alias("f")).select("label", "f.*"), how))


def fit(labelled: DataFrame, how: Forest):
    """A forest from ``label`` and feature columns."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled).select("label", "features")
    return RandomForestClassifier(numTrees=how.trees, maxDepth=how.depth, seed=how.seed, featureSubsetStrategy="sqrt", subsamplingRate=0.8).fit(rows.coalesce(1))


def forest_sql(model) -> str:
    names = list(FEATURES)

    def written(node) -> str:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return f"{stats[1] / sum(stats):.6f}D" if sum(stats) else "0.5D"
        return f"if(f.{names[node.split().featureIndex()]} <= {node.split().threshold()!r}D, {written(node.leftChild())}, {written(node.rightChild())})"

    trees = [written(tree.rootNode()) for tree in model._java_obj.trees()]
    return f"({' + '.join(trees)}) / {len(trees)}"


def pieces(docs: DataFrame, text_col: str, path_col: str | None, how: Forest, labelled: DataFrame | None, only_found: bool = False) -> tuple[DataFrame, str, str]:
    """The rows with two columns more, and their names: the text between candidates, and an array of candidate, kind and score."""
    vote = vote_of(docs.sparkSession, how, labelled)
    every, rest, values, got, path = unclashed(docs, "every", "rest", "values", "found", "path_of")
    cut = in_sql(CANDIDATE)
    kind = "CASE " + " ".join(f"WHEN v.c RLIKE '{in_sql(pattern)}' THEN '{name}'" for name, pattern in KINDS.items()) + " ELSE 'generic' END"
    if only_found:
        docs = docs.where(F.expr(f"`{text_col}` RLIKE '{cut}'"))
    held = docs.withColumn(path, F.expr(f"coalesce(cast(`{path_col}` AS string), '')" if path_col else "''")).withColumn(every, F.expr(f"regexp_extract_all(`{text_col}`, '{cut}', 0)"))
    held = held.withColumn(rest, F.expr(f"if(size({every}) > 0, split(`{text_col}`, '{cut}', -1), cast(array() AS array<string>))"))
    features = feature_sql("x.c", "x.b", "x.a", path)
    # Each array is made from whole arrays: nothing inside a lambda function is worth more than its element.
    ends = f"zip_with(slice({rest}, 1, size({every})), slice({rest}, 2, size({every})), (b, a) -> named_struct('b', right(b, {AROUND}), 'a', left(a, {AROUND})))"
    around = f"zip_with({every}, {ends}, (c, e) -> named_struct('c', c, 'b', e.b, 'a', e.a, 'before', regexp_extract(c, '{in_sql(BEFORE)}', 0)))"
    # The value alone is the candidate: its name and the signs after it stand around it.
    value = f"transform({around}, x -> named_struct('c', substring(x.c, length(x.before) + 1), 'b', x.b, 'a', x.a, 'before', x.before, 'after', if(x.before RLIKE '[\"\\'`]', '', regexp_extract(substring(x.c, length(x.before) + 1), '{in_sql(AFTER)}', 0))))"
    value = f"transform({value}, x -> named_struct('c', left(x.c, length(x.c) - length(x.after)), 'b', right(concat(x.b, x.before), {AROUND}), 'a', left(concat(x.after, x.a), {AROUND}), 'before', x.before, 'after', x.after))"
    held = held.withColumn(values, F.expr(f"if(size({every}) > 0, {value}, cast(array() AS array<struct<c: string, b: string, a: string, before: string, after: string>>))"))
    found = f"zip_with({values}, transform(transform({values}, x -> {features}), f -> {vote}), (v, s) -> named_struct('candidate', v.c, 'kind', {kind}, 'score', s, 'before', v.before, 'after', v.after))"
    return held.withColumn(got, F.expr(f"if(size({every}) > 0, {found}, cast(array() AS array<struct<candidate: string, kind: string, score: double, before: string, after: string>>))")).drop(every, values, path), rest, got


def scan(docs: DataFrame, how: Forest | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """A row for each candidate: ``id, n`` (which one of the text), ``kind, length, sha256, score, is_secret``."""
    how = how or Forest()
    columns = [f"`{c}`" for c in dict.fromkeys([id_col, text_col, *([path_col] if path_col else [])])]
    held, _, got = pieces(docs.select(*columns), text_col, path_col, how, labelled, only_found=True)
    # The outer form, as for the inner one Spark infers a filter that makes all candidates and features a second time.
    found = held.select(F.col(f"`{id_col}`").alias("id"), F.posexplode_outer(got).alias("n", "x")).where("n is not null")
    return found.select(F.col("id").alias(id_col), "n", "x.kind", F.length("x.candidate").cast("bigint").alias("length"), F.sha2("x.candidate", 256).alias("sha256"), F.round("x.score", 6).alias("score"), (F.col("x.score") >= how.threshold).alias("is_secret"))


def redact(docs: DataFrame, how: Forest | None = None, text_col: str = "text", path_col: str | None = None, sign: str = "[SECRET]", labelled: DataFrame | None = None) -> DataFrame:
    """The documents, all columns, with ``sign`` in place of each secret."""
    how = how or Forest()
    held, rest, got = pieces(docs, text_col, path_col, how, labelled)
    (signs,) = unclashed(held, "signs")
    held = held.withColumn(signs, F.expr(f"transform({got}, x -> if(x.score >= {how.threshold}D, concat(x.before, '{in_sql(sign)}', x.after), concat(x.before, x.candidate, x.after)))"))
    clean = f"if(size({signs}) > 0, array_join(zip_with({rest}, {signs}, (r, c) -> concat(r, coalesce(c, ''))), ''), `{text_col}`)"
    return held.withColumn(text_col, F.expr(clean)).drop(rest, got, signs)
