"""Queries of the layered brand matcher: documents as posts, names from the benchmark's items."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import text as T
from ..operators import extraction, layers
from .queries import query
from .tables import load, shared_folder

REJECTS, PRODUCTS = ("the", "der", "la", "of"), ("that", "in", "sch")
ALIASES = {"thea": "Thea", "ionen": "Ionen", "ingre": "IN-gre", "ber ": "Ber"}
LINES = {"nder": "Ander Works", "ungkeit": "Ung", "tionre": "Ander Works", "license": "Licence"}
KNOWN_NAMES = {"est": 1e-4, "apache": 0.0, "que": 6e-5, "ouand": 0.0, "an": 1e-5, "die": 2e-5}
FREQUENCIES = {"an": 1e-3, "er": 1e-3, "th": 2e-5, "as": 6e-5, "en": 6e-5, "le": 1e-3, "mit": 2e-5}
KEEP = ["community", "category", "is_cur", "sentiment"]


#: Characters that the review's queries read, by their SQL.
REVIEWED = 400


def posts(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """Whole texts, or their first ``most`` characters."""
    d = load(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select(F.col("doc_id").alias("mention_id"), (text if most is None else F.substring(text, 1, most)).alias("ner_input"), F.col("source").alias("community"), F.concat("lang", F.lit("_"), F.col("doc_id") % 5).alias("category"), (F.col("doc_id") % 3 != 0).alias("is_cur"), F.expr("cast((doc_id * 37) % 201 - 100 as double) / cast(100 as double)").alias("sentiment"))


def rules(spark: SparkSession) -> layers.Rules:
    return layers.Rules(REJECTS, PRODUCTS, spark.createDataFrame(list(FREQUENCIES.items()), "word string, freq double"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first one to three words of the benchmark's items, and the first two without the space."""
    words = load(spark, sf_dir, "benchmark").select(T.tokens(T.plain(F.col("text"))).alias("w"))
    part = lambda n, sign: F.array_join(F.slice("w", 1, n), sign)
    whitelist = words.select(F.explode(F.array(part(1, " "), part(2, " "), part(3, " "), part(2, ""))).alias("norm")).distinct().select("norm", T.upper(F.col("norm")).alias("display"))
    listed = lambda own: spark.createDataFrame([(n, b, i) for i, (n, b) in enumerate(own.items())], "name string, brand string, pos int")
    return layers.dictionary(whitelist, listed(ALIASES), listed(LINES), spark.createDataFrame(list(KNOWN_NAMES.items()), "name string, freq double"), rules(spark))


def decisions(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """Both passes over the table of hits, which stands in the shared folder."""
    path = f"{shared_folder(spark)}/layers/{uuid4().hex}"
    sources.write_stage(layers.hits(posts(spark, sf_dir, most), names(spark, sf_dir), rules(spark), keep=KEEP), f"{path}/hits")
    found = spark.read.parquet(f"{path}/hits")
    told = layers.statistics(found.where("is_cur"))
    sources.write_stage(layers.decided(found, told, rules(spark), keep=KEEP, recent=F.col("is_cur")), f"{path}/decisions")
    return spark.read.parquet(f"{path}/decisions")


def _values(own: dict, *columns: str) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"cast({v!r} AS double)"
    return "(VALUES " + ", ".join(f"({text(k)}, {text(v)}, {i})" for i, (k, v) in enumerate(own.items())) + f") v({', '.join(columns)})"


_list = lambda own: ", ".join(f"'{w}'" for w in own)
PLAIN = "trim(regexp_replace(regexp_replace(lower({0}), '[''\\-.&,!?/\\\\()\\[\\]_*@#%^~`|]', ' ', 'g'), '\\s+', ' ', 'g'))"
CONTEXT = "CASE WHEN {1} > 0 THEN substr({0}, greatest({1} - 60, 1), {1} + {2} + 60 - greatest({1} - 60, 1)) ELSE '' END"
WORDS_OF = "list_filter(string_split_regex(regexp_replace({0}, '[''\\-.&,!?/\\\\()\\[\\]_*@#%^~`|]', ' ', 'g'), '\\s+'), lambda x: x <> '')"
BARE = "trim(regexp_replace(raw, '[''\\-.&,!?/\\\\()\\[\\]_*@#%^~`|]', '', 'g'))"
QUOTED, *BOUND, AFTER = extraction.CANDIDATE_PATTERNS
#: Capitals after a letter's end: each run of letters by itself.
TITLED = f"array_to_string(list_transform(regexp_extract_all({BARE}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), '')"

#: Letters beyond ASCII are word characters for Spark's patterns, hence signs that the patterns don't take stand for them.
def _sql(text: str, is_cur: str, known: dict[str, float], freqs: dict[str, float], rejects: tuple, products: tuple) -> str:
    return rf"""WITH posts AS (SELECT doc_id AS k, {text} AS t, source AS community, concat(lang, '_', doc_id % 5) AS category, {is_cur} AS is_cur, cast((doc_id * 37) % 201 - 100 AS double) / cast(100 AS double) AS sentiment FROM documents),
p AS (SELECT *, replace(strip_accents(t), '`', '''') AS f, regexp_replace(t, '[^\x00-\x7F\P{{L}}]', '_', 'g') AS m FROM posts),
bw AS (SELECT string_split({PLAIN.format("text")}, ' ') AS w FROM benchmark),
wl AS (SELECT DISTINCT unnest([array_to_string(w[1:1], ' '), array_to_string(w[1:2], ' '), array_to_string(w[1:3], ' '), array_to_string(w[1:2], '')]) AS name FROM bw),
white AS (SELECT name FROM wl WHERE name NOT IN ({_list(products)})),
alias AS (SELECT * FROM {_values(ALIASES, "name", "brand", "pos")}), line AS (SELECT * FROM {_values(LINES, "name", "brand", "pos")}), known AS (SELECT * FROM {_values(known, "name", "freq", "pos")}), freqs AS (SELECT * FROM {_values(freqs, "word", "freq", "pos")}),
w AS (SELECT k, t, f, {WORDS_OF.format("f")} AS w FROM p),
grams AS (SELECT k, t, f, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS n))),
l1 AS (SELECT k, t, f, n, gram, name, instr(f, gram) AS spot FROM (SELECT g.*, coalesce(a.name, CASE WHEN n > 1 THEN b.name END) AS name FROM grams g LEFT JOIN white a ON a.name = lower(gram) LEFT JOIN white b ON b.name = replace(lower(gram), ' ', '')) WHERE name IS NOT NULL),
one AS (SELECT k, 1 AS layer, n * 1000 AS pos, name AS norm, upper(name) AS brand, cast(1.0 AS double) AS confidence, 'whitelist' AS source, 'whitelist_match' AS evidence, NULL AS raw FROM l1
  WHERE NOT (n = 1 AND regexp_matches(gram, '^\p{{Ll}}') AND name NOT IN (SELECT name FROM known)) AND NOT regexp_matches({CONTEXT.format("t", "spot", "length(gram)")}, '{extraction.ANTI_CONTEXT}')
  AND NOT (n > 1 AND spot > 0 AND split_part(lower(gram), ' ', 1) IN ({_list(layers.POSSESSIVE)}) AND regexp_matches(rtrim(left(f, spot - 1)), '^$|[.!?]$'))),
named AS (SELECT 2 AS layer, name, {PLAIN.format("name")} AS norm, brand, pos, cast(1.0 AS double) AS confidence, 'alias' AS source, 'brand_alias' AS evidence, false AS common FROM alias UNION ALL SELECT 3, name, {PLAIN.format("brand")}, brand, pos, 0.95, 'product_line', 'product_line:' || name, false FROM line
  UNION ALL SELECT 4, name, name, upper(left(name, 1)) || substr(name, 2), 0, 0.85, 'known_brand', 'known_brand+ctx', freq > 5e-5 FROM known),
parts AS (SELECT k, d.*, {CONTEXT.format("t", "instr(lower(f), name)", "length(name)")} AS ctx FROM p, named d WHERE contains(lower(f), name)),
rest AS (SELECT k, layer, pos, norm, brand, confidence, source, evidence, NULL AS raw FROM parts WHERE NOT regexp_matches(ctx, '{extraction.ANTI_CONTEXT}') AND (NOT common OR regexp_matches(ctx, '{extraction.BRAND_CONTEXT}'))),
found AS (SELECT k, t, list_concat(list_transform(regexp_extract_all(t, '{QUOTED}', 1), lambda x: {{'raw': x, 'label': 'quoted'}}), {', '.join(f"list_transform(regexp_extract_all(m, '{pattern}', 1), lambda x: {{'raw': x, 'label': '{label}'}})" for pattern, label in zip(BOUND, layers.LABELS[1:], strict=False))},
  list_transform(regexp_extract_all(regexp_replace(m, '([a-z,;:!?]\s)', '\1' || chr(1), 'g'), '\x01([A-Z][a-z]{{2,15}})\b', 1), lambda x: {{'raw': x, 'label': 'title_word'}})) AS c FROM p),
each AS (SELECT k, t, regexp_replace(c[i].raw, '^\s+|\s+$', '', 'g') AS raw, c[i].label AS label, i AS pos FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM found)),
lone AS (SELECT *, {PLAIN.format("raw")} AS norm, {CONTEXT.format("t", "instr(t, raw)", "length(raw)")} AS ctx, {BARE} AS bare, {TITLED} AS titled FROM (SELECT *, row_number() OVER (PARTITION BY k, raw ORDER BY pos) AS nth FROM each WHERE raw <> '') WHERE nth = 1),
counted AS (SELECT DISTINCT k, norm FROM lone WHERE norm <> '' AND norm NOT IN ({_list(rejects)}) UNION SELECT k, name FROM posts, known WHERE contains(lower(t), name)),
spread AS (SELECT norm, count(DISTINCT community) AS n FROM counted JOIN posts USING (k) WHERE is_cur GROUP BY 1),
scored AS (SELECT k, lone.pos, norm, raw, CASE WHEN regexp_full_match(bare, '[A-Z0-9]{{2,6}}') OR regexp_matches(bare, '\p{{Lu}}') AND regexp_matches(bare, '\p{{Ll}}') AND NOT regexp_matches(bare, '(?s)^.+\p{{Lu}}') THEN bare WHEN regexp_matches(bare, '\p{{Lu}}|\p{{Ll}}') THEN titled ELSE bare END AS brand,
  coalesce(CASE WHEN is_cur THEN s.n END, 1) AS n, label, regexp_matches(ctx, '{extraction.BRAND_CONTEXT}') AS near, regexp_matches(ctx, '{extraction.ANTI_CONTEXT}') AS against, coalesce(freqs.freq, 0) AS freq, norm IN (SELECT name FROM known) AS known
  FROM lone JOIN (SELECT k, is_cur FROM posts) USING (k) LEFT JOIN spread s USING (norm) LEFT JOIN freqs ON word = split_part(norm, ' ', 1) WHERE length(norm) >= 3 AND norm NOT IN ({_list(rejects + products)})),
based AS (SELECT *, cast(CASE label WHEN 'allcaps' THEN 0.30 WHEN 'camelcase' THEN 0.20 WHEN 'quoted' THEN 0.20 ELSE 0 END AS double) + cast(CASE WHEN freq < 1e-5 THEN 0.20 WHEN freq > 5e-5 THEN -0.25 ELSE 0 END AS double) + cast(CASE WHEN near THEN 0.30 ELSE 0 END AS double) - cast(CASE WHEN against THEN 0.40 ELSE 0 END AS double) AS base FROM scored),
five AS (SELECT k, 5 AS layer, pos, norm, brand, round(least(CASE WHEN known THEN greatest(base, cast(0.45 AS double)) ELSE base END + cast(CASE WHEN n >= 3 THEN 0.10 ELSE 0 END AS double), cast(0.99 AS double)), 3) AS confidence, 'candidate' AS source,
  coalesce(nullif(concat_ws(',', CASE WHEN label IN ('allcaps', 'camelcase', 'quoted') THEN label END, CASE WHEN freq < 1e-5 THEN 'uncommon' WHEN freq > 5e-5 THEN '-common' END, CASE WHEN near THEN 'brand_ctx' END, CASE WHEN against THEN '-anti_ctx' END, CASE WHEN known THEN 'known_brand' END, CASE WHEN n >= 3 THEN '+' || n || 'comm' END), ''), 'no_signal') AS evidence, raw FROM based),
hits AS (SELECT * FROM one UNION ALL SELECT * FROM rest UNION ALL SELECT * FROM five WHERE confidence >= 0.65 AND brand <> ''),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, norm ORDER BY layer, pos, brand, evidence) AS nth FROM hits) WHERE nth = 1),
matched AS (SELECT a.* FROM firsts a WHERE NOT EXISTS (SELECT 1 FROM firsts b WHERE b.k = a.k AND b.norm <> a.norm AND (starts_with(b.norm, a.norm) OR NOT contains(a.norm, ' ') AND length(a.norm) >= 4 AND list_contains(string_split(b.norm, ' '), a.norm))))
"""


LAYERS = _sql("coalesce(text, '')", "doc_id % 3 <> 0", KNOWN_NAMES, FREQUENCIES, REJECTS, PRODUCTS)
REVIEW = _sql(f"left(coalesce(text, ''), {REVIEWED})", "doc_id % 3 <> 0", KNOWN_NAMES, FREQUENCIES, REJECTS, PRODUCTS)


@query(f"{LAYERS} SELECT k AS mention_id, norm, brand, confidence, source, evidence FROM matched")
def brand_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.matches(decisions(spark, sf_dir))


@query(f"{REVIEW} SELECT k AS mention_id, raw AS candidate, norm, confidence AS score, evidence FROM five v WHERE confidence >= 0.45 AND confidence < 0.65 AND NOT EXISTS (SELECT 1 FROM firsts f WHERE f.k = v.k AND f.norm = v.norm AND (f.layer < 5 OR f.pos < v.pos))")
def brand_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.review(decisions(spark, sf_dir, REVIEWED)).drop("decision", "context")


TABLES = """, facts AS (SELECT k, category, is_cur, sentiment, brand, confidence, source, evidence FROM matched JOIN posts USING (k)),
base AS (SELECT category, brand, count(*) FILTER (is_cur) AS cur_mentions, count(*) FILTER (NOT is_cur) AS prev_mentions, round(avg(CASE WHEN is_cur THEN sentiment END), 3) AS avg_sentiment, min(struct_pack(k := k, c := confidence, s := source, e := evidence)) FILTER (is_cur) AS seen FROM facts GROUP BY 1, 2 HAVING count(*) FILTER (is_cur) > 0),
few AS (SELECT brand FROM base GROUP BY brand HAVING count(*) / cast((SELECT count(DISTINCT category) FROM base) AS double) <= 0.40),
spiked AS (SELECT *, round(cur_mentions / cast(greatest(prev_mentions, 1) AS double), 2) AS brand_spike FROM base WHERE cur_mentions >= 3 AND brand IN (SELECT brand FROM few))
SELECT category, brand, cur_mentions, prev_mentions, brand_spike, avg_sentiment, seen.c AS confidence, seen.s AS source, seen.e AS evidence, brand_rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY cur_mentions DESC, brand_spike DESC, avg_sentiment DESC NULLS LAST, brand) AS brand_rank FROM spiked) WHERE brand_rank <= 30"""


@query(LAYERS + TABLES)
def brand_tables_layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = layers.matches(decisions(spark, sf_dir), keep=KEEP)
    return layers.brand_tables(facts, ["mention_id"]).withColumn("brand_rank", F.col("brand_rank").cast("bigint"))


@query()
def brand_tables_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tables from the sentence extractor; names are the benchmark's first words, terms the documents' most usual endings."""
    first = load(spark, sf_dir, "benchmark").select(F.slice(T.tokens(T.plain(F.col("text"))), 1, 2).alias("w")).select(F.array_join("w", " ").alias("norm")).where("length(norm) > 5")
    own = spark.createDataFrame([("gnu", "GNU"), ("mit license", "MIT License")], "norm string, display string")
    # Displays of the benchmark's words begin each word with a capital; those of one's own come first.
    listed = first.distinct().join(F.broadcast(own), "norm", "left_anti").select("norm", extraction.title(F.col("norm")).alias("display")).unionByName(own)
    p = posts(spark, sf_dir)
    said = extraction.listed_brands(p, "mention_id", "ner_input", listed, frozenset({"license", "work"})).where("decision = 'display_brand'")
    # The tables ask three times, so the mentions are stored.
    path = f"{shared_folder(spark)}/layers/{uuid4().hex}"
    sources.write_stage(said.select("mention_id", "brand", "confidence", "source", F.col("relation").alias("evidence")).join(p.drop("ner_input"), "mention_id"), path)
    facts = spark.read.parquet(path)
    return layers.brand_tables(facts, ["mention_id"], least=1)


LICENCES = {"apache": 0.0, "mit": 0.0, "gnu": 1e-4}


@query(_sql("coalesce(text, '')", "true", LICENCES, FREQUENCIES, REJECTS, ("license",)) + " SELECT k AS doc_id, raw AS candidate, coalesce(spread.n, 1) AS communities, confidence AS score, evidence, CASE WHEN confidence >= 0.65 THEN 'accept' WHEN confidence >= 0.45 THEN 'review' ELSE 'reject' END AS decision FROM five LEFT JOIN spread USING (norm)")
def regex_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates alone, of whole texts; the texts are read once and the hits stand in the shared folder."""
    own = layers.Rules(REJECTS, ("license",), spark.createDataFrame(list(FREQUENCIES.items()), "word string, freq double"))
    none = spark.createDataFrame([], "name string, brand string, pos int, norm string, display string")
    known = layers.dictionary(none, none, none, spark.createDataFrame(list(LICENCES.items()), "name string, freq double"), own)
    path = f"{shared_folder(spark)}/layers/{uuid4().hex}"
    sources.write_stage(layers.hits(load(spark, sf_dir, "documents").withColumnRenamed("source", "community"), known, own, "doc_id", "text", ["community"]), path)
    found = spark.read.parquet(path)
    rows = layers.weighed(found.where(F.col("layer") == layers.CANDIDATE), layers.statistics(found, "doc_id"), own, "doc_id")
    decision = F.when(F.col("confidence") >= own.accept, "accept").when(F.col("confidence") >= own.review, "review").otherwise("reject")
    return rows.select("doc_id", F.col("raw").alias("candidate"), "communities", F.col("confidence").alias("score"), "evidence", decision.alias("decision"))
