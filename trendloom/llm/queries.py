"""Queries of this subpackage by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets_forest import scan

    return scan(table(spark, sf_dir, "documents"), path_col="source")


def op2_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_knn import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import histories

    return histories(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minmax import MinMax, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), MinMax(shingle=4))


def op5_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_text import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import score

    return score(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import removals

    return removals(table(spark, sf_dir, "documents"))


def op8_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .flat_graph import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings")).drop("audited_recall")


def op9_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_middle, restored

    rows = fill_middle(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


def op13_trie_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damaged, repair, with_digests

    return with_digests(repair(damaged(table(spark, sf_dir, "conversations")), present_col="present"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_forest, op2_neighbour_votes, op3_warc_merge, op4_minmax_near_dedup, op5_license_paragraphs, op6_quality_rules, op7_suffix_dedup, op8_flat_graph, op9_length_buckets, op10_byte_bpe, op11_benchmark_hits, op12_fill_middle, op13_trie_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_merge": OP3, "op4_minmax_near_dedup": OP4, "op8_flat_graph": OP8, "op11_benchmark_hits": OP11, "op12_fill_middle": OP12, "op13_trie_repair": OP13}


OP3 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, cast(strlen(html) AS bigint) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first, sha1(html) AS hex FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((cast(('0x' || substr(hex, cast(5 * (i // 4) + 1 AS bigint), 5)) AS bigint) >> cast(15 - 5 * (i % 4) AS bigint)) & 31) + 1 AS bigint), 1)), '') AS payload_digest,
CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

#: Components of links by the smallest id that is reached.
REACH = """reach(id, tip) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.tip)"""

OP4 = f"""WITH RECURSIVE t AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
u AS (SELECT id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM t),
g AS (SELECT id, x || ' ' || lead(x, 1) OVER s || ' ' || lead(x, 2) OVER s || ' ' || lead(x, 3) OVER s AS sh FROM u WHERE n >= 4 WINDOW s AS (PARTITION BY id ORDER BY i) UNION SELECT id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND 3),
sets AS (SELECT DISTINCT id, sh FROM g WHERE sh IS NOT NULL), sizes AS (SELECT id, count(*) AS n FROM sets GROUP BY id),
both_have AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM sets a JOIN sets b ON a.sh = b.sh AND a.id <> b.id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_have JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), nodes AS (SELECT doc_id AS id FROM documents), {REACH}
SELECT r.id AS doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.tip) AS component_id, r.id = min(r.tip) AS kept FROM reach r LEFT JOIN sizes s ON s.id = r.id GROUP BY r.id"""

OP8 = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, cast(embedding AS double[]) AS e FROM embeddings),
n AS (SELECT id, label, e, sqrt(list_dot_product(e, e)) AS m FROM v WHERE e IS NOT NULL AND label IS NOT NULL AND list_dot_product(e, e) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON x.label = y.label AND x.id <> y.id WHERE list_dot_product(x.e, y.e) / x.m / y.m >= cast(0.98 AS double)), nodes AS (SELECT id FROM v), {REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, min(tip) AS component_id, id = min(tip) AS kept FROM reach GROUP BY id"""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM_WORDS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP11 = f"""WITH d AS (SELECT doc_id, {ITEM_WORDS} AS w FROM documents), b AS (SELECT item_id, {ITEM_WORDS} AS w FROM benchmark),
items AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS x FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
cand AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM cand JOIN win USING (n, x)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(cast(item_id AS varchar), ',' ORDER BY cast(item_id AS varchar)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN its USING (doc_id)"""

OP12 = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || cast(doc_id AS varchar)) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, cast('0x' || substr(h, 1, 8) AS bigint) AS h1, cast('0x' || substr(h, 9, 8) AS bigint) AS h2, cast('0x' || substr(h, 17, 8) AS bigint) AS h3, cast('0x' || substr(h, 25, 8) AS bigint) AS h4 FROM d),
c AS (SELECT *, cast(len(w) AS bigint) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(list_slice(w, 1, a), '') AS prefix, array_to_string(list_slice(w, a + 1, b), '') AS middle, array_to_string(list_slice(w, b + 1, n), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

#: CRC-32 bit by bit; the program as a step for each row that keeps the least (cost, letters) of each state.
OP13 = """WITH RECURSIVE told AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' ') AS k FROM conversations),
way AS (SELECT *, xor(list_reduce(list_prepend(cast(4294967295 AS bigint), flatten(list_transform(string_split(k, ''), lambda c: list_transform(range(8), lambda i: cast((ascii(c) >> cast(i AS integer)) & 1 AS bigint))))), lambda c, b: xor(c >> 1, cast(3988292384 AS bigint) * (xor(c, b) & 1))), cast(4294967295 AS bigint)) % 20 AS d FROM told),
hurt AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM way WHERE d <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k FROM hurt),
marked AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2 WHEN regexp_matches(text, '[^\\x20\\x09-\\x0D.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS f, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM placed),
figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated, count(*) FILTER (k > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM marked GROUP BY conv_id),
st(s, nx) AS (VALUES ('e', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
ins AS (SELECT s AS b, s AS m, 0 AS c, '' AS l FROM st UNION ALL SELECT s, nx, 3, 'I' FROM st UNION ALL SELECT x.s, y.nx, 6, 'II' FROM st x JOIN st y ON y.s = x.nx),
signs AS (SELECT DISTINCT i, f FROM marked),
ops AS (SELECT s AS m, i, f, s AS z, 4 AS c, 'D' AS l FROM st, signs UNION ALL SELECT s, i, f, nx, 3 + f, 'R' FROM st, signs WHERE f IN (0, 3) UNION ALL SELECT s, i, f, i, f, 'K' FROM st, signs WHERE f IN (0, 3) AND (i = nx OR i = 's' AND s = 'e')),
moves AS (SELECT b, i, f, z, min(struct_pack(c := ins.c + ops.c, l := ins.l || ops.l)) AS w FROM ins JOIN ops USING (m) GROUP BY ALL),
dp AS (SELECT DISTINCT conv_id, cast(0 AS bigint) AS k, 'e' AS s, struct_pack(c := 0, l := '') AS w FROM marked UNION ALL
  SELECT dp.conv_id, dp.k + 1, m.z, min(struct_pack(c := dp.w.c + m.w.c, l := dp.w.l || m.w.l)) FROM dp JOIN marked x ON x.conv_id = dp.conv_id AND x.k = dp.k + 1 JOIN moves m ON m.b = dp.s AND m.i = x.i AND m.f = x.f GROUP BY dp.conv_id, dp.k, m.z),
ended AS (SELECT conv_id, min(struct_pack(c := w.c + CASE s WHEN 'u' THEN 3 WHEN 's' THEN 6 ELSE 0 END, l := w.l || CASE s WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END)) AS w FROM dp JOIN figures USING (conv_id) WHERE k = n GROUP BY conv_id),
letters AS (SELECT conv_id, unnest(string_split(w.l, '')) AS l, unnest(range(1, len(w.l) + 1)) AS j FROM ended WHERE w.l <> ''),
lined AS (SELECT *, count(*) FILTER (l <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS k FROM letters),
made AS (SELECT o.conv_id, j, l, x.role, x.text, x.i, row_number() OVER (PARTITION BY o.conv_id ORDER BY j) AS m FROM lined o LEFT JOIN marked x ON l <> 'I' AND x.conv_id = o.conv_id AND x.k = o.k WHERE l <> 'D'),
named AS (SELECT conv_id, j, coalesce(text, '') AS text, l, role, (m + cast(first_value(l = 'K' AND i = 's') OVER (PARTITION BY conv_id ORDER BY j) AS integer)) % 2 AS odd FROM (SELECT conv_id, j, l, role, CASE WHEN l <> 'I' THEN text END AS text, i, m FROM made)),
joined AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN odd = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS t FROM named GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cast(coalesce(w.c, 0) AS bigint) AS cost, coalesce(w.l, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN figures USING (conv_id) LEFT JOIN ended USING (conv_id) LEFT JOIN joined USING (conv_id)"""
