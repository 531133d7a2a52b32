"""Queries of this subpackage and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_trees, common, compression, decontaminate, quality_rules, toxicity
from .bpe_codec import bpe_round_trip
from .decontaminate import find_leaks
from .ngram_join import ngram_jaccard_join
from .periodic_runs import periodic_runs
from .repair import repair_token_files
from .secrets import BASE, find_secrets
from .site_templates import extract_texts
from .token_counts import count_tokens
from .url_filter import filter_urls


def op1_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return repair_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, base=50257)


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op3_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_texts(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(common.table(spark, sf_dir, "documents"), width=4, num=85, den=100)


URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "rule string, verdict string"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    return toxicity.score(docs, machine).select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    out = quality_rules.apply_rules(docs, quality_rules.fit_rules(docs, labels))
    return out.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "rule")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where, by the id's crc32, some texts go on from a place with a few words again and again; they are word lists joined by spaces."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    texts = common.id_text(docs).withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    at = texts.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    at = at.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("long"))
    tail = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return at.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periodic_tails(common.table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", *(r[f].cast("string") for f in ("start", "length", "period")))
    # the greatest length, then the least start, then the least period: the array is in the order of the last two
    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{f}").alias(f) for f in ("start", "length", "period")),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op12_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ball_trees.cluster(common.table(spark, sf_dir, "embeddings"), k=40, rounds=5, tag="2")
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op13_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = compression.fit(docs, labels.where(~toxicity.held_out()))
    out = compression.score(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "differences")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def _bounded(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(common.bound_batches(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _bounded(f) for f in (op1_repair_token_files, op2_template_decontamination, op3_site_templates, op4_bpe_round_trip, op5_ngram_jaccard_join, op6_url_filter, op7_toxicity, op8_secrets, op9_token_counts, op10_quality_rules, op11_periodic_runs, op12_ball_tree_clusters, op13_compression_quality, pipeline)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::varchar[] END AS g FROM t),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c WHERE 100 * k >= 85 * (na + nb - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, component) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y.b, r.component FROM r JOIN both_ways y ON y.a = r.node)
SELECT s.doc_id, len(s.g)::bigint AS n_shingles, (SELECT min(component) FROM r WHERE r.node = s.doc_id) AS component_id, (SELECT count(*) FROM both_ways y WHERE y.a = s.doc_id) AS n_links FROM s
"""

OP6_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in URL_RULES)}),
parts AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS q FROM rules),
m AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, length(h) DESC) AS k FROM p JOIN parts ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
"""


def _marked_sql(text: str) -> str:
    """decontaminate.marked in SQL without lookaround: inner separators of numbers stand as control characters meanwhile."""
    all_of = lambda x, pattern, to: f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    t = all_of(all_of(f"coalesce({text}, '')", r"(\p{N})(\p{L})", r"\1 \2"), r"(\p{L})(\p{N})", r"\1 \2")
    for inner, held in zip(r"\. , : /".split(), "\x01\x02\x03\x04"):
        for _ in range(2):  # neighbours share a digit
            t = all_of(t, rf"(\p{{N}}){inner}(\p{{N}})", rf"\1{held}\2")
    t = all_of(t, "\\p{N}+(?:[\x01-\x04]\\p{N}+)*", r"0\0")
    t = all_of(t, r"(^|[^\p{L}\p{M}\p{N}])(\p{Lu})(\p{Ll})", r"\11\2\3")
    t = f"lower({all_of(t, '[^\\p{L}\\p{N}\\p{M}\x01-\x04]+', ' ')})"
    t = all_of(t, rf"(\b0[\p{{N}}\x01-\x04]+ )((?:{decontaminate.UNITS})(?: |$))".replace(r"\x01-\x04", "\x01-\x04"), r"\12\2")
    return f"trim(translate({t}, '\x01\x02\x03\x04', '.,:/'))"


def _sequences_sql(table: str, id_col: str) -> str:
    return rf"SELECT {id_col}, text, string_split(m, ' ') AS words, string_split(regexp_replace(m, '(^| )([012])[^ ]+', '\1\2', 'g'), ' ') AS types FROM (SELECT DISTINCT {id_col}, coalesce(text, '') AS text, {_marked_sql('text')} AS m FROM {table})"


OP2_SQL = rf"""
WITH items AS ({_sequences_sql("benchmark", "item_id")}), docs AS ({_sequences_sql("documents", "doc_id")}),
sizes AS (SELECT least({decontaminate.WINDOW}, len(types)) AS width FROM items WHERE len(types) >= {decontaminate.SHORT_LITERALS} GROUP BY 1),
iw AS (SELECT item_id, width, types[p:p + width - 1] AS t, words[p:p + width - 1] AS w, p FROM (SELECT *, unnest(range(1, len(types) - width + 2)) AS p FROM items JOIN sizes ON width = least({decontaminate.WINDOW}, len(types)) WHERE item_id IS NOT NULL)
  WHERE len(list_filter(types[p:p + width - 1], lambda x: x NOT IN ('0', '1', '2'))) >= CASE WHEN width < {decontaminate.WINDOW} THEN {decontaminate.SHORT_LITERALS} ELSE {decontaminate.LITERALS} END),
n AS (SELECT item_id, count(DISTINCT p) AS item_windows FROM iw GROUP BY 1),
dw AS (SELECT doc_id, text, width, types[p:p + width - 1] AS t, words[p:p + width - 1] AS w, p FROM (SELECT *, unnest(range(1, len(types) - width + 2)) AS p FROM docs, sizes WHERE len(types) >= width)),
met AS (SELECT DISTINCT d.doc_id, d.text, i.item_id, d.p - i.p AS shift, i.p AS ipos, list_filter(list_zip(i.w, d.w), lambda x: x[1] < ':') AS slots FROM iw i JOIN dw d ON i.width = d.width AND i.t = d.t),
pairs AS (SELECT DISTINCT doc_id, text, item_id, shift, unnest(slots) AS s FROM met),
torn AS (SELECT doc_id, text, item_id, shift, s[1] AS v FROM pairs GROUP BY ALL HAVING count(*) > 1),
torn_lists AS (SELECT doc_id, text, item_id, shift, list(v) AS vs FROM torn GROUP BY ALL),
differ AS (SELECT DISTINCT doc_id, text, item_id, shift, true AS differs FROM pairs WHERE s[1] <> s[2]),
good AS (SELECT m.*, coalesce(d.differs, false) AS differs, t.vs IS NULL OR len(list_filter(m.slots, lambda x: list_contains(t.vs, x[1]))) = 0 AS fits FROM met m
  LEFT JOIN torn_lists t ON m.doc_id IS NOT DISTINCT FROM t.doc_id AND m.text = t.text AND m.item_id = t.item_id AND m.shift = t.shift
  LEFT JOIN differ d ON m.doc_id IS NOT DISTINCT FROM d.doc_id AND m.text = d.text AND m.item_id = d.item_id AND m.shift = d.shift),
aligned AS (SELECT doc_id, text, item_id, shift, count(DISTINCT ipos) FILTER (fits) AS k, NOT any_value(differs) AS exact FROM good GROUP BY 1, 2, 3, 4),
best AS (SELECT doc_id, text, item_id, max(struct_pack(k := k, exact := exact)).exact AS exact FROM aligned GROUP BY 1, 2, 3),
found AS (SELECT g.doc_id, g.text, g.item_id, count(DISTINCT ipos) FILTER (fits) AS matched FROM good g GROUP BY 1, 2, 3),
per AS (SELECT f.doc_id, f.item_id, n.item_windows, f.matched, f.matched / n.item_windows AS share, b.exact FROM found f JOIN n ON f.item_id = n.item_id JOIN best b ON f.doc_id IS NOT DISTINCT FROM b.doc_id AND f.text = b.text AND f.item_id = b.item_id)
SELECT doc_id, item_id, o.item_windows AS item_windows, o.matched AS matched, o.share AS share, o.exact AS exact FROM (SELECT doc_id, item_id, max(struct_pack(matched := matched, exact := exact, item_windows := item_windows, share := share)) AS o FROM per WHERE share >= {decontaminate.SHARE} GROUP BY 1, 2)
"""


OP11_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda s, x: list_reduce(range(8), lambda v, b: xor(v >> 1, (v & 1) * 3988292384), xor(s, x)), 4294967295::bigint), 4294967295::bigint) AS h FROM documents),
b AS (SELECT doc_id, w, len(w) AS n, h, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
v AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) END AS w FROM b),
x AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM v),
e AS (SELECT y.doc_id, y.i, z.i - y.i AS p FROM x y JOIN x z ON y.doc_id = z.doc_id AND y.word = z.word WHERE z.i > y.i AND greatest(6, 4 * (z.i - y.i)) <= y.n),
s AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM e) GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
r AS (SELECT doc_id, start, length, min(p) AS period FROM s GROUP BY 1, 2, 3),
d AS (SELECT doc_id, count(*) AS n_runs, max(struct_pack(length := length, a := -start, b := -period)) AS m, string_agg(start::varchar || ',' || length::varchar || ',' || period::varchar || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS text FROM x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.i = g.i WHERE g.i IS NULL GROUP BY 1)
SELECT v.doc_id AS doc_id, coalesce(d.n_runs, 0) AS n_runs, -m.a AS start, m.length AS length, -m.b AS period, 1000 * m.length // -m.b AS exponent_milli, sha256(coalesce(d.lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256, v.n AS n_words
FROM v LEFT JOIN d ON v.doc_id = d.doc_id LEFT JOIN kept ON v.doc_id = kept.doc_id
"""


def _op12_sql(k: int = 40, rounds: int = 5) -> str:
    """Each round's centroids and nearest centroids as tables of their own."""
    steps = [
        "v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS c, q FROM (SELECT sha256('2:' || vec_id::varchar) AS h, q FROM v ORDER BY h NULLS LAST, q LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS (SELECT r, min(struct_pack(d := d, c := c)) AS near FROM (SELECT v.r, c.c, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint AS d FROM v, c{i} c) GROUP BY r)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT c, list(floor(s / n)::bigint ORDER BY j) AS q FROM (SELECT a.near.c AS c, j, sum(x)::double AS s, count(*) AS n FROM (SELECT r, unnest(q) AS x, unnest(range(64)) AS j FROM v) u JOIN a{i} a ON u.r = a.r GROUP BY 1, 2) GROUP BY c)")
            steps.append(f"c{i + 1} AS (SELECT c{i}.c AS c, coalesce(m.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} m ON c{i}.c = m.c)")
    last = "SELECT v.vec_id AS vec_id, a.near.c::integer AS cluster, a.near.d AS distance, (sum(a.near.d) OVER (PARTITION BY a.near.c))::bigint AS cluster_inertia, (sum(a.near.d) OVER ())::bigint AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256"
    return f"WITH {', '.join(steps)} {last} FROM v JOIN a{rounds} a ON v.r = a.r JOIN c{rounds} c ON a.near.c = c.c"


OP12_SQL = _op12_sql()


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express. The others are tested against brute force, round trips or held-out rows."""
    return {"op2_template_decontamination": OP2_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op6_url_filter": OP6_SQL, "op11_periodic_runs": OP11_SQL, "op12_ball_tree_clusters": OP12_SQL}
