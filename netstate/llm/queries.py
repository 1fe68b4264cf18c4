"""The operators as queries over the given tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from netstate.llm import (
    decontaminate, host_reputation, language, line_dedup, packing, periodic_runs, pivot_search,
    quality, secret_scan, simhash, source_audit, warc_zip, wavelet)

END_ID = 2
#: The rules that the urls of ``pages`` are judged by.
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = wavelet.write_wavelets(
        _table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), END_ID)
    return wavelet.read_wavelets(manifest)


def line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(
        _table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), END_ID)
    return packing.place(pieces.drop("ids")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc_zip.write_archives(_table(spark, sf_dir, "pages"))
    return warc_zip.read_archives(manifest).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"))


def pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return pivot_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(number(k).alias(f"n_{k}") for k in secret_scan.KINDS),
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"))


def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.benchmark_hits(
        _table(spark, sf_dir, "documents").select("doc_id", "text"),
        _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
        decontaminate.digest(F.col("hits.items")).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"))


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def language_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return found.select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"),
        F.col("language.lang").alias("lang_pred"), "language.score")


def frequency_split_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.find_runs(periodic_runs.plant_repeats(docs))
    best, lines = F.col("periodic.best"), F.transform("periodic.runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                    r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("periodic.runs").cast("long").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * periodic.best.length) div periodic.best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("periodic.collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def host_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return host_reputation.judge(pages, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def collapsed_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit_sources(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wavelet_tokens": wavelet_tokens,
    "op2_line_bitmaps": line_bitmaps,
    "op3_best_fit_packing": best_fit_packing,
    "op4_warc_archives": warc_archives,
    "op5_quality_scores": quality_scores,
    "op6_pivot_top_k": pivot_top_k,
    "op7_secret_spans": secret_spans,
    "op8_benchmark_passages": benchmark_passages,
    "op9_simhash_components": simhash_components,
    "op10_language_mixtures": language_mixtures,
    "op11_frequency_split_runs": frequency_split_runs,
    "op12_host_reputation": host_verdicts,
    "op13_collapsed_source_audit": collapsed_source_audit,
    "pipeline": pipeline,
}

#: DuckDB statements over the same tables.
ORACLES = {
    "op2_line_bitmaps": r"""
WITH lines AS (
  SELECT doc_id, pos, line,
    translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents)),
firsts AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT l.*, f.first IS NOT NULL AND l.doc_id <> f.first AS dropped
  FROM lines l LEFT JOIN firsts f ON l.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), ''))
    AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op4_warc_archives": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100
      GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN p.page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest""",
    "op6_pivot_top_k": """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_benchmark_passages": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id::VARCHAR AS item, least(len(w), 10) AS n,
    array_to_string(w[i:i + 9], ' ') AS passage
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS passage
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM windows))),
found AS (SELECT doc_id, i, p.n, item FROM places p JOIN windows USING (passage)),
hits AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM found) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_frequency_split_runs": r"""
WITH bytes AS (
  SELECT DISTINCT doc_id, flatten([[(ascii(substr(doc_id::VARCHAR, i, 1)) >> b) & 1
      FOR b IN range(8)] FOR i IN range(1, length(doc_id::VARCHAR) + 1)]) AS bits
  FROM documents WHERE doc_id IS NOT NULL),
hashes AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_concat([4294967295], bits),
    lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384))) AS h
  FROM bytes),
split AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
planted AS (
  SELECT row, d.doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS made,
    CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a,
    CASE WHEN len(w) > 0
      THEN 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) END AS p
  FROM split d LEFT JOIN hashes h ON d.doc_id = h.doc_id),
texts AS MATERIALIZED (
  SELECT row, doc_id, n, CASE WHEN made
    THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(n)]
    ELSE w END AS w
  FROM planted),
words AS MATERIALIZED (
  SELECT row, n, unnest(range(n)) AS i, hash(unnest(w)) AS word FROM texts WHERE n >= 24),
equal AS (
  SELECT x.row, x.i, y.i - x.i AS q
  FROM words x JOIN words y
    ON x.row = y.row AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (
  SELECT row, q, min(i) AS s, max(i) + 1 + q AS e
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM equal)
  GROUP BY row, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS MATERIALIZED (
  SELECT * FROM islands r WHERE NOT EXISTS (
    SELECT 1 FROM islands t WHERE t.row = r.row AND t.q < r.q AND t.s <= r.s AND t.e >= r.e)),
best AS (
  SELECT *, count(*) OVER (PARTITION BY row) AS n_runs, row_number() OVER (
    PARTITION BY row ORDER BY ((e - s) * 1000000000000::HUGEINT) // q DESC, s, q) AS rank
  FROM runs),
listed AS (
  SELECT row, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS runs
  FROM runs GROUP BY row),
gone AS (SELECT DISTINCT row, unnest(range(s + q, e)) AS i FROM runs),
kept AS (
  SELECT t.row, string_agg(word, ' ' ORDER BY t.i) AS text
  FROM (SELECT row, unnest(range(n)) AS i, unnest(w) AS word FROM texts) t
  ANTI JOIN gone ON t.row = gone.row AND t.i = gone.i GROUP BY t.row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, e - s AS length, q AS period,
  (1000 * (e - s)) // q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
  sha256(coalesce(text, '')) AS collapsed_sha256
FROM texts LEFT JOIN (SELECT * FROM best WHERE rank = 1) b ON texts.row = b.row
LEFT JOIN listed ON texts.row = listed.row LEFT JOIN kept ON texts.row = kept.row""",
    "op12_host_reputation": r"""
WITH urls AS (
  SELECT page_id, translate(
      coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1')
      THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM urls),
judged AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 0 WHEN rule IS NOT NULL THEN 1 END AS bad
  FROM ruled),
hosts AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain,
    string_split(host, '.')[-1] AS suffix, count(bad)::DOUBLE AS n,
    coalesce(sum(bad), 0)::DOUBLE AS bad
  FROM judged GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
tops AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
tops_m AS (SELECT *, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM tops) AS m FROM tops),
tops_k AS (
  SELECT coalesce(CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN least(0.9, greatest(0.001,
    sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m))))
    END, 0.1) AS rho FROM tops_m WHERE n > 0),
tops_p AS (
  SELECT suffix, (bad + (1 - rho) / rho * m) / (n + (1 - rho) / rho) AS m FROM tops_m, tops_k),
domains_m AS (SELECT d.*, m FROM domains d JOIN tops_p USING (suffix)),
domains_k AS (
  SELECT coalesce(CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN least(0.9, greatest(0.001,
    sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m))))
    END, 0.1) AS rho FROM domains_m WHERE n > 0),
domains_p AS (
  SELECT domain, (bad + (1 - rho) / rho * m) / (n + (1 - rho) / rho) AS m
  FROM domains_m, domains_k),
hosts_m AS (SELECT h.*, m FROM hosts h JOIN domains_p USING (domain)),
hosts_k AS (
  SELECT coalesce(CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN least(0.9, greatest(0.001,
    sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m))))
    END, 0.1) AS rho FROM hosts_m WHERE n > 0),
hosts_p AS (
  SELECT host, n, (1 - rho) / rho AS k, (bad + (1 - rho) / rho * m) / (n + (1 - rho) / rho) AS mean
  FROM hosts_m, hosts_k)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN mean - 2 * sqrt(mean * (1 - mean) / (n + k + 1)) > 0.5 THEN 'block'
  ELSE 'allow' END AS verdict
FROM judged JOIN hosts_p USING (host)""",
    "op13_collapsed_source_audit": r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
counts AS (
  SELECT lang, source, term, sum(n)::BIGINT AS n, count(*) AS docs
  FROM (SELECT row, lang, source, term, count(*) AS n
        FROM (SELECT row, lang, source, unnest(w) AS term
              FROM (SELECT row_number() OVER () AS row, * FROM d)) GROUP BY ALL)
  GROUP BY ALL),
terms AS (
  SELECT lang, term, sum(n)::BIGINT AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM terms GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN (
    SELECT lang, source, sum(c.n)::BIGINT AS total
    FROM counts c JOIN terms USING (lang, term) GROUP BY ALL) USING (lang, source)),
dense AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + v) AS p,
    1 + (1000000000 * (t.n + 1)) // (l.total + v) AS q
  FROM groups g JOIN terms t USING (lang) JOIN langs l USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item,
    coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN dense x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN dense y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
own AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value
  FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank
FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value,
    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank
  FROM own) WHERE rank <= 200""",
}
