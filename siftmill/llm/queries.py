"""The numbered queries: each operator on its whole table, and SQL for the results that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm import bpe, decontam, fim, grammar, linededup, quality, secrets, simhash, topk, toxicity, urlfilter, warc, yinyang
from siftmill.llm.shared import bounded_batches

#: Host and path rules of op3 (fixed values).
RULES = [
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: all addresses with a `ref` parameter, so that a page that was ever reached by a
    referral link is blocked under all its addresses where no rule decides."""
    pages = table(spark, sf_dir, "pages")
    found = urlfilter.url_verdicts(pages, pages.where(F.col("url").rlike("[?&]ref=")).select("url"), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "expected_severity", "grade")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "lines", "lines_removed", "words_removed")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"), k=10)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grammar.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def learned(labels: DataFrame) -> DataFrame:
    """The labels that models may see: rows whose crc32(doc_id as text) mod 3 isn't 1."""
    return labels.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 != 1")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_scores(table(spark, sf_dir, "documents"), learned(table(spark, sf_dir, "labels")))
    held = F.expr("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1").alias("held_out")
    return found.select("doc_id", held, "score", "predicted")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    made = fim.rearranged(table(spark, sf_dir, "documents"))
    found = fim.restored(made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = yinyang.clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", yinyang.digest(F.col("centroid")).alias("centroid_sha256"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    found = secrets.scanned(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, secrets.KINDS[:3]), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_warc, op3_url_filter, op4_byte_bpe, op5_toxicity, op6_decontamination, op7_line_dedup, op8_top_k, op9_token_output, op10_quality, op11_fill_in_middle, op12_centroids, op13_secrets)}

_OP2 = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM f
"""

_CANONICAL = r"""
    CASE WHEN strpos(url, '://') > 0 THEN
        regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END
    END
"""

_OP3 = rf"""
WITH s AS (
    SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
    SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path,
           list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1, 's'), '&'),
               lambda x: x != '' AND split_part(x, '=', 1) NOT IN ('fbclid', 'gclid', 'ref', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'))) AS kept
    FROM s
), c AS (
    SELECT *, {_CANONICAL} AS page,
           (host = 'org' OR host LIKE '%.org') AS org, (host = 'example.org' OR host LIKE '%.example.org') AS example, (host = 'com' OR host LIKE '%.com') AS com
    FROM p
), l AS (SELECT DISTINCT page FROM c WHERE regexp_matches(url, '[?&]ref=') AND page IS NOT NULL),
r AS (
    SELECT page_id, host, path, page,
           CASE WHEN example AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN example AND starts_with(path, '/es/') THEN 'example.org/es/'
                WHEN org AND starts_with(path, '/') THEN 'org/' WHEN com AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN com AND starts_with(path, '/de/') THEN 'com/de/' END AS rule
    FROM c
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN page IN (SELECT page FROM l) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

_OP8 = """
WITH g AS (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM g q JOIN g c ON q.n != c.n WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY n ORDER BY score DESC, vec_id) QUALIFY rank <= 10
"""

# Lines; the windows of 50 words that begin and that end at each; contents' first places; what is left.
_OP7 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (
    SELECT doc_id, pos, line, len(line) - len(replace(line, ' ', '')) + 1 AS words
    FROM (SELECT doc_id, generate_subscripts(parts, 1) AS pos, trim(unnest(parts), ' ') AS line FROM d) WHERE line != ''
), n AS (
    SELECT doc_id, pos, line, words, row_number() OVER o AS n, sum(words) OVER o - words AS start, sum(words) OVER o AS stop
    FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), w AS (
    SELECT doc_id, n AS low, max(n) OVER h AS high, sum(words) OVER h AS held, md5(array_to_string(list(md5(line)) OVER h, '')) AS content
    FROM n WINDOW h AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
    UNION ALL
    SELECT doc_id, min(n) OVER h, n, sum(words) OVER h, md5(array_to_string(list(md5(line)) OVER h, ''))
    FROM n WINDOW h AS (PARTITION BY doc_id ORDER BY stop RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), f AS (
    SELECT content, min((doc_id, low, high)) AS first FROM w WHERE held >= 50 GROUP BY content
), m AS (
    SELECT DISTINCT w.doc_id, low, high FROM w JOIN f USING (content) WHERE held >= 50 AND (w.doc_id != first[1] OR low > first[3])
), c AS (
    SELECT DISTINCT n.doc_id, n.pos, n.words FROM n JOIN m ON n.doc_id = m.doc_id AND n.n BETWEEN low AND high
), g AS (
    SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id
), t AS (
    SELECT d.doc_id, d.text, d.parts, coalesce(g.gone, []) AS gone FROM d LEFT JOIN g USING (doc_id)
)
SELECT doc_id,
       CASE WHEN len(gone) = 0 THEN text ELSE array_to_string(list_transform(list_filter(list_zip(parts, generate_series(1, len(parts))), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]), chr(10)) END AS text,
       CAST(coalesce(len(list_filter(parts, lambda x: trim(x, ' ') != '')), 0) AS BIGINT) AS lines,
       CAST(len(gone) AS BIGINT) AS lines_removed,
       CAST(coalesce((SELECT sum(words) FROM c WHERE c.doc_id = t.doc_id), 0) AS BIGINT) AS words_removed
FROM t
"""

_OP11 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, string_split(text, chr(10)) AS parts FROM t),
l AS (
    SELECT doc_id, text, h, list_filter(list_transform(parts, lambda x, i: x || CASE WHEN i < len(parts) THEN chr(10) ELSE '' END), lambda x: x != '') AS units FROM u
), d AS (
    SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
           CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 AS spm, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain
    FROM l
), p AS (
    SELECT *, coalesce(array_to_string(units[1:least(a, b)], ''), '') AS prefix, coalesce(array_to_string(units[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
           coalesce(array_to_string(units[greatest(a, b) + 1:n], ''), '') AS suffix
    FROM d
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def _op12(k: int = 8, rounds: int = 10) -> str:
    """The rounds one after another: distances of all vectors and centroids, then floors of means."""
    near = """
a{0} AS MATERIALIZED (
    SELECT i, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
        SELECT g.i, c.j, list_sum(list_transform(list_zip(g.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM g, c{0} c
    ) GROUP BY i
)"""
    mean = """
c{1} AS MATERIALIZED (
    SELECT c.j, coalesce(m.v, c.v) AS v FROM c{0} c LEFT JOIN (
        SELECT j, list((s - ((s % n + n) % n)) // n ORDER BY p) AS v FROM (
            SELECT a.j, p, CAST(sum(g.v[p]) AS BIGINT) AS s, count(*) AS n FROM a{0} a JOIN g USING (i), generate_series(1, 64) AS x(p) GROUP BY a.j, p
        ) GROUP BY j
    ) m USING (j)
)"""
    steps = [near.format(r) + "," + mean.format(r, r + 1) for r in range(rounds)] + [near.format(rounds)]
    return f"""
WITH g AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) AS i, vec_id, v FROM (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    )
), c0 AS MATERIALIZED (SELECT CAST(i - 1 AS INTEGER) AS j, v FROM g WHERE i <= {k}),{",".join(steps)}
SELECT vec_id, a.j AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN g USING (i) JOIN c{rounds} c USING (j)
"""


ORACLE_SQL = {"op2_warc": _OP2, "op3_url_filter": _OP3, "op7_line_dedup": _OP7, "op8_top_k": _OP8, "op11_fill_in_middle": _OP11, "op12_centroids": _op12()}
