"""The registered queries of the operators, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extraction, language_id, lm_scoring
from . import toxicity as tox
from .collocations import collocations
from .decontaminate import decontaminate
from .fill_middle import fill_middle, restored
from .mixing import in_order, mix
from .sharding import shard
from .simhash import simhash
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .vector_search import nearest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("item_ids")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
     bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
            FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
     lengths AS (SELECT DISTINCT n FROM bw),
     dw AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
     hit AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
     words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
     items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = in_order(mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
    last = F.round(F.try_element_at("readings", F.lit(-1))["position"], 6)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"), F.size("readings").cast("long").alias("n_readings"), last.alias("last_position"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS o FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
     w AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight, source_size * 3 AS lim FROM s),
     f AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
                  sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS op FROM w),
     l AS (SELECT *, ((SELECT sum(source_size) FROM s) - below)::DOUBLE / op AS level FROM f),
     a AS (SELECT *, level * weight >= lim AS full_up FROM l),
     t AS (SELECT source, source_size, rank, CASE WHEN full_up THEN lim::DOUBLE ELSE (SELECT level FROM a WHERE NOT full_up ORDER BY below LIMIT 1) * weight END AS target FROM a),
     p AS (SELECT doc_id, size, source_size, target, t.rank, floor(target + 0.5)::BIGINT AS wanted,
                  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
     r AS (SELECT *, greatest(0, least(size, wanted - start)) AS r0, greatest(0, least(size, wanted - start - source_size)) AS r1,
                  greatest(0, least(size, wanted - start - 2 * source_size)) AS r2 FROM p),
     n AS (SELECT *, (r0 > 0)::BIGINT + (r1 > 0)::BIGINT + (r2 > 0)::BIGINT AS n_readings FROM r),
     -- positions: the share of the source's demand, inverted through the integral of its falling, steady or rising rate
     x AS (SELECT *, CASE WHEN n_readings > 0 THEN least(start / target, 1.0) END AS f, CASE WHEN n_readings > 0 THEN least((start + (n_readings - 1) * source_size) / target, 1.0) END AS l FROM n)
SELECT doc_id, size, source_size, target, (r0 + r1 + r2)::BIGINT AS taken, n_readings,
       round(CASE rank % 3 WHEN 0 THEN (1.5 - sqrt(2.25 - 2 * f)) WHEN 1 THEN f ELSE (sqrt(0.25 + 2 * f) - 0.5) END, 6) AS position,
       round(CASE rank % 3 WHEN 0 THEN (1.5 - sqrt(2.25 - 2 * l)) WHEN 1 THEN l ELSE (sqrt(0.25 + 2 * l) - 0.5) END, 6) AS last_position
FROM x
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
     later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
     gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
     n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
     words AS (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS i FROM d),
     kept AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS k FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def remainder(folds: int) -> Column:
    """crc32 of doc_id as text, modulo the number of folds."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = tox.learn(docs, table(spark, sf_dir, "labels").filter(remainder(5) != 0))
    return tox.toxicity(docs, machine).select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP6_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     s AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, v.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda a, b: a + b)) AS score FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, log_p = language_id.learn(docs.filter(remainder(4) != 2))
    found = language_id.identify(docs.select("doc_id", "text"), langs, log_p)
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scoring.cross_entropy_difference(docs, table(spark, sf_dir, "labels").filter("quality = 1"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, hex(encode(coalesce(text, ''))) AS x,
                  octet_length(encode(coalesce(text, ''))) AS n FROM documents),
     -- texts in parts of 256 bytes and 49 more: a long string is slow to index
     c AS (SELECT r, o, n, regexp_extract_all(x, '.{1,512}') AS c FROM d WHERE n > 0),
     parts AS MATERIALIZED (SELECT r, o, n, unnest(range(0, len(c))) AS k, unnest(list_transform(list_zip(c, c[2:]), lambda z: z[1] || coalesce(z[2][:98], ''))) AS part FROM c),
     w AS (SELECT r, o, 256 * k + j AS i, substr(part, 2 * j + 1, 100) AS s FROM (SELECT r, o, k, n, part, unnest(range(0, 256)) AS j FROM parts) WHERE 256 * k + j + 50 <= n),
     f AS (SELECT s, min(o) AS first_o FROM w GROUP BY s HAVING min(o) < max(o)),
     gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM w JOIN f USING (s) WHERE o > first_o),
     spans AS (SELECT r, count(*) AS n_removed, count(*) FILTER (i - 1 <> before) AS n_spans
               FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -9) AS before FROM gone) GROUP BY r),
     left_over AS (SELECT r, string_agg(b, '' ORDER BY i) AS k
              FROM (SELECT r, 256 * k + j AS i, substr(part, 2 * j + 1, 2) AS b FROM (SELECT r, k, n, part, unnest(range(0, 256)) AS j FROM parts SEMI JOIN gone USING (r)) WHERE 256 * k + j < n)
              ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n_removed IS NULL THEN x ELSE coalesce(k, '') END)) AS kept_sha256
FROM d LEFT JOIN spans USING (r) LEFT JOIN left_over USING (r)
"""


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract(table(spark, sf_dir, "pages"), html_extraction.learn())
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP11_SQL = """
WITH RECURSIVE bits AS (SELECT 0 AS step, i::BIGINT AS c, i FROM range(256) r(i) UNION ALL SELECT step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i FROM bits WHERE step < 8),
     crc AS (SELECT list(c ORDER BY i) AS v FROM bits WHERE step = 8),
     d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size, ('0x' || md5(coalesce(text, ''))[1:15])::BIGINT AS t, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS k,
                  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, v[xor(c & 255, x) + 1])), 4294967295) AS text_crc32 FROM documents, crc),
     c AS (SELECT t, k, sum(size) AS s FROM d GROUP BY t, k),
     r AS (SELECT t, k, sum(s) OVER (ORDER BY t, k) - s AS before, sum(s) OVER (ORDER BY t, k) AS upto, sum(s) OVER (ORDER BY t) AS text_upto FROM c),
     aim AS (SELECT unnest(range(1, 40)) AS i, (SELECT sum(size) FROM d)::DOUBLE / 40 AS each),
     texts AS (SELECT i, each, arg_min(b, (abs(b - each * i), b)) AS b FROM aim, (SELECT 0 AS b UNION SELECT text_upto FROM r) GROUP BY i, each),
     near AS (SELECT i, arg_min(b, (abs(b - each * i), b)) AS b FROM aim, (SELECT 0 AS b UNION SELECT upto FROM r) GROUP BY i, each),
     cut AS (SELECT i, CASE WHEN abs(texts.b - each * i) <= 0.01 * each THEN texts.b ELSE near.b END AS b FROM texts JOIN near USING (i)),
     s AS (SELECT t, k, (SELECT count(*) FROM cut WHERE cut.b <= r.before)::INT AS shard FROM r),
     -- the order of slots goes by the slices of shards over 16 MB
     p AS (SELECT d.*, shard, greatest(1, ceil(sum(size) OVER (PARTITION BY shard) / 16000000))::BIGINT AS slices FROM d JOIN s USING (t, k))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY (t + k) % slices, t, k) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM p
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     p AS (SELECT lang, w, count(*) AS m FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d) WHERE len(w) > 0 GROUP BY ALL),
     g AS (SELECT lang, k, w[i:i + k - 1] AS g, m FROM (SELECT lang, w, m, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
     f AS MATERIALIZED (SELECT lang, k, g, sum(m)::BIGINT AS f FROM g GROUP BY ALL HAVING sum(m) >= 100),
     n AS (SELECT lang, sum(m * len(w))::BIGINT AS n FROM p GROUP BY lang),
     cuts AS (SELECT lang, k, g, f AS a, unnest(range(1, k)) AS c FROM f WHERE k > 1),
     s AS (SELECT cuts.*, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
           FROM cuts JOIN f l ON l.lang = cuts.lang AND l.g = cuts.g[1:c] JOIN f r ON r.lang = cuts.lang AND r.g = cuts.g[c + 1:cuts.k] JOIN n ON n.lang = cuts.lang),
     low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
     inside AS (SELECT lang, g[i:j] AS g, max(f) AS most FROM (SELECT lang, g, k, f, i, unnest(range(i + 1, k + 1)) AS j FROM (SELECT lang, g, k, f, unnest(range(1, k)) AS i FROM f WHERE k > 2)) WHERE j - i + 1 < k GROUP BY ALL),
     kept AS (SELECT low.*, array_to_string(low.g, ' ') AS phrase FROM low LEFT JOIN inside USING (lang, g) WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    again = F.sha2(restored(F.col("output"), F.col("form")), 256)
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return made.select("doc_id", "n", "form", chars("prefix"), chars("middle"), F.sha2("output", 256).alias("output_sha256"), again.alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
     h AS (SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
     c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
     p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op2_mixing": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op6_vector_search": OP6_SQL, "op9_suffix_dedup": OP9_SQL, "op11_sharding": OP11_SQL, "op12_collocations": OP12_SQL, "op13_fill_middle": OP13_SQL}
