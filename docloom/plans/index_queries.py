"""Registered queries of what is kept in folders and changed in place: the vector index, tables by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import Vocabulary
from ..operators import cascade, jobs, retrieve
from ..operators.vector_index import VectorIndex
from ..sources import paged
from ..sources.keyed import KeyedTable
from ..streaming import limits, reorder, rollup
from .file_queries import work_folder
from .queries import SIM, register, t


def asked_of(vectors):
    return vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@register("q_vector_index", f"SELECT query_id, vec_id, label, rank::INT AS rank, round(similarity, 6) AS similarity FROM (SELECT q.vec_id AS query_id, e.vec_id, e.label, {SIM} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {SIM} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) q WHERE e.label IN (1, 2, 3)) WHERE rank <= 10")
def _(spark, d):
    v = t(spark, d, "embeddings")
    index = VectorIndex.build(v, f"{work_folder(spark)}/index", owner=["label"])
    found = index.search(asked_of(v), 10, where=F.col("label").isin(1, 2, 3), exact=True, columns=["label"])
    return found.select("query_id", "vec_id", "label", "rank", F.round("similarity", 6).alias("similarity"))


@register("q_vector_index_recall", "SELECT count(*) AS n_queries, true AS recall_reached, true AS vectors_spared FROM embeddings WHERE vec_id % 20 = 0")
def _(spark, d):
    # these vectors have no clusters: six in ten lists hold nine in ten of the nearest
    v = t(spark, d, "embeddings")
    index, asked = VectorIndex.build(v, f"{work_folder(spark)}/index"), asked_of(v)
    probes = -(-65 * len(index.numbers) // 100)
    truth = retrieve.top_k_of(asked, v, 10).select("query_id", "vec_id")
    hits = truth.join(index.search(asked, 10, probes, columns=[]).select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    sizes = index.lists.groupBy("list").agg(F.count("*").alias("size"))
    turned = asked.select("query_id", "query", F.lit(-1.0).alias("reach")).withColumn("query", F.col("query").cast("array<double>"))
    compared = index.probes(turned, probes).join(sizes, "list").agg(F.sum("size").alias("compared"))
    whole = v.agg(F.count("*").alias("n"))
    recall = hits.agg(F.countDistinct("query_id").alias("n_queries"), (F.count("hit") / F.count("*") >= 0.9).alias("recall_reached"))
    return recall.crossJoin(compared).crossJoin(whole).select("n_queries", "recall_reached", (F.col("compared") < 0.8 * F.col("n") * F.col("n_queries")).alias("vectors_spared"))


# ---- tables changed by key -----------------------------------------------------------------------------------------------
@register(
    "q_keyed_upsert",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 3 THEN 'changed' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders
       UNION ALL SELECT -o_orderkey, 'new', o_totalprice FROM orders WHERE o_orderkey % 97 = 4""",
)
def _(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    table = KeyedTable.create(orders, f"{work_folder(spark)}/orders", "o_orderkey", 16)
    changed = orders.filter("o_orderkey % 97 = 3").withColumn("o_orderstatus", F.lit("changed"))
    added = orders.filter("o_orderkey % 97 = 4").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("new").alias("o_orderstatus"), "o_totalprice")
    for _ in range(2):  # the second time nothing differs, so nothing is written
        table.upsert(changed.unionByName(added))
    return table.rows


@register(
    "q_keyed_queue",
    """WITH j AS (SELECT event_id AS id, event_type, ts, CASE event_id % 3 WHEN 0 THEN 'processing' WHEN 1 THEN 'pending' ELSE 'completed' END AS status FROM events),
     c AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, id) AS nth FROM j WHERE status = 'pending')
SELECT id, event_type, CASE WHEN id IN (SELECT id FROM c WHERE nth <= 2) THEN 'processing' ELSE status END AS status FROM j WHERE NOT (status = 'completed' AND event_type = 'error')""",
)
def _(spark, d):
    status = F.when(F.col("event_id") % 3 == 0, "processing").when(F.col("event_id") % 3 == 1, "pending").otherwise("completed")
    rows = t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("job_type"), F.col("ts").alias("created_at"), status.alias("status"))
    queue = KeyedTable.create(rows, f"{work_folder(spark)}/queue", "id", 16)
    for _ in range(2):  # each claim takes the oldest of each type that are left
        queue.upsert(jobs.oldest_pending(queue.rows).withColumn("status", F.lit("processing")))
    queue.delete((F.col("status") == "completed") & (F.col("job_type") == "error"))
    return queue.rows.select("id", F.col("job_type").alias("event_type"), "status")


# ---- streams --------------------------------------------------------------------------------------------------------------
FILE_ROWS = 100_000


def streamed(spark, rows, order, batches=4):
    """The rows as a stream of files, as many to each batch: the first batch has those whose `order` is 0, the next those of 1.

    A file for each FILE_ROWS rows of the smallest batch, so that a batch is written by more tasks the larger it is.
    """
    folder = f"{work_folder(spark)}/in"
    sizes = {r["k"]: r["count"] for r in rows.groupBy(F.pmod(order, F.lit(batches)).alias("k")).count().collect()}  # `batches` rows
    files = 1 + min(sizes.get(k, 0) for k in range(batches)) // FILE_ROWS
    for k in range(batches):
        part = rows.filter(F.pmod(order, F.lit(batches)) == k)
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def played(spark, frame):
    """All that a stream gives, written in the shared folder and read again."""
    folder = work_folder(spark)
    store, key = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        limits.append_log(frame, f"{folder}/out", f"{folder}/state").awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(frame.schema).parquet(f"{folder}/out")


@register("q_usage_stream", "SELECT user_id, ts::DATE AS day, sum(floor(value))::BIGINT AS used, count(*) AS requests FROM events GROUP BY ALL")
def _(spark, d):
    rows = t(spark, d, "events").select("event_id", "user_id", "ts", "value")
    stream = streamed(spark, rows, F.col("event_id"))
    by, sums = {"user_id": F.col("user_id"), "day": F.to_date("ts")}, {"used": F.floor("value"), "requests": F.lit(1)}
    table = rollup.rollup_table(stream, f"{work_folder(spark)}/usage", by, sums, 8)
    rollup.add_stream(stream, table, by, sums, f"{work_folder(spark)}/state").awaitTermination()
    rollup.batch_adder(table, by, sums)(rows.filter("event_id % 4 = 3"), 3)  # the last batch once more adds nothing
    return table.rows.select("user_id", "day", "used", "requests")


@register(
    "q_progressive_segments",
    """WITH s AS (SELECT conv_id, turn + turn // 2 * (conv_id % 2) AS segment, length(text) AS n_chars FROM conversations)
       SELECT conv_id, segment, row_number() OVER w - 1 AS place, segment <> coalesce(lag(segment) OVER w, -1) + 1 AS after_gap, n_chars FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY segment)""",
)
def _(spark, d):
    # segments come in the order of a hash, those of every second session with numbers left out; the last batch only says that hours have passed
    number = F.col("turn") + F.floor(F.col("turn") / 2) * (F.col("conv_id") % 2)
    rows = t(spark, d, "conversations").select("conv_id", number.cast("long").alias("segment"), "text", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"))
    clock = spark.range(2).select((-F.col("id") - 1).alias("conv_id"), F.lit(0).cast("long").alias("segment"), F.lit("").alias("text"), F.lit("2024-01-01 05:00:00").cast("timestamp").alias("at"))
    slot = F.when(F.col("conv_id") >= 0, F.pmod(F.xxhash64("conv_id", "segment"), F.lit(3))).otherwise(F.lit(2) - F.col("conv_id"))
    found = played(spark, reorder.in_order(streamed(spark, rows.unionByName(clock), slot, 5), "conv_id", "segment"))
    return found.filter("conv_id >= 0").select("conv_id", "segment", "place", "after_gap", F.length("row.text").alias("n_chars"))


@register("q_limited_stream", """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, CASE event_type WHEN 'signup' THEN 'auth' WHEN 'purchase' THEN 'generation' ELSE 'chat' END AS kind, event_id, epoch_us(ts) // 600 AS tick FROM events),
     o AS (SELECT *, row_number() OVER (PARTITION BY key, kind ORDER BY tick, event_id) AS n, CASE kind WHEN 'chat' THEN 30 WHEN 'generation' THEN 5 ELSE 10 END AS most FROM e),
     r AS (SELECT key, kind, n, event_id, true AS allowed, [tick] AS log, most - 1 AS remaining, 0 AS retry_after FROM o WHERE n = 1
           UNION ALL SELECT o.key, o.kind, o.n, o.event_id, len(f) < o.most, CASE WHEN len(f) < o.most THEN list_append(f, o.tick) ELSE f END, CASE WHEN len(f) < o.most THEN o.most - len(f) - 1 ELSE 0 END,
                  CASE WHEN len(f) < o.most THEN 0 ELSE (60000000 - (o.tick - f[1])) // 1000000 + 1 END
           FROM (SELECT o.*, list_filter(r.log, lambda x: x > o.tick - 60000000) AS f FROM r JOIN o ON o.key = r.key AND o.kind = r.kind AND o.n = r.n + 1) AS o)
SELECT key, kind, event_id AS request_id, allowed, remaining::INT AS remaining, retry_after::INT AS retry_after FROM r""")
def _(spark, d):
    # the log's days pass 600 times as fast, so that limits are reached; a file for each stretch of time
    e = t(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "auth").when(F.col("event_type") == "purchase", "generation").otherwise("chat")
    tick = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600).cast("long")
    rows = e.select(F.col("user_id").cast("string").alias("key"), kind.alias("kind"), F.col("event_id").alias("request_id"), F.timestamp_micros(tick).alias("ts"))
    ends = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    share = (F.unix_micros("ts") - F.lit(int(ends["a"].timestamp() * 1e6))) / F.lit(max(1.0, (ends["b"] - ends["a"]).total_seconds() * 1e6))
    stream = streamed(spark, rows, F.least(F.floor(share * 4), F.lit(3)), 4)
    return played(spark, limits.limited_stream(stream)).select("key", "kind", "request_id", "allowed", "remaining", "retry_after")


# ---- deletes that go on -----------------------------------------------------------------------------------------------------
@register(
    "q_cascade_levels",
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))))
       AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)))""",
)
def _(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("line"))  # order and number repeat
    tables = {n: t(spark, d, n) for n in ("region", "nation", "customer", "supplier", "orders")} | {"lineitem": lines}
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "lineitem": "line"}
    links = [("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"), ("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_suppkey", "supplier")]
    first = {"region": tables["region"].filter("r_regionkey IN (1, 3)").select("r_regionkey")}
    return cascade.cascaded(tables, keys, [cascade.Link(*x) for x in links], first, work_folder(spark))["lineitem"].select("l_orderkey", "l_linenumber")


@register(
    "q_cascade_tree",
    """WITH RECURSIVE gone AS (SELECT event_id FROM events WHERE event_id IN (2, 17) UNION SELECT e.event_id FROM events e JOIN gone g ON e.event_id // 3 = g.event_id)
       SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM gone)""",
)
def _(spark, d):
    # each event stands under the one of a third of its number; 0 stands under itself
    rows = t(spark, d, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 3).alias("up"))
    first = {"events": rows.filter("event_id IN (2, 17)").select("event_id")}
    return cascade.cascaded({"events": rows}, {"events": "event_id"}, [cascade.Link("events", "up", "events")], first, work_folder(spark))["events"].select("event_id", "user_id")


# ---- tokens -----------------------------------------------------------------------------------------------------------------
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@register("q_token_texts", "SELECT doc_id, md5(coalesce(text, '')) AS again, true AS counted FROM documents")
def _(spark, d):
    words = Vocabulary(spark, VOCABULARY)
    rows = t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tokens", words.encoded(F.col("text")))
    # no token is empty, and none is left out
    counted = (words.count(F.col("text")) == F.size("tokens")) & (F.size("tokens") <= F.octet_length("text"))
    return rows.select("doc_id", F.md5(words.decoded(F.col("tokens"))).alias("again"), counted.alias("counted"))


# ---- paged scan -------------------------------------------------------------------------------------------------------------
@register("q_paged_scan", "SELECT doc_id, source, n_chars FROM documents UNION ALL SELECT doc_id, source, -n_chars FROM documents WHERE source = 'src3' AND doc_id >= 100")
def _(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "source", "n_chars")
    store = paged.FolderStore.write(rows, f"{work_folder(spark)}/store", "doc_id", "source", 1000)
    columns = "doc_id long, source string, n_chars long"
    mine = paged.scan(spark, store, columns, "doc_id", "source", 200, pushdown=True).filter("source = 'src3' AND doc_id >= 100")
    return paged.scan(spark, store, columns, "doc_id", "source", 200).unionByName(mine.withColumn("n_chars", -F.col("n_chars")))
