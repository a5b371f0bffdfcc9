"""Cache and metadata queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.config import CacheConfig
from paperloom.functions.hashing import content_id, query_key
from paperloom.operators import cache as ops
from paperloom.operators import metadata as md
from paperloom.plans.catalog import query
from paperloom.plans.fixtures import AS_OF, HANDLERS
from paperloom.plans.sql import AS_OF as NOW
from paperloom.plans.sql import with_parts

LIMIT = 400 * 1024 * 1024
ENTRY = "key, size_bytes, access_count, last_accessed, expires_at, created_at"


@query("live_entries", with_parts(f"SELECT {ENTRY} FROM cache WHERE expires_at > {NOW}"))
def live_entries(t):
    return ops.live_entries(t.cache, AS_OF)


@query("purge_expired", with_parts(f"SELECT {ENTRY} FROM cache WHERE expires_at IS NULL OR expires_at >= {NOW}"))
def purge_expired(t):
    return ops.purge_expired(t.cache, AS_OF)


@query(
    "evict_lru",
    with_parts(
        f"""SELECT {ENTRY} FROM (
              SELECT *, row_number() OVER (ORDER BY last_accessed NULLS FIRST, key) AS pos,
                     count(*) OVER () AS entries, sum(size_bytes) OVER () AS bytes FROM cache)
            WHERE pos > CASE WHEN bytes > {LIMIT} THEN entries * 10 // 100 ELSE 0 END"""
    ),
)
def evict_lru(t):
    return ops.evict_lru(t.cache, CacheConfig(max_size_bytes=LIMIT))


@query(
    "upsert_latest",
    with_parts(
        """SELECT key, value, octet_length(encode(value)) AS size_bytes, CAST(0 AS BIGINT) AS access_count,
                  written_at AS last_accessed, written_at + INTERVAL 1 HOUR AS expires_at,
                  written_at AS created_at, seq
           FROM changed QUALIFY row_number() OVER (PARTITION BY key ORDER BY written_at DESC, seq DESC) = 1""",
        changed="""SELECT key, action || '/' || document_id AS value, "timestamp" AS written_at, event_id AS seq FROM audit""",
    ),
)
def upsert_latest(t):
    return ops.cached_query_rows(ops.upsert_latest(t.changes, ["key"], ["written_at", "seq"]))


@query(
    "cache_hit_split",
    with_parts(
        f"""SELECT a.event_id AS request_id, a.key, coalesce(c.size_bytes, 0) AS size_bytes, c.key IS NOT NULL AS hit
            FROM audit a LEFT JOIN (SELECT * FROM cache WHERE expires_at > {NOW}) c ON c.key = a.key"""
    ),
)
def cache_hit_split(t):
    return ops.cache_hit_split(requests(t), t.cache, AS_OF).na.fill(0, ["size_bytes"])


@query(
    "cache_touch",
    with_parts(
        f"""SELECT c.key, size_bytes, access_count + coalesce(n, 0) AS access_count, greatest(last_accessed, coalesce(latest, last_accessed)) AS last_accessed,
                   expires_at, created_at FROM cache c
            LEFT JOIN (SELECT key, count(*) AS n, max(ts + INTERVAL 1 MINUTE) AS latest FROM (
                         SELECT a.key, a."timestamp" AS ts FROM audit a WHERE action = 'view') GROUP BY 1) r ON r.key = c.key
            WHERE expires_at > {NOW}"""
    ),
)
def cache_touch(t):
    """Every view reads its entry a minute later."""
    views = t.audit.where("action = 'view'").select("key", (F.col("timestamp") + F.make_dt_interval(mins=F.lit(1))).alias("requested_at"))
    return ops.cache_touch(views, t.cache, AS_OF)


def requests(t):
    return t.audit.select(F.col("event_id").alias("request_id"), "key")


@query(
    "cache_hit_rate",
    with_parts(
        f"""SELECT hits, misses, round(coalesce(hits / nullif(hits + misses, 0), 0), 6) AS hit_rate FROM (
              SELECT count(*) FILTER (WHERE c.key IS NOT NULL) AS hits, count(*) FILTER (WHERE c.key IS NULL) AS misses
              FROM audit a LEFT JOIN (SELECT key FROM cache WHERE expires_at > {NOW}) c ON c.key = a.key)"""
    ),
)
def cache_hit_rate(t):
    return ops.cache_hit_rate(ops.cache_hit_split(requests(t), t.cache, AS_OF))


@query(
    "cache_stats_snapshot",
    with_parts(
        f"""SELECT {NOW} AS "timestamp",
                   (SELECT count(*) FROM audit WHERE key IN (SELECT key FROM cache WHERE expires_at > {NOW})) AS hits,
                   (SELECT count(*) FROM audit WHERE key NOT IN (SELECT key FROM cache WHERE expires_at > {NOW})) AS misses,
                   CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes, count(*) AS queries_cached, CAST(0 AS BIGINT) AS evictions
            FROM cache"""
    ),
)
def cache_stats_snapshot(t):
    return ops.stats_snapshot(t.cache, ops.cache_hit_split(requests(t), t.cache, AS_OF), AS_OF)


@query(
    "cache_totals",
    with_parts(
        f"""SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes, round(coalesce(sum(size_bytes), 0) / 1048576, 6) AS total_size_mb,
                   count(*) AS item_count, round(coalesce(sum(size_bytes), 0) / {LIMIT} * 100, 6) AS space_utilization FROM cache"""
    ),
)
def cache_totals(t):
    return ops.cache_totals(t.cache, LIMIT)


@query(
    "cache_size_buckets",
    with_parts(
        """SELECT CASE WHEN size_bytes < 1024 THEN '< 1KB' WHEN size_bytes < 1048576 THEN '< 1MB' ELSE '≥ 1MB' END AS size_category,
                  count(*) AS count FROM cache GROUP BY 1"""
    ),
)
def cache_size_buckets(t):
    return ops.cache_size_buckets(t.cache)


@query(
    "cache_age_buckets",
    with_parts(
        f"""SELECT CASE WHEN days < 1 THEN '< 1 day' WHEN days < 7 THEN '< 1 week' ELSE '≥ 1 week' END AS age_category, count(*) AS count
            FROM (SELECT (epoch_us({NOW}) - epoch_us(created_at)) / 86400e6 AS days FROM cache) GROUP BY 1"""
    ),
)
def cache_age_buckets(t):
    return ops.cache_age_buckets(t.cache, AS_OF)


@query(
    "latency_ewma",
    with_parts(
        """SELECT action, round(sum(latency_ms * power(0.5, n)), 6) AS ewma_ms FROM (
             SELECT action, latency_ms, row_number() OVER (PARTITION BY action ORDER BY "timestamp" DESC, event_id DESC) AS n FROM audit)
           GROUP BY 1"""
    ),
)
def latency_ewma(t):
    return ops.latency_ewma(t.audit, ["action"], ["timestamp", "event_id"], "latency_ms")


@query(
    "hash_keys",
    "SELECT doc_id, md5(text) AS checksum, sha256(text) AS document_id, 'query_' || md5(text) AS cache_key FROM documents",
)
def hash_keys(t):
    return t.documents.select(
        "doc_id",
        F.md5("text").alias("checksum"),
        content_id(F.col("text")).alias("document_id"),
        query_key(F.col("text")).alias("cache_key"),
    )


@query(
    "group_by_type",
    with_parts(
        """SELECT file_type, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
                  CASE WHEN file_type IN ('en', 'de', 'fr') THEN 'latin' END AS handler FROM meta GROUP BY 1"""
    ),
)
def group_by_type(t):
    return md.group_by_type(t.meta, HANDLERS)


BATCHED = """SELECT doc_id, file_type,
                    CAST(floor((row_number() OVER (PARTITION BY file_type ORDER BY doc_id) - 1) / 64) AS BIGINT) AS batch_no
             FROM meta WHERE file_type IN ('en', 'de', 'fr')"""


@query("assign_batches", with_parts(BATCHED))
def assign_batches(t):
    return md.assign_batches(t.meta.select("doc_id", "file_type"), HANDLERS, 64, "file_type", "doc_id")


@query(
    "union_batches",
    with_parts("SELECT doc_id, file_type, checksum FROM meta WHERE file_type IN ('en', 'de', 'fr')"),
)
def union_batches(t):
    batches = [t.meta.where(F.col("file_type") == kind) for kind in HANDLERS]
    return md.union_batches([b.select("doc_id", "file_type", "checksum") for b in batches])


@query(
    "split_failures",
    with_parts(
        """SELECT doc_id, file_path, CASE WHEN file_type IN ('en', 'de', 'fr') THEN 'success' ELSE 'failed' END AS status,
                  CASE WHEN file_type NOT IN ('en', 'de', 'fr') THEN 'unsupported type: ' || file_type END AS error FROM meta"""
    ),
)
def split_failures(t):
    good, failed = md.split_failures(md.with_status(t.meta.select("doc_id", "file_path", "file_type"), HANDLERS))
    return good.unionByName(failed).select("doc_id", "file_path", "status", "error")


@query(
    "validate_required",
    with_parts("SELECT doc_id, coalesce(author <> '' AND file_path <> '' AND file_type <> '' AND creation_date IS NOT NULL, false) AS valid FROM meta"),
)
def validate_required(t):
    return md.validate_required(t.meta).select("doc_id", "valid")


PROPS = T.StructType([T.StructField("k", T.LongType()), T.StructField("note", T.StringType())])


@query("metadata_from_json", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.note' AS note FROM events")
def metadata_from_json(t):
    return md.metadata_from_json(t.read("events").select("event_id", "props"), "props", PROPS)


JSON_FIELDS = ["doc_id", "file_path", "file_type", "department", "checksum", "size_bytes", "access_level"]


@query(
    "metadata_to_json",
    with_parts(
        "SELECT doc_id, CAST(json_object({}) AS VARCHAR) AS metadata FROM meta".format(
            ", ".join(f"'{f}', {f}" for f in JSON_FIELDS)
        )
    ),
)
def metadata_to_json(t):
    return md.metadata_to_json(t.meta.select(*JSON_FIELDS), "doc_id")


@query(
    "metadata_patch",
    with_parts(
        """SELECT m.doc_id, m.file_path, coalesce('review-' || l.toxic, m.classification) AS classification,
                  coalesce(l.quality * 30, m.retention_period) AS retention_period
           FROM meta m LEFT JOIN labels l ON l.doc_id = m.doc_id"""
    ),
)
def metadata_patch(t):
    patch = t.labels.select(
        "doc_id",
        F.concat(F.lit("review-"), "toxic").alias("classification"),
        (F.col("quality") * 30).cast("bigint").alias("retention_period"),
        F.lit("ignored").alias("no_such_field"),
    )
    base = t.meta.select("doc_id", "file_path", "classification", "retention_period")
    return md.metadata_patch(base, patch, "doc_id")


@query(
    "metadata_defaults",
    """SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'approved' ELSE '' END AS classification,
              CASE WHEN l.toxic = 1 THEN 'internal' ELSE 'public' END AS access_level,
              coalesce(CAST(l.quality AS BIGINT) * 30, 0) AS retention_period,
              CAST(0 AS BIGINT) AS page_count, CAST(0 AS BIGINT) AS size_bytes, '' AS checksum
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def metadata_defaults(t):
    partial = t.documents.select("doc_id").join(t.labels, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("quality") == 1, "approved").alias("classification"),
        F.when(F.col("toxic") == 1, "internal").alias("access_level"),
        (F.col("quality").cast("bigint") * 30).alias("retention_period"),
    )
    return md.metadata_defaults(partial)


@query(
    "metadata_lookup",
    with_parts(
        """SELECT a.event_id, a.document_id AS doc_id, m.file_path, m.checksum, m.access_level
           FROM audit a LEFT JOIN meta m ON m.doc_id = a.document_id"""
    ),
)
def metadata_lookup(t):
    asked = t.audit.select("event_id", F.col("document_id").alias("doc_id"))
    found = t.meta.select("doc_id", "file_path", "checksum", "access_level")
    return md.metadata_lookup(asked, found, "doc_id", "event_id")


@query(
    "skip_processed",
    with_parts("SELECT doc_id, file_path, checksum FROM meta WHERE NOT (author = 'curator' AND classification = 'approved')"),
)
def skip_processed(t):
    """Approved documents were processed as they are; restricted ones in an older version."""
    done = t.meta.where(F.col("author") == "curator").select(
        "file_path",
        F.when(F.col("classification") == "approved", F.col("checksum")).otherwise("older").alias("checksum"),
    )
    return md.skip_processed(t.meta.select("doc_id", "file_path", "checksum"), done)
