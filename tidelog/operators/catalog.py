"""Catalogue of topics and schemas, retention, access control, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.scalar import is_admin, principal_kind
from tidelog.operators.append import running_total

#: Arrivals in a block of a two-phase rank.
RANKED = 65_536


def latest_schema(topic_schemas: DataFrame) -> DataFrame:
    """The newest schema of each topic; of equally new ones the larger id."""
    top = topic_schemas.groupBy("topic_id").agg(F.max(F.struct("created_us", "schema_id")).alias("s"))
    return top.select("topic_id", "s.schema_id")


def latest_schema_text(topic_schemas: DataFrame, schemas: DataFrame) -> DataFrame:
    """topic_id, schema_id, schema_json of the newest schema of each topic. schemas: schema_id, schema_json."""
    return latest_schema(topic_schemas).join(schemas, "schema_id").select("topic_id", "schema_id", "schema_json")


def resolved(names: DataFrame, topics: DataFrame, strict: bool = False) -> DataFrame:
    """ref, topic_id: a reference is a topic's name, or its number as text; null if there is none, or an error if strict."""
    by_name = names.join(topics, names["ref"] == topics["topic"], "left").select("ref", "topic_id")
    number = F.expr("try_cast(ref AS bigint)")
    ids = topics.select(F.col("topic_id").alias("known"))
    return by_name.join(ids, number == F.col("known"), "left").select("ref", F.coalesce("topic_id", "known", *([F.raise_error(F.concat(F.lit("no topic "), "ref")).cast("long")] if strict else [])).alias("topic_id"))


def by_day(index: DataFrame) -> DataFrame:
    """index with ingest_date: the column to partition its table by, so that retention drops whole days."""
    return index.withColumn("ingest_date", F.to_date(F.timestamp_micros("ingest_us")))


ACL = ["principal", "resource_type", "resource_name", "operation"]


def acl_upsert(acls: DataFrame, new: DataFrame) -> DataFrame:
    """acls after entries were created; one that is there takes the new permission. new has one row for each entry."""
    return acls.join(new.select(*ACL), ACL, "left_anti").unionByName(new)


def acl_delete(acls: DataFrame, principal: str | None = None, resource_type: str | None = None, resource_name: str | None = None, operation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries that stay, entries that go): those that equal all that is given go."""
    gone = F.lit(True)
    for c, v in zip(ACL, (principal, resource_type, resource_name, operation), strict=True):
        gone = gone & (F.col(c) == v) if v is not None else gone
    return acls.where(~gone), acls.where(gone)


def keys_validated(presented: DataFrame, keys: DataFrame, now_us: int) -> DataFrame:
    """api_key, status, principal: a presented key is looked up by the id in its text among keys (key_id, principal, expires_us, revoked_us)."""
    rows = presented.select("api_key", F.regexp_extract("api_key", "^tb_([0-9a-f]{32})_.+$", 1).alias("key_id")).join(keys, "key_id", "left")
    status = F.when(F.col("key_id") == "", "MALFORMED").when(F.col("principal").isNull(), "UNKNOWN").when(F.col("revoked_us").isNotNull(), "REVOKED").when(F.col("expires_us") <= now_us, "EXPIRED").otherwise("VALID")
    return rows.withColumn("status", status).select("api_key", "status", F.when(F.col("status") == "VALID", F.col("principal")).alias("principal"))


def key_revoked(keys: DataFrame, key_id: str, now_us: int) -> DataFrame:
    """keys after one was revoked; a key revoked before keeps its time."""
    return keys.withColumn("revoked_us", F.when((F.col("key_id") == key_id) & F.col("revoked_us").isNull(), F.lit(now_us).cast("long")).otherwise(F.col("revoked_us")))


def updated(topics: DataFrame, changes: DataFrame) -> DataFrame:
    """topics (topic_id, topic, retention_hours) with the changes (topic_id, retention_hours; null leaves it) of known topics."""
    new = changes.select("topic_id", F.col("retention_hours").alias("new"))
    return topics.join(new, "topic_id", "left").select("topic_id", "topic", F.coalesce("new", "retention_hours").alias("retention_hours"))


def expired_segments(index: DataFrame, topics: DataFrame, now: DataFrame) -> DataFrame:
    """Segments older than their topic's retention. now: one row, now_us."""
    rows = index.join(topics.select("topic_id", "retention_hours"), "topic_id").crossJoin(F.broadcast(now))
    return rows.where(F.col("ingest_us") < F.col("now_us") - F.col("retention_hours") * 3_600_000_000).select("topic_id", "batch_id")


def stale_writers(log: DataFrame, now: DataFrame, older_us: int) -> DataFrame:
    """Writers whose last append is older than so many microseconds."""
    last = log.groupBy("writer_id").agg(F.max("ts_us").alias("updated_us"))
    return last.crossJoin(F.broadcast(now)).where(F.col("updated_us") < F.col("now_us") - older_us).select("writer_id", "updated_us")


def newest(df: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.col(by).desc(), F.col(tie).desc()).limit(n)


def acl_decision(requests: DataFrame, acls: DataFrame) -> DataFrame:
    """requests (principal, resource_type, resource_name, operation) with allowed.

    An entry matches by principal, type, operation or "*", and name or "*". A named deny beats a named allow, which beats a
    wildcard deny, which beats a wildcard allow; without an entry: denied. Administrators are always allowed.
    """
    keys = ["principal", "resource_type", "resource_name", "operation"]
    own = lambda c: F.explode(F.array_distinct(F.array(c, F.lit("*"))))
    wanted = requests.distinct().select(*keys, own("resource_name").alias("__name")).select(*keys, "__name", own("operation").alias("__operation"))  # up to four keys each: equi-joins
    a = acls.select(F.col("principal"), F.col("resource_type"), F.col("resource_name").alias("__name"), F.col("operation").alias("__operation"), "permission")
    named, deny = F.col("__name") != "*", F.col("permission") == "deny"
    flag = lambda x, name: F.coalesce(F.bool_or(x), F.lit(False)).alias(name)
    rows = wanted.join(a, ["principal", "resource_type", "__name", "__operation"], "left").groupBy(*keys).agg(flag(named & deny, "nd"), flag(named & ~deny, "na"), flag(~named & deny, "wd"), flag(~named & ~deny, "wa"))
    allowed = F.when(is_admin(F.col("principal")), True).when(F.col("nd"), False).when(F.col("na"), True).when(F.col("wd"), False).otherwise(F.col("wa"))
    return rows.select(*keys, allowed.alias("allowed"))


def request_authz(needs: DataFrame, acls: DataFrame) -> DataFrame:
    """request_id, allowed: every resource a request needs must be allowed. needs: request_id and the columns of acl_decision."""
    keys = ["principal", "resource_type", "resource_name", "operation"]
    told = acl_decision(needs.select(*keys).distinct(), acls)
    return needs.join(told, keys).groupBy("request_id").agg(F.bool_and("allowed").alias("allowed"))


def key_status(keys: DataFrame) -> DataFrame:
    """api_key, status from a key's text and its row (revoked, expires_us, now_us): tb_, 32 hex digits, _ and a secret."""
    key_id = F.regexp_extract("api_key", "^tb_([0-9a-f]{32})_.+$", 1)
    status = F.when(key_id == "", "MALFORMED").when(F.col("revoked"), "REVOKED").when(F.col("expires_us") <= F.col("now_us"), "EXPIRED").otherwise("VALID")
    return keys.select("api_key", status.alias("status"))


def principals(names: DataFrame) -> DataFrame:
    return names.select("principal", principal_kind(F.col("principal")).alias("kind"), is_admin(F.col("principal")).alias("is_admin"))


def numbered_schemas(rows: DataFrame) -> DataFrame:
    """Registration: topic_id, schema_id for rows (topic_id, schema_json, at); equal JSON has one id, numbered from 100 by first sight.

    Ranks in two phases: by blocks of RANKED arrivals, then within a block."""
    first = rows.withColumn("h", F.sha2("schema_json", 256)).groupBy("h").agg(F.min("at").alias("first"))
    first = first.select("*", F.lit(0).alias("__all"), F.expr(f"first div {RANKED}").alias("__block"), F.lit(1).alias("__one"))
    ids = running_total(first, "__all", "__block", ["first"], "__one", "rank").select("h", (F.col("rank") + 99).alias("schema_id"))
    return rows.withColumn("h", F.sha2("schema_json", 256)).join(ids, "h").select("topic_id", "schema_id").distinct()
