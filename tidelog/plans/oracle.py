"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from tidelog.functions.scalar import ERROR_CODES, RETRYABLE, WIRE_CODES

#: The log model as common table expressions; a query names those it needs, and they name theirs.
PARTS = {
    "topics": "SELECT event_type AS topic, row_number() OVER (ORDER BY event_type) AS topic_id FROM (SELECT DISTINCT event_type FROM events)",
    "log": """SELECT e.event_id, epoch_us(e.ts) AS ts_us, t.topic_id, t.topic, e.event_id // 64 AS flush_id, 100 + (e.event_id // 500) % 3 AS schema_id, e.user_id AS writer_id,
        row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS append_seq, CAST(e.user_id AS VARCHAR) AS key, e.props AS value,
        strlen(CAST(e.user_id AS VARCHAR)) + strlen(e.props) AS size FROM events e JOIN topics t ON e.event_type = t.topic""",
    "arrivals": """SELECT event_id, writer_id, append_seq, topic_id, schema_id, kind, event_id + shift AS pos, (event_id + shift) * 4 + kind AS arrival, (event_id + shift) // 64 AS flush_id
        FROM log, (VALUES (0, 0, 1), (1, 3, 7), (2, 40, 11)) k(kind, shift, every) WHERE event_id % every = 0""",
    "seg": "SELECT topic_id, flush_id, schema_id, count(*) AS record_count, CAST(sum(size) AS BIGINT) AS byte_length, max(ts_us) AS last_us FROM log GROUP BY ALL",
    "idx": """SELECT topic_id, flush_id, schema_id, CAST(sum(record_count) OVER t - record_count AS BIGINT) AS start_offset, CAST(sum(record_count) OVER t AS BIGINT) AS end_offset, record_count,
        CAST(sum(byte_length) OVER (PARTITION BY flush_id ORDER BY topic_id, schema_id) - byte_length AS BIGINT) AS byte_offset, byte_length, max(last_us) OVER (PARTITION BY flush_id) AS ingest_us,
        flush_id * 1000 + topic_id * 10 + schema_id - 100 AS batch_id FROM seg WINDOW t AS (PARTITION BY topic_id ORDER BY flush_id, schema_id)""",
    "rec": "SELECT l.*, start_offset, start_offset + row_number() OVER (PARTITION BY topic_id, flush_id, schema_id ORDER BY event_id) - 1 AS \"offset\" FROM log l JOIN idx USING (topic_id, flush_id, schema_id)",
    "hw": "SELECT topic_id, coalesce(max(end_offset), 0) AS high_watermark FROM topics LEFT JOIN idx USING (topic_id) GROUP BY topic_id",
    "now": "SELECT max(ts_us) AS now_us FROM log",
    "cursors": "SELECT 'g1' AS group_id, t.topic_id, (SELECT coalesce(max(end_offset), 0) FROM idx i WHERE i.topic_id = t.topic_id AND end_offset * 4 <= 3 * (SELECT high_watermark FROM hw WHERE hw.topic_id = t.topic_id)) AS dispatch_cursor FROM topics t",
    "inflight": "SELECT 'g1' AS group_id, topic_id, start_offset, end_offset, 'r' || (flush_id % 3) AS reader_id, ingest_us + 45000000 AS expires_us FROM idx JOIN hw USING (topic_id) WHERE end_offset * 4 <= high_watermark * 3 AND start_offset * 2 >= high_watermark",
    "members": "SELECT 'g1' AS group_id, 'r' || (writer_id % 3) AS reader_id, max(ts_us) - CASE WHEN writer_id % 3 = 2 THEN 31000000 ELSE 0 END AS heartbeat_us FROM log GROUP BY writer_id % 3",
    "claims": "SELECT batch_id, CASE WHEN flush_id % 3 = 0 THEN 'completed' ELSE 'pending' END AS status, ingest_us AS claimed_us FROM idx WHERE flush_id % 3 < 2",
    "tschemas": "SELECT topic_id, schema_id, min(ts_us) AS created_us FROM log GROUP BY ALL",
    "pairs": "SELECT DISTINCT 'user:' || lower(c_mktsegment) AS principal, n_name, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "acls": """SELECT principal, 'topic' AS resource_type, n_name AS resource_name, CASE WHEN n_nationkey % 2 = 0 THEN 'append' ELSE '*' END AS operation, CASE WHEN n_nationkey % 4 = 0 THEN 'deny' ELSE 'allow' END AS permission
        FROM pairs WHERE n_nationkey % 3 = 0 UNION ALL SELECT DISTINCT principal, 'topic', '*', CASE WHEN length(principal) % 2 = 0 THEN 'consume' ELSE 'append' END, CASE WHEN length(principal) % 3 = 0 THEN 'deny' ELSE 'allow' END FROM pairs""",
    "asks": """SELECT principal, 'topic' AS resource_type, n_name AS resource_name, operation FROM pairs, (VALUES ('append'), ('consume')) o(operation)
        UNION ALL VALUES ('admin', 'topic', 'FRANCE', 'append'), ('admin:ops', 'group', 'g1', 'consume'), ('user:none', 'topic', 'x', 'append')""",
    "told": """SELECT q.*, CASE WHEN principal = 'admin' OR starts_with(principal, 'admin:') THEN true
        WHEN EXISTS (SELECT 1 FROM acls a WHERE a.principal = q.principal AND a.resource_type = q.resource_type AND a.operation IN (q.operation, '*') AND a.resource_name = q.resource_name AND permission = 'deny') THEN false
        WHEN EXISTS (SELECT 1 FROM acls a WHERE a.principal = q.principal AND a.resource_type = q.resource_type AND a.operation IN (q.operation, '*') AND a.resource_name = q.resource_name AND permission = 'allow') THEN true
        WHEN EXISTS (SELECT 1 FROM acls a WHERE a.principal = q.principal AND a.resource_type = q.resource_type AND a.operation IN (q.operation, '*') AND a.resource_name = '*' AND permission = 'deny') THEN false
        ELSE EXISTS (SELECT 1 FROM acls a WHERE a.principal = q.principal AND a.resource_type = q.resource_type AND a.operation IN (q.operation, '*') AND a.resource_name = '*' AND permission = 'allow') END AS allowed FROM asks q""",
    "w0": """SELECT writer_id, topic_id, append_seq, "offset", 'p' || writer_id || '-s' || append_seq AS value, event_id * 1000 AS start_us, event_id * 1000 + 500 AS end_us FROM rec""",
    "w1": """SELECT writer_id, topic_id, append_seq, CASE WHEN "offset" % 97 = 5 THEN "offset" + 1 WHEN "offset" % 89 = 7 THEN "offset" + 20 ELSE "offset" END AS "offset",
        CASE WHEN append_seq % 31 = 3 THEN 'p' || writer_id || '-s1' ELSE value END AS value, start_us, end_us FROM w0""",
    "s0": 'SELECT topic_id, value, "offset" FROM w0',
    "s1": 'SELECT topic_id, value, "offset" FROM w0 WHERE "offset" % 83 <> 2',
    "rd": "SELECT 'r0' AS reader_id, topic_id, unnest(range(0, greatest(n - 1, 0) // 50 + 1)) AS read_no, n FROM (SELECT topic_id, max(end_offset) AS n FROM idx GROUP BY 1)",
    "r0": "SELECT reader_id, topic_id, read_no, read_no * 50 AS requested_offset, least(50, n - read_no * 50) AS n_values, least(read_no * 60 + 60, n) AS high_watermark FROM rd",
    "r1": "SELECT reader_id, topic_id, read_no, read_no * 50 + CASE WHEN read_no % 7 = 3 THEN 1 ELSE 0 END AS requested_offset, least(50, n - read_no * 50) AS n_values, least(read_no * 60 + 60, n) - CASE WHEN read_no % 5 = 4 THEN 100 ELSE 0 END AS high_watermark FROM rd",
}


def needs(sql: str) -> list[str]:
    """Names of the parts that sql names, and of those that these name, in order."""
    import re

    words = set(re.findall(r"\b[a-z]\w*\b", sql))
    found: set[str] = set()
    for name in reversed(PARTS):
        if name in words:
            found.add(name)
            words |= set(re.findall(r"\b[a-z]\w*\b", PARTS[name]))
    return [n for n in PARTS if n in found]


def full(sql: str) -> str:
    parts = ", ".join(f"{n} AS ({PARTS[n]})" for n in needs(sql))
    head = "WITH RECURSIVE " if "RECURSIVE" in sql else "WITH "
    sql = sql.replace("RECURSIVE ", "")
    if sql.startswith("WITH "):
        sql = sql.removeprefix("WITH ")
        return f"{head}{parts}, {sql}" if parts else f"{head}{sql}"
    return f"{head}{parts} {sql}" if parts else sql


DECISION = """WITH d AS (SELECT *, max(append_seq) OVER (PARTITION BY writer_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last,
    max(append_seq) OVER (PARTITION BY writer_id, flush_id ORDER BY arrival ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM arrivals),
    c AS (SELECT arrival, writer_id, append_seq, topic_id, schema_id, flush_id, pos, CASE WHEN last IS NULL OR append_seq > last THEN 'ACCEPT' WHEN append_seq = last THEN 'DUPLICATE' {} ELSE 'STALE' END AS decision FROM d) """
LEAVE = """WITH cur AS (SELECT c.group_id, c.topic_id, least(dispatch_cursor, coalesce((SELECT min(start_offset) FROM inflight i WHERE i.topic_id = c.topic_id AND reader_id = '{0}'), dispatch_cursor)) AS dispatch_cursor FROM cursors c)
    SELECT *, coalesce((SELECT min(start_offset) FROM inflight i WHERE i.topic_id = cur.topic_id AND reader_id <> '{0}'), dispatch_cursor) AS committed_watermark FROM cur"""
GRANTS = """g AS (SELECT topic_id, start_offset, i, (SELECT min(b.i) FROM n b WHERE b.topic_id = a.topic_id AND b.i BETWEEN a.i AND a.i + 9 AND (b.cum - a.cum + a.byte_length >= {} OR b.i = a.i + 9 OR b.i = a.last)) AS j FROM n a)"""
NUMBERED = "n AS (SELECT topic_id, start_offset, end_offset, byte_length, row_number() OVER (PARTITION BY topic_id ORDER BY start_offset) AS i, count(*) OVER (PARTITION BY topic_id) AS last, sum(byte_length) OVER (PARTITION BY topic_id ORDER BY start_offset) AS cum FROM idx {})"

#: The state of the groups after a step: which leases l stay, which members stay, and where the cursors stand.
AFTER = """WITH l AS (SELECT * FROM inflight {leases}), mem AS (SELECT group_id, count(*) AS m FROM members {members} GROUP BY 1), cur AS ({cursors})
    SELECT cur.group_id, cur.topic_id, dispatch_cursor, coalesce((SELECT min(start_offset) FROM l WHERE l.topic_id = cur.topic_id AND l.group_id = cur.group_id), dispatch_cursor) AS committed_watermark,
    (SELECT count(*) FROM l WHERE l.topic_id = cur.topic_id AND l.group_id = cur.group_id) AS n_leases, coalesce((SELECT m FROM mem WHERE mem.group_id = cur.group_id), 0) AS n_members FROM cur"""
ROLLED = "SELECT c.group_id, c.topic_id, least(dispatch_cursor, coalesce((SELECT min(start_offset) FROM inflight i WHERE i.topic_id = c.topic_id AND {}), dispatch_cursor)) AS dispatch_cursor FROM cursors c"
SILENT = "reader_id <> 'r1' AND reader_id IN (SELECT reader_id FROM members, now WHERE heartbeat_us < now_us - 30000000)"
FRESH = """WITH n AS (SELECT i.topic_id, i.start_offset, i.end_offset, row_number() OVER t AS i, sum(byte_length) OVER t - byte_length AS before FROM idx i JOIN cursors c USING (topic_id)
    WHERE i.end_offset > c.dispatch_cursor WINDOW t AS (PARTITION BY i.topic_id ORDER BY i.start_offset)), fresh AS (SELECT topic_id, min(start_offset) AS s, max(end_offset) AS e FROM n WHERE i <= 10 AND before < 4096 GROUP BY 1)"""
AT_LAST = 'SELECT writer_id, append_seq, "offset" FROM rec'

SQL = {
    "group_join_state": """WITH cur AS (SELECT * FROM cursors UNION ALL SELECT 'g2', topic_id, 0 FROM topics), mem AS (SELECT group_id, count(*) + 1 AS m FROM members GROUP BY 1 UNION ALL SELECT 'g2', 1)
        SELECT cur.group_id, cur.topic_id, dispatch_cursor, coalesce((SELECT min(start_offset) FROM inflight l WHERE l.topic_id = cur.topic_id AND l.group_id = cur.group_id), dispatch_cursor) AS committed_watermark,
        (SELECT count(*) FROM inflight l WHERE l.topic_id = cur.topic_id AND l.group_id = cur.group_id) AS n_leases, m AS n_members FROM cur JOIN mem USING (group_id)""",
    "poll_decision": FRESH + """, old AS (SELECT topic_id, start_offset, end_offset FROM inflight, now WHERE expires_us < now_us QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY start_offset) = 1),
        q AS (SELECT scenario, topic_id, CASE WHEN topic_id = 1 THEN 'r9' ELSE 'r' || (topic_id % 3) END AS reader_id FROM topics, (VALUES ('fresh'), ('steal'), ('limited')) v(scenario)),
        d AS (SELECT q.*, CASE WHEN reader_id = 'r9' THEN 'none' WHEN scenario = 'limited' AND (SELECT count(*) FROM inflight i WHERE i.topic_id = q.topic_id AND i.reader_id = q.reader_id) >= 10 THEN 'limit'
            WHEN scenario <> 'fresh' AND old.topic_id IS NOT NULL THEN 'old' ELSE 'new' END AS what, old.start_offset AS os, old.end_offset AS oe, s, e FROM q LEFT JOIN old USING (topic_id) LEFT JOIN fresh USING (topic_id))
        SELECT scenario, topic_id, reader_id, CASE WHEN what = 'limit' THEN 'MAX_INFLIGHT' ELSE 'OK' END AS status, CASE what WHEN 'old' THEN os WHEN 'new' THEN s END AS start_offset, CASE what WHEN 'old' THEN oe WHEN 'new' THEN e END AS end_offset FROM d""",
    "poll_state": FRESH + """ SELECT c.group_id, c.topic_id, coalesce(e, dispatch_cursor) AS dispatch_cursor, coalesce((SELECT min(start_offset) FROM inflight i WHERE i.topic_id = c.topic_id), s, dispatch_cursor) AS committed_watermark,
        (SELECT count(*) FROM inflight i WHERE i.topic_id = c.topic_id) + CASE WHEN s IS NULL THEN 0 ELSE 1 END AS n_leases, (SELECT count(*) FROM members) AS n_members FROM cursors c LEFT JOIN fresh USING (topic_id)""",
    "poll_after_leave": "WITH c AS (" + ROLLED.format("reader_id = 'r0'") + """), live AS (SELECT * FROM inflight WHERE reader_id <> 'r0'),
        p AS (SELECT topic_id, dispatch_cursor AS pos FROM c UNION SELECT c.topic_id, end_offset FROM c JOIN live USING (topic_id) WHERE end_offset > dispatch_cursor),
        f AS (SELECT topic_id, min(pos) AS pos FROM p WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.topic_id = p.topic_id AND start_offset <= pos AND pos < end_offset) GROUP BY 1),
        u AS (SELECT f.topic_id, pos, (SELECT min(start_offset) FROM live WHERE live.topic_id = f.topic_id AND start_offset > pos) AS until FROM f),
        s AS (SELECT u.topic_id, pos, until, idx.end_offset, row_number() OVER (PARTITION BY u.topic_id ORDER BY idx.start_offset) AS i FROM u JOIN idx USING (topic_id) WHERE idx.end_offset > pos AND (until IS NULL OR idx.start_offset < until))
        SELECT topic_id, 'r1' AS reader_id, 'OK' AS status, any_value(pos) AS start_offset, least(max(end_offset), any_value(until)) AS end_offset FROM s WHERE i <= 10 GROUP BY topic_id""",
    "heartbeat_state": AFTER.format(leases=f"WHERE NOT ({SILENT})", members=f"WHERE NOT ({SILENT})", cursors=ROLLED.format(SILENT)),
    "heartbeat_answers": "SELECT 'g1' AS group_id, r AS reader_id, CASE WHEN r IN (SELECT reader_id FROM members) THEN 'OK' ELSE 'UNKNOWN_MEMBER' END AS status FROM (VALUES ('r1'), ('r9')) v(r)",
    "commit_state": AFTER.format(leases="WHERE reader_id <> 'r0'", members="", cursors="SELECT * FROM cursors"),
    "leave_state": AFTER.format(leases="WHERE reader_id <> 'r0'", members="WHERE reader_id <> 'r0'", cursors=ROLLED.format("reader_id = 'r0'")),
    "force_remove_state": AFTER.format(leases="WHERE reader_id <> 'r2'", members="WHERE reader_id <> 'r2'", cursors=ROLLED.format("reader_id = 'r2'")),
    "force_reset_state": AFTER.format(leases="WHERE topic_id > 2", members="WHERE false", cursors="SELECT group_id, topic_id, CASE WHEN topic_id <= 2 THEN coalesce((SELECT min(start_offset) FROM inflight i WHERE i.topic_id = c.topic_id), dispatch_cursor) ELSE dispatch_cursor END AS dispatch_cursor FROM cursors c"),
    "writer_acks": f'WITH r AS ({AT_LAST}) SELECT writer_id, append_seq AS last_seq, "offset" AS last_start, "offset" + 1 AS last_end FROM r QUALIFY row_number() OVER (PARTITION BY writer_id ORDER BY append_seq DESC) = 1',
    "dedup_answers": f"""WITH r AS ({AT_LAST}), s AS (SELECT writer_id, append_seq AS last, "offset" AS o FROM r QUALIFY row_number() OVER (PARTITION BY writer_id ORDER BY append_seq DESC) = 1)
        SELECT arrival, writer_id, append_seq, CASE WHEN append_seq > last THEN 'ACCEPT' WHEN append_seq = last THEN 'DUPLICATE' ELSE 'STALE' END AS decision, CASE WHEN append_seq = last THEN o END AS start_offset, CASE WHEN append_seq = last THEN o + 1 END AS end_offset FROM arrivals JOIN s USING (writer_id)""",
    "ack_ranges": """WITH q AS (SELECT flush_id, topic_id, schema_id, writer_id, min(event_id) AS append_seq, count(*) AS n FROM log GROUP BY 1, 2, 3, 4),
        p AS (SELECT *, CAST(sum(n) OVER (PARTITION BY flush_id, topic_id, schema_id ORDER BY append_seq) - n AS BIGINT) AS place FROM q)
        SELECT writer_id, append_seq, topic_id, schema_id, start_offset + place AS start_offset, start_offset + place + n AS end_offset FROM p JOIN idx USING (flush_id, topic_id, schema_id)""",
    "offset_allocation": "SELECT topic_id, flush_id, schema_id, start_offset, end_offset, record_count FROM idx",
    "segment_index": "SELECT * EXCLUDE (batch_id) FROM idx",
    "segment_layout": "SELECT flush_id, topic_id, schema_id, byte_offset, byte_offset + byte_length AS byte_end, CAST(sum(byte_length) OVER (PARTITION BY flush_id) AS BIGINT) AS object_bytes, 'log/' || strftime(make_timestamp(ingest_us), '%Y-%m-%d') || '/' || (ingest_us // 1000) || '-' || flush_id || '.fl' AS object_key FROM idx",
    "record_encoded_size": "SELECT event_id, size, CAST(size + CASE WHEN strlen(key) < 64 THEN 1 ELSE 2 END + CASE WHEN strlen(value) < 64 THEN 1 WHEN strlen(value) < 8192 THEN 2 ELSE 3 END AS BIGINT) AS encoded_size FROM log",
    "buffer_merge": "SELECT flush_id, topic_id, schema_id, writer_id, min(p) AS start_idx, count(*) AS record_count FROM (SELECT *, row_number() OVER (PARTITION BY flush_id, topic_id, schema_id ORDER BY event_id) - 1 AS p FROM log) GROUP BY ALL",
    "ack_distribution": 'SELECT writer_id, append_seq, topic_id, schema_id, "offset" AS start_offset, "offset" + 1 AS end_offset FROM rec',
    "dedup_coalesce": "SELECT flush_id, writer_id, append_seq, count(*) AS n_requests FROM arrivals GROUP BY ALL",
    "dedup_classify": DECISION.format("") + "SELECT arrival, writer_id, append_seq, decision FROM c",
    "dedup_pipelined": DECISION.format("WHEN later > append_seq THEN 'ACCEPT'") + "SELECT arrival, writer_id, append_seq, decision FROM c",
    "accepted_offsets": DECISION.format("") + ", s AS (SELECT topic_id, flush_id, schema_id, count(*) AS k FROM c WHERE decision = 'ACCEPT' GROUP BY ALL) SELECT topic_id, flush_id, schema_id, CAST(sum(k) OVER t - k AS BIGINT) AS start_offset, CAST(sum(k) OVER t AS BIGINT) AS end_offset FROM s WINDOW t AS (PARTITION BY topic_id ORDER BY flush_id, schema_id)",
    "writer_state_upsert": "SELECT writer_id, max(append_seq) AS last_seq FROM log GROUP BY 1",
    "append_bytes": "SELECT writer_id, CAST(sum(size) AS BIGINT) AS bytes FROM log GROUP BY 1",
    "segment_lookup": "SELECT topic_id, start_offset, end_offset, schema_id FROM idx WHERE end_offset > 250 QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY start_offset) <= 10",
    "segment_lookup_bounded": "SELECT topic_id, start_offset, end_offset, schema_id FROM idx WHERE end_offset > 250 AND start_offset < 400 QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY start_offset) <= 10",
    "offset_point_lookup": "SELECT topic_id, CAST(p AS BIGINT) AS probe_offset, start_offset, end_offset FROM idx, (VALUES (0), (250), (999)) v(p) WHERE start_offset <= p AND p < end_offset",
    "high_watermark": "SELECT topic_id, high_watermark FROM hw UNION ALL SELECT 99, 0",
    "read_from_offset": 'SELECT topic_id, "offset", key, value FROM rec WHERE "offset" >= 100',
    "read_range": 'SELECT topic_id, "offset", key, value FROM rec WHERE "offset" >= 100 AND "offset" < 200',
    "read_beyond_watermark": 'SELECT topic_id, "offset", key, value FROM rec WHERE "offset" >= 1000000000',
    "read_max_bytes": 'SELECT * FROM (SELECT topic_id, "offset", size, CAST(sum(size) OVER (PARTITION BY topic_id ORDER BY "offset") - size AS BIGINT) AS running_before FROM rec WHERE "offset" >= 100) WHERE running_before < 4096',
    "schema_runs": """WITH c AS (SELECT topic_id, "offset" AS o, schema_id, CASE WHEN schema_id = lag(schema_id) OVER t THEN 0 ELSE 1 END AS ch FROM rec WINDOW t AS (PARTITION BY topic_id ORDER BY "offset")),
        r AS (SELECT *, sum(ch) OVER (PARTITION BY topic_id ORDER BY o) AS run_no FROM c)
        SELECT topic_id, CAST(run_no AS BIGINT) AS run_no, schema_id, min(o) AS first_offset, max(o) AS last_offset, count(*) AS n, any_value(high_watermark) AS high_watermark FROM r JOIN hw USING (topic_id) GROUP BY topic_id, run_no, schema_id UNION ALL SELECT 99, 1, 0, 0, -1, 0, 0""",
    "flagship": """WITH b AS (SELECT topic_id, "offset" AS o, schema_id, sum(size) OVER (ORDER BY "offset") - size AS before FROM rec WHERE topic = 'purchase' AND "offset" >= 50),
        c AS (SELECT *, CASE WHEN schema_id = lag(schema_id) OVER (ORDER BY o) THEN 0 ELSE 1 END AS ch FROM b WHERE before < 16384), r AS (SELECT *, sum(ch) OVER (ORDER BY o) AS run_no FROM c)
        SELECT topic_id, CAST(run_no AS BIGINT) AS run_no, schema_id, min(o) AS first_offset, max(o) AS last_offset, count(*) AS n, any_value(high_watermark) AS high_watermark FROM r JOIN hw USING (topic_id) GROUP BY topic_id, run_no, schema_id""",
    "tail_last_n": 'SELECT event_id, topic_id, "offset", key, value FROM rec ORDER BY event_id DESC LIMIT 100',
    "tail_json": 'SELECT topic_id, "offset", key, value, value AS json_value FROM rec',
    "tail_decode_fallback": """SELECT topic_id, "offset", key, CASE WHEN event_id % 10 = 0 THEN 'x' || value ELSE value END AS value, CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract(value, '$.k') AS BIGINT) END AS k, event_id % 10 <> 0 AS decoded FROM rec""",
    "json_ingest": """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'REJECTED' ELSE 'OK' END AS status, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""",
    "latest_schema_per_topic": "SELECT topic_id, schema_id FROM tschemas QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY created_us DESC, schema_id DESC) = 1",
    "schemas_for_topic": "SELECT topic_id, schema_id, created_us FROM tschemas WHERE topic_id = 1",
    "cursor_vs_watermark": "SELECT group_id, topic_id, dispatch_cursor, high_watermark, dispatch_cursor < high_watermark AS has_more FROM cursors JOIN hw USING (topic_id)",
    "unclaimed_batches": "SELECT batch_id, topic_id, start_offset FROM idx WHERE topic_id IN (1, 2, 3) AND batch_id NOT IN (SELECT batch_id FROM claims) ORDER BY start_offset, batch_id LIMIT 100",
    "member_exists": "SELECT topic_id, start_offset, reader_id FROM inflight WHERE reader_id IN (SELECT reader_id FROM members WHERE reader_id <> 'r1')",
    "topics_in_list": "SELECT topic_id, flush_id, schema_id FROM idx WHERE topic_id IN (1, 3)",
    "group_member_counts": "SELECT g.group_id, topic_id, (SELECT count(*) FROM members m WHERE m.group_id = g.group_id) AS member_count FROM topics, (VALUES ('g1'), ('g2')) g(group_id)",
    "topic_resolution": "SELECT ref, coalesce(a.topic_id, b.topic_id) AS topic_id FROM (VALUES ('purchase'), ('2'), ('5'), ('77'), ('nothing')) r(ref) LEFT JOIN topics a ON a.topic = ref LEFT JOIN topics b ON b.topic_id = try_cast(ref AS BIGINT)",
    "list_topics": "SELECT topic_id, topic, min(ts_us) AS created_us FROM log GROUP BY ALL",
    "list_groups": "SELECT group_id, topic_id, dispatch_cursor FROM cursors",
    "topic_update": "SELECT topic_id, topic, CAST(CASE WHEN topic_id = 1 THEN 24 ELSE 168 END AS BIGINT) AS retention_hours FROM topics",
    "retention_prune": "SELECT topic_id, batch_id FROM idx, now WHERE ingest_us < now_us - topic_id * 24 * 3600000000",
    "stale_writers": "SELECT writer_id, max(ts_us) AS updated_us FROM log GROUP BY 1 HAVING max(ts_us) < (SELECT now_us FROM now) - 86400000000",
    "group_join": "SELECT group_id, reader_id, max(heartbeat_us) AS heartbeat_us FROM (SELECT * FROM members UNION ALL SELECT group_id, reader_id, heartbeat_us + 5000000 FROM members WHERE reader_id <> 'r0' UNION ALL VALUES ('g1', 'r9', 1)) GROUP BY 1, 2",
    "inflight_per_reader": "SELECT group_id, topic_id, reader_id, count(*) AS inflight, count(*) >= 10 AS at_limit FROM inflight GROUP BY 1, 2, 3",
    "poll_next_range": "WITH " + NUMBERED.format("WHERE end_offset > 120") + ", " + GRANTS.format(4096) + " SELECT g.topic_id, greatest(g.start_offset, 120) AS start_offset, n.end_offset, j AS n_segments FROM g JOIN n ON n.topic_id = g.topic_id AND n.i = g.j WHERE g.i = 1",
    "poll_sequence": "WITH RECURSIVE " + NUMBERED.format("") + ", " + GRANTS.format(4096) + ", p AS (SELECT topic_id, 0 AS step, i, j FROM g WHERE i = 1 UNION ALL SELECT p.topic_id, step + 1, g.i, g.j FROM p JOIN g ON g.topic_id = p.topic_id AND g.i = p.j + 1) SELECT p.topic_id, CAST(step AS BIGINT) AS step, a.start_offset, b.end_offset FROM p JOIN n a ON a.topic_id = p.topic_id AND a.i = p.i JOIN n b ON b.topic_id = p.topic_id AND b.i = p.j",
    "expired_lease_steal": "SELECT topic_id, start_offset, end_offset, reader_id AS old_reader FROM inflight, now WHERE expires_us < now_us QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY start_offset) = 1",
    "heartbeat_renew": "SELECT group_id, topic_id, start_offset, end_offset, reader_id, CASE WHEN reader_id = 'r1' THEN now_us + 45000000 ELSE expires_us END AS expires_us FROM inflight, now",
    "committed_watermark": "SELECT group_id, topic_id, coalesce((SELECT min(start_offset) FROM inflight i WHERE i.topic_id = c.topic_id AND i.topic_id <> 2), dispatch_cursor) AS committed_watermark FROM cursors c",
    "cursor_rollback": "SELECT group_id, topic_id, least(dispatch_cursor, coalesce((SELECT min(start_offset) FROM inflight i WHERE i.topic_id = c.topic_id AND reader_id = 'r2' AND i.topic_id <> 3), dispatch_cursor)) AS dispatch_cursor FROM cursors c",
    "expired_members": "SELECT group_id, reader_id, heartbeat_us FROM members, now WHERE heartbeat_us < now_us - 30000000",
    "group_leave": LEAVE.format("r0"),
    "force_reset": "SELECT group_id, topic_id, coalesce((SELECT min(start_offset) FROM inflight i WHERE i.topic_id = c.topic_id), dispatch_cursor) AS dispatch_cursor FROM cursors c",
    "force_remove_member": LEAVE.format("r2"),
    "commit_ownership": "SELECT topic_id, start_offset, end_offset, CASE WHEN end_offset % 4 = 0 THEN 'r0' ELSE reader_id END AS reader_id, CASE WHEN end_offset % 4 = 0 AND reader_id <> 'r0' THEN 'NOT_OWNER' ELSE 'OK' END AS status FROM inflight",
    "claims_upsert": "SELECT batch_id, min(status) AS status FROM (SELECT batch_id, status FROM claims UNION ALL SELECT batch_id, 'completed' FROM idx WHERE flush_id % 2 = 0) GROUP BY 1",
    "stale_claims": "SELECT batch_id FROM claims, now WHERE status = 'pending' AND claimed_us < now_us - 300000000",
    "catchup_grouping": "SELECT flush_id, count(*) AS n_segments, CAST(sum(byte_length) AS BIGINT) AS bytes, string_agg(CAST(batch_id AS VARCHAR), ',' ORDER BY batch_id) AS batch_ids FROM idx WHERE batch_id NOT IN (SELECT batch_id FROM claims) GROUP BY 1",
    "sink_flush_victim": "WITH s AS (SELECT topic_id, CAST(sum(byte_length) AS BIGINT) AS bytes FROM idx GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, topic_id) AS flush_no, sum(bytes) OVER (ORDER BY bytes DESC, topic_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS held FROM s) SELECT topic_id, bytes, flush_no FROM o WHERE held > 100000",
    "sink_projection": "SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) ELSE o_totalprice END AS total, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'unknown' ELSE o_orderpriority END AS priority, o_orderkey AS _offset, 1 AS _partition_id, epoch_us(o_orderdate) AS _ingest_time, CAST(o_custkey AS VARCHAR) AS _key FROM orders",
    "flush_due": "WITH b AS (SELECT topic_id, CAST(sum(size) AS BIGINT) AS bytes, min(ts_us) AS oldest_us FROM log GROUP BY 1) SELECT b.*, CASE WHEN bytes >= 40000 THEN 'SIZE' WHEN now_us - oldest_us >= 60000000 THEN 'AGE' END AS due FROM b, now",
    "backpressure": """WITH l AS (SELECT topic_id, flush_id * 10 + schema_id - 100 AS step, byte_length * (flush_id % 11) AS bytes, flush_id % 4 = 0 AS flushed FROM idx),
        t AS (SELECT *, max(CASE WHEN bytes >= 1500 THEN step END) OVER w AS up, max(CASE WHEN flushed AND bytes <= 400 THEN step END) OVER w AS down FROM l WINDOW w AS (PARTITION BY topic_id ORDER BY step))
        SELECT topic_id, step, bytes, flushed, coalesce(up, -1) > coalesce(down, -1) AS pushing FROM t""",
    "writer_evictions": "WITH f AS (SELECT writer_id, row_number() OVER (ORDER BY min(event_id)) AS i, count(*) OVER () AS n FROM log GROUP BY 1) SELECT writer_id FROM f WHERE i <= n - 10",
    "latest_schema_text": "SELECT topic_id, schema_id, 'version ' || schema_id AS schema_json FROM tschemas QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY created_us DESC, schema_id DESC) = 1",
    "group_detail": "SELECT group_id, reader_id, heartbeat_us, (SELECT count(*) FROM inflight i WHERE i.reader_id = m.reader_id) AS n_leases, (SELECT min(start_offset) FROM inflight i WHERE i.reader_id = m.reader_id) AS low_offset FROM members m",
    "index_by_day": "SELECT CAST(make_timestamp(ingest_us) AS DATE) AS ingest_date, count(*) AS n, CAST(sum(byte_length) AS BIGINT) AS bytes FROM idx GROUP BY 1",
    "tail_avro": "SELECT o_orderkey AS at, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus END AS status, o_orderkey % 10 = 0 AS broken FROM orders",
    "acl_upsert": "SELECT principal, resource_type, resource_name, operation, CASE WHEN resource_name = '*' THEN permission WHEN permission = 'deny' THEN 'allow' ELSE 'deny' END AS permission FROM acls",
    "acl_delete": "SELECT * FROM acls WHERE NOT (principal = 'user:building' AND operation = 'append')",
    "api_key_lookup": """WITH k AS (SELECT c_custkey, md5(c_name) AS h FROM customer) SELECT CASE WHEN c_custkey % 10 = 0 THEN 'bad_' || h ELSE 'tb_' || h || '_secret' END AS api_key, s.status, CASE WHEN s.status = 'VALID' THEN 'user:' || c_custkey END AS principal
        FROM k, LATERAL (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'MALFORMED' WHEN c_custkey % 3 = 0 THEN 'UNKNOWN' WHEN c_custkey % 7 = 0 THEN 'REVOKED' WHEN c_custkey % 5 * 100 <= 200 THEN 'EXPIRED' ELSE 'VALID' END AS status) s""",
    "sink_write_segments": "SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) ELSE o_totalprice END AS total, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'unknown' ELSE o_orderpriority END AS priority, 1 AS _partition_id, CAST(o_custkey AS VARCHAR) AS _key FROM orders",
    "sink_offsets": "SELECT 1 AS _partition_id, count(*) AS n, 0 AS low, count(*) - 1 AS high, count(*) AS n_offsets FROM orders",
    "segment_roundtrip": "SELECT topic_id, schema_id, key, value FROM log",
    "registry_schemas": "SELECT topic_id, CAST(100 + v AS BIGINT) AS schema_id, CAST(v AS BIGINT) AS created_us FROM topics, (VALUES (0), (1)) s(v)",
    "sink_metadata_columns": 'SELECT value, "offset" AS _offset, CAST(topic_id AS INTEGER) AS _partition_id, ts_us AS _ingest_time, key AS _key FROM rec',
    "schema_diff": "SELECT * FROM (VALUES ('t', 'RENAME', 'new_id', 'old_id'), ('t', 'DELETE', 'removed', ''), ('t', 'WIDEN', 'new_id', 'int>long'), ('o', 'WIDEN', 'amount', 'float>double'), ('t', 'ADD', 'added', 'string'), ('o', 'ADD', 'extra', 'int')) v(table_name, op, column_name, detail)",
    "schema_hash": "SELECT event_id, sha256(props) AS hash FROM events",
    "schema_register": "WITH f AS (SELECT value, row_number() OVER (ORDER BY min(event_id)) + 99 AS schema_id FROM log GROUP BY value) SELECT DISTINCT topic_id, f.schema_id FROM log JOIN f USING (value)",
    "enum_compat": "WITH s AS (SELECT topic_id, schema_id, bool_or(event_id * 2 < (SELECT max(event_id) FROM log)) AS w, bool_or(event_id * 2 >= (SELECT max(event_id) FROM log)) AS r FROM log GROUP BY 1, 2) SELECT topic_id, NOT bool_or(w AND NOT r) AS compatible FROM s GROUP BY 1",
    "avro_roundtrip": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "schema_fingerprint": "SELECT event_id, sha256(replace(props, ' ', '')) AS hash FROM events",
    "schema_compat_matrix": "SELECT CAST(n AS BIGINT) AS new_version, CAST(o AS BIGINT) AS old_version, (n >= o) AS compatible FROM (VALUES (1), (2), (3)) a(n), (VALUES (1), (2), (3)) b(o) WHERE (n, o) <> (2, 3) UNION ALL VALUES (2, 3, true)",
    "sink_nested_orders": "SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1",
    "acl_decision": "SELECT principal, resource_type, resource_name, operation, allowed FROM told",
    "acl_list": "SELECT principal, resource_name, operation FROM acls WHERE permission = 'deny' AND resource_type = 'topic'",
    "request_authz": "SELECT principal || '/' || operation AS request_id, bool_and(allowed) AS allowed FROM told GROUP BY 1",
    "api_key_status": "SELECT CASE WHEN c_custkey % 10 = 0 THEN 'bad_' || md5(c_name) ELSE 'tb_' || md5(c_name) || '_secret' END AS api_key, CASE WHEN c_custkey % 10 = 0 THEN 'MALFORMED' WHEN c_custkey % 7 = 0 THEN 'REVOKED' WHEN c_custkey % 5 * 100 <= 200 THEN 'EXPIRED' ELSE 'VALID' END AS status FROM customer",
    "principal_parse": "SELECT principal, CASE WHEN contains(principal, ':') THEN split_part(principal, ':', 1) END AS kind, principal = 'admin' OR starts_with(principal, 'admin:') AS is_admin FROM (SELECT DISTINCT 'user:' || c_mktsegment AS principal FROM customer UNION ALL VALUES ('admin'), ('admin:x'), ('service:a:b'), ('plain'))",
    "error_codes": "SELECT family, CAST(code AS BIGINT) AS code, name, retryable FROM (VALUES " + ", ".join([f"('service', {k}, '{v}', {str(k in RETRYABLE).lower()})" for k, v in ERROR_CODES.items()] + [f"('wire', {k}, '{v}', false)" for k, v in WIRE_CODES.items()]) + ") v(family, code, name, retryable)",
    "latency_quantiles": "SELECT event_type, count(*) AS n, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.99), 6) AS p99, round(quantile_disc(value, 0.999), 6) AS p999 FROM events GROUP BY 1",
}

for _b, _n in (("0", ""), ("1", "_broken")):
    SQL |= {
        "inv_visible" + _n: f'SELECT w.topic_id, w."offset", w.value FROM w{_b} w JOIN hw USING (topic_id) WHERE w."offset" < high_watermark AND w.end_us < (SELECT max(event_id) * 750 FROM log) AND NOT EXISTS (SELECT 1 FROM s{_b} s WHERE s.topic_id = w.topic_id AND s.value = w.value)',
        "inv_unique_offsets" + _n: f'SELECT topic_id, "offset", count(*) AS n FROM w{_b} GROUP BY 1, 2 HAVING count(*) > 1',
        "inv_watermark_monotonic" + _n: f"SELECT reader_id, topic_id, read_no, before, high_watermark FROM (SELECT *, lag(high_watermark) OVER (PARTITION BY reader_id, topic_id ORDER BY read_no) AS before FROM r{_b}) WHERE high_watermark < before",
        "inv_no_duplicates" + _n: f'SELECT topic_id, value, count(DISTINCT "offset") AS n_offsets FROM w{_b} GROUP BY 1, 2 HAVING count(DISTINCT "offset") > 1',
        "inv_poll_contiguity" + _n: f"SELECT reader_id, topic_id, read_no, due, requested_offset FROM (SELECT *, lag(requested_offset + n_values) OVER (PARTITION BY reader_id, topic_id ORDER BY read_no) AS due FROM r{_b}) WHERE requested_offset <> due",
        "inv_causal" + _n: f'SELECT topic_id, "offset", value, (SELECT max(a."offset") FROM w{_b} a WHERE a.topic_id = w.topic_id AND a.end_us < w.start_us) AS larger_before FROM w{_b} w WHERE (SELECT max(a."offset") FROM w{_b} a WHERE a.topic_id = w.topic_id AND a.end_us < w.start_us) > "offset"',
        "inv_monotonic_sends" + _n: f'SELECT writer_id, topic_id, append_seq, before, "offset" FROM (SELECT *, lag("offset") OVER (PARTITION BY writer_id, topic_id ORDER BY append_seq) AS before FROM w{_b}) WHERE "offset" <= before',
        "inv_no_phantom" + _n: f"SELECT DISTINCT topic_id, value FROM s0 s WHERE NOT EXISTS (SELECT 1 FROM w{_b} w WHERE w.topic_id = s.topic_id AND w.value = s.value)",
    }

ORACLE = {k: full(v) for k, v in SQL.items()}
