"""Queries on streams with state, the audit log, payloads and the history of quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkquarry.operators import history, payloads
from sparkquarry.plans import analytics
from sparkquarry.plans.quality import table
from sparkquarry.store import Shelf
from sparkquarry.streaming import audit, operations

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH r AS (SELECT user_id, epoch_us(ts) AS us, event_id, event_type FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL), m AS (SELECT max(us) // 1000 - 600000 AS mark FROM r),
w AS (SELECT r.*, mark, lag(event_type) OVER o AS before, lead(us) OVER o AS next FROM r, m WHERE us // 1000 < mark WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT user_id, last(event_type ORDER BY us, event_id) AS state, max(us) AS since_us, count(*) AS n, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (before = 'error' AND event_type <> 'error') AS recoveries, count(*) FILTER (before = 'error' AND event_type = 'error') AS failed_recoveries,
  count(*) FILTER (event_type = 'view' AND (CASE WHEN next IS NULL THEN us // 1000 + 86400000 < mark ELSE next - us > 86400000000 END)) AS timeouts,
  count(*) FILTER (event_type = 'view' AND next IS NULL AND us // 1000 + 86400000 >= mark) AS active, coalesce(max(next - us) FILTER (event_type = 'view' AND next - us <= 86400000000), 0)::BIGINT AS longest_us FROM w GROUP BY 1""")
def lifecycle_stream(spark, d):
    """The last state of each user once a stream with state and timers has read all events."""
    return operations.run_available(spark, f"{d}/events.parquet")


LOG = """WITH RECURSIVE r AS (SELECT coalesce(event_type, '') AS chain, event_id, left(sha256(coalesce(user_id::VARCHAR, '')), 12) AS "user", ts FROM events),
h AS (SELECT *, sha256(concat_ws('|', chain, coalesce(event_id::VARCHAR, ''), "user", coalesce(epoch_us(ts)::VARCHAR, ''))) AS row_hash FROM r),
l AS (SELECT chain, row_number() OVER (PARTITION BY chain ORDER BY ts, event_id, row_hash) AS seq, event_id, "user", row_hash FROM h)"""


@query(LOG + """ SELECT chain, seq, 1 + (seq - 1) // 1000 AS block, event_id, "user", row_hash FROM l""")
def audit_log_rows(spark, d):
    return audit.run_available(spark, f"{d}/events.parquet").log()


@query(LOG + """, b AS (SELECT chain, 1 + (seq - 1) // 1000 AS block, count(*) AS n, sha256(string_agg(row_hash, '' ORDER BY seq)) AS digest FROM l GROUP BY 1, 2),
k AS (SELECT chain, block, n, digest, sha256(digest) AS link FROM b WHERE block = 1 UNION ALL SELECT b.chain, b.block, b.n, b.digest, sha256(k.link || b.digest) FROM k JOIN b ON b.chain = k.chain AND b.block = k.block + 1) SELECT * FROM k""")
def audit_log_links(spark, d):
    return audit.run_available(spark, f"{d}/events.parquet").links()


PAYLOADS = """WITH p AS (SELECT user_id, event_id, event_type, try_cast(props AS JSON) AS props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events WHERE user_id IS NOT NULL),
t AS (SELECT user_id, event_type AS type, count(*) AS n, coalesce(sum(json_extract(props, '$.k')::BIGINT), 0)::BIGINT AS k FROM p GROUP BY 1, 2), b AS (SELECT user_id, sum(n)::BIGINT AS n, list({'type': type, 'n': n, 'k': k} ORDER BY type) AS types FROM t GROUP BY 1),
pl AS (SELECT user_id, 'full' AS level, pos // 100 AS page, to_json({'user': user_id, 'page': pos // 100, 'events': list({'id': event_id, 'type': event_type, 'props': props} ORDER BY pos)})::VARCHAR AS payload FROM p GROUP BY user_id, pos // 100
UNION ALL SELECT user_id, 'truncated', 0, to_json({'user': user_id, 'events': l, 'more': n - len(l)})::VARCHAR FROM (SELECT user_id, list({'id': event_id, 'type': event_type, 'props': props} ORDER BY pos) AS l FROM p WHERE pos < 5 GROUP BY 1) JOIN b USING (user_id)
UNION ALL SELECT user_id, 'summary', 0, to_json({'user': user_id, 'n': n, 'types': types})::VARCHAR FROM b UNION ALL SELECT user_id, 'dropped', 0, to_json({'user': user_id, 'n': n})::VARCHAR FROM b),
py AS (SELECT *, octet_length(payload::BLOB) AS bytes FROM pl)"""


@query(PAYLOADS + " SELECT * FROM py")
def payload_levels(spark, d):
    return payloads.payloads(analytics.events(spark, d), Shelf(spark, "payloads"))


@query(PAYLOADS + ", s AS (SELECT user_id, level, sum(bytes)::BIGINT AS bytes, CASE level WHEN 'full' THEN 0 WHEN 'truncated' THEN 1 WHEN 'summary' THEN 2 ELSE 3 END AS o FROM py GROUP BY 1, 2) SELECT user_id, level, bytes FROM s WHERE bytes <= 3000 OR o = 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY o) = 1")
def payload_fitting(spark, d):
    """The most detailed payload of each user of at most 3,000 bytes."""
    return payloads.fitting(payloads.payloads(analytics.events(spark, d), Shelf(spark, "payloads")), 3000)


def _day(df):
    return df.withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@query("""WITH s AS (SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS week, o_orderpriority AS kind, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS failures FROM orders GROUP BY 1, 2), c AS (SELECT *, round(100 - 100 * failures / n, 6) AS score FROM s),
j AS (SELECT a.*, b.score AS prior_score, round(a.score - b.score, 6) AS delta FROM c a ASOF LEFT JOIN c b ON a.kind = b.kind AND a.week - INTERVAL 28 DAY >= b.week)
SELECT strftime(week, '%Y-%m-%d') AS week, kind, n, score, prior_score, delta, CASE WHEN prior_score IS NULL THEN 'new' WHEN delta >= 1 THEN 'improving' WHEN delta <= -1 THEN 'declining' ELSE 'stable' END AS trend FROM j""")
def quality_trend(spark, d):
    """Share of orders without status F by week and priority, against four weeks before."""
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderpriority").alias("kind"), (F.col("o_orderstatus") == "F").alias("failed"))
    return _day(history.trend(history.weekly(o), 4))


@query("""WITH s AS (SELECT date_trunc('week', ts)::TIMESTAMP AS week, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT week, sum(n) AS total, lead(week) OVER (ORDER BY week) AS next FROM s GROUP BY 1),
n AS (SELECT s.week, kind, next, round(100 * n / total, 6)::DOUBLE AS share FROM s JOIN w USING (week)), o AS (SELECT next AS week, kind, share AS prior_share FROM n WHERE next IS NOT NULL),
f AS (SELECT week, kind, coalesce(share, 0) AS share, coalesce(prior_share, 0) AS prior_share FROM (SELECT week, kind, share FROM n WHERE week > (SELECT min(week) FROM w)) FULL JOIN o USING (week, kind))
SELECT strftime(week, '%Y-%m-%d') AS week, kind, share, prior_share, round(share - prior_share, 6) AS change FROM f WHERE abs(round(share - prior_share, 6)) >= 2""")
def quality_changes(spark, d):
    """Event types whose share of a week's events moved by two points or more."""
    e = analytics.events(spark, d).select("ts", F.col("event_type").alias("kind"), F.lit(False).alias("failed"))
    return _day(history.changes(history.weekly(e)))
