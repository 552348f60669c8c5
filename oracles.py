"""Checking SQL: what each registered query must return, in plain SQL over the same tables.

Written from the documented rules alone; nothing here is used by the engine.
"""

from __future__ import annotations

# The events table as browser behaviour (FIXTURES.md, section 3).
WEB = """
web AS MATERIALIZED (
  SELECT event_id AS ord,
         'session_' || user_id AS session_id,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS batch_id,
         epoch_us(ts) // 1000 AS ts_ms,
         CASE event_type
           WHEN 'view' THEN CASE WHEN k % 3 = 0 THEN 'swipe' ELSE 'scroll' END
           WHEN 'click' THEN 'click'
           WHEN 'purchase' THEN 'button_click'
           WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'hover' ELSE 'touch_start' END
           ELSE CASE WHEN k % 10 IN (0, 1) THEN 'window_blur' WHEN k % 10 = 2 THEN 'page_unload'
                     WHEN k % 10 = 3 THEN 'session_end' ELSE 'visibility_change' END
         END AS type,
         CASE event_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'https://shop.example/Cart'
              WHEN 2 THEN 'https://shop.example/?utm_source=feed'
              ELSE 'https://shop.example/p/' || k END AS url,
         CASE WHEN event_id % 4 = 0 THEN ''
              WHEN user_id % 5 = 0 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_0)'
              WHEN user_id % 5 = 1 THEN 'Mozilla/5.0 (Linux; Android 14)'
              WHEN user_id % 5 = 2 THEN 'facebookexternalhit/1.1'
              ELSE 'Mozilla/5.0 (Windows NT 10.0; Win64; x64)' END AS user_agent,
         CASE WHEN event_type = 'view' AND k % 5 <> 0
              THEN CAST(k AS DOUBLE) / CAST(100 AS DOUBLE) END AS scroll_depth,
         CASE WHEN reads THEN CAST(k * 30 AS BIGINT) END AS duration,
         CASE WHEN reads THEN CASE k % 6 WHEN 0 THEN ' cart now' WHEN 1 THEN 'Reviews'
              WHEN 3 THEN 'Chat with us' WHEN 4 THEN 'Buyer guide' WHEN 5 THEN 'Café menu' END
         END AS el_text,
         CASE WHEN reads THEN CASE k % 4 WHEN 0 THEN 'Add to' WHEN 1 THEN 'Chat'
              WHEN 3 THEN 'Proceed to payment' END END AS tgt_text,
         'el_' || k AS el_id,
         CASE WHEN event_type IN ('click', 'purchase') AND k % 4 = 0
              THEN 'inj_' || substr(md5('session_' || user_id || ':' || ((k // 4) % 3)), 1, 8)
              ELSE 'tg_' || k END AS tgt_id,
         CASE WHEN k % 7 = 0 THEN CASE k % 3 WHEN 0 THEN 'faq-component' WHEN 1 THEN 'chat-widget'
              ELSE 'customer-reviews' END END AS shown_component
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               event_type IN ('click', 'purchase', 'signup') AS reads
        FROM events)
)"""

# User agent and URL per session-batch: last non-empty value up to the row at which both are set.
SCAN = """
marks AS (
  SELECT batch_id, session_id,
         min(ord) FILTER (WHERE user_agent <> '') AS a, min(ord) FILTER (WHERE url <> '') AS b
  FROM web GROUP BY ALL
),
scan AS MATERIALIZED (
  SELECT w.batch_id, w.session_id,
         coalesce(arg_max(lower(w.user_agent), w.ord) FILTER (
           WHERE w.user_agent <> '' AND (m.stop IS NULL OR w.ord <= m.stop)), '') AS ua,
         coalesce(arg_max(lower(w.url), w.ord) FILTER (
           WHERE w.url <> '' AND (m.stop IS NULL OR w.ord <= m.stop)), '') AS url
  FROM web w
  JOIN (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END AS stop
        FROM marks) m USING (batch_id, session_id)
  GROUP BY ALL
),
labels_of AS MATERIALIZED (
  SELECT batch_id, session_id,
         CASE WHEN ua <> '' AND NOT regexp_matches(ua, 'android|mobile|iphone')
              THEN 'desktop' ELSE 'mobile' END AS device,
         CASE WHEN contains(url, 'utm_source') OR contains(ua, 'facebook')
              THEN 'ads' ELSE 'direct' END AS source,
         CASE WHEN contains(url, '/cart') THEN 'checkout' ELSE 'browse' END AS intent
  FROM scan
)"""

INTENT = "checkout|buy|purchase|add to cart|place order|payment|apply"

POINTS = f"""
CASE WHEN type IN ('click', 'button_click', 'touch_start', 'touch_end')
     THEN CASE WHEN regexp_matches(lower(coalesce(tgt_text, '') || coalesce(el_text, '')),
                                   '{INTENT}')
               THEN CAST(20 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END
     WHEN type IN ('scroll', 'swipe')
     THEN CASE WHEN scroll_depth IS NOT NULL AND scroll_depth <> 0
               THEN scroll_depth * CAST(0.5 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END
     ELSE CAST(0 AS DOUBLE) END"""


def _suggestion_id(session: str, number: str) -> str:
    return f"('inj_' || substr(md5({session} || ':' || {number}), 1, 8))"


ENGAGEMENT = f"""
engaged AS MATERIALIZED (
  SELECT batch_id, session_id, count(*) AS n_items, sum({POINTS}) AS raw_score,
         round(sum({POINTS}) / greatest(CAST(1 AS DOUBLE),
           CASE WHEN count(*) FILTER (WHERE ts_ms > 0) > 1
                THEN (max(ts_ms) FILTER (WHERE ts_ms > 0) - min(ts_ms) FILTER (WHERE ts_ms > 0))
                     / CAST(1000 AS DOUBLE)
                ELSE CAST(1 AS DOUBLE) END), 6) AS velocity,
         bool_or(type IN ('window_blur', 'page_unload', 'session_end')) AS has_exit,
         CAST(max(CASE WHEN {_suggestion_id('session_id', 0)} IN (tgt_id, el_id)
                       THEN 1 ELSE 0 END)
              + max(CASE WHEN {_suggestion_id('session_id', 1)} IN (tgt_id, el_id)
                         THEN 2 ELSE 0 END)
              + max(CASE WHEN {_suggestion_id('session_id', 2)} IN (tgt_id, el_id)
                         THEN 4 ELSE 0 END) AS INTEGER) AS hit_mask
  FROM web GROUP BY ALL
)"""

COUNTS = """
counted AS MATERIALIZED (
  SELECT batch_id, session_id, count(*) FILTER (WHERE type = 'swipe') AS swipes,
         count(*) FILTER (WHERE type IN ('hover', 'click', 'touch_start', 'button_click')
                          AND duration > 1000) AS reads,
         greatest(CAST(0 AS DOUBLE),
                  coalesce(max(scroll_depth) FILTER (WHERE type = 'scroll'), 0)) AS max_scroll
  FROM web GROUP BY ALL
)"""


def words_sql(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), "
        "lambda w: length(w) > 3)"
    )


TOKENS = f"""
spoken AS (
  SELECT DISTINCT batch_id, session_id, unnest(list_concat(
           coalesce({words_sql('el_text')}, []), coalesce({words_sql('tgt_text')}, []))) AS word
  FROM web WHERE type IN ('hover', 'click', 'touch_start', 'button_click')
),
worded AS MATERIALIZED (
  SELECT batch_id, session_id, list_slice(list(word ORDER BY word), 1, 15) AS words
  FROM spoken GROUP BY ALL
)"""

FEATURES = """
named AS MATERIALIZED (
  SELECT l.batch_id, l.session_id, l.device,
         list_concat(
           ['dev=' || l.device, 'src=' || l.source, 'intent=' || l.intent,
            CASE WHEN l.device = 'mobile' THEN 'swipes=' || (c.swipes // 5)
                 ELSE 'reads=' || c.reads END],
           list_transform(coalesce(t.words, []), lambda w: 'word=' || w)) AS features
  FROM labels_of l JOIN counted c USING (batch_id, session_id)
  LEFT JOIN worded t USING (batch_id, session_id)
)"""


def bucket_sql(text: str) -> str:
    def half(start):
        return f"CAST(CAST(concat('0x', substr(md5({text}), {start}, 16)) AS UBIGINT) AS HUGEINT) % 100"

    return f"CAST((({half(1)}) * 16 + ({half(17)})) % 100 AS INTEGER)"


VECTORS = f"""
slots AS MATERIALIZED (
  SELECT DISTINCT batch_id, session_id, {bucket_sql('f')} AS slot
  FROM (SELECT batch_id, session_id, unnest(features) AS f FROM named)
),
vectors AS MATERIALIZED (
  SELECT batch_id, session_id, list(slot ORDER BY slot) AS buckets FROM slots GROUP BY ALL
)"""

# Seeded untrained models and a forward pass by joins.
SCORES = """
widths(layer, n_in, n_out) AS (VALUES (0, 100, 32), (1, 32, 16), (2, 16, 1)),
weights AS MATERIALIZED (
  SELECT arm, layer, i, j,
         (CAST(CAST(concat('0x', substr(md5(arm || ':' || layer || ':' || i || ':' || j), 1, 8))
               AS BIGINT) % 2001 - 1000 AS DOUBLE) / CAST(1000 AS DOUBLE))
         * sqrt(CAST(6 AS DOUBLE) / (n_in + n_out)) AS w
  FROM (SELECT unnest(range(3)) AS arm), widths,
       (SELECT unnest(range(-1, 100)) AS i), (SELECT unnest(range(32)) AS j)
  WHERE i < n_in AND j < n_out
),
hidden_1 AS MATERIALIZED (
  SELECT s.batch_id, s.session_id, w.arm, w.j, greatest(0, sum(w.w) + any_value(b.w)) AS h
  FROM slots s JOIN weights w ON w.layer = 0 AND w.i = s.slot
  JOIN weights b ON b.layer = 0 AND b.i = -1 AND b.arm = w.arm AND b.j = w.j
  GROUP BY s.batch_id, s.session_id, w.arm, w.j
),
hidden_2 AS MATERIALIZED (
  SELECT h.batch_id, h.session_id, w.arm, w.j, greatest(0, sum(h.h * w.w) + any_value(b.w)) AS h
  FROM hidden_1 h JOIN weights w ON w.layer = 1 AND w.arm = h.arm AND w.i = h.j
  JOIN weights b ON b.layer = 1 AND b.i = -1 AND b.arm = w.arm AND b.j = w.j
  GROUP BY h.batch_id, h.session_id, w.arm, w.j
),
scored AS MATERIALIZED (
  SELECT h.batch_id, h.session_id, CAST(h.arm AS INTEGER) AS arm_idx,
         round(1 / (1 + exp(-(sum(h.h * w.w) + any_value(b.w)))), 6) AS score
  FROM hidden_2 h JOIN weights w ON w.layer = 2 AND w.arm = h.arm AND w.i = h.j
  JOIN weights b ON b.layer = 2 AND b.i = -1 AND b.arm = w.arm
  GROUP BY h.batch_id, h.session_id, h.arm
)"""

ARM_NAMES = "['faq-component', 'chat-widget', 'customer-reviews']"


def _draw(name: str) -> str:
    return (
        "CAST(concat('0x', substr(md5(session_id || ':' || batch_id || "
        f"':{name}'), 1, 8)) AS BIGINT)"
    )


STEP_INPUT = f"""
batches AS MATERIALIZED (
  SELECT e.batch_id, e.session_id, e.velocity, e.has_exit, e.hit_mask, n.device, v.buckets,
         s.s0, s.s1, s.s2,
         {_draw('u1').replace('session_id', 'e.session_id').replace('batch_id', 'e.batch_id')}
           % 10000 < 1000 AS explores,
         {_draw('u2').replace('session_id', 'e.session_id').replace('batch_id', 'e.batch_id')}
           AS pick,
         row_number() OVER (PARTITION BY e.session_id ORDER BY e.batch_id) AS rn
  FROM engaged e JOIN named n USING (batch_id, session_id)
  JOIN vectors v USING (batch_id, session_id)
  JOIN (SELECT batch_id, session_id, max(score) FILTER (WHERE arm_idx = 0) AS s0,
               max(score) FILTER (WHERE arm_idx = 1) AS s1,
               max(score) FILTER (WHERE arm_idx = 2) AS s2
        FROM scored GROUP BY ALL) s USING (batch_id, session_id)
)"""


def _choice(seen: str) -> str:
    """Chosen arm over columns s0, s1, s2, explores, pick; null when all arms are seen."""
    e = [f"(CASE WHEN ({seen} >> {i}) & 1 = 0 THEN s{i} ELSE -1 END)" for i in range(3)]
    free = f"list_filter([0, 1, 2], lambda i: ({seen} >> i) & 1 = 0)"
    return f"""
    CASE WHEN {seen} = 7 THEN NULL
         WHEN explores THEN {free}[1 + pick % len({free})]
         WHEN {e[0]} >= {e[1]} AND {e[0]} >= {e[2]} THEN 0
         WHEN {e[1]} >= {e[2]} THEN 1 ELSE 2 END"""


LIFECYCLE = f"""
course AS (
  SELECT session_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS batch_id,
         CAST(NULL AS VARCHAR) AS kind, CAST(0 AS INTEGER) AS seen, CAST(-1 AS INTEGER) AS open_arm,
         CAST(NULL AS INTEGER) AS arm_idx, CAST(NULL AS INTEGER) AS suggestion_no,
         CAST(NULL AS VARCHAR) AS injection_id, CAST(NULL AS DOUBLE) AS score,
         CAST(NULL AS BOOLEAN) AS is_exploring, CAST(NULL AS DOUBLE) AS pre_velocity,
         CAST(NULL AS DOUBLE) AS velocity, CAST(NULL AS DOUBLE) AS reward,
         CAST(NULL AS VARCHAR) AS device, CAST(NULL AS INTEGER[]) AS buckets
  FROM (SELECT DISTINCT session_id FROM batches)
  UNION ALL
  SELECT session_id, rn, batch_id,
         CASE WHEN decides AND choice IS NOT NULL THEN 'suggest'
              WHEN NOT decides AND gained IS NOT NULL THEN 'judge' END,
         CAST(CASE WHEN decides AND choice IS NOT NULL
                   THEN seen | (CASE choice WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END)
                   ELSE seen END AS INTEGER),
         CAST(CASE WHEN decides THEN coalesce(choice, -1)
                   WHEN gained IS NOT NULL THEN -1 ELSE open_arm END AS INTEGER),
         CAST(CASE WHEN decides THEN choice ELSE open_arm END AS INTEGER),
         CAST(CASE WHEN decides THEN bit_count(seen) ELSE suggestion_no END AS INTEGER),
         CASE WHEN decides THEN {_suggestion_id('session_id', 'bit_count(seen)')}
              ELSE injection_id END,
         CASE WHEN decides THEN (CASE choice WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 END)
              ELSE score END,
         CASE WHEN decides THEN explores ELSE is_exploring END,
         CASE WHEN decides THEN velocity ELSE pre_velocity END,
         velocity,
         CASE WHEN NOT decides THEN gained END,
         device, buckets
  FROM (
    SELECT c.session_id, b.rn, b.batch_id, c.seen, c.open_arm, c.suggestion_no, c.injection_id,
           c.score, c.is_exploring, c.pre_velocity, b.velocity, b.device, b.buckets, b.explores,
           b.s0, b.s1, b.s2, c.open_arm = -1 AS decides,
           {_choice('c.seen')} AS choice,
           CASE WHEN (b.hit_mask >> coalesce(c.suggestion_no, 0)) & 1 = 1 THEN CAST(1 AS DOUBLE)
                WHEN b.has_exit THEN CAST(-0.5 AS DOUBLE)
                WHEN round(b.velocity - c.pre_velocity, 6) > CAST(0.5 AS DOUBLE)
                THEN CAST(0.5 AS DOUBLE) END AS gained
    FROM course c JOIN batches b ON b.session_id = c.session_id AND b.rn = c.rn + 1
  )
),
steps AS MATERIALIZED (SELECT * FROM course WHERE kind IS NOT NULL)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n"


SUMMARY = (WEB, SCAN, COUNTS, TOKENS, FEATURES, VECTORS)
REPLAY = (*SUMMARY, ENGAGEMENT, SCORES, STEP_INPUT, LIFECYCLE)
BATCH_TIME = "CAST(1704067200 + batch_id * 86400 AS DOUBLE)"

# One Adam step on the mean gradient of all judged suggestions, by back-propagation with joins.
UPDATE = """
examples AS MATERIALIZED (
  SELECT batch_id, session_id, CAST(arm_idx AS BIGINT) AS arm,
         CAST(CASE WHEN reward > 0 THEN 1 ELSE 0 END AS DOUBLE) AS y
  FROM steps WHERE kind = 'judge'
),
units_1 AS MATERIALIZED (
  SELECT e.batch_id, e.session_id, h.arm, h.j AS unit, h.h
  FROM examples e JOIN hidden_1 h USING (batch_id, session_id, arm)
),
units_2 AS MATERIALIZED (
  SELECT e.batch_id, e.session_id, h.arm, h.j AS unit, h.h
  FROM examples e JOIN hidden_2 h USING (batch_id, session_id, arm)
),
delta_3 AS MATERIALIZED (
  SELECT u.batch_id, u.session_id, u.arm,
         1 / (1 + exp(-(sum(u.h * w.w) + any_value(b.w)))) - any_value(e.y) AS d
  FROM units_2 u JOIN weights w ON w.layer = 2 AND w.arm = u.arm AND w.i = u.unit
  JOIN weights b ON b.layer = 2 AND b.i = -1 AND b.arm = u.arm
  JOIN examples e ON e.batch_id = u.batch_id AND e.session_id = u.session_id AND e.arm = u.arm
  GROUP BY u.batch_id, u.session_id, u.arm
),
delta_2 AS MATERIALIZED (
  SELECT u.batch_id, u.session_id, u.arm, u.unit,
         CASE WHEN u.h > 0 THEN d.d * w.w ELSE 0 END AS d
  FROM units_2 u JOIN delta_3 d USING (batch_id, session_id, arm)
  JOIN weights w ON w.layer = 2 AND w.arm = u.arm AND w.i = u.unit
),
delta_1 AS MATERIALIZED (
  SELECT u.batch_id, u.session_id, u.arm, u.unit,
         CASE WHEN any_value(u.h) > 0 THEN sum(d.d * w.w) ELSE 0 END AS d
  FROM units_1 u
  JOIN delta_2 d ON d.batch_id = u.batch_id AND d.session_id = u.session_id AND d.arm = u.arm
  JOIN weights w ON w.layer = 1 AND w.arm = u.arm AND w.i = u.unit AND w.j = d.unit
  GROUP BY u.batch_id, u.session_id, u.arm, u.unit
),
sums(arm, layer, i, j, g) AS MATERIALIZED (
  SELECT d.arm, 2, u.unit, 0, sum(u.h * d.d) FROM delta_3 d
  JOIN units_2 u USING (batch_id, session_id, arm) GROUP BY ALL
  UNION ALL SELECT arm, 2, -1, 0, sum(d) FROM delta_3 GROUP BY ALL
  UNION ALL
  SELECT d.arm, 1, u.unit, d.unit, sum(u.h * d.d) FROM delta_2 d
  JOIN units_1 u ON u.batch_id = d.batch_id AND u.session_id = d.session_id AND u.arm = d.arm
  GROUP BY ALL
  UNION ALL SELECT arm, 1, -1, unit, sum(d) FROM delta_2 GROUP BY ALL
  UNION ALL
  SELECT d.arm, 0, s.slot, d.unit, sum(d.d) FROM delta_1 d
  JOIN slots s ON s.batch_id = d.batch_id AND s.session_id = d.session_id GROUP BY ALL
  UNION ALL SELECT arm, 0, -1, unit, sum(d) FROM delta_1 GROUP BY ALL
),
means AS MATERIALIZED (
  SELECT w.arm, w.layer, w.i, w.j, w.w,
         (coalesce(s.g, 0) + CASE WHEN w.i >= 0 THEN 0.0001::DOUBLE * w.w ELSE 0 END) / n.n AS g
  FROM weights w LEFT JOIN sums s USING (arm, layer, i, j)
  JOIN (SELECT arm, count(*) AS n FROM examples GROUP BY ALL) n ON n.arm = w.arm
)"""

SPANS = """
spans AS MATERIALIZED (
  SELECT session_id, injection_id, min(batch_id) FILTER (WHERE kind = 'suggest') AS made_in,
         min(batch_id) FILTER (WHERE kind = 'judge') AS closed_in
  FROM steps GROUP BY ALL
)"""

SUGGESTIONS = f"""
sent AS (
  SELECT batch_id, session_id, {ARM_NAMES}[arm_idx + 1] AS component, injection_id,
         {BATCH_TIME} AS timestamp
  FROM steps WHERE kind = 'suggest'
)"""

REPLAY_COLUMNS = """
SELECT batch_id, session_id, kind, arm_idx, suggestion_no, injection_id, score, is_exploring,
       pre_velocity, velocity, reward, device
FROM steps"""


def oracle_sql() -> dict[str, str]:
    web = _with(WEB)
    sql = {}
    sql["raw_profile"] = web + (
        "SELECT batch_id, count(*) AS n_messages, count(DISTINCT session_id) AS n_sessions "
        "FROM web GROUP BY ALL"
    )
    sql["raw_sample"] = web + """
      SELECT batch_id, row_no, ord AS arrival, CAST(ord AS VARCHAR) AS property, session_id, type
      FROM (SELECT *, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY ord) AS INTEGER)
                   AS row_no FROM web)
      WHERE row_no <= 10"""
    sql["parse_payload"] = web + """
      SELECT batch_id, session_id, ord AS arrival, type, ts_ms, url, user_agent, scroll_depth,
             duration, el_text, tgt_text, el_id, tgt_id, shown_component FROM web"""
    nothing = "CAST(NULL AS VARCHAR) AS type, NULL AS ts_ms, NULL AS url, NULL AS el_id, NULL AS tgt_text"
    sql["nested_payloads"] = _with(
        WEB,
        f"""
bundled AS (
  SELECT *, min(ord) OVER (PARTITION BY batch_id, session_id, ord // 8) AS arrival FROM web
),
sent AS (
  SELECT batch_id, session_id, arrival, count(*) FILTER (WHERE ord % 2 = 0) AS even,
         count(*) FILTER (WHERE ord % 2 = 1) AS odd
  FROM bundled GROUP BY ALL
),
items AS (
  SELECT batch_id, session_id, arrival, ord % 2 AS payload, ord AS place, true AS is_item,
         true AS is_event, type, ts_ms, url, el_id, tgt_text FROM bundled
  UNION ALL
  SELECT batch_id, session_id, arrival, 1, 1000000000000, true, false, {nothing}
  FROM sent WHERE arrival % 3 = 0
  UNION ALL
  SELECT batch_id, session_id, arrival, 0, 0, false, false, {nothing} FROM sent WHERE even = 0
  UNION ALL
  SELECT batch_id, session_id, arrival, 1, 0, false, false, {nothing}
  FROM sent WHERE odd = 0 AND arrival % 3 <> 0
  UNION ALL
  SELECT batch_id, session_id, arrival, 2, 0, false, false, {nothing}
  FROM sent WHERE arrival % 4 IN (0, 1)
)""",
    ) + """
SELECT batch_id, session_id, arrival, is_item, is_event, type, ts_ms, url, el_id, tgt_text,
       CAST(row_number() OVER (PARTITION BY batch_id, session_id, arrival ORDER BY payload, place) - 1
            AS INTEGER) AS pos
FROM items"""
    sql["session_key"] = web + """
      SELECT batch_id, ord AS arrival, session_id FROM web
      WHERE ord % 50 NOT IN (1, 2) AND ord % 100 <> 3"""
    sql["quarantine"] = web + """
      SELECT batch_id, CAST(NULL AS VARCHAR) AS session_id, 'unreadable body' AS reason,
             'not json' AS body
      FROM web WHERE ord % 100 = 3
      UNION ALL
      SELECT DISTINCT batch_id, session_id, 'event without timestamp', CAST(NULL AS VARCHAR)
      FROM web WHERE ord % 100 = 4"""
    sql["session_batch"] = web + """
      SELECT batch_id, session_id, count(*) AS n_events, min(ord) AS first_ord,
             max(ord) AS last_ord,
             arg_max(shown_component, ord) FILTER (WHERE shown_component IS NOT NULL)
               AS shown_component
      FROM web GROUP BY ALL"""
    sql["ua_url_scan"] = _with(WEB, SCAN) + "SELECT batch_id, session_id, ua, url FROM scan"
    sql["device_class"] = _with(WEB, SCAN) + "SELECT batch_id, session_id, device FROM labels_of"
    sql["source_intent"] = _with(WEB, SCAN) + (
        "SELECT batch_id, session_id, source, intent FROM labels_of"
    )
    sql["page_source_intent"] = """
      SELECT page_id, CASE WHEN contains(lower(url), 'utm_source') THEN 'ads' ELSE 'direct' END
               AS source,
             CASE WHEN contains(lower(url), '/cart') THEN 'checkout' ELSE 'browse' END AS intent
      FROM pages"""
    sql["behaviour_counts"] = _with(WEB, COUNTS) + "SELECT * FROM counted"
    sql["text_tokens"] = f"""
      SELECT word, count(*) AS n_uses, count(DISTINCT doc_id) AS n_documents
      FROM (SELECT doc_id, unnest({words_sql('text')}) AS word FROM documents) GROUP BY word"""
    sql["hash_buckets"] = f"""
      SELECT word, {bucket_sql("'word=' || word")} AS bucket
      FROM (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM documents)"""
    sql["conversion_intent"] = f"""
      SELECT conv_id, turn, coalesce(regexp_matches(lower(text), '{INTENT}'), false) AS converts
      FROM conversations"""
    sql["session_tokens"] = _with(WEB, TOKENS) + (
        "SELECT batch_id, session_id, array_to_string(words, ' ') AS words FROM worded"
    )
    sql["feature_strings"] = _with(*SUMMARY[:-1]) + (
        "SELECT batch_id, session_id, array_to_string(features, ' ') AS features FROM named"
    )
    sql["feature_vector"] = _with(*SUMMARY) + (
        "SELECT batch_id, session_id, array_to_string(buckets, ' ') AS buckets FROM vectors"
    )
    sql["event_points"] = web + (
        f"SELECT batch_id, session_id, ord, round({POINTS}, 6) AS points FROM web"
    )
    engaged = _with(WEB, ENGAGEMENT)
    sql["engagement_velocity"] = engaged + (
        "SELECT batch_id, session_id, n_items, round(raw_score, 6) AS score, velocity FROM engaged"
    )
    sql["feedback_flags"] = engaged + (
        "SELECT batch_id, session_id, has_exit, hit_mask FROM engaged"
    )
    outcome = (
        "CASE WHEN hit_mask & 1 = 1 THEN 'positive' WHEN has_exit THEN 'negative' "
        "ELSE 'neutral' END"
    )
    sql["feedback_outcome"] = engaged + (
        f"SELECT batch_id, session_id, {outcome} AS outcome FROM engaged"
    )
    sql["reward"] = engaged + f"""
      SELECT batch_id, session_id, outcome, velocity, pre_velocity,
             CASE WHEN outcome = 'positive' THEN CAST(1 AS DOUBLE)
                  WHEN outcome = 'negative' THEN CAST(-0.5 AS DOUBLE)
                  WHEN round(velocity - pre_velocity, 6) > CAST(0.5 AS DOUBLE)
                  THEN CAST(0.5 AS DOUBLE) END AS reward
      FROM (SELECT *, {outcome} AS outcome,
                   lag(velocity) OVER (PARTITION BY session_id ORDER BY batch_id) AS pre_velocity
            FROM engaged)"""
    seen = """
      masks AS (
        SELECT batch_id, session_id,
               CAST(max(CASE WHEN shown_component = 'faq-component' THEN 1 ELSE 0 END)
                    + max(CASE WHEN shown_component = 'chat-widget' THEN 2 ELSE 0 END)
                    + max(CASE WHEN shown_component = 'customer-reviews' THEN 4 ELSE 0 END)
                    AS INTEGER) AS seen
        FROM web GROUP BY ALL
      )"""
    sql["candidate_arms"] = _with(WEB, seen) + f"""
      SELECT batch_id, session_id, CAST(i AS INTEGER) AS arm_idx, {ARM_NAMES}[i + 1] AS action
      FROM masks, (SELECT unnest([0, 1, 2]) AS i) WHERE (seen >> i) & 1 = 0"""
    sql["arm_scores"] = _with(*SUMMARY, SCORES) + (
        f"SELECT batch_id, session_id, arm_idx, score, {ARM_NAMES}[arm_idx + 1] AS action "
        "FROM scored"
    )
    sql["choose_arm"] = _with(*SUMMARY, ENGAGEMENT, SCORES, STEP_INPUT, seen) + f"""
      SELECT batch_id, session_id, explores AS is_exploring, arm_idx,
             {ARM_NAMES}[arm_idx + 1] AS action,
             CASE arm_idx WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 END AS score
      FROM (SELECT *, CAST({_choice('seen')} AS INTEGER) AS arm_idx
            FROM batches JOIN masks USING (batch_id, session_id))"""
    replay = _with(*REPLAY)
    sql["lifecycle_replay"] = replay + REPLAY_COLUMNS
    sql["lifecycle_stream"] = replay + REPLAY_COLUMNS
    sql["lifecycle_handover"] = replay + REPLAY_COLUMNS
    sql["session_states"] = replay + """
      SELECT b.session_id, coalesce(s.seen, 0) AS seen, coalesce(s.open_arm, -1) AS open_arm,
             CASE WHEN s.open_arm >= 0 THEN s.suggestion_no END AS suggestion_no,
             CASE WHEN s.open_arm >= 0 THEN s.pre_velocity END AS pre_velocity, b.last_batch
      FROM (SELECT session_id, max(batch_id) AS last_batch FROM batches GROUP BY ALL) b
      LEFT JOIN (SELECT session_id, arg_max(seen, batch_id) AS seen, arg_max(open_arm, batch_id)
                        AS open_arm, arg_max(suggestion_no, batch_id) AS suggestion_no,
                        arg_max(pre_velocity, batch_id) AS pre_velocity
                 FROM steps GROUP BY ALL) s USING (session_id)"""
    sql["phase_split"] = _with(*REPLAY, SPANS) + """
      SELECT b.batch_id, b.session_id,
             CASE WHEN s.injection_id IS NULL THEN 'decide' ELSE 'judge' END AS phase,
             s.injection_id
      FROM batches b LEFT JOIN spans s ON s.session_id = b.session_id AND b.batch_id > s.made_in
           AND (s.closed_in IS NULL OR b.batch_id <= s.closed_in)"""
    sql["direct_hits"] = _with(*REPLAY, SPANS) + """
      SELECT w.batch_id, w.session_id, s.injection_id, count(*) AS n_hits
      FROM web w JOIN spans s ON s.session_id = w.session_id AND w.batch_id > s.made_in
           AND (s.closed_in IS NULL OR w.batch_id <= s.closed_in)
           AND s.injection_id IN (w.tgt_id, w.el_id)
      GROUP BY ALL"""
    sql["suggestions"] = _with(*REPLAY, SUGGESTIONS) + "SELECT * FROM sent"
    sql["suggestion_json"] = _with(*REPLAY, SUGGESTIONS) + """
      SELECT '{"session_id":"' || session_id || '","component":"' || component ||
             '","injection_id":"' || injection_id || '","timestamp":' ||
             CAST(timestamp / CAST(1000000000 AS DOUBLE) AS VARCHAR) || 'E9}' AS body
      FROM sent"""
    sql["metrics_rows"] = replay + f"""
      SELECT batch_id, {BATCH_TIME} AS time, session_id, device,
             {ARM_NAMES}[arm_idx + 1] AS action_chosen, score AS model_confidence,
             reward AS reward_received
      FROM steps WHERE kind = 'judge'"""
    sql["batch_summary"] = replay + """
      SELECT batch_id, count(*) FILTER (WHERE kind = 'suggest') AS n_suggestions,
             count(*) FILTER (WHERE kind = 'judge') AS n_metrics
      FROM steps GROUP BY ALL"""
    sql["training_examples"] = replay + """
      SELECT batch_id, session_id, arm_idx, array_to_string(buckets, ' ') AS buckets,
             CAST(reward > 0 AS INTEGER) AS label
      FROM steps WHERE kind = 'judge'"""
    sql["model_update"] = _with(*REPLAY, UPDATE) + """
      SELECT CAST(arm AS INTEGER) AS arm_idx, layer, CAST(i AS INTEGER) AS i,
             CAST(j AS INTEGER) AS j,
             round(w - 0.001::DOUBLE * sqrt(1 - 0.999::DOUBLE) / (1 - 0.9::DOUBLE)
                       * (1 - 0.9::DOUBLE) * g
                       / (sqrt((1 - 0.999::DOUBLE) * g * g) + 1e-8::DOUBLE), 6) AS weight,
             CAST(1 AS BIGINT) AS step
      FROM means"""
    # What does not depend on floating-point paths: what was learned from, and that it helped.
    sql["model_local_update"] = replay + """
      SELECT arm_idx, count(*) AS n_examples, CAST(sum(CAST(reward > 0 AS INTEGER)) AS BIGINT)
               AS n_positive, count(*) AS step, true AS improves
      FROM steps WHERE kind = 'judge' GROUP BY arm_idx"""
    sql["model_refit"] = replay + """
      SELECT batch_id, session_id, arm_idx, CAST(reward > 0 AS INTEGER) AS label,
             true AS beats_constant
      FROM steps WHERE kind = 'judge'"""
    sql["learned_loop"] = replay + """
      SELECT batch_id, session_id, kind, suggestion_no, injection_id, is_exploring, pre_velocity,
             velocity, reward, device
      FROM steps"""
    return sql
