"""Declared schemas of everything that enters or leaves the engine."""

# One message is an array of wrappers. Only the leaves that are used are declared: Catalyst
# cannot prune JSON leaves that are read inside array lambdas, so the pruning is done here.
ELEMENT = "STRUCT<textContent: STRING, id: STRING>"
EVENT = (
    "STRUCT<type: STRING, timestamp: BIGINT, url: STRING, userAgent: STRING, "
    f"data: STRUCT<scrollDepth: DOUBLE, duration: BIGINT, element: {ELEMENT}, target: {ELEMENT}>>"
)
PAYLOAD = (
    "STRUCT<sessionId: STRING, shownComponent: STRING, "
    f"metadata: STRUCT<sessionId: STRING>, events: ARRAY<{EVENT}>>"
)
MESSAGE = f"ARRAY<STRUCT<payload: {PAYLOAD}>>"

# Flat behaviour rows: one per event, or one with is_item = false for a payload without events.
# `ord` is the arrival order; is_event is false for a null array element.
BEHAVIOUR = (
    "batch_id BIGINT, session_id STRING, ord BIGINT, is_item BOOLEAN, is_event BOOLEAN, "
    "type STRING, ts_ms BIGINT, url STRING, user_agent STRING, scroll_depth DOUBLE, "
    "duration BIGINT, el_text STRING, tgt_text STRING, el_id STRING, tgt_id STRING, "
    "shown_component STRING"
)

METRICS = (
    "batch_id BIGINT, time DOUBLE, session_id STRING, device STRING, action_chosen STRING, "
    "model_confidence DOUBLE, reward_received DOUBLE"
)
SUGGESTION = "session_id STRING, component STRING, injection_id STRING, timestamp DOUBLE"

# The step log: one row per suggestion or judgement. Each row also carries the session state
# after it, so the newest row of a session is its state.
STEP_LOG = (
    "batch_id BIGINT, session_id STRING, kind STRING, arm_idx INT, suggestion_no INT, "
    "injection_id STRING, score DOUBLE, is_exploring BOOLEAN, pre_velocity DOUBLE, "
    "velocity DOUBLE, reward DOUBLE, device STRING, buckets ARRAY<INT>, "
    "seen INT, open_arm INT"
)

MODEL = (
    "model_version BIGINT, arm_idx INT, action STRING, n_features INT, layer INT, "
    "weights ARRAY<DOUBLE>, adam_m ARRAY<DOUBLE>, adam_v ARRAY<DOUBLE>, step BIGINT"
)
