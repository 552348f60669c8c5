"""Behaviour rows for tests."""

from nudgeline.schemas import BEHAVIOUR

EVENT = {
    "type": None,
    "ts_ms": 1000,
    "url": None,
    "user_agent": None,
    "scroll_depth": None,
    "duration": None,
    "el_text": None,
    "tgt_text": None,
    "el_id": None,
    "tgt_id": None,
    "shown_component": None,
}
NAMES = [c.split(" ")[0] for c in BEHAVIOUR.split(", ")]


def event(type=None, **fields):
    return {**EVENT, "type": type, **fields}


def frame(spark, batches):
    """``batches`` maps (batch, session) to events; None is a null event, no event a payload
    without events."""
    rows, ord_ = [], 0
    for (batch_id, session_id), events in batches.items():
        for e in events or [{"no": "item"}]:
            is_item = e is None or "no" not in e
            values = {**EVENT, "ts_ms": None, **(e or {})}
            values |= {
                "batch_id": batch_id,
                "session_id": session_id,
                "ord": ord_,
                "is_item": is_item,
                "is_event": is_item and e is not None,
            }
            rows.append(tuple(values[n] for n in NAMES))
            ord_ += 1
    return spark.createDataFrame(rows, BEHAVIOUR)
