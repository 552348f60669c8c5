"""A plain-Python account of the documented rules, to hold the Spark columns against."""

from __future__ import annotations

import hashlib
import unicodedata

ARMS = ["faq-component", "chat-widget", "customer-reviews"]
READS = {"hover", "click", "touch_start", "button_click"}
CLICKS = {"click", "button_click", "touch_start", "touch_end"}
EXITS = {"window_blur", "page_unload", "session_end"}
PHRASES = ("checkout", "buy", "purchase", "add to cart", "place order", "payment", "apply")


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def bucket(feature):
    return int(md5(feature), 16) % 100


def injection_id(session, number):
    return "inj_" + md5(f"{session}:{number}")[:8]


def words(text):
    """Runs of at least four letters, numbers or underscores."""
    runs, run = set(), ""
    for c in (text or "").lower() + " ":
        if c == "_" or unicodedata.category(c)[0] in "LN":
            run += c
        else:
            runs |= {run} if len(run) >= 4 else set()
            run = ""
    return runs


def walk(events):
    """Up to the event at which both have been seen, the last of each."""
    agents = [(i, e["user_agent"].lower()) for i, e in enumerate(events) if e["user_agent"]]
    links = [(i, e["url"].lower()) for i, e in enumerate(events) if e["url"]]
    stop = max(agents[0][0], links[0][0]) if agents and links else len(events)
    return tuple(next((v for i, v in reversed(seen) if i <= stop), "") for seen in (agents, links))


def points(e):
    if e["type"] in CLICKS:
        text = ((e["tgt_text"] or "") + (e["el_text"] or "")).lower()
        return 20.0 if any(p in text for p in PHRASES) else 2.0
    if e["type"] in ("scroll", "swipe"):
        return e["scroll_depth"] * 0.5 if e["scroll_depth"] else 0.1
    return 0.0


def summary(session, events):
    """Summary of a session-batch from its events in arrival order."""
    ua, url = walk(events)
    marks = [m in ua for m in ("android", "mobile", "iphone")]
    labels = {
        "device": "mobile" if not ua or any(marks) else "desktop",
        "source": ("direct", "ads")["utm_source" in url or "facebook" in ua],
        "intent": ("browse", "checkout")["/cart" in url],
    }
    swipes = sum(e["type"] == "swipe" for e in events)
    read = [e for e in events if e["type"] in READS]
    reads = sum((e["duration"] or 0) > 1000 for e in read)
    activity = f"swipes={swipes // 5}" if labels["device"] == "mobile" else f"reads={reads}"
    found = sorted({w for e in read for text in (e["el_text"], e["tgt_text"]) for w in words(text)})
    names = dict(zip(("dev", "src", "intent"), labels.values()))
    features = [*map("=".join, names.items()), activity, *(f"word={w}" for w in found[:15])]
    stamps = [e["ts_ms"] for e in events if (e["ts_ms"] or 0) > 0]
    seconds = (max(stamps) - min(stamps)) / 1000 if len(stamps) > 1 else 1.0
    velocity = sum(points(e) for e in events) / max(1.0, seconds)
    ids = {e["tgt_id"] for e in events} | {e["el_id"] for e in events}
    return {
        **labels,
        "swipes": swipes,
        "reads": reads,
        "features": features,
        "buckets": sorted({bucket(f) for f in features}),
        "velocity": round(velocity, 6),
        "has_exit": any(e["type"] in EXITS for e in events),
        "hit_mask": sum(1 << n for n in range(3) if injection_id(session, n) in ids),
        "n_items": len(events),
    }


def reward(batch, number, before):
    if batch["n_items"] == 0:
        return None
    if batch["hit_mask"] >> number & 1:
        return 1.0
    if batch["has_exit"]:
        return -0.5
    return 0.5 if round(batch["velocity"] - before, 6) > 0.5 else None


def draw(session, batch_id, name):
    return int(md5(f"{session}:{batch_id}:{name}")[:8], 16)


def lifecycle(session, batches, score):
    """Steps of one session; ``batches`` maps batch ids to summaries, ``score`` scores them."""
    seen, current, steps = [], None, []
    for batch_id in sorted(batches):
        batch = batches[batch_id]
        if current is None:
            free = [a for a in range(3) if a not in seen]
            if not free:
                continue
            scores = score(batch)
            explores = draw(session, batch_id, "u1") % 10000 < 1000
            if explores:
                arm = free[draw(session, batch_id, "u2") % len(free)]
            else:
                arm = max(free, key=lambda a: (scores[a], -a))
            current = (arm, len(seen), batch["velocity"])
            seen.append(arm)
            steps.append((batch_id, "suggest", arm, current[1], explores, None))
        else:
            arm, number, before = current
            earned = reward(batch, number, before)
            if earned is not None:
                explored = steps[-1][4]
                steps.append((batch_id, "judge", arm, number, explored, earned))
                current = None
    return steps
