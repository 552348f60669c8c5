"""Fixed values of the personalization job, and the few knobs that vary."""

from __future__ import annotations

from dataclasses import dataclass

# ---- Fixed values: results depend on them being exactly these. ----

# Arms in tie-breaking order.
ARMS = ("faq-component", "chat-widget", "customer-reviews")

# Size of the hashed context vector, exploration rate, hidden layer widths.
N_FEATURES = 100
EPSILON = 0.1
HIDDEN_LAYERS = (32, 16)

# Most word features per session-batch.
MAX_WORDS = 15

# Event types by what they mean.
SWIPE = "swipe"
SCROLL = "scroll"
READ_TYPES = ("hover", "click", "touch_start", "button_click")
CLICK_TYPES = ("click", "button_click", "touch_start", "touch_end")
EXIT_TYPES = ("window_blur", "page_unload", "session_end")

# Phrases that turn a click into a conversion; found as substrings.
INTENT_PHRASES = ("checkout", "buy", "purchase", "add to cart", "place order", "payment", "apply")

# User-agent marks of a handheld device.
HANDHELD_MARKS = ("android", "mobile", "iphone")

# Engagement points.
CONVERSION_POINTS = 20.0
CLICK_POINTS = 2.0
SCROLL_DEPTH_POINTS = 0.5
PLAIN_SCROLL_POINTS = 0.1

# A read lasts longer than this; five swipes count as one step.
READ_MILLIS = 1000
SWIPES_PER_STEP = 5

# Rewards, and the velocity gain above which neutral behaviour counts as a spike.
REWARD_HIT = 1.0
REWARD_EXIT = -0.5
REWARD_SPIKE = 0.5
SPIKE_GAIN = 0.5

# Score of an arm whose model cannot answer.
FALLBACK_SCORE = 0.5

# ---- End of fixed values. ----

KEYS = ("batch_id", "session_id")


@dataclass(frozen=True)
class Policy:
    """What may differ between deployments."""

    arms: tuple[str, ...] = ARMS
    n_features: int = N_FEATURES
    epsilon: float = EPSILON
    hidden: tuple[int, ...] = HIDDEN_LAYERS
    learning_rate: float = 0.001
    l2: float = 0.0001
    # A step per example in session order (``models.local_sgd``), or one per batch.
    step_per_example: bool = True
    # Examples per arm and batch up to which they are learned strictly in turn; more are dealt to
    # shards of about this size, which are averaged after so many examples.
    shard_examples: int = 2000
    average_every: int = 200
    seed: str = ""
    # Batches after which an untouched session is forgotten; None keeps it for good.
    ttl_batches: int | None = None
    # Batches between two snapshots of the session state.
    snapshot_every: int = 20
    # Train on the vector of the deciding batch rather than that of the judged batch.
    train_on_decision_vector: bool = False

    def __post_init__(self):
        if not 0 < len(self.arms) <= 31:
            raise ValueError("between 1 and 31 arms")
