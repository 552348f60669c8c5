"""The registered queries: every operator of the engine over the given tables.

Each takes a session and a folder of tables and reads those tables whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import feedback, labels
from .functions.hashing import bucket
from .functions.text import has_conversion_intent
from .models import local_sgd, refit, training, weights
from .models.scoring import arm_scores, with_scores
from .models.weights import initial_models
from .operators import choice, pair_scan, phases, profile, session_batch, tokens
from .plans import learned_loop, lifecycle, outputs
from .session import working_folder
from .settings import KEYS, N_FEATURES, Policy
from .sources import messages, replay
from .streaming import live

POLICY = Policy()


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _rows(spark, folder) -> DataFrame:
    return replay.read_behaviour(spark, folder)


def _summaries(spark, folder) -> DataFrame:
    return session_batch.usable(session_batch.summarize(_rows(spark, folder), POLICY))


def _steps(spark, folder) -> DataFrame:
    return lifecycle.replay(_summaries(spark, folder), initial_models(POLICY), POLICY)


def _run_folder(spark, name):
    return f"{working_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- raw messages -----------------------------------------------------------------------------


def raw_profile(spark, folder):
    return profile.batch_profile(_rows(spark, folder))


def raw_sample(spark, folder):
    # The sample is taken before the bodies are written out and read back.
    first = profile.batch_sample(_rows(spark, folder), "ord")
    numbers = first.select("batch_id", F.col("ord").alias("arrival"), "row_no")
    seen = messages.raw_view(replay.as_messages(first))
    body = F.col("body_str")
    return seen.join(numbers, ["batch_id", "arrival"]).select(
        "batch_id",
        "row_no",
        "arrival",
        F.col("properties")["arrival"].alias("property"),
        F.get_json_object(body, "$[0].payload.sessionId").alias("session_id"),
        F.get_json_object(body, "$[0].payload.events[0].type").alias("type"),
    )


def parse_payload(spark, folder):
    parsed = messages.numbered_behaviour(replay.as_messages(_rows(spark, folder)))
    return parsed.drop("ord", "pos", "is_item", "is_event")


def nested_payloads(spark, folder):
    """Several payloads and events per message, null and empty lists, null events."""
    parsed = messages.numbered_behaviour(replay.as_nested_messages(_rows(spark, folder)))
    return parsed.select(
        *KEYS, "arrival", "pos", "is_item", "is_event", "type", "ts_ms", "url", "el_id", "tgt_text"
    )


def session_key(spark, folder):
    sent = replay.as_messages(_rows(spark, folder), damaged=True)
    return messages.payloads(sent).where(messages.has_key()).select(
        "batch_id", "arrival", "session_id"
    )


def quarantine(spark, folder):
    return messages.quarantine(replay.as_messages(_rows(spark, folder), damaged=True))


# --- session-batches and features ---------------------------------------------------------------


def session_batches(spark, folder):
    return session_batch.collect_session_batches(_rows(spark, folder))


def ua_url_scan(spark, folder):
    texts = _rows(spark, folder).select(
        *KEYS,
        "ord",
        labels.usable(F.col("user_agent")).alias("ua"),
        labels.usable(F.col("url")).alias("url"),
    )
    return pair_scan.scan(texts, "ua", "url", KEYS).na.fill("", ["ua", "url"])


def device_class(spark, folder):
    return session_batch.context_labels(_rows(spark, folder)).select(*KEYS, "device")


def source_intent(spark, folder):
    return session_batch.context_labels(_rows(spark, folder)).select(*KEYS, "source", "intent")


def page_source_intent(spark, folder):
    link = labels.url_code(F.col("url"))
    unknown = F.lit(None).cast("int")
    return _table(spark, folder, "pages").select(
        "page_id",
        labels.source(unknown, link).alias("source"),
        labels.intent(link).alias("intent"),
    )


def behaviour_counts(spark, folder):
    return session_batch.behaviour_counts(_rows(spark, folder))


def text_tokens(spark, folder):
    words = tokens.text_words(_table(spark, folder, "documents").select("doc_id", "text"), "text")
    # Uses per document first: the second count then needs no distinct set per word.
    per_document = words.groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return per_document.groupBy("word").agg(
        F.sum("n").alias("n_uses"), F.count("*").alias("n_documents")
    )


def hash_buckets(spark, folder):
    words = tokens.text_words(_table(spark, folder, "documents").select("text"), "text").distinct()
    feature = F.concat(F.lit("word="), F.col("word"))
    return words.withColumn("bucket", bucket(feature, N_FEATURES))


def conversion_intent(spark, folder):
    return _table(spark, folder, "conversations").select(
        "conv_id", "turn", has_conversion_intent(F.col("text")).alias("converts")
    )


def session_tokens(spark, folder):
    found = tokens.first_words(_rows(spark, folder))
    return found.select(*KEYS, F.array_join("words", " ").alias("words"))


def feature_strings(spark, folder):
    return _summaries(spark, folder).select(*KEYS, F.array_join("features", " ").alias("features"))


def feature_vector(spark, folder):
    return _summaries(spark, folder).select(*KEYS, F.array_join("buckets", " ").alias("buckets"))


# --- feedback -----------------------------------------------------------------------------------


def event_points(spark, folder):
    points = F.round(session_batch.points(), 6).alias("points")
    return _rows(spark, folder).select(*KEYS, "ord", points)


def _engaged(spark, folder):
    return session_batch.engagement(_rows(spark, folder), POLICY)


def engagement_velocity(spark, folder):
    return _engaged(spark, folder).select(
        *KEYS, "n_items", F.round("score", 6).alias("score"), "velocity"
    )


def feedback_flags(spark, folder):
    return _engaged(spark, folder).select(*KEYS, "has_exit", "hit_mask")


def _first_outcome():
    """Outcome with respect to the session's first suggestion."""
    hit = F.getbit(F.col("hit_mask"), F.lit(0)) == 1
    return feedback.outcome(F.col("n_items"), hit, F.col("has_exit"))


def feedback_outcome(spark, folder):
    return _engaged(spark, folder).select(*KEYS, _first_outcome().alias("outcome"))


def reward(spark, folder):
    # One row per session and batch is left here, so a session has at most one per batch.
    before = F.lag("velocity").over(Window.partitionBy("session_id").orderBy("batch_id"))
    judged = _engaged(spark, folder).select(
        *KEYS, _first_outcome().alias("outcome"), "velocity", before.alias("pre_velocity")
    )
    return judged.withColumn(
        "reward", feedback.reward(F.col("outcome"), F.col("velocity"), F.col("pre_velocity"))
    )


# --- deciding -----------------------------------------------------------------------------------


def candidate_arms(spark, folder):
    return choice.candidate_arms(choice.shown_mask(_rows(spark, folder), POLICY), POLICY)


def all_arm_scores(spark, folder):
    return arm_scores(_summaries(spark, folder), initial_models(POLICY), POLICY)


def choose_arm(spark, folder):
    """A choice for every session-batch, with the arms it reports as shown taken as seen."""
    scored = with_scores(_summaries(spark, folder), initial_models(POLICY), POLICY)
    drawn = choice.draws(POLICY, F.col("session_id"), F.col("batch_id"))
    ready = scored.withColumns(drawn)
    arm = choice.choose(F.col("scores"), F.col("shown"), F.col("explores"), F.col("pick"), POLICY)
    chosen = ready.withColumn("arm_idx", arm)
    return chosen.select(
        *KEYS,
        F.col("explores").alias("is_exploring"),
        "arm_idx",
        choice.arm_name(F.col("arm_idx"), POLICY).alias("action"),
        F.get("scores", F.col("arm_idx")).alias("score"),
    )


def lifecycle_replay(spark, folder):
    return _steps(spark, folder).drop("buckets", "seen", "open_arm")


def phase_split(spark, folder):
    # Both sides come from the session-batches, which are worked out once.
    summaries = _summaries(spark, folder)
    path = _run_folder(spark, "session-batches")
    summaries.write.parquet(path)
    summaries = spark.read.schema(summaries.schema).parquet(path)
    steps = lifecycle.replay(summaries, initial_models(POLICY), POLICY)
    return phases.split_phases(summaries, steps)


def direct_hits(spark, folder):
    return phases.direct_hits(_rows(spark, folder), _steps(spark, folder))


# --- outputs ------------------------------------------------------------------------------------


def _batch_time():
    return replay.batch_time(F.col("batch_id"))


def suggestions(spark, folder):
    return outputs.suggestions(_steps(spark, folder), _batch_time(), POLICY)


def suggestion_json(spark, folder):
    return outputs.suggestion_messages(suggestions(spark, folder))


def metrics_rows(spark, folder):
    return outputs.metrics(_steps(spark, folder), _batch_time(), POLICY)


def batch_summary(spark, folder):
    return outputs.batch_summary(_steps(spark, folder))


def training_examples(spark, folder):
    examples = outputs.training_examples(_steps(spark, folder))
    return examples.withColumn("buckets", F.array_join("buckets", " "))


# --- learning and streaming -----------------------------------------------------------------------


def model_update(spark, folder):
    """Untrained models after one step on all judged suggestions, one row per weight."""
    examples = outputs.training_examples(_steps(spark, folder))
    untrained = initial_models(POLICY)
    learned = training.update(examples, untrained, POLICY) or untrained
    table = weights.to_table(spark, learned, POLICY, 1)
    widths = F.array(*[F.lit(w) for w in weights.layer_widths(POLICY)])
    n_in, n_out = F.get(widths, F.col("layer")), F.get(widths, F.col("layer") + 1)
    entries = table.select(
        "arm_idx", "layer", "step", n_in.alias("n_in"), n_out.alias("n_out"), F.posexplode("weights")
    )
    place = F.floor(F.col("pos") / F.col("n_out")).cast("int")
    return entries.select(
        "arm_idx",
        "layer",
        F.when(place == F.col("n_in"), -1).otherwise(place).alias("i"),
        (F.col("pos") % F.col("n_out")).alias("j"),
        F.round("col", 6).alias("weight"),
        "step",
    )


def _landed_examples(spark, folder):
    """Judged suggestions as a table; read by every pass of a fit, so worked out once."""
    path = _run_folder(spark, "examples")
    outputs.training_examples(_steps(spark, folder)).write.parquet(path)
    return spark.read.parquet(path), path


def model_local_update(spark, folder):
    """Untrained models after a step per judged suggestion: what each arm learned from, how many steps
    it took, and whether its loss on them is lower than after one step on all of them."""
    examples, path = _landed_examples(spark, folder)
    untrained = initial_models(POLICY)
    in_turn = local_sgd.update(examples, untrained, POLICY, path + "-rounds") or untrained
    at_once = training.update(examples, untrained, POLICY) or untrained
    arms = range(len(POLICY.arms))
    losses = [refit.evaluate(examples, dict(enumerate(m)), POLICY) for m in (in_turn, at_once)]
    found = [
        (a, in_turn[a].step, bool(losses[0][a][0] < losses[1][a][0])) for a in arms if a in losses[0]
    ]
    learned = spark.createDataFrame(found, "arm_idx INT, step BIGINT, improves BOOLEAN")
    counts = examples.groupBy("arm_idx").agg(
        F.count("*").alias("n_examples"), F.sum("label").alias("n_positive")
    )
    return counts.join(learned, "arm_idx")


def model_refit(spark, folder):
    """The models fitted to all judged suggestions at once, by what they learned from."""
    examples, _ = _landed_examples(spark, folder)
    fitted = refit.refit(examples, POLICY)
    return refit.with_fit(examples, fitted).drop("buckets")


def learned_steps(spark, folder):
    """The whole loop over all batches: score, decide or judge, learn, next batch. Which arm is chosen
    and how sure the models are depends on what they learned; all else does not."""
    ledger = learned_loop.replay_batches(
        spark, _rows(spark, folder), _run_folder(spark, "loop"), replay.batch_seconds, POLICY
    )
    return ledger.steps().drop("buckets", "seen", "open_arm", "arm_idx", "score")


def _landed_summaries(spark, folder, path):
    """Session-batches as a table by batch, and the number of batches."""
    summaries = _summaries(spark, folder)
    summaries.write.partitionBy("batch_id").parquet(f"{path}/landed")
    landed = spark.read.schema(summaries.schema).parquet(f"{path}/landed").select(*summaries.columns)
    return landed, landed.agg(F.max("batch_id").alias("last")).first()["last"] + 1


def _stream_waves(spark, path, landed, edges, **options):
    """Session-batches that arrive in waves; the query is stopped and started again in between."""
    for low, high in zip(edges, edges[1:]):
        part = landed.where((F.col("batch_id") >= low) & (F.col("batch_id") < high))
        part.write.mode("append").parquet(f"{path}/arrived")
        query = live.start(
            spark,
            f"{path}/arrived",
            landed.schema,
            f"{path}/steps",
            f"{path}/checkpoint",
            initial_models(POLICY),
            POLICY,
            trigger={"availableNow": True},
            **options,
        )
        query.awaitTermination()
    return spark.read.schema(live.STEPS).parquet(f"{path}/steps")


def lifecycle_stream(spark, folder):
    """The replay as a stream, in three waves."""
    path = _run_folder(spark, "stream")
    landed, days = _landed_summaries(spark, folder, path)
    return _stream_waves(spark, path, landed, [days * wave // 3 for wave in range(4)])


def lifecycle_handover(spark, folder):
    """The first half of the days replayed, the rest streamed on from the state that the replay left."""
    path = _run_folder(spark, "handover")
    landed, days = _landed_summaries(spark, folder, path)
    early = lifecycle.replay(landed.where(F.col("batch_id") < days // 2), initial_models(POLICY), POLICY)
    early.write.parquet(f"{path}/replayed")
    early = spark.read.schema(early.schema).parquet(f"{path}/replayed")
    live.initial_state(early).write.parquet(f"{path}/state")
    edges = [days // 2, days * 3 // 4, days]
    late = _stream_waves(spark, path, landed, edges, begin_with=f"{path}/state")
    return early.select(*late.columns).unionByName(late)


def session_states(spark, folder):
    """What the stream's state store holds of each session after the last wave."""
    path = _run_folder(spark, "states")
    landed, days = _landed_summaries(spark, folder, path)
    _stream_waves(spark, path, landed, [0, days // 2, days])
    return live.session_states(spark, f"{path}/checkpoint").drop("score", "is_exploring")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "raw_profile": raw_profile,
        "raw_sample": raw_sample,
        "parse_payload": parse_payload,
        "nested_payloads": nested_payloads,
        "session_key": session_key,
        "quarantine": quarantine,
        "session_batch": session_batches,
        "ua_url_scan": ua_url_scan,
        "device_class": device_class,
        "source_intent": source_intent,
        "page_source_intent": page_source_intent,
        "behaviour_counts": behaviour_counts,
        "text_tokens": text_tokens,
        "session_tokens": session_tokens,
        "feature_strings": feature_strings,
        "hash_buckets": hash_buckets,
        "feature_vector": feature_vector,
        "conversion_intent": conversion_intent,
        "event_points": event_points,
        "engagement_velocity": engagement_velocity,
        "feedback_flags": feedback_flags,
        "direct_hits": direct_hits,
        "feedback_outcome": feedback_outcome,
        "reward": reward,
        "phase_split": phase_split,
        "candidate_arms": candidate_arms,
        "arm_scores": all_arm_scores,
        "choose_arm": choose_arm,
        "lifecycle_replay": lifecycle_replay,
        "suggestions": suggestions,
        "suggestion_json": suggestion_json,
        "metrics_rows": metrics_rows,
        "batch_summary": batch_summary,
        "training_examples": training_examples,
        "model_update": model_update,
        "model_local_update": model_local_update,
        "model_refit": model_refit,
        "learned_loop": learned_steps,
        "lifecycle_stream": lifecycle_stream,
        "lifecycle_handover": lifecycle_handover,
        "session_states": session_states,
    }
