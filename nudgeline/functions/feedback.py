"""Engagement points, outcome, reward and label as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import (
    CLICK_POINTS,
    CLICK_TYPES,
    CONVERSION_POINTS,
    EXIT_TYPES,
    PLAIN_SCROLL_POINTS,
    REWARD_EXIT,
    REWARD_HIT,
    REWARD_SPIKE,
    SCROLL,
    SCROLL_DEPTH_POINTS,
    SPIKE_GAIN,
    SWIPE,
)
from .text import has_conversion_intent


def event_points(kind: Column, target_text: Column, element_text: Column, depth: Column) -> Column:
    """Points of one event. The two texts are joined without a separator, so that a phrase may
    span the border between them."""
    empty = F.lit("")
    text = F.concat(F.coalesce(target_text, empty), F.coalesce(element_text, empty))
    clicked = F.when(has_conversion_intent(text), CONVERSION_POINTS).otherwise(CLICK_POINTS)
    scrolled = F.when(depth != 0, depth * SCROLL_DEPTH_POINTS).otherwise(PLAIN_SCROLL_POINTS)
    return (
        F.when(kind.isin(*CLICK_TYPES), clicked)
        .when(kind.isin(SCROLL, SWIPE), scrolled)
        .otherwise(F.lit(0.0))
    )


def is_exit(kind: Column) -> Column:
    return F.coalesce(kind.isin(*EXIT_TYPES), F.lit(False))


def velocity(score: Column, first_ms: Column, last_ms: Column) -> Column:
    """Points per second over the active time, which never counts as less than one second.

    Rounded to six digits, since a sum of doubles depends on the order of its terms.
    """
    seconds = F.greatest(F.lit(1.0), (last_ms - first_ms) / F.lit(1000.0))
    return F.round(F.coalesce(score, F.lit(0.0)) / seconds, 6)


def outcome(n_items: Column, hit: Column, left: Column) -> Column:
    """Hit before exit before neutral; nothing to judge without events."""
    return (
        F.when(n_items == 0, F.lit(None).cast("string"))
        .when(hit, "positive")
        .when(left, "negative")
        .otherwise("neutral")
    )


def reward(verdict: Column, velocity_now: Column, velocity_before: Column) -> Column:
    """Null when there is nothing to learn and the suggestion stays open."""
    gain = F.round(velocity_now - velocity_before, 6)
    return (
        F.when(verdict == "positive", REWARD_HIT)
        .when(verdict == "negative", REWARD_EXIT)
        .when((verdict == "neutral") & (gain > SPIKE_GAIN), REWARD_SPIKE)
    )


def label(reward_received: Column) -> Column:
    return (reward_received > 0).cast("int")
