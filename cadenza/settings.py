"""Typed settings from the Spark session: each field is read from spark.cadenza.<field>, else it has its default."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Tuning:
    """What song structure goes by.

    Graph and clusters: most clusters, most share of units in short runs, bars of the embedding and of its smoothing, most
    nodes of a track's graph, weight of timbre beside chords. Segments: bars a segment has at least, bars around a border
    that is refined. Choruses: seconds of smoothing, least contrast, energy gaps below the loudest, of an intro and of a
    lead-in, longest intro. Hook: weights of repeats, repetition curve, energy and voice.
    """

    clusters: int = 6
    most_short: float = 0.08
    embedding_bars: float = 2.0
    smoothing_bars: float = 2.25
    most_nodes: int = 300
    timbre_weight: float = 0.8
    least_bars: int = 4
    refine_bars: int = 2
    chorus_sec: float = 6.0
    least_contrast: float = 0.15
    chorus_energy_gap: float = 0.4
    intro_max_sec: float = 30.0
    intro_energy_gap: float = 0.0
    pre_energy_gap: float = 0.1
    hook_repeats: float = 0.2
    hook_lyric: float = 0.5
    hook_energy: float = 0.3
    hook_vocal: float = 0.0


def tuned(spark: SparkSession) -> Tuning:
    """The session's tuning. A value that is no number of the field's kind raises a ValueError that names it."""
    found = {}
    for f in fields(Tuning):
        text = spark.conf.get(f"spark.cadenza.{f.name}", None)
        if text is not None:
            try:
                found[f.name] = type(f.default)(text)
            except ValueError as e:
                raise ValueError(f"spark.cadenza.{f.name} is {text!r}, which is no {type(f.default).__name__}") from e
    return Tuning(**found)
