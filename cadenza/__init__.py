"""Cadenza: signal, lyric and scoring analytics as Spark DataFrame jobs."""
