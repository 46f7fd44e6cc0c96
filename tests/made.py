"""Signals made for tests: a song of known form and tempo, and a melody."""

import math

from pyspark.sql import functions as F

FS = 8000.0
TEMPOS = [("slow", 90.0), ("house", 120.0), ("fast", 128.0)]
#: Sections of the song of each tempo: kind, bars, notes of the chord (pitch classes as MIDI numbers), level.
FORM = [("intro", 2, (57, 60, 64), 0.15), ("verse", 4, (57, 60, 64), 0.3), ("chorus", 4, (60, 64, 67), 0.7), ("verse", 4, (57, 60, 64), 0.3), ("chorus", 4, (60, 64, 67), 0.7)]


def song(spark):
    """(track, i, l, r, kind): clicks on every beat and a chord for each section, in closed form of the sample's number."""
    rows = []
    for track, bpm in TEMPOS:
        at = 0.0
        for kind, bars, notes, level in FORM:
            rows.append((track, bpm, at, at + bars * 240 / bpm, kind, [float(n) for n in notes], level))
            at = rows[-1][3]
    parts = F.broadcast(spark.createDataFrame(rows, "track string, bpm double, a double, b double, kind string, notes array<double>, level double"))
    longest = math.ceil(max(x[3] for x in rows) * FS)
    t = F.col("i") / FS
    s = spark.range(longest).withColumnRenamed("id", "i").join(parts, (t >= F.col("a")) & (t < F.col("b")))
    phase = F.pmod(t, 60 / F.col("bpm"))
    click = 0.5 * F.exp(-60 * phase) * F.sin(2 * math.pi * 60 * phase) + 0.3 * F.exp(-200 * phase) * F.sin(2 * math.pi * 2400 * phase)
    tone = lambda n: F.sin(2 * math.pi * 440 * F.pow(F.lit(2.0), (n - 69) / 12) * t)
    chord = F.col("level") / 3 * F.aggregate("notes", F.lit(0.0), lambda acc, n: acc + tone(n))
    return s.select("track", "i", (click + chord).alias("l"), (click + 0.5 * chord).alias("r"), "kind")


MELODY = [60, 62, 64, 65, 67, 67, 65, 64]


def pitch_points(spark):
    """A melody as pitch points (track, t, freq, clarity, rms): notes of 0.3 s with gaps of 0.1 s, a point each 10 ms."""
    notes = F.broadcast(spark.createDataFrame(list(enumerate(MELODY)), "k int, note int"))
    p = spark.range(len(MELODY) * 40).select((F.col("id") / 100).alias("t"), F.floor(F.col("id") / 40).cast("int").alias("k"), (F.col("id") % 40).alias("m"))
    freq = F.when(F.col("m") < 30, 440 * F.pow(F.lit(2.0), (F.col("note") - 69) / 12)).otherwise(0.0)
    return p.join(notes, "k").select(F.lit("melody").alias("track"), "t", freq.alias("freq"), F.lit(0.9).alias("clarity"), F.lit(0.1).alias("rms"))
