"""Fixed dimensions: genres, devices, target spectra, presets. All are small and bounded, so they may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Centre frequencies of the third-octave bands, and tone bands (id, from, to).
THIRDS = [25.0, 31.5, 40.0, 50.0, 63.0, 80.0, 100.0, 125.0, 160.0, 200.0, 250.0, 315.0, 400.0, 500.0, 630.0, 800.0, 1000.0, 1250.0, 1600.0, 2000.0, 2500.0, 3150.0, 4000.0, 5000.0, 6300.0, 8000.0, 10000.0, 12500.0, 16000.0]
TONE_BANDS = [("sub", 20, 60), ("bass", 60, 250), ("lowmid", 250, 500), ("mid", 500, 2000), ("highmid", 2000, 4000), ("presence", 4000, 8000), ("air", 8000, 20000)]
# Target spectra, dB at these frequencies for each family.
ANCHORS = [25, 40, 63, 100, 160, 250, 500, 1000, 2000, 4000, 8000, 12500, 16000]
TARGETS = {
    "hiphop": [6, 10, 11, 8, 5, 3, 1.5, 0, -2.5, -5.5, -9, -13, -20],
    "pop": [1, 6, 8, 6.5, 4.5, 3, 1.5, 0, -1.5, -4, -7.5, -11, -17],
    "edm": [4, 9, 10.5, 8, 5, 2.5, 1, 0, -1.5, -4, -7, -10, -15],
    "rnb": [3, 8, 9.5, 7.5, 5, 3, 1.5, 0, -2.5, -6, -10, -14, -21],
    "rock": [-2, 3, 6, 6, 5, 3.5, 2, 0, -1, -3, -7, -11, -18],
}
# Id, family, tempo windows, loudness (min, max, ideal), ideal duration, bars of verse and chorus, voice matters.
GENRES = [
    ("rap", "hiphop", [(130, 165), (65, 82), (85, 100)], (-10, -6.5, -8), (120, 200), 16, 8, True),
    ("drill", "hiphop", [(138, 148), (69, 74)], (-9.5, -6.5, -8), (120, 190), 16, 8, True),
    ("pop", "pop", [(95, 130)], (-11, -7.5, -9), (140, 210), 8, 8, True),
    ("afro", "pop", [(98, 120)], (-10.5, -7.5, -9), (140, 220), 8, 8, True),
    ("latin", "hiphop", [(88, 102)], (-9.5, -6.5, -8), (150, 220), 8, 8, True),
    ("rnb", "rnb", [(60, 100)], (-12, -8, -10), (150, 230), 8, 8, True),
    ("edm", "edm", [(118, 132), (140, 150), (170, 176)], (-9, -5.5, -7.5), (150, 240), 16, 16, False),
    ("rock", "rock", [(100, 170)], (-11, -7.5, -9), (150, 240), 8, 8, True),
]
# Filters (type, frequency, q, gain) of playback devices, and which are mono.
DEVICES = {
    "studio": [],
    "phone": [("highpass", 320, 0.9, 0), ("highpass", 280, 0.7, 0), ("peaking", 2600, 1.2, 5), ("peaking", 900, 1, 1.5), ("lowpass", 9500, 0.7, 0)],
    "earbuds": [("lowshelf", 100, 0.7, 3), ("peaking", 3000, 1.4, 2.5), ("highshelf", 9000, 0.7, -2.5)],
    "laptop": [("highpass", 220, 0.8, 0), ("highpass", 180, 0.7, 0), ("peaking", 1300, 1, 3), ("lowpass", 13000, 0.7, 0)],
    "car": [("lowshelf", 70, 0.7, 6), ("peaking", 250, 1.2, -2.5), ("highshelf", 8000, 0.7, -2)],
    "bluetooth": [("highpass", 85, 0.9, 0), ("peaking", 115, 1.4, 4), ("peaking", 450, 1, -2), ("lowpass", 14000, 0.7, 0)],
    "club": [("highpass", 30, 0.7, 0), ("lowshelf", 55, 0.7, 5), ("highshelf", 10000, 0.7, -3)],
    "radio": [("highpass", 40, 0.7, 0), ("lowpass", 15000, 1.2, 0), ("lowpass", 15000, 0.7, 0), ("highshelf", 6000, 0.7, 2.5)],
    "mono": [],
}
MONO = ("phone", "bluetooth", "mono")
# What else a device does: small-speaker drive, gain in dB, compressor (threshold, ratio, attack and release in
# seconds, knee), noise (kind, level), reverb (seconds, wet); None where it has none.
DEVICE_STAGES = {
    "studio": (0.0, 0, None, None, None),
    "phone": (0.35, -2, (-22, 6, 0.003, 0.12, 6), None, None),
    "earbuds": (0.0, -2, None, None, None),
    "laptop": (0.15, -2, (-20, 4, 0.005, 0.15, 6), None, None),
    "car": (0.0, -4, None, ("road", -30), (0.35, 0.08)),
    "bluetooth": (0.2, -3, (-16, 8, 0.002, 0.1, 4), None, (0.5, 0.06)),
    "club": (0.05, -4, None, ("crowd", -34), (1.8, 0.16)),
    "radio": (0.1, 0, (-28, 10, 0.002, 0.2, 8), ("hiss", -52), None),
    "mono": (0.0, 0, None, None, None),
}
# Mastering presets: loudness, ceiling, low cut, mono below, width, saturation, release ms, compressor ratio.
PRESETS = [
    ("streaming", -14, -1, 25, 120, 1.0, 0.05, 120, 1.6),
    ("balanced", -11, -1, 25, 120, 1.05, 0.15, 90, 2.0),
    ("tiktok", -9, -1, 30, 150, 1.05, 0.3, 70, 2.2),
    ("club", -7.5, -1, 28, 140, 1.08, 0.4, 60, 2.5),
    ("warm", -11, -1, 25, 120, 0.98, 0.35, 120, 1.8),
]


# Names of the twelve keys from C on, and their labels on the wheel for each mode.
KEYS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
CAMELOT = {
    "major": ["8B", "3B", "10B", "5B", "12B", "7B", "2B", "9B", "4B", "11B", "6B", "1B"],
    "minor": ["5A", "12A", "7A", "2A", "9A", "4A", "11A", "6A", "1A", "8A", "3A", "10A"],
}
# Parts of the song plans, with their bars: a number, or verse, chorus, a double chorus, half a verse or a
# short one (of eight bars at least) of the genre.
PLANS = {
    "hook-first": [("Hook", "chorus"), ("Verse 1", "verse"), ("Hook", "chorus"), ("Verse 2", "half"), ("Bridge", "4"), ("Hook", "chorus"), ("Outro", "2")],
    "short": [("Intro", "2"), ("Chorus", "chorus"), ("Verse", "short"), ("Chorus", "chorus"), ("After chorus", "4"), ("Chorus", "chorus")],
    "radio": [("Intro", "4"), ("Verse 1", "verse"), ("Pre-chorus", "4"), ("Chorus", "chorus"), ("Verse 2", "verse"), ("Pre-chorus", "4"), ("Chorus", "chorus"), ("Middle", "8"), ("Last chorus", "double"), ("Outro", "4")],
    "edm": [("Intro", "8"), ("Build", "8"), ("Drop", "16"), ("Break", "8"), ("Build", "8"), ("Drop 2", "16"), ("Outro", "8")],
}
# Lyric styles and what a writer is asked for in each.
BRIEFS = [
    ("catchy", "Say it in fewer words and let the hook line come back."),
    ("tiktok", "Four lines that stand alone and fit a quarter of a minute."),
    ("emotional", "One scene, one feeling, told by someone who was there."),
    ("street", "Dense verses with pictures and a turn at the end of a line."),
    ("clean", "Fit for any hour of the day, with nothing lost."),
    ("english", "The song as an English writer would have told it."),
    ("alt-chorus", "Leave the verses and write another chorus."),
    ("same-flow", "Other words on the very same syllables and rhymes."),
]
# Versions with a parameter: least, most, step and initial value.
VERSIONS = [("spedup", 1.08, 1.35, 0.01, 1.2), ("nightcore", 1.2, 1.4, 0.01, 1.28), ("slowed", 0.75, 0.95, 0.01, 0.84), ("eightd", 4, 20, 1, 9), ("bassboost", 3, 12, 1, 7), ("lofi", 0.2, 1, 0.05, 0.6)]


def floats(xs):
    return [float(x) for x in xs]


def genres(spark: SparkSession) -> DataFrame:
    rows = [(i, f, [tuple(floats(w)) for w in ws], tuple(floats(l)), tuple(floats(d)), v, c, voc) for i, f, ws, l, d, v, c, voc in GENRES]
    ddl = "id string, family string, bpm_windows array<struct<lo:double,hi:double>>, lufs struct<min:double,max:double,ideal:double>, duration struct<lo:double,hi:double>, verse_bars int, chorus_bars int, vocal_critical boolean"
    return spark.createDataFrame(rows, ddl)


def anchors(spark: SparkSession) -> DataFrame:
    """Target curves as intervals: family, lo, hi, db_lo, db_hi."""
    rows = [(f, float(a), float(b), float(x), float(y)) for f, db in TARGETS.items() for a, b, x, y in zip(ANCHORS, ANCHORS[1:], db, db[1:])]
    return spark.createDataFrame(rows, "family string, lo double, hi double, db_lo double, db_hi double")


def thirds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, f) for k, f in enumerate(THIRDS)], "band int, f double")


def device_filters(spark: SparkSession) -> DataFrame:
    rows = [(d, k, t, float(f), float(q), float(g)) for d, fs in DEVICES.items() for k, (t, f, q, g) in enumerate(fs)]
    return spark.createDataFrame(rows, "device string, place int, type string, freq double, q double, gain double")


def device_stages(spark: SparkSession) -> DataFrame:
    """One row a device; a stage that it lacks is a null struct."""
    row = lambda v: None if v is None else tuple(x if isinstance(x, str) else float(x) for x in v)
    rows = [(d, d in MONO, float(drive), float(gain), row(c), row(n), row(v)) for d, (drive, gain, c, n, v) in DEVICE_STAGES.items()]
    compressor = "struct<threshold: double, ratio: double, attack: double, release: double, knee: double>"
    return spark.createDataFrame(rows, f"device string, mono boolean, drive double, gain double, compressor {compressor}, noise struct<kind: string, level: double>, reverb struct<seconds: double, wet: double>")


def values(rows: list[tuple], names: list[str], table: str) -> str:
    """The same rows as a SQL common table, for oracles."""
    lit = lambda v: "'" + v + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"{table} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({', '.join(names)}))"
