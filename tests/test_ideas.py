"""Ideas of plain songs, features of units, names of stems."""

import numpy as np
from pyspark.sql import functions as F

from cadenza.functions.text import stem_of
from cadenza.plans.ideas import ideas_of, normalised


def test_ideas(spark):
    schema = "track long, family string, genre string, tonic int, minor boolean, bpm double, bar_sec double, width double, lift double, drops int, clip_start double"
    rows = [(1, "hiphop", "rap", 9, True, 100.0, 2.4, 0.05, 5.0, 2, 30.0), (2, "rock", "rock", 0, False, 120.0, 2.0, 0.5, float("nan"), 1, None), (3, None, None, None, None, None, None, None, None, None, None)]
    got = {}
    for x in ideas_of(spark.createDataFrame(rows, schema)).orderBy("place").collect():
        got.setdefault(x.track, {})[x.idea] = (x.value, x.note)
    assert got[1]["tune_bass"] == (55.0, "A") and got[1]["glide_a_fifth"][1] == "E" and got[1]["relative_major"][1] == "C" and "beat_of_silence" not in got[1]
    assert got[1]["faster"][0] == 120.0 and got[1]["slower"][0] == 84.0 and "narrow_verse_wide_chorus" in got[1] and got[1]["push_the_clip"][0] == 30.0
    assert set(got[2]) == {"double_the_hook", "opening_filter", "signature_sound", "faster", "slower", "borrowed_minor_fourth"} and got[2]["borrowed_minor_fourth"][1] == "Fm"
    assert set(got[3]) == {"double_the_hook", "opening_filter", "signature_sound"}


def test_normalised_against_arrays(spark):
    rng = np.random.default_rng(6)
    t, c = rng.normal(0, 2, (7, 4)), rng.uniform(0, 1, (7, 3))
    c[2] = 0
    df = spark.createDataFrame([(1, u, t[u].tolist(), c[u].tolist()) for u in range(7)], "track long, u long, t array<double>, c array<double>")
    got = {(x.kind, x.u, x.k): x.v for x in normalised(df).collect()}
    total = c.sum(1, keepdims=True)
    share = c / np.where(total == 0, 1, total)
    for kind, z in (("chroma", share - share.mean(0)), ("timbre", (t - t.mean(0)) / (t.std(0) + 1e-3))):
        z = z / np.linalg.norm(z, axis=1, keepdims=True)
        assert all(abs(got[kind, u, k] - z[u, k]) < 1e-9 for u in range(7) for k in range(z.shape[1]))


def test_stems(spark):
    names = ["song_(Vocals)_htdemucs_6s.wav", "drums.wav", "mix (no_vocals).flac", "Lead  Guitar!.v2.wav", ".wav", "( )", "(!)", None, ""]
    got = [v.s for v in spark.createDataFrame([(n,) for n in names], "n string").select(stem_of(F.col("n")).alias("s")).collect()]
    assert got == ["vocals", "drums", "instrumental", "lead-guitar-v2", "wav", "stem", "stem", None, "stem"]
