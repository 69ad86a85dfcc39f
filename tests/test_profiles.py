"""Checks of profiles and wrapped descriptions on small tables."""

import textwrap

from pyspark.sql import functions as F

from tessella.operators import profiles


def test_wrapped_descriptions(spark):
    texts = ["", "one", "a description of several words, one of which is extraordinarilylong and then more", "two  blanks\tand tabs", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: (r.w, r.c) for r in frame.select("id", profiles.wrapped(F.col("t"), 18, 2).alias("w"), profiles.wrapped(F.col("t"), 40, 0, 10).alias("c")).collect()}
    for i, t in enumerate(texts[:4]):
        fill = lambda x, width, indent: textwrap.fill(x, width, subsequent_indent=" " * indent, break_long_words=False, break_on_hyphens=False)
        plain = " ".join(t.split())
        assert got[i][0] == fill(plain, 18, 2)
        assert got[i][1] == (fill(" ".join((t[:10] + "...").split()), 40, 0) if len(t) > 10 else plain)
    assert got[4] == (None, None)


def test_incompatibilities(spark):
    schema = "id int, pos int, residue string"
    one = spark.createDataFrame([(1, 1, "A"), (1, 2, None), (2, 1, "A"), (2, 2, "C"), (3, 1, "A"), (4, 1, "A"), (6, 1, "A"), (6, 2, "A")], schema)
    other = spark.createDataFrame([(1, 1, "A"), (1, 2, None), (2, 1, "A"), (3, 1, "C"), (5, 1, "A"), (6, 1, "A"), (6, 3, "A")], schema)
    got = {r.id: r.reason for r in profiles.incompatibilities(one, other).collect()}
    assert got == {2: "length", 3: "residue", 4: "missing", 5: "missing", 6: "residue"}
    assert profiles.incompatibilities(one.limit(0), other.limit(0)).count() == 0


def test_profile_scores_without_values(spark):
    rows = spark.createDataFrame([(1, [1.0, None, 2.0]), (1, [1.0, 1.0, 1.0]), (2, None)], "id int, scores array<double>")
    got = {(r.id, r.score): r.p for r in profiles.profile_score_distribution(rows, [0.5, 0.3, 0.0]).collect()}
    assert got == {(1, 1): (0.5 + 0.5 + 0.3) / 2}
    assert profiles.thick_enough(spark.createDataFrame([(1, 2.9), (2, 3.0), (3, None)], "id int, n double"), "n").count() == 1
