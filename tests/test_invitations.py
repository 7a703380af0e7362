"""Invitations with late, repeated and missing answers; tokens that are good once; over restarts."""

from pyspark.sql import functions as F

from treeline.streaming import edits as E
from treeline.streaming import invitations as I

ASKED, TOLD = "invite_id long, to_user string, sent_at long", "invite_id long, answer string, answered_at long"
TOKENS, USES = "token string, user_id long, issued_at long", "token string, next_token string, used_at long"


def arriving(spark, folder, schema, time, rows):
    made = spark.createDataFrame(rows, schema).withColumn(time, F.timestamp_seconds(time))
    made.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(made.schema).parquet(folder)


def seconds(df, *columns):
    return sorted(tuple(r) for r in df.select(*(F.unix_seconds(c).alias(c) if c.endswith("_at") else F.col(c) for c in columns)).collect())


def test_answers_late_repeated_and_missing(spark, tmp_path):
    def turn(asked, told):
        a = arriving(spark, str(tmp_path / "asked"), ASKED, "sent_at", asked)
        b = arriving(spark, str(tmp_path / "told"), TOLD, "answered_at", told)
        return I.outcomes(E.appended(I.answered(a, b, "100 seconds"), str(tmp_path / "out")))

    turn([(1, "a", 1000), (2, "b", 1000), (3, "c", 1000), (4, "d", 1010), (None, "n", 1000)], [(1, "accepted", 1020), (1, "accepted", 1020), (1, "rejected", 1050), (2, "rejected", 999), (77, "accepted", 1020), (None, "accepted", 1001)])
    found = turn([(5, "e", 2000), (6, "f", 2000)], [(3, "accepted", 1100), (4, "accepted", 1111), (5, "rejected", 2100), (5, "accepted", 2100)])
    # 2 was answered before it was asked, 4 too late; 6 is still open
    want = [(1, "a", 1000, "accepted", 1020), (2, "b", 1000, None, None), (3, "c", 1000, "accepted", 1100), (4, "d", 1010, None, None), (5, "e", 2000, "accepted", 2100)]
    assert seconds(found.where("answer IS NOT NULL"), "invite_id", "to_user", "sent_at", "answer", "answered_at") == [w for w in want if w[3]]
    assert seconds(found.where("answer IS NULL"), "invite_id", "to_user", "sent_at") == [w[:3] for w in want if not w[3]]


def test_a_token_is_good_once(spark, tmp_path):
    def turn(tokens, uses):
        a = arriving(spark, str(tmp_path / "tokens"), TOKENS, "issued_at", tokens)
        b = arriving(spark, str(tmp_path / "uses"), USES, "used_at", uses)
        return E.appended(I.rotated(a, b, "100 seconds"), str(tmp_path / "out"))

    turn([("t", 1, 1000), ("u", 2, 1000), ("late", 3, 1000)], [("t", "t2", 1010), ("t", "t2", 1010), ("forged", "x", 1010), (None, "x", 1010)])
    found = turn([("t2", 1, 1010)], [("t", "stolen", 1030), ("t2", "t3", 1040), ("u", "u2", 1100), ("late", "x", 1101)])
    assert seconds(found, "token", "user_id", "next_token", "used_at") == [("t", 1, "t2", 1010), ("t2", 1, "t3", 1040), ("u", 2, "u2", 1100)]


def test_streams_without_rows(spark, tmp_path):
    a = arriving(spark, str(tmp_path / "asked"), ASKED, "sent_at", [])
    b = arriving(spark, str(tmp_path / "told"), TOLD, "answered_at", [])
    assert I.outcomes(E.appended(I.answered(a, b, "100 seconds"))).count() == 0
