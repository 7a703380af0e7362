"""Invitations and their answers, tokens and their use, as joins of two streams.

Both sides carry watermarks, so what can no longer be answered leaves the state: it grows with what is open, not with the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def answered(invitations: DataFrame, answers: DataFrame, within: str = "7 days", late: str = "0 seconds") -> DataFrame:
    """(..., answer, answered_at): invitations (invite_id, sent_at, ...) with each answer (invite_id, answer, answered_at) given from then on, ``within`` that time.

    An invitation without one comes out once, with nulls, when the watermark says that none can come any more. Answers without an invitation, before it or
    too late are dropped, and so are rows without an id or a time. An answer delivered again counts once while the watermark has not passed it;
    several unlike answers all come out, see ``outcomes``.
    """
    asked = _timed(invitations.where("invite_id IS NOT NULL AND sent_at IS NOT NULL"), "sent_at", late)
    told = answers.where("invite_id IS NOT NULL AND answered_at IS NOT NULL").select(F.col("invite_id").alias("__invite"), "answer", "answered_at")
    once = _timed(told, "answered_at", late).dropDuplicatesWithinWatermark(["__invite", "answer", "answered_at"])
    in_time = F.col("answered_at").between(F.col("sent_at"), F.col("sent_at") + F.expr(f"INTERVAL {within}"))
    return asked.join(once, (F.col("invite_id") == F.col("__invite")) & in_time, "left_outer").drop("__invite")


def outcomes(rows: DataFrame) -> DataFrame:
    """One row an invitation of what ``answered`` has given so far: its first answer counts, of those of one moment the least.

    Rows that repeat an id are one invitation, with the least of their other columns, ``sent_at`` among them.
    """
    rest = [c for c in rows.columns if c not in ("invite_id", "answer", "answered_at")]
    first = F.min(F.when(F.col("answered_at").isNotNull(), F.struct("answered_at", "answer"))).alias("a")
    found = rows.groupBy("invite_id").agg(F.min(F.struct(*rest)).alias("i"), first)
    return found.select("invite_id", *(f"i.{c}" for c in rest), "a.answer", "a.answered_at")


def rotated(tokens: DataFrame, uses: DataFrame, valid: str = "7 days", late: str = "0 seconds") -> DataFrame:
    """(token, user_id, next_token, used_at): the use of each token (token, user_id, issued_at) that buys a new one; ``uses`` are (token, next_token, used_at).

    A token is good once, ``valid`` from its issue: a later use finds its first one in the state, which is kept for as long as the token could be
    good. Of uses that arrive in one micro-batch one counts, whichever it is. Uses of tokens that were never issued, or not yet, or
    too long ago, give nothing, nor do rows without a token or a time.
    """
    issued = _timed(tokens.where("token IS NOT NULL AND issued_at IS NOT NULL"), "issued_at", late).select("token", "user_id", "issued_at")
    used = uses.where("token IS NOT NULL AND used_at IS NOT NULL").select(F.col("token").alias("__token"), "next_token", "used_at")
    # uses may be as late as a token is good, so that the first one is remembered for that long
    in_time = F.col("used_at").between(F.col("issued_at"), F.col("issued_at") + F.expr(f"INTERVAL {valid}"))
    first = _timed(used, "used_at", valid).dropDuplicatesWithinWatermark(["__token"])
    return issued.join(first, (F.col("token") == F.col("__token")) & in_time).select("token", "user_id", "next_token", "used_at")
