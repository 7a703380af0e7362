"""License scans by ordered signature rules, with DataFrame functions only.

Texts become lines of lower-case words; a cheap gate, then a keyword of each rule, decide which patterns
run. A match is an interval of words. Of two detections of which one contains the other, that of the worse rank is
suppressed, of equal ranks the inner one; of the same words and rank, that of the later label. Detections that only overlap,
without one containing the other, both stand. All of it is one
projection: no shuffle, no join, and nothing per row leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import ANCHORS, BASE, RULES, Rule

CONFIDENCE = {1: 0.99, 2: 0.95, 3: 0.9, 4: 0.6}
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _STOP = "\x01", "\x02"
_DETECTIONS = "array<struct<start:int,back:int,rank:int,label:string>>"


def _positions(words: Column, test) -> Column:
    """Indexes, from 0, of the words that pass a test."""
    return F.filter(F.transform(words, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())


def _detected(line: Column) -> Column:
    """All matches of the rules whose keyword occurs, as (start, -stop, rank, label)."""

    def tried(r: Rule) -> Column:
        # a literal pattern is compiled once, whatever the number of rows
        marked = F.regexp_replace(line, f"(?<= )(?:{r.pattern})(?= )", f"{_START}$0{_STOP}")
        return F.struct(F.lit(r.label).alias("label"), F.lit(r.rank).alias("rank"), F.when(F.contains(line, F.lit(r.keyword)), marked).alias("marked"))

    def found(r: Column) -> Column:
        words = F.split(F.trim(r["marked"]), " ", -1)
        starts, stops = _positions(words, lambda w: F.startswith(w, F.lit(_START))), _positions(words, lambda w: F.endswith(w, F.lit(_STOP)))
        return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), (-b).alias("back"), r["rank"].alias("rank"), r["label"].alias("label")))

    matched = F.filter(F.array(*map(tried, RULES)), lambda r: F.contains(r["marked"], F.lit(_START)))
    return F.array_sort(F.flatten(F.transform(matched, found)))


def _resolved(detections: Column) -> Column:
    """(labels, best): the labels that stand after suppression, and their best rank.

    By start and then longest first, whatever contains a detection comes before it: it is suppressed
    if one of those of no worse rank ends behind it. Whatever it contains comes after it: backwards, it
    is suppressed if one of better rank ends before it. So two passes with the furthest end of each rank decide.
    """
    ranks, far, empty = sorted(CONFIDENCE), 1 << 30, F.array().cast("array<struct<back:int,rank:int,label:string,stands:boolean>>")
    ends = lambda value: F.struct(*(F.lit(value).alias(f"r{r}") for r in ranks))

    def forward(a: Column, x: Column) -> Column:
        inside = reduce(lambda c, r: c | ((x["rank"] >= r) & (a["ends"][f"r{r}"] >= -x["back"])), ranks, F.lit(False))
        reach = F.struct(*(F.when(x["rank"] == r, F.greatest(a["ends"][f"r{r}"], -x["back"])).otherwise(a["ends"][f"r{r}"]).alias(f"r{r}") for r in ranks))
        row = F.struct(x["back"].alias("back"), x["rank"].alias("rank"), x["label"].alias("label"), (~inside).alias("stands"))
        return F.struct(reach.alias("ends"), F.concat(a["out"], F.array(row)).alias("out"))

    def backward(a: Column, x: Column) -> Column:
        around = reduce(lambda c, r: c | ((x["rank"] > r) & (a["ends"][f"r{r}"] <= -x["back"])), ranks, F.lit(False))
        reach = F.struct(*(F.when(x["rank"] == r, F.least(a["ends"][f"r{r}"], -x["back"])).otherwise(a["ends"][f"r{r}"]).alias(f"r{r}") for r in ranks))
        stands = x["stands"] & ~around
        labels = F.when(stands, F.array_union(a["labels"], F.array(x["label"]))).otherwise(a["labels"])
        return F.struct(reach.alias("ends"), labels.alias("labels"), F.when(stands, F.least(a["best"], x["rank"])).otherwise(a["best"]).alias("best"))

    first = F.aggregate(F.array_distinct(detections), F.struct(ends(-1).alias("ends"), empty.alias("out")), forward, lambda a: a["out"])
    start = F.struct(ends(far).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(9).alias("best"))
    return F.aggregate(F.reverse(first), start, backward, lambda a: F.struct(a["labels"].alias("labels"), a["best"].alias("best")))


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections).

    One row per row of ``docs`` (doc_id, text). ``n_base`` counts all places of the base phrases and
    ``first_word``/``last_word`` are their least and largest start among the words, from 0; null
    without any. ``labels`` adds the labels that stand after suppression; base labels always stay.
    ``score`` is the confidence of the best standing detection, 0 without any. ``detections``
    holds every match before suppression (start, -stop, rank, label). A null text is empty: no
    words, empty strings, score 0. A null doc_id stays null, repeated rows are scanned alike,
    other columns are ignored, no rows give no rows. Only A-Z are lower-cased; texts of any length are whole.
    """
    plain = F.trim(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), _GAP, " "))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain.alias("plain"))
    small = F.concat(F.lit(" "), F.lower("plain"), F.lit(" "))
    gate = reduce(lambda a, b: a | b, (F.contains("small", F.lit(x)) for x in ANCHORS))
    n_words = F.when(F.col("plain") == "", 0).otherwise(F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1)
    rows = rows.select("doc_id", n_words.cast("long").alias("n_words"), "plain", small.alias("small")).select("doc_id", "n_words", "plain", gate.alias("gate"))
    line = F.when(F.col("gate"), F.concat(F.lit(" "), F.translate("plain", _UPPER, _LOWER), F.lit(" ")))
    rows = rows.select("doc_id", "n_words", line.alias("line"))
    phrases = "|".join(phrase for phrase, _ in BASE.values())
    marked = F.split(F.trim(F.regexp_replace("line", f"(?<= )({phrases})(?= )", f"{_START}$1")), " ", -1)
    is_base = lambda w: F.startswith(w, F.lit(_START))
    base = F.when(F.contains("line", F.lit("license ")) | F.contains("line", F.lit("cc by")), marked)
    rows = rows.select("doc_id", "n_words", base.alias("marked"), F.when(F.col("line").isNotNull(), _detected(F.col("line"))).alias("detections"))
    heads = F.array_distinct(F.filter("marked", is_base))
    named = F.create_map(*(F.lit(x) for head, (_, label) in BASE.items() for x in (f"{_START}{head}", label)))
    rows = rows.select(
        "doc_id",
        "n_words",
        _positions(F.col("marked"), is_base).alias("places"),
        F.coalesce(F.array_sort(F.transform(heads, lambda w: F.element_at(named, w))), F.array().cast("array<string>")).alias("base"),
        F.coalesce("detections", F.array().cast(_DETECTIONS)).alias("detections"),
    )
    rows = rows.withColumn("standing", _resolved(F.col("detections")))
    best = reduce(lambda c, x: c.when(F.col("standing.best") == x[0], x[1]), CONFIDENCE.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    n_base = F.greatest(F.coalesce(F.size("places"), F.lit(0)), F.lit(0))
    return rows.select(
        "doc_id",
        "n_words",
        n_base.cast("long").alias("n_base"),
        F.when(n_base > 0, F.array_min("places")).cast("long").alias("first_word"),
        F.when(n_base > 0, F.array_max("places")).cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "standing.labels")), ",").alias("labels"),
        F.greatest(best, F.when(n_base > 0, CONFIDENCE[3]).otherwise(0.0)).cast("double").alias("score"),
        "detections",
    )

