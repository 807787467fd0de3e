"""License scan by ordered signature rules, in DataFrame functions only.

A text is lower-cased and its words (runs of letters, digits and anything beyond ASCII) are joined by single
spaces. Rules are regular expressions over that; a rule runs only where its keyword stands. Overlapping
detections are resolved: one that lies within another of the same or a better priority is dropped.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import drop_clashing, fresh, table
from .license_rules import NAMED, NOTED, PRIORITIES, RULES, STEMS

#: Word phrases that always count: (words, label).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RULE = "array<struct<rule:int,label:string,priority:int,sure:double,keyword:string,pattern:string>>"
_HIT = "array<struct<start:int,stop:int,priority:int,sure:double,label:string,rule:int>>"


#: Entries of an array that are run through at a time; longer arrays are cut into runs, so that work stays in proportion.
RUN = 512


def _let(value: Column, made) -> Column:
    """``made`` of a value that is computed once: a lambda would compute an expression from outside anew for each entry."""
    return F.get(F.transform(F.array(value), made), 0)


def _before(values: Column, kind: str, add, none: Column) -> Column:
    """For each entry of an array of ``kind``, what ``add`` (associative) makes of those before it, beginning with ``none``.

    Runs of entries are added up first, so that no array grows longer than a run or than the number of runs.
    """

    def running(entries: Column, first: Column) -> Column:
        begin = F.struct(first.alias("now"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(entries, begin, lambda acc, x: F.struct(add(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")), lambda acc: acc["out"])

    def cut(v: Column) -> Column:
        n = F.floor((F.size(v) + RUN - 1) / RUN).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(v, k * RUN + 1, RUN))).otherwise(F.array().cast(f"array<array<{kind}>>"))

    def summed(runs: Column) -> Column:
        return F.flatten(F.zip_with(runs, running(F.transform(runs, lambda r: F.aggregate(r, none, add)), none), running))

    return _let(values, lambda v: _let(cut(v), summed))


def _places(norm: Column, r: Column) -> Column:
    """The places of a rule's matches: the length of all gaps and matches before, and of its own gap."""
    lengths = F.struct(
        F.transform(F.regexp_extract_all(norm, r["pattern"], F.lit(0)), F.length).alias("hits"), F.transform(F.split(norm, r["pattern"], -1), F.length).alias("gaps")
    )
    made = lambda at, n: F.struct(
        at.alias("start"), (-(at + n)).alias("back"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["sure"].alias("sure"), r["label"].alias("label")
    )

    def placed(x: Column) -> Column:
        gaps = F.slice(x["gaps"], 1, F.size(x["hits"]))
        before = _before(F.zip_with(x["hits"], gaps, lambda h, g: h + g), "int", lambda a, b: a + b, F.lit(0))
        return F.zip_with(F.zip_with(before, gaps, lambda a, g: a + g), x["hits"], made)

    return _let(lengths, placed)


def _stay(hits: Column) -> Column:
    """The hits that no other one suppresses.

    In the order of (start, longer first, priority, rule) all that may suppress a hit stand before it; so it goes if one before it
    of its priority or a better one reaches its end. The furthest ends by priority are carried along.
    """
    kind = "struct<" + ",".join(f"p{p}:int" for p in PRIORITIES) + ">"
    none = F.struct(*[F.lit(0).alias(f"p{p}") for p in PRIORITIES])
    most = lambda a, b: F.struct(*[F.greatest(a[f"p{p}"], b[f"p{p}"]).alias(f"p{p}") for p in PRIORITIES])
    reached = lambda h, e: F.coalesce(*[F.when(h["priority"] == p, e[f"p{p}"]) for p in PRIORITIES])
    made = lambda x: F.struct(
        x["h"]["start"].alias("start"), (-x["h"]["back"]).alias("stop"), x["h"]["priority"].alias("priority"), x["h"]["sure"].alias("sure"), x["h"]["label"].alias("label"), x["h"]["rule"].alias("rule")
    )

    def kept(ordered: Column) -> Column:
        ends = F.transform(ordered, lambda h: F.struct(*[F.when(h["priority"] <= p, -h["back"]).otherwise(F.lit(0)).alias(f"p{p}") for p in PRIORITIES]))
        both = F.zip_with(ordered, _before(ends, kind, most, none), lambda h, e: F.struct(h.alias("h"), (reached(h, e) >= -h["back"]).alias("gone")))
        return F.transform(F.filter(both, lambda x: ~x["gone"]), made)

    return _let(F.array_sort(hits), kept)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``words`` (count), ``base`` (places, first, last, labels) and ``hits`` (detections that stay).

    Hits are places in the text's words joined by single spaces, with label, rule, priority and confidence; A-Z are lower-cased
    and no other letters. Null and empty texts have no words and no hits. Very long texts are scanned whole, in time in proportion
    to their length and hits. Of detections with equal places, priority and then the earlier rule decide, so no tie is
    left open. Rows are independent: nothing is shuffled, and equal rows have equal results. Columns of those three names are replaced.
    """
    docs = drop_clashing(docs, "words", "base", "hits")
    low_, norm_, present_ = fresh(docs, "low", "norm", "present")
    out = docs.withColumn(low_, F.translate(F.coalesce(F.col(text), F.lit("")), _CAPITALS, _CAPITALS.lower()))
    gate = F.col(low_).rlike(NAMED) | (F.contains(low_, F.lit("mit")) & F.col(low_).rlike(NOTED))
    for stem in STEMS:
        gate = gate | F.contains(low_, F.lit(stem))
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(low_, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))
    out = out.withColumn("words", F.regexp_count(low_, F.lit(_LETTERS)).cast("long")).withColumn(norm_, F.when(gate, norm)).drop(low_)

    n = F.col(norm_)
    spaces = lambda s: (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE:
        there = F.contains(n, F.lit(f" {phrase} "))
        places.append(F.when(there, F.regexp_count(n, F.lit(f" {phrase}(?= )")).cast("long")).otherwise(F.lit(0)))
        firsts.append(F.when(there, spaces(F.left(n, F.instr(n, f" {phrase} ") - 1))))
        after = F.substring_index(n, f" {phrase} ", -1)
        lasts.append(F.when(there, spaces(F.left(n, F.length(n) - F.length(after) - len(phrase) - 2))))
        labels.append(F.when(there, F.lit(label)))
    base = F.struct(
        sum(places[1:], places[0]).alias("places"), F.least(*firsts).alias("first"), F.greatest(*lasts).alias("last"), F.array_compact(F.array(*labels)).alias("labels")
    )
    keywords = sorted({r["keyword"] for r in RULES})
    rules = F.from_json(F.lit(json.dumps(RULES)), _RULE)
    present = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(n, k))
    out = out.withColumn("base", base).withColumn(present_, F.when(n.isNotNull(), present))
    held = F.filter(rules, lambda r: F.array_contains(F.col(present_), r["keyword"]))
    found = F.flatten(F.transform(held, lambda r: _places(n, r)))
    out = out.withColumn("hits", F.when(F.size(present_) > 0, found))
    out = out.withColumn("hits", F.coalesce(F.when(F.size("hits") > 0, _stay(F.col("hits"))), F.array().cast(_HIT)))
    # A row made by a generator is a value: without it, a filter on the result takes in copies of all these expressions.
    (row,) = fresh(docs, "row")
    return out.select(F.explode(F.array(F.struct(*docs.columns, "words", "base", "hits"))).alias(row)).select(f"{row}.*")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of all documents; ``score`` is the largest confidence among detections."""
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.coalesce("base.labels", F.array().cast("array<string>"))
    both = F.array_sort(F.array_distinct(F.concat(base, F.transform("hits", lambda h: h["label"]))))
    return out.select(
        "doc_id",
        F.col("words").alias("n_words"),
        F.coalesce("base.places", F.lit(0)).cast("long").alias("n_base"),
        F.col("base.first").alias("first_word"),
        F.col("base.last").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["sure"])), F.lit(0.0)).alias("score"),
    )


QUERIES = {"op8_license_scan": op8_license_scan}
ORACLES: dict[str, str] = {}
