"""Personal data by bootstrapped contextual extraction; DataFrame functions only.

The base patterns find the seeds.  The words next to a seed induce lexical patterns (`word before` or `word after`, for a
kind).  Tokens with a digit or an at sign that no base pattern covers are the candidates.  Patterns and candidates form a
graph that is scored in rounds: a pattern is as sure as the part of its occurrences that are seeds or scored candidates,
and a candidate as its surest pattern, averaged over its occurrences.  Candidates that end up sure are new spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
# Possessive forms of the given patterns with the same matches: what follows a possessive part can never match inside it, and
# an attempt inside a run that failed from its start fails too, so attempts begin at a run or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token that could be an identifier.
CANDIDATE = r"(?<![^\s\x01])[^\s0-9@\x01]*+[0-9@][^\s\x01]*+"
ROUNDS = 3
#: A pattern needs this many seeds; it is measured against its occurrences and PRIOR more.
MIN_SEEDS, PRIOR, MIN_PATTERN, SURE = 5, 2, 0.3, 0.8
_MARK, _OTHER = "\x01", "\x02"


def _pieces(text: Column, pattern: str, maybe: Column) -> Column:
    """The text cut at the matches: pieces 2, 4, ... are the matches.  They are looked for only where `maybe` holds."""
    return F.when(maybe, F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)).otherwise(F.array(text))


def _spans(pieces: Column, kind: str) -> Column:
    """Array of (kind, start, end, value, left, right) of the matches that the pieces hold."""

    def span(i: Column) -> Column:
        value = F.element_at(pieces, i)
        start = F.aggregate(F.slice(pieces, 1, i - 1), F.lit(0), lambda n, piece: n + F.length(piece))
        left = F.substring_index(F.rtrim(F.translate(F.element_at(pieces, i - 1), "\n\t", "  ")), " ", -1)
        right = F.substring_index(F.ltrim(F.translate(F.element_at(pieces, i + 1), "\n\t", "  ")), " ", 1)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.lower(left).alias("left"), F.lower(right).alias("right"))

    places = F.when(F.size(pieces) > 2, F.sequence(F.lit(2), F.size(pieces) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, span)


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right; every second digit from the right counts double."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(span: Column, kind: str) -> Column:
    digits = F.regexp_replace(span["value"], "[^0-9]", "")
    if kind == "ip":
        # Leading zeros do not count; four digits or more are above 255.
        part = lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255).otherwise(False)
        return F.forall(F.split(span["value"], r"\."), part)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def found(docs: DataFrame) -> DataFrame:
    """key, doc_id, the base spans of each kind, and the candidates outside of them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.translate("text", _MARK, _OTHER).alias("text"))
    digit = F.col("text").rlike("[0-9]")
    at, plus = F.col("text").contains("@"), F.col("text").contains("+")
    rows = rows.withColumn("_digit", digit)
    maybe = {"email": at, "ip": F.col("_digit"), "card": F.col("_digit"), "phone": plus & F.col("_digit"), "other": F.col("_digit") | at}
    # The pieces are columns of their own, so that they are cut once and not for every match.
    rows = rows.withColumns({f"_{kind}": _pieces(F.col("text"), PATTERNS.get(kind, CANDIDATE), m) for kind, m in maybe.items()})
    rows = rows.select("key", "doc_id", *(_spans(F.col(f"_{kind}"), kind).alias(kind) for kind in maybe))
    rows = rows.withColumns({kind: F.filter(kind, _filter(kind)) for kind in KINDS})
    outside = lambda c: ~F.exists(F.concat(*KINDS), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    return rows.withColumn("other", F.filter("other", outside))


def _is(kind: str):
    return lambda span: span["kind"] == kind


def _filter(kind: str):
    return lambda span: _holds(span, kind)


def _edges(mentions: DataFrame) -> DataFrame:
    """One row for each mention and side: its lexical pattern."""
    sides = F.array(*(F.concat(F.lit(f"{side} "), F.col(side)) for side in ("left", "right")))
    return mentions.where("left <> '' or right <> ''").select("kind", "value", "key", "start", F.explode(sides).alias("pattern")).where("pattern not in ('left ', 'right ')")


def discovered(rows: DataFrame) -> DataFrame:
    """(key, start, end, kind) of the candidates in `rows` (see found) that high-confidence patterns give away."""
    mentions = written(rows.select("key", F.explode(F.concat(*KINDS, "other")).alias("m")).select("key", "m.*").distinct(), "mentions")
    edges = _edges(mentions)
    seeds = edges.where("kind <> 'other'").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("mass"), F.countDistinct("value").alias("seeds")).where(F.col("seeds") >= MIN_SEEDS)
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    base = written(seeds.join(totals, "pattern"), "patterns")
    others = edges.where("kind = 'other'").drop("kind")
    times = mentions.where("kind = 'other'").groupBy("value").agg(F.count(F.lit(1)).alias("times"))
    scores = None
    for _ in range(ROUNDS):
        known = base
        if scores is not None:
            more = others.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("more"))
            known = base.join(more, ["pattern", "kind"], "left").withColumn("mass", F.col("mass") + F.coalesce("more", F.lit(0.0)))
        sure = known.select("pattern", "kind", (F.col("mass") / (F.col("total") + PRIOR)).alias("sure")).where(F.col("sure") >= MIN_PATTERN)
        mention = others.join(sure, "pattern").groupBy("value", "key", "start", "kind").agg(F.max("sure").alias("sure"))
        scores = mention.groupBy("value", "kind").agg(F.sum("sure").alias("score")).join(times, "value").select("value", "kind", (F.col("score") / F.col("times")).alias("score"))
        scores = written(scores, "scores")
    best = scores.where(F.col("score") >= SURE).groupBy("value").agg(F.max(F.struct("score", "kind")).alias("best")).select("value", "best.kind")
    return mentions.where("kind = 'other'").drop("kind").join(best, "value").select("key", "start", "end", "kind")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered for every row of docs (doc_id, text).

    The counts and base_sha256 are of the base spans; spans lists these and the discovered ones as kind:start:end by kind and
    start, in code points, end exclusive.  NULL counts as empty, and a text without spans has an empty list.  Repeated rows
    have the same spans.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = written(found(docs), "found")
    new = discovered(rows).groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.lit(0).alias("rank"), "start", "end", "kind"))).alias("new"))
    rows = rows.join(new, "key", "left").withColumn("new", F.coalesce("new", F.array().cast("array<struct<rank: int, start: int, end: int, kind: string>>")))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.array_join(F.transform(F.concat(*KINDS), text), ",")
    place = lambda kind: F.transform(F.col(kind), lambda s: F.struct(F.lit(0).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    all_ = F.flatten(F.array(*(F.array_sort(F.concat(place(kind), F.filter("new", _is(kind)))) for kind in KINDS)))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform(all_, text), ",").alias("spans"), F.size("new").cast("long").alias("n_discovered"))
