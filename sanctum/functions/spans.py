"""Regular-expression spans and rewrites as column expressions.

``regexp_extract_all`` and ``split`` walk the text with the same matcher, so matches and the gaps between them interleave:
an offset is the sum of what came before.  Every expression may carry a guard, a cheap test for a literal that any match
holds; texts that fail it skip the expression.  Patterns must not match the empty string.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def any_of(text: Column, literals: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in literals)) if literals else F.lit(True)


def _parts(text: Column, pattern: str) -> Column:
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))


def _interleave(z: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(match, gap before it) for each match."""
    return F.zip_with(z["m"], F.slice(z["g"], F.lit(1), F.size(z["m"])), f)


def spans(text: Column, pattern: str, group: int = 0, trail: int = 0, guard: Column | None = None) -> Column:
    """Spans of all matches, in code points, end exclusive; of ``group`` if given, which ends ``trail`` signs before the
    match does.  Null text: empty."""

    def one(z):
        def step(acc, x):
            at = acc["at"] + F.length(x["g"])
            end = at + F.length(x["m"])
            value = F.regexp_extract(x["m"], pattern, group) if group else x["m"]
            start, stop = (end - trail - F.length(value), end - trail) if group else (at, end)
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("end"), value.alias("value")))).alias("out"))

        zipped = _interleave(z, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    found = bind(_parts(text, pattern), one)
    hit = text.isNotNull() if guard is None else text.isNotNull() & guard
    return F.when(hit, found).otherwise(F.array().cast(SPAN))


def quoted(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_sql(text: str, pattern: str, guard: str = "true") -> str:
    """``spans`` of whole matches as SQL text over a column's name: one call to the JVM where Column objects take dozens."""
    p = quoted(pattern)
    zipped = "zip_with(z.m, slice(z.g, 1, size(z.m)), (m, g) -> struct(m AS m, g AS g))"
    step = "struct(acc.at + length(x.g) + length(x.m) AS at, concat(acc.out, array(struct(acc.at + length(x.g) AS start, acc.at + length(x.g) + length(x.m) AS end, x.m AS value))) AS out)"
    found = f"transform(array(struct(regexp_extract_all({text}, {p}, 0) AS m, split({text}, {p}, -1) AS g)), z -> aggregate({zipped}, struct(0 AS at, CAST(array() AS {SPAN}) AS out), (acc, x) -> {step}, acc -> acc.out))[0]"
    return f"CASE WHEN {text} IS NOT NULL AND {guard} THEN {found} ELSE CAST(array() AS {SPAN}) END"


def rewrite(text: Column, pattern: str, replace: Callable[[Column], Column], guard: Column | None = None) -> Column:
    """The text with each match m replaced by replace(m), a column expression."""

    def one(z):
        return F.concat(F.array_join(_interleave(z, lambda m, g: F.concat(g, replace(m))), ""), F.element_at(z["g"], -1))

    done = bind(_parts(text, pattern), one)
    return F.when(text.isNotNull() & guard, done).otherwise(text) if guard is not None else F.when(text.isNotNull(), done)


def inside(span: Column, zones: Column) -> Column:
    """Whether a span lies in one of the zones; null zones are no restriction, an empty array lets nothing through."""
    return zones.isNull() | F.coalesce(F.exists(zones, lambda z: (z["start"] <= span["start"]) & (span["end"] <= z["end"])), F.lit(False))


def line_of(text: Column, start: Column) -> Column:
    before = F.substring(text, F.lit(1), start)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def merge_zones(zones: Column) -> Column:
    """Zones sorted, overlapping and touching ones joined."""

    def step(acc, z):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], z["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (z["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), joined).otherwise(F.concat(acc, F.array(F.struct(z["start"].alias("start"), z["end"].alias("end")))))

    return F.aggregate(F.array_sort(zones), F.array().cast("array<struct<start:int,end:int>>"), lambda a, z: bind(F.struct(a.alias("a"), z.alias("z")), lambda b: step(b["a"], b["z"])))


def splice(text: Column, edits: Column) -> Column:
    """The text with disjoint edits array<struct<start, end, replacement>>, sorted by start, put in."""

    def step(acc, e):
        return F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), e["replacement"]).alias("out"), e["end"].alias("at"))

    return F.aggregate(edits, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def disjoint(spans_: Column) -> Column:
    """Spans without those that overlap an earlier or, at the same start, a longer one; sorted by start."""
    ordered = F.array_sort(spans_, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def step(acc, s):
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(s)).alias("out"))).otherwise(acc)

    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.slice(spans_, F.lit(1), F.lit(0)).alias("out")), step, lambda acc: acc["out"])
