"""Span extraction with built-in functions: positions of all matches of a pattern.

Spark returns the matches of a pattern but not their places.  Splitting by the same
pattern returns the gaps between them, and a running sum over gap, match, gap, ... gives
each place in code points.  Nothing here appends to an array match by match, so a text with
very many matches costs little more than its share.  Patterns are written with possessive loops, which need no
stack and never try a run twice; ``\\G`` lets a match begin where the last one ended.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F



def bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def running(values: Column, join) -> Column:
    """Inclusive running results of an associative ``join`` over an array.

    Each round joins every place with the one 1, 2, 4, ... places before it, so n values
    take n log n steps; appending to an array element by element would take n squared.
    """
    def over(v: Column) -> Column:
        return F.aggregate(_shifts(v, 31), v, lambda acc, s: F.transform(
            acc, lambda x, i: F.when(i < s, x).otherwise(join(F.get(acc, i - s), x))))
    return bound(values, over)


def _shifts(v: Column, most: int) -> Column:
    """1, 2, 4, ... as far as the array reaches, at most ``most`` of them."""
    return F.slice(F.array(*[F.lit(1 << k) for k in range(most)]), F.lit(1), F.least(F.length(F.bin(F.size(v))), F.lit(most)))


def places(text: Column, pattern: str, kind: int, group: int | None = None, context: int = 0) -> Column:
    """All leftmost non-overlapping matches as array of (kind, s, e, m), e exclusive.

    ``m`` is the match, or its ``group``.  With ``context`` each match also holds that many
    characters before it and the one behind it (``before``, ``after``).  The work grows
    with the text and with n log n of the matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    m = "whole" if group is None else "part"

    def parts(f: Column) -> Column:
        # the last gap has no match behind it
        both = [F.split(text, pattern, -1).alias("gap"), f.alias("whole")]
        if group is not None:
            both.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
        return F.arrays_zip(*both)

    def spans(p: Column) -> Column:
        steps = F.transform(p, lambda x: (F.length(x["gap"]) + F.coalesce(F.length(x["whole"]), F.lit(0))).cast("long"))
        ends = running(steps, lambda a, b: a + b)

        def one(x: Column, e: Column, near: tuple[Column, ...] = ()) -> Column:
            return F.struct(F.lit(kind).alias("kind"), (e - F.length(x["whole"])).alias("s"), e.alias("e"), x[m].alias("m"), *near)

        if not context:
            rows = F.zip_with(p, ends, lambda x, e: F.struct(x["whole"].alias("whole"), one(x, e).alias("span")))
        else:
            rows = F.zip_with(F.transform(p, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), F.arrays_zip(
                ends.alias("e"), _before(p, context).alias("before")), lambda y, z: F.struct(
                    y["x"]["whole"].alias("whole"),
                    one(y["x"], z["e"], (z["before"].alias("before"), _after(p, y["i"]).alias("after"))).alias("span")))
        return F.transform(F.filter(rows, lambda r: r["whole"].isNotNull()), lambda r: r["span"])

    return bound(found, lambda f: F.when(F.size(f) > 0, bound(parts(f), spans)).otherwise(
        F.array().cast(_span_type(context))))


def _span_type(context: int) -> str:
    return f"array<struct<kind:int,s:bigint,e:bigint,m:string{',before:string,after:string' if context else ''}>>"


def _before(parts: Column, width: int) -> Column:
    """The last ``width`` characters in front of each match.

    A match has at least one character, so ``width`` matches back reach far enough.
    """
    def last(c: Column) -> Column:
        return F.substring(c, -width, width)

    tails = F.transform(parts, lambda x, i: F.when(F.length(x["gap"]) >= width, last(x["gap"])).otherwise(
        last(F.concat(F.coalesce(F.get(parts, i - 1)["whole"], F.lit("")), x["gap"]))))
    return F.aggregate(_shifts(parts, width.bit_length()), tails, lambda acc, s: F.transform(acc, lambda x, i: F.when(
        (i < s) | (F.length(x) >= width), x).otherwise(last(F.concat(F.get(acc, i - s), x)))))


def _after(parts: Column, i: Column) -> Column:
    behind = F.get(parts, i + 1)
    return F.when(F.length(behind["gap"]) > 0, F.substring(behind["gap"], 1, 1)).otherwise(
        F.substring(F.coalesce(behind["whole"], F.lit("")), 1, 1))


def apart(loose: Column, fixed: Column) -> Column:
    """The spans of ``loose`` that touch none of ``fixed``, in their order, by one sorted pass.

    A span x is touched when, of the fixed spans that begin before x ends, the one that
    reaches farthest ends behind the start of x.
    """
    def over(spans: Column) -> Column:
        begins = F.transform(fixed, lambda b: F.struct(b["s"].alias("at"), F.lit(1).alias("rank"), F.lit(-1).alias("i"), b["e"].alias("reach")))
        stops = F.transform(spans, lambda x, i: F.struct(x["e"].alias("at"), F.lit(0).alias("rank"), i.alias("i"), F.lit(-1).cast("long").alias("reach")))
        free = bound(F.array_sort(F.concat(begins, stops)), lambda events: F.filter(
            F.zip_with(events, running(F.transform(events, lambda v: v["reach"]), F.greatest),
                       lambda v, reach: F.struct(v["i"].alias("i"), reach.alias("reach"))),
            lambda v: (v["i"] >= 0) & (v["reach"] <= F.get(spans, v["i"])["s"])))
        return F.transform(F.array_sort(F.transform(free, lambda v: v["i"])), lambda i: F.get(spans, i))

    return F.when((F.size(loose) == 0) | (F.size(fixed) == 0), loose).otherwise(bound(loose, over))


def merged(spans: Column) -> Column:
    """Spans (s, e) by place, those that overlap as one."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))

    def over(y: Column) -> Column:
        v, reach = y["v"], y["reach"]
        # a span that begins where all earlier ones have ended begins a run
        heads = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | (F.get(reach, i - 1) <= F.get(v, i)["s"]))
        return bound(heads, lambda h: F.transform(h, lambda i, j: F.struct(
            F.get(v, i)["s"].alias("s"),
            F.get(reach, F.coalesce(F.get(h, j + 1), F.size(v)) - 1).alias("e"))))

    whole = bound(ordered, lambda v: F.struct(v.alias("v"), running(F.transform(v, lambda x: x["e"]), F.greatest).alias("reach")))
    return F.when(F.size(spans) == 0, F.array().cast("array<struct<s:bigint,e:bigint>>")).otherwise(bound(whole, over))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The check sum of a digit string holds."""
    back = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    total = F.aggregate(F.transform(back, _luhn_digit), F.lit(0), lambda a, d: a + d)
    return (F.length(number) > 0) & (total % 10 == 0)


def _luhn_digit(c: Column, i: Column) -> Column:
    d = F.ascii(c) - 48
    twice = d * 2
    return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))


def count_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def joined(spans: Column, names: tuple[str, ...], by_place: bool) -> Column:
    """kind:start:end, comma-joined, ordered by start then kind, or by kind then start."""
    order = (lambda x: F.struct(x["s"], x["kind"], x["e"])) if by_place else (lambda x: F.struct(x["kind"], x["s"], x["e"]))
    rows = F.array_sort(F.transform(spans, order))
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(
        ":", F.element_at(kinds, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def upper_tail(z: Column) -> Column:
    """P(N(0,1) > z) for z >= 0 by a continued fraction; 1/2 at and below 0."""
    frac = z + F.lit(4.0)
    for k in (4.0, 3.0, 2.0, 1.0):
        frac = z + F.lit(k) / frac
    dens = F.exp(-z * z / 2) / F.lit((2 * 3.141592653589793) ** 0.5)
    return F.when(z > 0, F.least(F.lit(0.5), dens / frac)).otherwise(F.lit(0.5))
