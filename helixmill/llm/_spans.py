"""Spans of regular expressions as DataFrame expressions, in code points, end exclusive.

`split` by the same expression gives the gaps between matches, so that running sums of lengths
place each match. Guards are plain substring tests that every match passes.

The patterns take what follows possessively and start at the head of a run of their first
class: what backtracking or later starts could give is no match either, and no text makes them
recurse or scan a run more than once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def scanned(items: Column, zero: Column, out: str, step) -> Column:
    """Struct of a state and the array<out> that the items add to, one after another: step(state, item) gives (state, array to add).

    Items go by blocks of about the square root of their number, since adding to an array copies it.
    """

    def block(state: Column, some: Column) -> Column:
        def one(a: Column, x: Column) -> Column:
            after, more = step(a["state"], x)
            return F.struct(after.alias("state"), F.concat(a["out"], more).alias("out"))

        return F.aggregate(some, F.struct(state.alias("state"), F.array().cast(f"array<{out}>").alias("out")), one)

    def walk(held: Column) -> Column:
        size = F.size(held)
        wide = F.greatest(F.ceil(F.sqrt(size)).cast("int"), F.lit(1))
        starts = F.when(size > 0, F.sequence(F.lit(1), size, wide)).otherwise(F.array().cast("array<int>"))
        done = F.aggregate(
            starts,
            F.struct(zero.alias("state"), F.array().cast(f"array<array<{out}>>").alias("outs")),
            lambda a, k: let(block(a["state"], F.slice(held, k, wide)), lambda r: F.struct(r["state"].alias("state"), F.concat(a["outs"], F.array(r["out"])).alias("outs"))),
        )
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.flatten(d["outs"]).alias("out")))

    return let(items, walk)


def spans_of(text: Column, pattern: str | Column) -> Column:
    """All matches, leftmost and non-overlapping, as array<struct<start, end, value>>."""
    p = pattern if isinstance(pattern, Column) else F.lit(pattern)
    found, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, p, -1)
    sized = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.struct(F.length(g).alias("gap"), F.length(v).alias("size"), v.alias("value")))

    def step(at: Column, x: Column):
        start = at + x["gap"]
        return start + x["size"], F.array(F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["value"].alias("value")))

    return scanned(sized, F.lit(0), "struct<start:int,end:int,value:string>", step)["out"]


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, what its matches must also hold, and what any text with a match holds."""

    name: str
    pattern: str
    holds: object
    guard: object

    def spans(self, text: Column) -> Column:
        return F.when(self.guard(text), F.filter(spans_of(text, self.pattern), lambda s: self.holds(s["value"]))).otherwise(F.array().cast(SPAN))


def all_spans(text: Column, kinds: list[Kind]) -> Column:
    """Spans of all kinds: array<struct<start, kind, end, value>>, kind being the place in `kinds`."""

    def of(i: int, kind: Kind) -> Column:
        return F.transform(kind.spans(text), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    return F.concat(*[of(i, k) for i, k in enumerate(kinds)])


def joined(spans: Column, names: list[str], by_kind: bool) -> Column:
    """kind:start:end of each span, comma-joined, by start and kind, or by kind and start."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(*([s["kind"], s["start"]] if by_kind else [s["start"], s["kind"]]), s["end"].alias("end"))))
    named = F.array(*[F.lit(n) for n in names])
    return F.concat_ws(",", F.transform(keyed, lambda s: F.concat_ws(":", F.get(named, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def counted(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, spans: Column, label) -> Column:
    """The text with each span, from left to right and without those that overlap an earlier one, replaced by label(span).

    It is cut into stretches of about the square root of the spans' number first, since each cut walks from the head.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label"))))

    def keep(at: Column, s: Column):
        return F.when(s["start"] >= at, s["end"]).otherwise(at), F.when(s["start"] >= at, F.array(s)).otherwise(F.array().cast("array<struct<start:int,end:int,label:string>>"))

    def put(stretch: Column, first: Column, some: Column) -> Column:
        """A stretch of the text from `first` on, with the spans in it replaced."""
        ends = F.concat(F.array(first), F.transform(some, lambda s: s["end"]))
        cuts = F.zip_with(F.slice(ends, F.lit(1), F.size(some)), some, lambda e, s: F.concat(F.substring(stretch, e - first + 1, s["start"] - e), s["label"]))
        return F.concat(F.array_join(cuts, ""), F.substring(stretch, F.element_at(ends, -1) - first + 1, F.length(stretch)))

    def walk(kept: Column) -> Column:
        size = F.size(kept)
        wide = F.greatest(F.ceil(F.sqrt(size)).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(1), F.greatest(size, F.lit(1)), wide)
        first = lambda k: F.when(k == 1, F.lit(0)).otherwise(F.get(kept, k - 1)["start"])
        last = lambda k: F.when(k + wide > size, F.length(text)).otherwise(F.get(kept, k + wide - 1)["start"])
        return F.array_join(F.transform(starts, lambda k: put(F.substring(text, first(k) + 1, last(k) - first(k)), first(k), F.slice(kept, k, wide))), "")

    return F.when(F.size(spans) > 0, let(scanned(ordered, F.lit(0), "struct<start:int,end:int,label:string>", keep)["out"], walk)).otherwise(text)


def bracketed(names: list[str]):
    """Labels of spans by their kind: its name in brackets."""
    named = F.array(*[F.lit(f"[{n.upper()}]") for n in names])
    return lambda s: F.get(named, s["kind"])
