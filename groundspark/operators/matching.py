"""Matching of answer entities with context entities: tolerant equality, each used once.

``matches`` extracts and matches in one pass over the texts of a row and gives only what came of
it; the expressions beside it do the same over entities that are there as columns.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from groundspark.functions.entities import Entity, ExtractorConfig, plans_of, surface, value_of
from groundspark.functions.text import in_steps

TYPES = ("MONEY", "NUMBER", "PERCENT", "DATE", "QUANTITY", "PHONE")
NUMERIC = ("MONEY", "NUMBER", "PERCENT")


def equal(a: Column, b: Column) -> Column:
    """Whether two entity structs state the same value.

    Money: within 0.01, currencies equal or one missing. Numbers: within 1 % of the larger.
    Percents: within 0.01 %. Dates, quantities and phones: exactly.
    """
    far = F.abs(a["num"] - b["num"])
    top = F.greatest(F.abs(a["num"]), F.abs(b["num"]))
    money = (far <= 0.01) & (a["currency"].isNull() | b["currency"].isNull() | (a["currency"] == b["currency"]))
    value = (
        F.when(a["type"] == "MONEY", money)
        .when(a["type"] == "NUMBER", far <= F.greatest(F.lit(1e-9), 0.01 * top))
        .when(a["type"] == "PERCENT", far <= F.greatest(F.lit(1e-9), 1e-4 * top))
        .when(a["type"] == "DATE", a["iso"] == b["iso"])
        .when(a["type"] == "QUANTITY", (a["num"] == b["num"]) & (a["unit"] == b["unit"]))
        .otherwise(a["e164"] == b["e164"])
    )
    return F.coalesce((a["type"] == b["type"]) & value, F.lit(False))


def matched(answer: Column, context: Column) -> Column:
    """Array of booleans, one an answer entity: each in turn takes the first unused equal one."""
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<boolean>").alias("hits"))

    def step(acc: Column, e: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size(context) - 1), lambda i: ~F.array_contains(acc["used"], i) & equal(e, F.get(context, i)))
        first = F.when(F.size(context) > 0, F.get(free, F.lit(0)))
        return F.struct(
            F.when(first.isNull(), acc["used"]).otherwise(F.array_append(acc["used"], first)).alias("used"),
            F.array_append(acc["hits"], first.isNotNull()).alias("hits"),
        )

    return F.aggregate(answer, start, step, lambda acc: acc["hits"])


def pairs(answer: Column, context: Column) -> Column:
    """The answer's entities e, each with whether it was found, h. Kinds don't compete, so what
    holds for all kinds holds for some of them alone."""
    return F.zip_with(answer, matched(answer, context), lambda e, h: F.struct(e.alias("e"), h.alias("h")))


def _found(found: Column) -> Column:
    return F.filter(found, lambda p: p["h"])


def _numeric(found: Column) -> Column:
    return F.filter(found, lambda p: p["e"]["type"].isin(*NUMERIC))


def share_found(found: Column) -> Column:
    """Share of ``pairs`` that are found; 1 without any."""
    return F.when(F.size(found) == 0, 1.0).otherwise(F.size(_found(found)) / F.size(found))


def numeric_share(found: Column) -> Column:
    """The same of money, numbers and percents."""
    return share_found(_numeric(found))


def numeric_match(answer: Column, context: Column) -> Column:
    """Share of the answer's money, numbers and percents found in the context; 1 without any."""
    keep = lambda x: x["type"].isin(*NUMERIC)
    return share_found(pairs(F.filter(answer, keep), F.filter(context, keep)))


def coverage_of(found: Column) -> Column:
    """Struct: overall share of entities found (1 without any), counts found and asked by type."""

    def counts(kind: str) -> Column:
        own = F.filter(found, lambda p: p["e"]["type"] == kind)
        return F.struct(F.size(own).alias("asked"), F.size(_found(own)).alias("found")).alias(kind)

    return F.struct(F.round(share_found(found), 4).alias("overall"), F.struct(*map(counts, TYPES)).alias("by_type"))


def coverage(answer: Column, context: Column) -> Column:
    return coverage_of(pairs(answer, context))


def lost(found: Column) -> Column:
    """The entities of ``pairs`` that found no partner, as TYPE:value."""
    return F.transform(F.filter(found, lambda p: ~p["h"]), lambda p: F.concat_ws(":", p["e"]["type"], p["e"]["value"]))


def lost_numbers(found: Column) -> Column:
    return lost(_numeric(found))


def unsupported(answer: Column, context: Column) -> Column:
    """The answer's entities that found no partner, as TYPE:value."""
    return lost(pairs(answer, context))


def alignment(coverage: Column, found: Column) -> tuple[Column, Column]:
    """How the answer's entities stand to the contexts': structs of match and supported, from a
    column of ``coverage_in`` and one of ``matches``.

    match: overall share (1 without entities), unsupported values, and by type whether the
    answer has any, whether all of them were found as 1 or 0, and the same as a state of 1.0
    or 0.0; an answer without entities has empty maps. supported: the found ones with their
    places, their number by type and in all.
    """
    of = lambda t: coverage["by_type"][t]

    def by_type(value, kind: str) -> Column:
        made = F.create_map(*[x for t in TYPES for x in (F.lit(t), value(of(t)).cast(kind))])
        return F.when(_sum(found, "asked") > 0, made).otherwise(F.create_map().cast(f"map<string,{kind}>"))

    any_of = lambda x: (x["asked"] > 0).cast("int")
    all_of = lambda x: ((x["asked"] > 0) & (x["asked"] == x["found"])).cast("int")
    counts = F.map_filter(F.create_map(*[x for t in TYPES for x in (F.lit(t), of(t)["found"])]), lambda k, v: v > 0)
    match = F.struct(coverage["overall"].alias("overall"), found["lost"].alias("unsupported"), by_type(any_of, "int").alias("presence_by_type"), by_type(all_of, "double").alias("state_by_type"), by_type(all_of, "int").alias("all_matched_by_type"))
    return match, F.struct(found["items"].alias("items"), counts.alias("by_type"), _sum(found, "found").alias("count"))


def _near(x: float | None, y: float | None, share: float) -> bool:
    return x is not None and y is not None and abs(x - y) <= max(1e-9, share * max(abs(x), abs(y)))


def _money(a: Entity, x: float | None, b: Entity, y: float | None) -> bool:
    return x is not None and y is not None and abs(x - y) <= 0.01 and (a.currency is None or b.currency is None or a.currency == b.currency)


#: ``equal`` of two entities of a kind with their values.
EQUAL = {
    "MONEY": _money,
    "NUMBER": lambda a, x, b, y: _near(x, y, 0.01),
    "PERCENT": lambda a, x, b, y: _near(x, y, 1e-4),
    "DATE": lambda a, x, b, y: x is not None and x == y,
    "QUANTITY": lambda a, x, b, y: x is not None and x == y and a.unit is not None and a.unit == b.unit,
    "PHONE": lambda a, x, b, y: x is not None and x == y,
}

Valued = list[tuple[Entity, "float | str | None"]]


def hits(answer: Valued, context: Valued) -> list[bool]:
    """``matched`` of entities with their values."""
    free: dict[str, Valued] = {}
    for pair in context:
        free.setdefault(pair[0].type, []).append(pair)
    out = []
    for a, x in answer:
        rivals, same = free.get(a.type, ()), EQUAL[a.type]
        at = next((i for i, (b, y) in enumerate(rivals) if same(a, x, b, y)), None)
        if at is not None:
            del rivals[at]
        out.append(at is not None)
    return out


_ITEM = pa.struct([("type", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_COUNTS = pa.struct([("asked", pa.int32()), ("found", pa.int32())])
MATCHES = f"struct<by_type:struct<{','.join(f'{t}:struct<asked:int,found:int>' for t in TYPES)}>,lost:array<string>,lost_numbers:array<string>,items:array<struct<type:string,text:string,start:int,end:int>>>"


def _matches(answers: list[str | None], contexts: list[list[str | None] | None], config: ExtractorConfig) -> pa.Array:
    entities, place = plans_of(config).entities, {t: i for i, t in enumerate(TYPES)}
    asked, found = [[0] * len(answers) for _ in TYPES], [[0] * len(answers) for _ in TYPES]
    lost, numbers, items, ends = [], [], [], ([0], [0], [0])
    for row, (a, c) in enumerate(zip(answers, contexts)):
        own = entities(a)
        if own:
            for (e, v), hit in zip(own, hits(own, [x for t in c or () for x in entities(t)])):
                k = place[e.type]
                asked[k][row] += 1
                if hit:
                    found[k][row] += 1
                    items.append((e.type, surface(e, a), e.start, e.end))
                else:
                    value = f"{e.type}:{value_of(e.type, v, e.currency, e.unit) or v or surface(e, a)}"
                    lost.append(value)
                    if e.type in NUMERIC:
                        numbers.append(value)
        for end, values in zip(ends, (lost, numbers, items)):
            end.append(len(values))
    array = lambda end, values: pa.ListArray.from_arrays(pa.array(end, pa.int32()), values)
    flat = [pa.array(x, f.type) for x, f in zip(zip(*items) if items else [()] * 4, _ITEM)]
    by = [pa.StructArray.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32())], fields=list(_COUNTS)) for x, y in zip(asked, found)]
    made = [pa.StructArray.from_arrays(by, names=list(TYPES)), array(ends[0], pa.array(lost, pa.string())), array(ends[1], pa.array(numbers, pa.string())), array(ends[2], pa.StructArray.from_arrays(flat, fields=list(_ITEM)))]
    return pa.StructArray.from_arrays(made, names=["by_type", "lost", "lost_numbers", "items"])


def matches(answer: Column, contexts: Column, config: ExtractorConfig = ExtractorConfig()) -> Column:
    """What the entities of a text find in those of an array of texts: counts asked and found by
    type, the lost as TYPE:value, of them the numeric ones, and the found with their places."""

    @F.arrow_udf(MATCHES)
    def run(a: pa.Array, c: pa.Array) -> pa.Array:
        rows = pa.StructArray.from_arrays([a, c], names=["a", "c"])
        return in_steps(rows, lambda part: _matches(part.field("a").to_pylist(), part.field("c").to_pylist(), config))

    return run(answer, contexts)


def _sum(match: Column, of: str, kinds: tuple[str, ...] = TYPES) -> Column:
    out = match["by_type"][kinds[0]][of]
    for t in kinds[1:]:
        out = out + match["by_type"][t][of]
    return out


def share_of(match: Column, kinds: tuple[str, ...] = TYPES) -> Column:
    """Share of ``matches`` of some kinds that are found; 1 without any."""
    asked = _sum(match, "asked", kinds)
    return F.when(asked == 0, 1.0).otherwise(_sum(match, "found", kinds) / asked)


def coverage_in(match: Column) -> Column:
    """``coverage_of`` from a column of ``matches``."""
    return F.struct(F.round(share_of(match), 4).alias("overall"), match["by_type"].alias("by_type"))
