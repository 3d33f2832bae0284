import datetime as dt

import pytest
from pyspark.sql import functions as F

from groundspark.functions.entities import Entity, ExtractorConfig, extract, number_words, relative_weekday, resolve
from groundspark.operators import matching

DAY = ExtractorConfig(reference=dt.date(2024, 5, 15))


@pytest.mark.parametrize(
    "text,num,currency",
    [("$5.2B", 5.2e9, "USD"), ("-$1,200", -1200, "USD"), ("£250", 250, "GBP"), ("EUR 3.5k", 3500, "EUR"), ("(1,250) USD", -1250, "USD"), ("2.5k USD", 2500, "USD"), ("20 dollars", 20, "USD"), ("3 million euros", 3e6, "EUR"), ("twenty bucks", 20, "USD"), ("$2500", 2500, "USD")],
)
def test_money(text, num, currency):
    found = extract(f"it was {text} then")
    assert [(e.type, e.num, e.currency) for e in found] == [("MONEY", num, currency)]


def test_money_compat_and_refusals():
    assert extract("$2500", ExtractorConfig(types=("MONEY",), compat=True))[0].num == 250
    assert not extract("ABC 25 and XYZ 3", ExtractorConfig(types=("MONEY",)))


@pytest.mark.parametrize("text,num", [("12.5%", 12.5), ("(12.5%)", -12.5), ("(12.5)%", -12.5), ("7 %", 7)])
def test_percent(text, num):
    assert [(e.type, e.num) for e in extract(text, ExtractorConfig(types=("PERCENT",)))] == [("PERCENT", num)]


@pytest.mark.parametrize("text,value", [("two hundred and five", 205), ("twenty-one", 21), ("three million four", 3_000_004), ("and", None), ("cat", None), ("hundred", 100)])
def test_number_words(text, value):
    assert number_words(text) == value


@pytest.mark.parametrize("text,num,unit", [("5 km", 5, "km"), ("1,234.5 kg", 1234.5, "kg"), ("3 hours", 3, "h"), ("20°C", 20, "°C"), ("2 fl oz", 2, "fl_oz"), (".75 mi", 0.75, "mi")])
def test_quantity(text, num, unit):
    assert [(e.num, e.unit) for e in extract(text, ExtractorConfig(types=("QUANTITY",)))] == [(num, unit)]


@pytest.mark.parametrize("text,iso", [("on 2021-03-04", "2021-03-04"), ("March 4, 2021", "2021-03-04"), ("4th of Mar 2021", "2021-03-04"), ("Sept 2020", "2020-09-01"), ("04/03/2021", "2021-03-04"), ("in 1999", "1999-01-01"), ("next Friday", "2024-05-17"), ("last Wednesday", "2024-05-08"), ("tomorrow", "2024-05-16"), ("21-13-40 nothing", None)])
def test_date(text, iso):
    found = extract(text, ExtractorConfig(types=("DATE",), reference=DAY.reference))
    assert [e.iso for e in found] == ([iso] if iso else [])


def test_weekdays_are_strict():
    base = dt.date(2024, 5, 15)
    assert relative_weekday(base, 2, True) == dt.date(2024, 5, 22) and relative_weekday(base, 2, False) == dt.date(2024, 5, 8)


def test_spans_and_phone():
    for e in extract("Paid $1,234.50 on 1996-01-02, 5% off, 3 kg."):
        assert "Paid $1,234.50 on 1996-01-02, 5% off, 3 kg."[e.start : e.end].strip() == e.text.strip()
    assert [e.e164 for e in extract("call (415) 555-2671", ExtractorConfig(types=("PHONE",)))] == ["+14155552671"]
    assert extract(None) == extract("  ") == []


def entity(type, num=None, currency=None, unit=None, iso=None):
    return (type, "x", 0, 1, num, currency, unit, iso, None, "t", "v")


@pytest.mark.parametrize(
    "a,b,same",
    [
        (entity("MONEY", 5.0, "USD"), entity("MONEY", 5.009, None), True),
        (entity("MONEY", 5.0, "USD"), entity("MONEY", 5.0, "EUR"), False),
        (entity("NUMBER", 2023.0), entity("NUMBER", 2024.0), True),
        (entity("NUMBER", 100.0), entity("NUMBER", 102.0), False),
        (entity("PERCENT", 12.0), entity("PERCENT", 12.01), False),
        (entity("DATE", iso="2021-01-01"), entity("DATE", iso="2021-01-01"), True),
        (entity("QUANTITY", 5.0, unit="km"), entity("QUANTITY", 5.0, unit="m"), False),
        (entity("NUMBER", 5.0), entity("PERCENT", 5.0), False),
    ],
)
def test_equality(spark, a, b, same):
    from groundspark.functions.entities import SCHEMA

    df = spark.createDataFrame([([a], [b])], f"a {SCHEMA}, b {SCHEMA}")
    assert df.select(matching.equal(F.col("a")[0], F.col("b")[0])).first()[0] is same


def test_greedy_uses_each_once(spark):
    from groundspark.functions.entities import SCHEMA

    a = [entity("NUMBER", 100.0), entity("NUMBER", 100.5), entity("MONEY", 3.0, "USD")]
    c = [entity("NUMBER", 100.2), entity("MONEY", 3.0)]
    df = spark.createDataFrame([(a, c), ([], c), (a, [])], f"a {SCHEMA}, c {SCHEMA}")
    got = [tuple(r) for r in df.select(matching.matched(F.col("a"), F.col("c")), matching.numeric_match(F.col("a"), F.col("c")), matching.coverage(F.col("a"), F.col("c"))["overall"]).collect()]
    assert got[0][0] == [True, False, True] and abs(got[0][1] - 2 / 3) < 1e-9 and got[0][2] == 0.6667
    assert got[1] == ([], 1.0, 1.0) and got[2] == ([False] * 3, 0.0, 0.0)


ALL = ExtractorConfig(types=("MONEY", "NUMBER", "PERCENT", "DATE", "QUANTITY", "PHONE"), reference=DAY.reference)


@pytest.mark.parametrize(
    "text,want",
    [
        ("raised $3m from 12 funds", [("MONEY", 3e6), ("NUMBER", 12.0)]),
        ("about 40 km in 2 hours", [("QUANTITY", 40.0), ("QUANTITY", 2.0)]),
        ("up 7% on 2021-03-04", [("PERCENT", 7.0), ("DATE", None)]),
        ("forty-two ships", [("NUMBER", 42.0)]),
        ("2.5k people and 3m coins", [("NUMBER", 2500.0), ("QUANTITY", 3.0)]),
        ("nothing to see", []),
    ],
)
def test_kinds_together(text, want):
    assert [(e.type, e.num) for e in extract(text, ALL)] == want


def test_scores_and_overlaps():
    made = lambda kind, text, start, **more: Entity(kind, text, start, start + len(text), **more)
    assert made("DATE", "4 May 2020", 0, iso="2020-05-04").score == pytest.approx(1.15)
    assert made("MONEY", "$5k", 0, currency="USD").score == pytest.approx(1.10) and made("MONEY", "$5 k", 0, currency="USD").score == pytest.approx(1.0)
    assert made("NUMBER", "5", 0, source="model").score == pytest.approx(0.60)
    # the tail of number words stands beside the whole, but what comes next still decides
    words, tail = made("NUMBER", "two hundred five", 0, source="number-words"), made("NUMBER", "five", 12, source="number-words-tail")
    assert resolve([words, tail]) == [words, tail]
    money = made("MONEY", "hundred five dollars", 4, currency="USD", source="money-words")
    assert resolve([words, tail, money])[0] == money
    model = made("NUMBER", "205", 0, num=205.0, source="model")
    number = made("NUMBER", "205", 0, num=205.0, source="number")
    assert resolve([model, number]) == [number]


def _tagger():
    def spans(text):
        at = text.find("July 2024")
        return [("DATE", at, at + 9)] * (at >= 0) + [("PERSON", 0, 1), ("MONEY", 0, 2)]

    return spans


def test_a_model_may_add_candidates():
    config = ExtractorConfig(types=("DATE", "MONEY"), model=_tagger)
    found = extract("on the 24th of July 2024", config)
    assert [(e.iso, e.text) for e in found] == [("2024-07-24", "24th of July 2024")]
    assert extract("ab", config) == []


def test_values_as_text():
    values = [e.value for e in extract("$1,200.50, 7%, 5 km, 2021-03-04, 12 and 415-555-2671", ALL)]
    assert values == ["1200.5:USD", "7.0%", "5.0km", "2021-03-04", "12.0", "+14155552671"]
    assert [e.value for e in extract("1,250", ExtractorConfig(types=("NUMBER",), whole=True))][0] == "1250.0"


def test_columns_of_entities(spark):
    from groundspark.functions.entities import canonical_date, entities_of, entities_of_all

    df = spark.createDataFrame([(1, "pay $5", ["$5", None, "3 kg then"]), (2, None, []), (3, "", None)], "id long, a string, c array<string>")
    rows = df.select("id", entities_of(F.col("a")).alias("a"), entities_of_all(F.col("c")).alias("c")).orderBy("id").collect()
    assert [len(r.a) for r in rows] == [1, 0, 0] and [[(e.type, e.start) for e in r.c] for r in rows] == [[("MONEY", 0), ("QUANTITY", 0)], [], []]
    assert df.select(canonical_date(F.lit("2020-01-02T10:00"))).first()[0] == "2020-01-02"


PIECES = ("$0 000.00", "-€00.0k", "000 USD", "0 dollars", "twenty bucks", "(00.0%)", "0 %", "0", "0000", "0,000", "0 km", "00.5 kg.", "0 m2", "0000-00-00T00:00", "0000-00-00", "May 00, 0000", "00/00/0000", "Sept 0000", "two hundred and five", "٣ x", "next friday", "the", ".")


def test_texts_of_one_shape_share_a_plan():
    import random

    from groundspark.functions.entities import planned

    rng = random.Random(4)
    for _ in range(150):
        shape = ", ".join(rng.choice(PIECES) for _ in range(rng.randint(1, 4)))
        for config in (ExtractorConfig(), ALL, ExtractorConfig(types=("DATE", "NUMBER")), ExtractorConfig(compat=True, whole=True)):
            for pool in ("0123456789", "0129"):
                text = "".join(rng.choice(pool) if x == "0" else x for x in shape)
                assert [(repr(e), e.value) for e in planned(text, config)] == [(repr(e), e.value) for e in extract(text, config)], text


def test_a_shape_is_read_once(monkeypatch):
    from groundspark.functions import entities

    calls = []
    monkeypatch.setattr(entities, "extract", lambda text, config: calls.append(text) or extract(text, config))
    entities.plans_of.cache_clear()
    texts = [f"Order {100 + k} cost ${k % 9 + 1},{k % 1000:03d}.50 on 1995-03-{k % 28 + 1:02d}, {k % 10}% off, 7 kg." for k in range(400)]
    found = [entities.planned(t, ExtractorConfig()) for t in texts]
    assert len(calls) == 1 and [e.num for e in found[123]][:2] == [223.0, 7123.5] and found[27][2].iso == "1995-03-28"
    # a day that does not exist and a year that is none are other plans
    assert [e.type for e in entities.planned(texts[0].replace("03-01", "13-01"), ExtractorConfig())] != [e.type for e in found[0]]
    for k in range(entities.PLANS + 50):
        entities.planned("x" * (k % 500 + 1) + str(k), ExtractorConfig())
    assert len(entities.plans_of(ExtractorConfig()).known) <= entities.PLANS


def test_matches_in_one_pass(spark):
    from groundspark.functions.entities import entities_of, entities_of_all

    rows = [(1, "It cost $20, then $30, 5% and 100 or 100.5 on 2020-01-02, 3 kg.", ["It was $20.005 and 5%.", None, "100.2 then, 3 kg, 2020-01-03"]), (2, None, ["$5"]), (3, "$5", None), (4, "no figure", []), (5, "$5 and $5", ["$5"])]
    df = spark.createDataFrame(rows, "id long, a string, c array<string>")
    df = df.withColumns({"ea": entities_of(F.col("a")), "ec": entities_of_all(F.col("c")), "m": matching.matches(F.col("a"), F.col("c"))})
    df = df.withColumn("p", matching.pairs(F.col("ea"), F.col("ec")))
    got = df.select("m", matching.coverage_in(F.col("m")).alias("cov"), matching.coverage_of(F.col("p")).alias("cov2"), matching.lost(F.col("p")).alias("lost"), matching.lost_numbers(F.col("p")).alias("numbers"), matching.share_of(F.col("m"), matching.NUMERIC).alias("share"), matching.numeric_share(F.col("p")).alias("share2"), F.transform(F.filter("p", lambda p: p["h"]), lambda p: F.struct(*[p["e"][f].alias(f) for f in ("type", "text", "start", "end")])).alias("items")).collect()
    for r in got:
        assert r.cov == r.cov2 and r.m.lost == r.lost and r.m.lost_numbers == r.numbers and r.share == r.share2 and [tuple(x) for x in r.m["items"]] == [tuple(x) for x in r["items"]]
    assert got[0].m.lost == ["MONEY:30.0:USD", "NUMBER:100.5", "DATE:2020-01-02"] and got[4].cov.overall == 0.5
