"""Typed entities of a text: money, numbers, percents, dates, quantities and phone numbers.

Each kind has its patterns and a reader that turns a match into a value or refuses it. All
candidates of a text compete for their spans; one Arrow UDF a batch of texts does the whole
work. A reader starts only where the text holds a sign or word that its patterns need. Texts that
differ in digits alone share a plan (``Plans``): where entities stand and how to read their values.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.functions.text import in_steps

SCHEMA = "array<struct<type:string,text:string,start:int,end:int,num:double,currency:string,unit:string,iso:string,e164:string,source:string,value:string>>"

# Symbols, codes and names of currencies.
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
CODES = frozenset("USD EUR GBP JPY CAD AUD CHF CNY HKD SGD INR NZD SEK NOK DKK RUB BRL MXN ZAR KRW TWD AED SAR TRY PLN IDR THB MYR PHP ILS".split())
#: How currencies are called.
CURRENCY_NAMES = {
    "USD": ("dollar", "dollars", "buck", "bucks", "usd"),
    "EUR": ("euro", "euros", "eur"),
    "GBP": ("pound", "pounds", "quid", "quids", "gbp"),
    "JPY": ("yen", "jpy"),
    "CNY": ("yuan", "renminbi", "cny"),
    "INR": ("rupee", "rupees", "inr"),
    "KRW": ("won", "krw"),
    "CHF": ("franc", "francs", "chf"),
    "MXN": ("peso", "pesos", "mxn"),
    "BRL": ("real", "reais", "brl"),
    "CAD": ("canadian dollar", "canadian dollars", "cad"),
    "AUD": ("australian dollar", "australian dollars", "aud"),
}
MAGNITUDES = {"k": 1e3, "m": 1e6, "b": 1e9, "thousand": 1e3, "million": 1e6, "billion": 1e9}
#: Units and what they are written as.
UNITS = {
    "m": ("m", "meter", "meters", "metre", "metres"),
    "km": ("km", "kilometer", "kilometers", "kilometre", "kilometres"),
    "cm": ("cm", "centimeter", "centimeters"),
    "mm": ("mm", "millimeter", "millimeters"),
    "mi": ("mi", "mile", "miles"),
    "yd": ("yd", "yard", "yards"),
    "ft": ("ft", "foot", "feet"),
    "in": ("in", "inch", "inches"),
    "kg": ("kg", "kilogram", "kilograms"),
    "g": ("g", "gram", "grams"),
    "mg": ("mg", "milligram", "milligrams"),
    "lb": ("lb", "lbs", "pound", "pounds"),
    "oz": ("oz", "ounce", "ounces"),
    "s": ("s", "sec", "secs", "second", "seconds"),
    "ms": ("ms", "millisecond", "milliseconds"),
    "min": ("min", "mins", "minute", "minutes"),
    "h": ("h", "hr", "hrs", "hour", "hours"),
    "d": ("day", "days", "d"),
    "wk": ("week", "weeks", "wk"),
    "mo": ("month", "months", "mo"),
    "yr": ("year", "years", "yr", "yrs"),
    "L": ("l", "liter", "liters", "litre", "litres"),
    "mL": ("ml", "milliliter", "milliliters", "millilitre", "millilitres"),
    "gal": ("gal", "gallon", "gallons"),
    "fl_oz": ("floz", "fl oz", "fluid ounce", "fluid ounces"),
    "m^2": ("m2", "sqm", "square meter", "square meters"),
    "ft^2": ("ft2", "sqft", "square foot", "square feet"),
    "km^2": ("km2", "square kilometer", "square kilometers"),
    "mi^2": ("mi2", "square mile", "square miles"),
    "°C": ("°c", "celsius"),
    "°F": ("°f", "fahrenheit"),
    "µm": ("µm", "μm"),
    "KB": ("kb", "kilobyte", "kilobytes"),
    "MB": ("mb", "megabyte", "megabytes"),
    "GB": ("gb", "gigabyte", "gigabytes"),
    "TB": ("tb", "terabyte", "terabytes"),
    "mAh": ("mah",),
    "Wh": ("wh",),
    "kWh": ("kwh",),
}
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()

#: Who keeps a contested span: the higher; on a tie the better score.
RANK = {"MONEY": 3, "DATE": 2, "QUANTITY": 1, "PHONE": 1, "PERCENT": 0, "NUMBER": 0}
#: Strict order of the second pass, which lets no lower kind overlap a higher one.
ORDER = ("MONEY", "DATE", "QUANTITY", "PHONE", "PERCENT", "NUMBER")

_aliases = lambda table: {a: k for k, names in table.items() for a in names}
_CURRENCY, _UNIT = _aliases(CURRENCY_NAMES), _aliases(UNITS)
_any = lambda names: "(?:" + "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n))) + ")"
_NUMBER_WORDS = {w: i for i, w in enumerate(SMALL)} | {w: 20 + 10 * i for i, w in enumerate(TENS)}
_WORDS = _any([*_NUMBER_WORDS, "hundred", "thousand", "million", "billion", "and"])
_GROUPED = r"\d{1,3}(?:[, ]\d{3})+(?:\.\d+)?(?!\d)|\d+(?:\.\d+)?"
#: Without the guard against a fourth digit an amount after a symbol stops at three.
_GROUPED_COMPAT = r"\d{1,3}(?:[, ]\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?"


#: What a candidate scores for being there, by kind, for a long surface, and at most.
SURE, SURE_MODEL, SURE_LONG, SURE_MOST = 0.60, 0.50, 0.05, 1.5
SURE_KIND = {"NUMBER": 0.10, "PHONE": 0.20, "PERCENT": 0.10, "QUANTITY": 0.10}
#: What the signs of its surface and value add, by kind.
SURE_SIGNS: dict[str, tuple[tuple[float, Callable], ...]] = {
    "MONEY": ((0.25, lambda e: any(s in e.text for s in SYMBOLS)), (0.15, lambda e: e.currency), (0.10, lambda e: re.search(r"\d[kmb]\b", e.text, re.I))),
    "PERCENT": ((0.25, lambda e: "%" in e.text),),
    "QUANTITY": ((0.30, lambda e: e.unit),),
    "DATE": ((0.25, lambda e: e.iso), (0.10, lambda e: _MONTH_START.search(e.text)), (0.15, lambda e: re.search(r"\b\d{4}\b", e.text))),
}
_MONTH_START = re.compile(rf"\b(?:{'|'.join(n[:3] for n in MONTHS)}|\d{{1,2}}/\d{{1,2}})", re.I)


@dataclass(frozen=True)
class ExtractorConfig:
    """Which kinds to extract, and the day that relative dates count from (null: none are read)."""

    types: tuple[str, ...] = ("MONEY", "NUMBER", "PERCENT", "DATE", "QUANTITY")
    reference: dt.date | None = None
    #: Read $2500 as 250, as patterns without a right guard do.
    compat: bool = False
    #: Apply the strict second pass.
    suppress: bool = True
    #: Read a text that is one number as a whole.
    whole: bool = False
    #: Gives, once a worker, a function text -> (label, start, end) of a model's spans; null: none.
    model: Callable[[], Callable] | None = None


@dataclass
class Entity:
    type: str
    text: str
    start: int
    end: int
    num: float | None = None
    currency: str | None = None
    unit: str | None = None
    iso: str | None = None
    e164: str | None = None
    source: str = ""
    #: Reads num or iso of a text that differs in digits alone; null: the value has no digits.
    read: Callable[[str], float | str] | None = field(default=None, compare=False, repr=False)

    @property
    def score(self) -> float:
        """How sure a candidate is by its surface."""
        sure = SURE_MODEL if self.source == "model" else SURE
        sure += SURE_KIND.get(self.type, 0.0) + sum(w for w, sign in SURE_SIGNS.get(self.type, ()) if sign(self))
        return min(SURE_MOST, sure + SURE_LONG * (len(self.text) >= 6))

    @property
    def value(self) -> str:
        """The value as text: amount and currency, number, share, day, quantity or phone number."""
        return value_of(self.type, self.num, self.currency, self.unit) or self.iso or self.e164 or self.text


def value_of(kind: str, num: float | None, currency: str | None, unit: str | None) -> str | None:
    if kind == "MONEY":
        return f"{num}:{currency or ''}"
    if kind == "NUMBER":
        return f"{num}"
    return f"{num}%" if kind == "PERCENT" else f"{num}{unit}" if kind == "QUANTITY" else None


def amount(text: str) -> float | None:
    """A written amount: grouping, sign, parentheses for negative, k, m or b."""
    t = text.strip()
    negative = t.startswith("-") or ("(" in t and ")" in t)
    t = t.strip("+-() ").replace(",", "").replace(" ", "")
    factor = MAGNITUDES.get(t[-1:].lower(), 1.0) if t[-1:].isalpha() else 1.0
    try:
        value = float(t[:-1] if t[-1:].isalpha() else t) * factor
    except ValueError:
        return None
    return -value if negative else value


_DIGITS_ONLY = re.compile(r"[0-9,]*\.?[0-9]*")


def amount_at(text: str, at: tuple[int, int], mark: tuple[int, int] = (0, 0), factor: float = 1.0) -> Callable[[str], float]:
    """A function that reads the amount at a place, with its magnitude at another, times a factor."""
    (s, e), (s2, e2) = at, mark
    if e2 <= s2 and _DIGITS_ONLY.fullmatch(text, s, e):
        return lambda t: float(t[s:e].replace(",", "")) * factor
    return lambda t: amount(t[s:e] + t[max(s2, 0) : max(e2, 0)].strip()) * factor


def number_words(text: str) -> float | None:
    """Value of English number words; None for a word that is none or for no number at all."""
    total = group = 0
    seen = False
    for w in re.split(r"[\s-]+", text.strip().lower()):
        if w == "and":
            continue
        if w in _NUMBER_WORDS:
            group += _NUMBER_WORDS[w]
        elif w == "hundred":
            group = max(1, group) * 100
        elif w in MAGNITUDES and len(w) > 1:
            total += max(1, group) * int(MAGNITUDES[w])
            group = 0
        else:
            return None
        seen = True
    return float(total + group) if seen else None


def _money_patterns(body: str) -> tuple[tuple[str, re.Pattern], ...]:
    value = rf"(?P<amt>[-+]?\(?(?:{body})\)?)(?P<mag>\s?[kKmMbB]\b)?"
    sym = _any(SYMBOLS)
    return (
        ("signed-symbol", re.compile(rf"(?P<sign>[-+])\s*(?P<cur>{sym})\s*{value}")),
        ("symbol", re.compile(rf"(?P<cur>{sym})\s*{value}")),
        ("code-amount", re.compile(rf"\b(?P<cur>[A-Z]{{3}})\s+{value}")),
        ("amount-code", re.compile(rf"(?<![\w.]){value}\s+(?P<cur>[A-Z]{{3}})\b")),
    )


_MONEY = {compat: _money_patterns(_GROUPED_COMPAT if compat else _GROUPED) for compat in (False, True)}
_NUMBER_RUN = re.compile(rf"\b{_WORDS}(?:[-\s]+{_WORDS})*\b", re.I)
_SPOKEN_MONEY = (
    re.compile(rf"\b(?P<amt>(?:{_GROUPED})|{_WORDS}(?:[-\s]+{_WORDS})*)(?:\s+(?P<mag>thousand|million|billion))?\s+(?P<cur>{_any(_CURRENCY)})\b", re.I),
    re.compile(rf"\b(?P<cur>{_any(_CURRENCY)})\s+(?P<amt>{_GROUPED})(?:\s+(?P<mag>thousand|million|billion))?\b", re.I),
)
#: What may stand after a percent sign, and a plain number with its magnitude.
_AFTER_PERCENT = r"(?=\s|[.,;:!?)]|$)"
_PERCENT = re.compile(rf"(?<!\S)(?P<open>\(?)\s*(?P<share>[-+]?\d+(?:\.\d+)?)(?P<inner>\)?)\s*%(?P<outer>\)?){_AFTER_PERCENT}")
_PLAIN = re.compile(r"\b[-+]?\d+(?:\.\d+)?\s*[kmb]?\b", re.I)
_QUANTITY = re.compile(rf"(?P<v>[-+]?(?:\d+(?:[, ]\d{{3}})*(?:\.\d+)?|\.\d+))\s*(?=[a-zµμ°])(?P<u>{_any(_UNIT)})\.?(?![A-Za-z-])", re.I)


class Signs:
    """What a text holds at all, looked up once for all readers."""

    def __init__(self, text: str):
        self.digit = re.search(r"\d", text) is not None
        self.words = frozenset(re.findall(r"[^\W\d_]+", text.lower()))
        self.symbol = any(s in text for s in SYMBOLS)


_LAST = lambda names: frozenset(n.split()[-1] for n in names)
_CURRENCY_WORDS, _COUNT_WORDS = _LAST(_CURRENCY), frozenset([*_NUMBER_WORDS, "hundred", "thousand", "million", "billion", "and"])


def _money(text: str, config: ExtractorConfig, signs: Signs) -> Iterator[Entity]:
    for source, pattern in _MONEY[config.compat] if signs.digit else ():
        if not (signs.symbol if "symbol" in source else re.search("[A-Z]{3}", text)):
            continue
        for m in pattern.finditer(text):
            currency = SYMBOLS.get(m["cur"]) or (m["cur"] if m["cur"] in CODES else None)
            num = amount(m["amt"] + (m["mag"] or "").strip())
            if currency and num is not None:
                sign = -1.0 if m.groupdict().get("sign") == "-" else 1.0
                yield Entity("MONEY", m[0], m.start(), m.end(), num * sign, currency, source=source, read=amount_at(text, m.span("amt"), m.span("mag"), sign))
    for pattern in _SPOKEN_MONEY if signs.words & _CURRENCY_WORDS else ():
        for m in pattern.finditer(text):
            written = m["amt"][0].isdigit()
            num = amount(m["amt"]) if written else number_words(m["amt"])
            if num is not None:
                factor = MAGNITUDES.get((m["mag"] or "").lower(), 1.0)
                yield Entity("MONEY", m[0], m.start(), m.end(), num * factor, _CURRENCY[re.sub(r"\s+", " ", m["cur"].lower())], source="money-words", read=amount_at(text, m.span("amt"), factor=factor) if written else None)


def _percent(text: str, config: ExtractorConfig, signs: Signs) -> Iterator[Entity]:
    if "%" not in text or not signs.digit:
        return
    for m in _PERCENT.finditer(text):
        opened, closed = m["open"] != "", m["inner"] != "" or m["outer"] != ""
        if opened != closed and not (not opened and m["outer"] and not m["inner"]):
            continue
        # a bracket that closes what stands before is not the percent's own
        end = m.end() - (not opened and m["outer"] != "")
        s, e = m.span("share")
        read = (lambda t, s=s, e=e: -abs(float(t[s:e]))) if opened else (lambda t, s=s, e=e: float(t[s:e]))
        yield Entity("PERCENT", text[m.start() : end], m.start(), end, read(text), source="percent", read=read)


def _number(text: str, config: ExtractorConfig, signs: Signs) -> Iterator[Entity]:
    if config.whole and re.fullmatch(r"\s*\d[\d,]*\s*", text):
        yield Entity("NUMBER", text, 0, len(text), float(text.replace(",", "")), source="number-parser", read=lambda t: float(t.replace(",", "")))
    for m in _PLAIN.finditer(text) if signs.digit else ():
        if (num := amount(m[0])) is not None:
            yield Entity("NUMBER", m[0], m.start(), m.end(), num, source="number", read=amount_at(text, m.span()))
    for m in _NUMBER_RUN.finditer(text) if signs.words & _COUNT_WORDS else ():
        if (num := number_words(m[0])) is None:
            continue
        yield Entity("NUMBER", m[0], m.start(), m.end(), num, source="number-words")
        if m[0] == text.strip():  # the run is the whole text: a tighter tail may be meant
            pieces = list(re.finditer(r"[^\s-]+", m[0]))
            for k in (3, 2, 1):
                if k < len(pieces) and (tail := number_words(m[0][pieces[-k].start() :])) is not None:
                    at = m.start() + pieces[-k].start()
                    yield Entity("NUMBER", text[at : m.end()], at, m.end(), tail, source="number-words-tail")
                    break


def _quantity(text: str, config: ExtractorConfig, signs: Signs) -> Iterator[Entity]:
    for m in _QUANTITY.finditer(text) if signs.digit else ():
        unit = _UNIT.get(m["u"].lower())
        if unit:
            read = lambda t, s=m.start("v"), e=m.end("v"): float(t[s:e].replace(",", "").replace(" ", ""))
            yield Entity("QUANTITY", m[0].strip(), m.start(), m.end(), read(text), unit=unit, source="quantity", read=read)


def relative_weekday(base: dt.date, weekday: int, forward: bool) -> dt.date:
    """The next or last such weekday; never the base day itself."""
    if forward:
        return base + dt.timedelta(days=(weekday - base.weekday() - 1) % 7 + 1)
    return base - dt.timedelta(days=(base.weekday() - weekday - 1) % 7 + 1)


_MONTH = r"(?P<mo>" + "|".join(rf"{n[:3]}(?:{n[3:]})?" if n != "september" else "sept?(?:ember)?" for n in MONTHS) + r")\.?"
_DATES = tuple(
    (source, re.compile(pattern, re.I))
    for source, pattern in (
        ("month-day-year", rf"\b{_MONTH}\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})\b"),
        ("day-month-year", rf"\b(?P<d>\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?{_MONTH},?\s+(?P<y>\d{{4}})\b"),
        ("slashes", r"\b(?P<d>\d{1,2})[/.](?P<n>\d{1,2})[/.](?P<y>\d{4})\b"),
        ("month-year", rf"\b{_MONTH}\s+(?P<y>\d{{4}})\b"),
        ("year", r"\b(?P<y>(?:19|20)\d{2})\b"),
    )
)


def _month(m: re.Match) -> int:
    return next(i for i, n in enumerate(MONTHS, 1) if n.startswith(m["mo"].lower()[:3]))


_DAY_WORDS = frozenset(["today", "tomorrow", "yesterday", *WEEKDAYS])


_ISO = re.compile(r"\b(\d{4})-(\d\d)-(\d\d)(T\d\d:\d\d(?::\d\d)?)?\b")


@lru_cache(maxsize=1 << 14)
def _iso(y, mo=1, d=1) -> str | None:
    try:
        return dt.date(int(y), int(mo), int(d)).isoformat()
    except ValueError:
        return None


def _day(m: re.Match) -> tuple:
    """Where the year of a match of ``_DATES`` stands, its month (a place, or a number that its
    name gives) and the place of its day (null: the first)."""
    g = m.groupdict()
    return m.span("y"), m.span("n") if g.get("n") else _month(m) if g.get("mo") else 1, m.span("d") if g.get("d") else None


def _day_at(text: str, year: tuple[int, int], month, day) -> str | None:
    return _iso(text[slice(*year)], text[slice(*month)] if isinstance(month, tuple) else month, text[slice(*day)] if day else 1)


def _date(text: str, config: ExtractorConfig, signs: Signs) -> Iterator[Entity]:
    if not (signs.digit or signs.words & _DAY_WORDS):
        return

    def made(m, value, source, read=None):
        return Entity("DATE", m[0], m.start(), m.end(), iso=value, source=source, read=read)

    found = []
    for m in _ISO.finditer(text):
        if value := _iso(m[1], m[2], m[3]):
            # of plain digits, the text is the value
            read = (lambda t, s=m.start(), e=m.end(): t[s:e]) if m[0].isascii() else None
            found.append(made(m, value + (m[4] or ""), "iso", read))
    if found:  # plain ISO dates speak for the whole text
        yield from found
        return
    if config.reference is not None:
        base = config.reference
        if m := re.search(rf"\b(?:(today|tomorrow|yesterday)|(next|last)\s+({'|'.join(WEEKDAYS)}))\b", text, re.I):
            day = base + dt.timedelta(days={"today": 0, "tomorrow": 1, "yesterday": -1}[m[1].lower()]) if m[1] else relative_weekday(base, WEEKDAYS.index(m[3].lower()), m[2].lower() == "next")
            yield made(m, day.isoformat(), "relative")
            return
    taken: list[tuple[int, int]] = []
    for source, pattern in _DATES:
        for m in pattern.finditer(text):
            if any(m.start() < e and s < m.end() for s, e in taken):
                continue
            day = _day(m)
            if value := _day_at(text, *day):
                taken.append(m.span())
                yield made(m, value, source, lambda t, day=day: _day_at(t, *day))


def _phone(text: str, config: ExtractorConfig, signs: Signs) -> Iterator[Entity]:
    for m in () if not signs.digit else re.finditer(r"(?<![\w+])(?:\+?(?P<c>\d{1,3})[\s.-]?)?\(?(?P<a>[2-9]\d{2})\)?[\s.-]?(?P<x>[2-9]\d{2})[\s.-]?(?P<l>\d{4})(?!\w)", text):
        yield Entity("PHONE", m[0], m.start(), m.end(), e164=f"+{m['c'] or '1'}{m['a']}{m['x']}{m['l']}", source="phone")


READERS = {"MONEY": _money, "DATE": _date, "QUANTITY": _quantity, "PHONE": _phone, "PERCENT": _percent, "NUMBER": _number}


def _model_spans(text: str, config: ExtractorConfig) -> Iterator[Entity]:
    """Candidates from a model's labelled spans, each read again by the readers above."""
    kinds = {"MONEY": "MONEY", "PERCENT": "PERCENT", "DATE": "DATE", "QUANTITY": "QUANTITY", "CARDINAL": "NUMBER", "ORDINAL": "NUMBER"}
    for label, start, end in _loaded(config.model)(text):
        kind = kinds.get(label.upper())
        if kind not in config.types:
            continue
        if kind == "DATE" and re.fullmatch(r"[A-Za-z]+\s+\d{4}", text[start:end]):
            # a month and year may have lost the day to their left
            if m := re.search(r"\d{1,2}(?:st|nd|rd|th)?\s+(?:of\s+)?$", text[max(0, start - 12) : start], re.I):
                start -= len(m[0])
        part = text[start:end]
        found = next(READERS[kind](part, config, Signs(part)), None)
        if found:
            yield Entity(kind, found.text if kind == "PERCENT" else part, start, end, found.num, found.currency, found.unit, found.iso, found.e164, "model")


@lru_cache(maxsize=4)
def _loaded(load: Callable) -> Callable:
    return load()


def resolve(candidates: list[Entity]) -> list[Entity]:
    """Greedy by start. A newcomer is held against the kept ones that it overlaps, in turn: of
    higher rank, or of equal rank and better score, it takes that one's place; otherwise it
    goes. Number words and their tail stand beside each other, so the next one decides. On
    equal scores a reader's candidate beats a model's."""
    kept: list[tuple] = []
    scored = [(RANK[e.type], round(e.score, 9), e.source != "model", e) for e in candidates]
    scored.sort(key=lambda x: (x[3].start, -x[0], -x[1], not x[2], x[3].start - x[3].end))
    for own in scored:
        c = own[3]
        rivals = (i for i, (*_, k) in enumerate(kept) if c.start < k.end and k.start < c.end and {k.source, c.source} != {"number-words", "number-words-tail"})
        at = next(rivals, None)
        if at is None:
            kept.append(own)
        elif own[:3] > kept[at][:3]:
            kept[at] = own
    return [own[3] for own in kept]


def suppressed(entities: list[Entity]) -> list[Entity]:
    """No entity that overlaps one of a kind earlier in ORDER, in the order of the text."""
    if len(entities) < 2:
        return entities
    kept: list[Entity] = []
    for e in sorted(entities, key=lambda e: (ORDER.index(e.type), e.start)):
        if not any(ORDER.index(k.type) < ORDER.index(e.type) and e.start < k.end and k.start < e.end for k in kept):
            kept.append(e)
    return sorted(kept, key=lambda e: (e.start, e.end))


def extract(text: str | None, config: ExtractorConfig = ExtractorConfig()) -> list[Entity]:
    """Entities of one text; none for a null or blank one."""
    if not text or not text.strip():
        return []
    signs = Signs(text)
    found = [e for t, read in READERS.items() if t in config.types for e in read(text, config, signs)]
    outer = [(e.start, e.end) for e in found if e.type in ("MONEY", "DATE", "QUANTITY", "PHONE")]
    found = [e for e in found if e.type not in ("NUMBER", "PERCENT") or not any(s <= e.start and e.end <= t for s, t in outer)]
    if config.model is not None:
        found += _model_spans(text, config)
    found = resolve(found) if len(found) > 1 else found
    return suppressed(found) if config.suppress else sorted(found, key=lambda e: (e.start, e.end))


#: Plans that a worker remembers, and the longest text that gets one.
PLANS, PLANNED = 4096, 512
_SAME_DIGIT = str.maketrans("123456789", "0" * 9)
_YEAR_LIKE = re.compile(r"\b\d{4}\b")
#: A digit behind a letter may be a unit's own (m2), and one that is not ASCII has its own value.
_UNPLANNED = re.compile(r"[^\W\d_]\d|(?![0-9])\d")


class Plans:
    """What texts with the same characters but for their digits have in common.

    Patterns ask for digits, not for which ones, and so do scores. Which digits they are decides
    only whether a day exists and whether four of them are a year; those questions are kept with
    the shape of the text, and each set of answers has its own plan. Kinds that ask more (phone
    numbers, models) and units that are written with a digit go without a plan.
    """

    def __init__(self, config: ExtractorConfig):
        self.config, self.known = config, {}
        self.usable = config.model is None and "PHONE" not in config.types
        self.dates = "DATE" in config.types

    def entities(self, text: str | None) -> list[tuple[Entity, float | str | None]]:
        """Entities of a text, each with its num, iso or phone number. The entity may come from
        another text of this shape: its text, num and iso are to be read by ``read``."""
        if not text:
            return []
        if not self.usable or len(text) > PLANNED:
            return [(e, e.num if e.num is not None else e.iso or e.e164) for e in extract(text, self.config)]
        shape = text.translate(_SAME_DIGIT)
        if (own := self.known.get(shape)) is None:
            if len(self.known) >= PLANS:
                self.known.clear()
            own = self.known[shape] = (self.questions(shape), {})
        asked, plans = own
        if asked is None:
            return [(e, e.num if e.num is not None else e.iso) for e in extract(text, self.config)]
        answers = tuple([ask(text) for ask in asked])
        if (plan := plans.get(answers)) is None:
            plan = plans[answers] = [(e, e.read, e.num if e.num is not None else e.iso) for e in extract(text, self.config)]
        return [(e, value if read is None else read(text)) for e, read, value in plan]

    def questions(self, shape: str) -> list[Callable[[str], bool]] | None:
        """What decides between texts of a shape: functions of a text; null: too much does."""
        if _UNPLANNED.search(shape):
            return None
        if not self.dates:
            return []
        days = [(m.span(1), m.span(2), m.span(3)) for m in _ISO.finditer(shape)] + [_day(m) for source, p in _DATES if source != "year" for m in p.finditer(shape)]
        years = [m.start() for m in _YEAR_LIKE.finditer(shape)]
        return [lambda t, day=day: _day_at(t, *day) is not None for day in days] + [lambda t, s=s: t.startswith(("19", "20"), s) for s in years]


@lru_cache(maxsize=4)
def plans_of(config: ExtractorConfig) -> Plans:
    return Plans(config)


def surface(e: Entity, text: str) -> str:
    """The text of an entity, whichever text of this shape it came from."""
    if e.read is None:
        return e.text
    own = text[e.start : e.end]
    return own.strip() if e.type == "QUANTITY" else own


def planned(text: str | None, config: ExtractorConfig, only: str | None = None) -> list[Entity]:
    """``extract`` by plans; of one kind only, if named."""
    made = []
    for e, value in plans_of(config).entities(text):
        if only is None or e.type == only:
            dated = e.type == "DATE"
            made.append(Entity(e.type, surface(e, text), e.start, e.end, e.num if dated or e.read is None else value, e.currency, e.unit, value if dated else e.iso, e.e164, e.source))
    return made


_FIELDS = [("type", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("num", pa.float64()), ("currency", pa.string()), ("unit", pa.string()), ("iso", pa.string()), ("e164", pa.string()), ("source", pa.string()), ("value", pa.string())]


def _lists(found: list[list[Entity]]) -> pa.Array:
    flat = [e for own in found for e in own]
    columns = [pa.array([getattr(e, name) for e in flat], kind) for name, kind in _FIELDS]
    offsets = [0]
    for own in found:
        offsets.append(offsets[-1] + len(own))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=[pa.field(*f) for f in _FIELDS]))


def entities_of(text: Column, config: ExtractorConfig = ExtractorConfig(), only: str | None = None) -> Column:
    """Entities of a text column as an array of structs (see SCHEMA); of one kind only, if named,
    which competes with the others all the same."""

    @F.arrow_udf(SCHEMA)
    def run(texts: pa.Array) -> pa.Array:
        return in_steps(texts, lambda part: _lists([planned(t, config, only) for t in part.to_pylist()]))

    return run(text)


def entities_of_all(texts: Column, config: ExtractorConfig = ExtractorConfig()) -> Column:
    """Entities of an array of texts, one text after another; places count within each text."""

    @F.arrow_udf(SCHEMA)
    def run(lists: pa.Array) -> pa.Array:
        return in_steps(lists, lambda part: _lists([[e for t in own or () for e in planned(t, config)] for own in part.to_pylist()]))

    return run(texts)


def canonical_date(iso: Column) -> Column:
    """The day of an ISO date or time."""
    return F.split_part(iso, F.lit("T"), F.lit(1))


def with_entities(df: DataFrame, column: str, out: str = "entities", config: ExtractorConfig = ExtractorConfig(), only: str | None = None) -> DataFrame:
    return df.withColumn(out, entities_of(F.col(column), config, only))
