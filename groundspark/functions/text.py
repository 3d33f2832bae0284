"""Tokens, lemmas, informative terms and sentences as Catalyst expressions, and the same terms in
Python for what counts or places them within a row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: One token per run of word characters and $ % . -, from its first to its last word character.
TOKEN = r"([\p{L}\p{N}_](?:[\p{L}\p{N}_$%.\-]*[\p{L}\p{N}_])?)"
#: Where a sentence ends: after . ! ? and before a capital, a digit or a dollar sign.
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z0-9$])"
ORDINAL = r"(?i)\b(\d+)(st|nd|rd|th)\b"

# Function words that carry no grounding.
STOPWORDS = (
    "the a an and or but in on at to for of with by "
    "is are was were be been being have has had do does did "
    "will would could should may might must can this that these those "
    "i you he she it we they me him her us them my your "
    "his hers its our their as from about into over under than "
    "then so if not no yes also just only very more most such"
).split()


def tokens(text: Column) -> Column:
    """Raw tokens of a text, in order; null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(1))


def lemma(token: Column) -> Column:
    """Lower case, no outer punctuation; money, percent and numbers stripped of separators;
    else the first fitting ending of s, ed, ing goes if at least three characters stay."""
    t = F.btrim(F.lower(token), F.lit(".,;:!?()[]{}'\""))
    digits = F.regexp_replace(F.substring(t, 2, 1 << 30), r"[^\p{Nd}]", "")
    share = F.regexp_replace(t, r"[^\p{Nd}.]", "")
    size = F.length(t)

    def cut(n: int) -> Column:
        return t.substr(F.lit(1), size - n)

    return (
        F.when(F.startswith(t, F.lit("$")), F.concat(F.lit("$"), digits))
        .when(F.endswith(t, F.lit("%")), F.concat(share, F.lit("%")))
        .when(t.rlike(r"^[-+]?\p{Nd}[\p{Nd},]*\.?\p{Nd}*$"), F.replace(t, F.lit(","), F.lit("")))
        .when(F.endswith(t, F.lit("s")) & (size > 3), cut(1))
        .when(F.endswith(t, F.lit("ed")) & (size > 4), cut(2))
        .when(F.endswith(t, F.lit("ing")) & (size > 5), cut(3))
        .otherwise(t)
    )


def informative(term: Column) -> Column:
    """True for a term that is not empty, a stop word, all digits, or a bare $ or %."""
    return ~term.isin("", "$", "%", *STOPWORDS) & ~term.rlike(r"^\p{Nd}+$")


#: The same tokens for Python's patterns.
_TOKEN = re.compile(r"\w(?:[\w$%.\-]*\w)?")


#: Terms of tokens that a worker remembers, and texts that are Python objects at one time.
REMEMBERED, STEP = 1 << 16, 256
_NUMBER = re.compile(r"[-+]?\d[\d,]*\.?\d*")
_DROPPED = frozenset(["", "$", "%", *STOPWORDS])
_known: dict[str, str] = {}


def lemma_of(token: str) -> str:
    """``lemma`` in Python."""
    t = token.lower().strip(".,;:!?()[]{}'\"")
    if t.startswith("$"):
        return "$" + re.sub(r"\D", "", t[1:])
    if t.endswith("%"):
        return re.sub(r"[^\d.]", "", t) + "%"
    if _NUMBER.fullmatch(t):
        return t.replace(",", "")
    for end, least in (("s", 3), ("ed", 4), ("ing", 5)):
        if t.endswith(end) and len(t) > least:
            return t[: -len(end)]
    return t


def term_of(token: str) -> str:
    """The informative term of a token; empty for none."""
    term = _known.get(token)
    if term is None:
        if len(_known) >= REMEMBERED:
            _known.clear()
        term = lemma_of(token)
        term = _known[token] = "" if term in _DROPPED or re.fullmatch(r"\d+", term) else term
    return term


def term_counts(text: str | None) -> dict[str, int]:
    """Counts of the informative terms of a text."""
    out: dict[str, int] = {}
    known = _known.get
    for token in _TOKEN.findall(text or ""):
        term = known(token)
        if term is None:
            term = term_of(token)
        if term:
            out[term] = out.get(term, 0) + 1
    return out


def stepwise(kind: str, made: Callable[[pa.StructArray], pa.Array], *columns: Column, steady: bool = True) -> Column:
    """``made`` of every STEP rows of some columns, sent on before the next are read, so that a
    worker holds no more of what it makes than of a few rows."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = batch if isinstance(batch, tuple) else (batch,)
            for at in range(0, len(parts[0]), STEP):
                yield made(pa.StructArray.from_arrays([x.slice(at, STEP) for x in parts], names=[f"c{i}" for i in range(len(parts))]))

    return (run if steady else run.asNondeterministic())(*columns)


def in_steps(rows: pa.Array, made: Callable[[pa.Array], pa.Array], step: int = 2048) -> pa.Array:
    """``made`` of every few rows, so that a batch is never held as Python objects at once."""
    done = [made(rows.slice(at, step)) for at in range(0, max(1, len(rows)), step)]
    return pa.concat_arrays(done) if len(done) > 1 else done[0]


def listed(ends: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


_PLACES = [pa.field("start", pa.int32()), pa.field("end", pa.int32())]


def _located(kind: str, found: list[tuple[str, int, int]]) -> pa.StructArray:
    names, starts, ends = zip(*found) if found else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=[pa.field(kind, pa.string()), *_PLACES])


def token_spans(text: Column) -> Column:
    """Raw tokens of a text with their places: array of (token, start, end); null gives none.

    Catalyst has no function that gives the places of all matches, so this runs in Arrow batches.
    """

    def made(rows: pa.StructArray) -> pa.Array:
        ends, found = [0], []
        for t in rows.field(0).to_pylist():
            found += [(m[0], *m.span()) for m in _TOKEN.finditer(t or "")]
            ends.append(len(found))
        return listed(ends, _located("token", found))

    return stepwise("array<struct<token:string,start:int,end:int>>", made, text)


def spans_of_sentences(text: Column, sentences: Column, terms: Column) -> Column:
    """Each sentence of a text with its terms out of a list, by their places in the text, where a
    sentence stands for its first occurrence there: array of (sentence, supported_terms)."""

    def made(rows: pa.StructArray) -> pa.Array:
        ends, said, inner, found = [0], [], [0], []
        for text, every, terms in zip(*(rows.field(i).to_pylist() for i in range(3))):
            terms = frozenset(terms or ())
            spans = [(term, *m.span()) for m in _TOKEN.finditer(text or "") if (term := term_of(m[0])) in terms] if terms else []
            for s in every or ():
                at = (text or "").find(s)
                found += [x for x in spans if x[1] >= at and x[2] <= at + len(s)]
                inner.append(len(found))
                said.append(s)
            ends.append(len(said))
        own = listed(inner, _located("term", found))
        return listed(ends, pa.StructArray.from_arrays([pa.array(said, pa.string()), own], names=["sentence", "supported_terms"]))

    return stepwise("array<struct<sentence:string,supported_terms:array<struct<term:string,start:int,end:int>>>>", made, text, sentences, terms)


def informative_of(spans: Column) -> Column:
    """The informative ones of ``token_spans``: array of (term, start, end, surface)."""
    each = F.transform(spans, lambda t: F.struct(lemma(t["token"]).alias("term"), t["start"].alias("start"), t["end"].alias("end"), t["token"].alias("surface")))
    return F.filter(each, lambda t: informative(t["term"]))


def informative_spans(text: Column) -> Column:
    """Informative terms of a text with their places."""
    return informative_of(token_spans(text))


def sentences(text: Column) -> Column:
    """Sentences of a text without outer white space; none for a blank text."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), SENTENCE_GAP)
    return F.filter(parts, lambda p: p != "")


def word_set(text: Column) -> Column:
    """Distinct lower-case words of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def strip_ordinals(text: Column) -> Column:
    """24th becomes 24."""
    return F.regexp_replace(text, ORDINAL, "$1")


def word_count(text: Column) -> Column:
    """Parts between white space, as Python's ``split`` counts them for ASCII space."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\s]+"), F.lit(0)))
