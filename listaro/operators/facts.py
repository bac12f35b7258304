"""Facts of a listing's prose, sentence by sentence: completion certificate, rental, pets.

A rule looks at the words of single sentences that name its subject: which cue
words stand how near to it, on which side. All of it is column expressions over
arrays of words; only sentences that name the subject are cut into words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEGATIONS = ("ikke", "uten", "ingen", "aldri", "mangler", "manglende", "verken", "hverken")
#: What a certificate is said to be where there is one.
GIVEN = ("foreligger", "utstedt", "gitt", "datert", "innvilget", "mottatt", "kom")
CONSENT = ("godkjen", "samtykk", "søkna", "søknad", "styre")


def sentences(text: Column, naming: str) -> Column:
    """The lower-case sentences that match ``naming``. One ends at a line's end, and at a full stop or the like before a capital letter, not within dates and shortened words."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n|[.!?]+\s+(?=\p{Lu})"), lambda s: F.lower(s)), lambda s: s.rlike(naming))


def words(sentence: Column) -> Column:
    return F.filter(F.split(sentence, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def near(sentence: Column, subject: str, cues: tuple[str, ...], before: int, behind: int) -> Column:
    """Whether a word of ``cues`` stands at most so many words before or behind one that begins with ``subject``."""
    w = words(sentence)
    return F.exists(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda at: at["x"].startswith(subject) & F.arrays_overlap(_around(w, at["i"], before, behind), F.lit(list(cues))))


def _around(w: Column, i: Column, before: int, behind: int) -> Column:
    first = F.greatest(i - before, F.lit(0))
    return F.slice(w, first + 1, i + behind + 1 - first)


def _begins(sentence: Column, prefixes: tuple[str, ...]) -> Column:
    return F.exists(words(sentence), lambda w: F.lit(False) if not prefixes else _any([w.startswith(p) for p in prefixes]))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _talks_around(s: Column) -> Column:
    """The sentence is about certificates in general, or sends the reader elsewhere."""
    points = F.arrays_overlap(words(s), F.lit(["se", "jf", "jfr"])) & _begins(s, ("punkt", "avsnitt"))
    law = s.contains("bygningslov") | s.contains("21-10") | s.contains("ikke lenger")
    return points | law | s.contains("garanti") | s.contains("eller ikke") | s.contains("omfatter ikke")


def certificate(text: Column) -> Column:
    """ingen, midlertidig or ferdigattest; null where none is spoken of.

    A denial counts before a statement, as both use the same words; beside a
    temporary permit a denial means that permit. A certificate that is only
    named counts as there, if nothing says otherwise.
    """
    named = sentences(text, "ferdigattest|midlertidig brukstillatelse")
    own = F.filter(named, lambda s: ~_talks_around(s))
    temporary = F.exists(own, lambda s: s.contains("midlertidig brukstillatelse"))
    denied = F.exists(own, lambda s: near(s, "ferdigattest", NEGATIONS, 6, 4))
    given = F.exists(own, lambda s: near(s, "ferdigattest", GIVEN, 4, 4) | s.rlike("ferdigattest.* p[åa] eiendommen"))
    return (
        F.when(denied, F.when(temporary, "midlertidig").otherwise("ingen"))
        .when(given, "ferdigattest")
        .when(temporary, "midlertidig")
        .when(F.exists(named, lambda s: s.contains("ferdigattest")), "ferdigattest")
    )


def rental(text: Column) -> Column:
    """egen_enhet, ikke_tillatt or tillatt; null where nothing is said. A unit to let counts before what is allowed."""
    named = sentences(text, "utlei|leies? ut|hybel")
    unit = F.exists(named, lambda s: _begins(s, ("utleiedel", "utleieenhet", "utleieleilighet", "hybelleilighet")) | near(s, "hybel", ("egen", "eget"), 1, 0) | near(s, "utleie", ("egen",), 1, 0))
    barred = F.exists(named, lambda s: _any([near(s, p, ("ikke",), 2, 0) for p in ("tillatt", "anledning", "lov", "adgang")]))
    allowed = F.exists(named, lambda s: near(s, "utleie", ("tillatt",), 0, 2) | s.contains("kan leies ut") | s.contains("anledning til å leie ut"))
    return F.when(unit, "egen_enhet").when(barred, "ikke_tillatt").when(allowed, "tillatt")


def pets(text: Column) -> Column:
    """krever_godkjenning, ikke_tillatt or tillatt; null where nothing is said. What needs consent is allowed with it, however it is put."""
    named = sentences(text, "dyrehold|husdyr")
    asks = F.exists(named, lambda s: _begins(s, CONSENT))
    barred = F.exists(named, lambda s: near(s, "tillatt", ("ikke",), 1, 0) | near(s, "forbud", ("mot",), 0, 1) | near(s, "forbudt", ("er",), 2, 0))
    allowed = F.exists(named, lambda s: _begins(s, ("tillatt",)))
    return F.when(asks, "krever_godkjenning").when(barred, "ikke_tillatt").when(allowed, "tillatt")
