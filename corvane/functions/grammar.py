"""Roles of entities in French clauses from closed classes of words; where no pattern holds, nothing is said."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import TOKEN
from corvane.functions.words import STOPWORDS

_SIGNS = ",;:.()!?"
_PIECES = re.compile(f"{TOKEN}|[{re.escape(_SIGNS)}]")


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


def _agreeing(words: Iterable[str]) -> frozenset[str]:
    return frozenset(w + end for w in words for end in ("", "e", "es", "s"))


_ARTICLES = _set("un une l la le les")
_WITHOUT = _set("aucun aucune ni sans")
_CLOSERS = _set("jamais pas plus")
_NE = _set("n ne")
_FIXED = _set("cesse délai fin objet préavis suite")
_BE = _set("a aura demeure demeurent est étaient était ont reste restent sera seront sont")
_HAVE = _set("comporte dispose inclut intègre possède présente prévoit")
_STOPS = _NE | _set("à après au aux avant avec car chez dans de depuis des donc dont du en entre et hors mais où ou par pendant pour puis que qui selon sous sur vers") - {"en", "de"}
_SET_VERBS = _set("branche câble implante insère installe monte place pose raccorde situe")
_SET_WORDS = _agreeing(_set("câblé disposé implanté inséré installé monté placé posé positionné prévu raccordé repris situé"))
SKIPPED = _SET_WORDS | _SET_VERBS | frozenset(v + "nt" for v in _SET_VERBS) | _BE | _ARTICLES | _NE | _set("directement figure figurent immédiatement juste se trouve trouvent")
_DO = _set("alimente commande contrôle coupe déclenche pilote protège")
ACTIVE = _DO | frozenset(v + "nt" for v in _DO) | _set("dessert desservent")
PASSIVE = _agreeing(_set("alimenté commandé contrôlé coupé déclenché desservi piloté protégé"))
_BARE, _DEFINITE = _set("d de"), _set("au aux des du")
ROLES = "array<struct<role:string,entity:string>>"


def _full(word: str) -> bool:
    return len(word) > 2 and word not in _SIGNS and not any(c.isdigit() for c in word)


class _Clause:
    def __init__(self, words: list[str], active: frozenset[str], passive: frozenset[str], skipped: frozenset[str]):
        self.words, self.active, self.passive, self.skipped = words, active, passive, skipped
        self.found: dict[tuple[str, str], None] = {}
        self.negated: set[int] = set()
        for i, w in enumerate(words):
            if w in _NE:
                end = next((j for j in range(i + 1, min(i + 4, len(words))) if words[j] in _CLOSERS), None)
                if end is not None:
                    self.negated |= set(range(i, end + 1))

    def at(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def say(self, *pairs: tuple[str, str | None]) -> None:
        if all(e for _, e in pairs):
            self.found |= dict.fromkeys(pairs)

    def argument(self, i: int, step: int) -> str | None:
        """The nearest full word before or after i; a sign or a negation comes between and there is none."""
        skip = (self.skipped if step < 0 else _ARTICLES) | STOPWORDS
        i += step
        while 0 <= i < len(self.words):
            w = self.words[i]
            if w in _SIGNS or w in _WITHOUT:
                return None
            if _full(w) and w not in skip:
                return w
            i += step
        return None

    def scope(self, i: int) -> list[str]:
        """Up to four full words that a negation at i covers."""
        out: list[str] = []
        for j in range(i + 1, len(self.words)):
            w = self.words[j]
            ends = w in _SIGNS or w in _WITHOUT or w in _STOPS or w in _DEFINITE or (out and (w in self.active or w in _BE)) or (w in _BARE and self.at(j + 1) in _ARTICLES)
            if ends or len(out) == 4:
                break
            if w not in _BARE and w not in _ARTICLES and _full(w):
                out.append(w)
        return out

    def negated_verb(self, i: int) -> None:
        verb = None
        for j in range(i - 1, -1, -1):
            if self.words[j] in _NE:
                break
            if _full(self.words[j]) or self.words[j] in _BE:
                verb = self.words[j]
        if verb in _BE:
            self.say(("absent", self.argument(i, 1)))
        elif verb in _HAVE and self.at(i + 1) in _BARE:
            for e in self.scope(i + 1):
                self.say(("absent", e))
        else:
            self.say(("absent", verb))

    def read(self) -> list[tuple[str, str]]:
        for i, w in enumerate(self.words):
            if w in _WITHOUT:
                if not (w == "sans" and self.at(i + 1) in _FIXED):
                    for e in self.scope(i):
                        self.say(("absent", e))
            elif w == "non":
                self.say(("absent", self.argument(i, 1)))
            elif w in _CLOSERS and i in self.negated:
                self.negated_verb(i)
            elif w in ("amont", "aval") and self.at(i - 1) == "en" and i > 0:
                if self.at(i + 1) in _BARE | _DEFINITE:
                    other = "aval" if w == "amont" else "amont"
                    self.say((w, self.argument(i - 1, -1)), (other, self.argument(i + 1, 1)))
            elif w in self.active and i not in self.negated:
                self.say(("agent", self.argument(i, -1)), ("patient", self.argument(i, 1)))
            elif w in self.passive and i > 0 and self.at(i - 1) in _BE and self.at(i + 1) == "par":
                self.say(("patient", self.argument(i - 1, -1)), ("agent", self.argument(i + 1, 1)))
        return list(self.found)


def analyse(text: str, active: Iterable[str] = (), passive: Iterable[str] = (), skipped: Iterable[str] = ()) -> list[tuple[str, str]]:
    """(role, entity) pairs of a clause, each once: absent, amont, aval, agent, patient. The word lists of a trade may be extended."""
    return _Clause(_PIECES.findall((text or "").lower()), ACTIVE | frozenset(active), PASSIVE | _agreeing(passive), SKIPPED | frozenset(skipped)).read()


def roles(text: Column, active: Iterable[str] = (), passive: Iterable[str] = (), skipped: Iterable[str] = ()) -> Column:
    """``analyse`` over a column, a batch at a time; no roles for a null text."""
    lists = (list(active), list(passive), list(skipped))

    @F.pandas_udf(ROLES)
    def read(column):
        return column.map(lambda t: [{"role": r, "entity": e} for r, e in analyse(t, *lists)] if t else [])

    return read(text)
