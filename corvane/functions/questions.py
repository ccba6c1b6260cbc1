"""What a question asks for: politeness off, its circuit, wanted and unwanted terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.functions.words import EXCLUDERS, JOINERS

_J = r"[\s'’]+"
_GREETINGS = (
    r"bonjour", r"bonne journ[eé]e", r"bonne soir[eé]e", r"bonsoir", r"cordialement", r"coucou", r"d[eé]sol[eé]e?", r"excusez[ -]moi", r"hello",
    rf"merci{_J}d{_J}?avance", r"merci beaucoup", r"merci", r"pardon", rf"s{_J}il (?:te|vous) pla[iî]t", r"salut", r"svp",
)
_HELP = (
    r"aidez[ -]moi", r"est[ -]ce que quelqu.? un (?:peut|pourrait)", rf"(?:je voudrais|j{_J}aimerais) savoir", rf"j{_J}ai (?:des |une )?questions?",
    rf"j{_J}?(?:aimerais |aurais |voudrais )?(?:voulais |besoin d{_J})?(?:un peu d{_J})?aide", r"ma question (?:porte sur|est)",
    rf"merci de m{_J}(?:r[eé]pondre|expliquer|aider)", rf"(?:peux[ -]tu|pouvez[ -]vous) m{_J}(?:expliquer|aider)", rf"quelqu.? un (?:pourrait|peut) m{_J}(?:expliquer|aider)", r"voici ma question",
)
_LOST = (
    rf"je (?:n{_J}|ne )?(?:arrive|comprend|comprends|sais|saisis) (?:rien|pas)(?: (?:[aà] )?(?:comprendre|(?:la |le |les )?faire))?",
    rf"j{_J}ai (?:des difficult[eé]s|du mal)(?: [aà] (?:faire|comprendre))?", r"je (?:suis )?(?:perdue?|bloqu[eé]e?)",
    rf"je (?:n{_J}|ne )?(?:comprend|comprends) pas (?:ce que|comment|pourquoi)",
)
_NOISE = (
    rf"(?iu)(?:^|(?<=[\s,;:.!?—–-]))(?:{'|'.join(_GREETINGS)})(?U:\b)(?=[\s,;:.!?…)]*(?:$|(?U:\W)))",
    rf"(?iu)(?U:\b)(?:{'|'.join(_HELP)})(?U:\b)",
    rf"(?iu)(?U:\b)(?:{'|'.join(_LOST)})(?U:\b)",
)


def clean(question: Column) -> Column:
    """(text, removed): the question without politeness, pleas and confessions; unchanged with nothing removed if all of it would go."""
    text, removed = question, []
    for pattern in _NOISE:
        removed.append(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.trim))
        text = F.regexp_replace(text, F.lit(pattern), F.lit(" "))
    text = F.regexp_replace(text, F.lit(r"([!?])\1+"), F.lit("$1"))
    text = F.regexp_replace(text, F.lit(r"""^[\s,;:.!?…–—'"-]+|[\s,;:]+(?=[,;:.])|\s+(?=[,.;:!?])"""), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, F.lit(r"\s{2,}"), F.lit(" ")), F.lit(r"^[ ,;:–—-]+|[ ,;:–—-]+$"), F.lit(""))
    some = F.length(F.trim(text)) > 0
    return F.struct(F.when(some, text).otherwise(question).alias("text"), F.when(some, F.concat(*removed)).otherwise(F.array().cast("array<string>")).alias("removed"))


def noise_ratio(question: Column) -> Column:
    """Share of the characters that ``clean`` takes away, to 4 places; 0 for a blank question."""
    return F.when(F.length(F.trim(question)) > 0, F.round(1 - F.length(clean(question)["text"]) / F.length(question), 4)).otherwise(F.lit(0.0))


def signed_terms(question: Column) -> Column:
    """[(word, sign)]: words after an excluder are unwanted until "mais"; a "mais" before an excluder excludes."""
    words = F.filter(F.split(F.regexp_replace(F.lower(question), F.lit(","), F.lit(" ")), r"\s+"), lambda w: w != "")
    empty = F.struct(F.lit(1).alias("sign"), F.array().cast("array<struct<word:string,sign:int>>").alias("out"))
    skip = F.lit(sorted(JOINERS))
    neg = F.lit(sorted(EXCLUDERS))

    def step(s: Column, w: Column) -> Column:
        sign = F.when(F.array_contains(neg, w), -1).when(w == "mais", 1).otherwise(s["sign"])
        stays = F.array_contains(neg, w) | (w == "mais") | F.array_contains(skip, w)
        term = F.struct(w.alias("word"), s["sign"].alias("sign"))
        return F.struct(sign.alias("sign"), F.when(stays, s["out"]).otherwise(F.concat(s["out"], F.array(term))).alias("out"))

    return F.aggregate(words, empty, step, lambda s: s["out"])


def wanted(question: Column, sign: int = 1) -> Column:
    """The wanted terms of a question as text, or the unwanted for sign -1."""
    return F.array_join(F.transform(F.filter(signed_terms(question), lambda t: t["sign"] == sign), lambda t: t["word"]), " ")


_L, _R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
#: Patterns that Java and RE2 read alike.
METHOD = rf"(?i){_L}(?:calculer|comment|convertir|expliqu[\p{{L}}\p{{N}}_]+|formule|méthode){_R}"
COUNT = rf"(?i){_L}(?:(?:combien|nombre|quantité)\s+(?:de{_R}|d')|combien\s+y\s+a-t-il{_R})"
NOT_COUNT = rf"(?i){_L}(?:(?:le|un)\s+(?:certain|grand|petit)\s+nombre\s+(?:de{_R}|d')|combien\s+(?:de\s+)?(?:fois|temps){_R})"
ORDER = rf"(?i){_L}(?:plus\s+récent(?:e|es|s)?|(?:la|le|les)\s+derni(?:er|ère)s?|[0-9]+\s+derni(?:er|ère|ère)s?){_R}"
NOT_ORDER = rf"(?i){_L}(?:derniers?\s+(?:cri|étage|mot|niveau|recours|ressort)|dernières?\s+(?:chance|main|minute)){_R}"
LATEST = r"(?i)([0-9]+)\s+derni"
KINDS = {"photo": ("clichés?", "images?", "photos?"), "spreadsheet": ("excel", "liste de prix", "tableau de prix", "tableur", "xlsx"), "scanned pdf": ("scan", "scanné", "scannés", "scannée"), "note": ("notes?",)}
WORDS = r"[\p{L}\p{N}_-]+"
_YEAR = "^(?:19|20)[0-9]{2}$"
_MEASURE = "(?i)^[0-9]+(?:[.,][0-9]+)?(?:-[0-9]+(?:[.,][0-9]+)?)?(?:a|cm|k|kw|lm|m|ma|mm|v|va|w|%|°)$"


def question_codes(question: Column) -> Column:
    """Codes of a question: mixed of five signs or six digits, in capitals, neither years nor measures, each once."""
    words = F.transform(F.regexp_extract_all(question, F.lit(WORDS), F.lit(0)), lambda w: F.regexp_replace(w, F.lit("^-+|-+$"), F.lit("")))

    def fits(w: Column) -> Column:
        mixed = w.rlike("^[A-Z0-9-]{5,}$") & w.rlike("[A-Z]") & w.rlike("[0-9]")
        return (mixed | w.rlike("^[0-9]{6,}$")) & ~w.rlike(_YEAR) & ~w.rlike(_MEASURE)

    return F.array_distinct(F.filter(words, fits))


def route(question: Column) -> Column:
    """(circuit, reason, codes, kind, k): how to answer a question; "semantic" unless a closed class says otherwise.

    Method questions stay semantic; then counting goes before order, order before a reference. kind is a filter named in the
    question, k the number of latest documents asked for.
    """
    q = F.trim(question)
    found = question_codes(q)
    kind = reduce(lambda c, kv: c.when(q.rlike(rf"(?i){_L}(?:{'|'.join(kv[1])}){_R}"), kv[0]), KINDS.items(), F.when(F.lit(False), ""))
    count, order = q.rlike(COUNT) & ~q.rlike(NOT_COUNT), q.rlike(ORDER) & ~q.rlike(NOT_ORDER)
    case = F.when(q == "", "empty").when(q.rlike(METHOD), "method").when(count, "count").when(order, "order").when(F.size(found) > 0, "code").otherwise("default")
    circuit = F.when(case == "count", "count").when(case == "order", "order").when(case == "code", "reference").otherwise("semantic")
    none = F.array().cast("array<string>")
    return F.struct(
        circuit.alias("circuit"),
        case.alias("reason"),
        F.when(circuit == "semantic", none).otherwise(found).alias("codes"),
        F.when(q != "", kind).alias("kind"),
        F.when(circuit == "order", F.nullif(F.regexp_extract(q, LATEST, 1), F.lit("")).cast("int")).alias("k"),
    )


def query_tokens(question: Column) -> Column:
    return tokens(clean(question)["text"])
