"""Text functions as column expressions, with the patterns that a second SQL engine shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.words import NEGATORS, STOPWORDS

_ACCENTED = "".join(sorted("éèêëàâäîïôöùûüÿçœæ"))
CHARS = "0-9a-z" + _ACCENTED
#: A token in lower case: words and numbers, joined by single hyphens.
TOKEN = f"[{CHARS}]+(?:-[{CHARS}]+)*"
#: A code candidate, and what is left out of it.
CODE, NOT_CODE = "[0-9A-Za-z][0-9A-Za-z./-]*", "[^0-9A-Za-z]"
#: The same of those that have a digit, as all codes but those of a pattern of one's own have; it never goes back, so words cost little.
_DIGITAL = "(?:[A-Za-z][A-Za-z./-]*+)?+[0-9][0-9A-Za-z./-]*+"
#: Codes kept of one document.
MAX_CODES = 300
NO_DATE = "0000-00-00"
_YEAR, _MONTH, _DAY = "(?:19|20)[0-9]{2}", "0[1-9]|1[0-2]", "0[1-9]|[12][0-9]|3[01]"
DASHED = "([0-9]{4})-([0-9]{2})-([0-9]{2})"
COMPACT = f"(?:^|[^0-9])({_YEAR})({_MONTH})({_DAY})(?:$|[^0-9])"
FOLDER = rf"(?:^|[^0-9])({_YEAR})[/_]({_MONTH})-\p{{L}}"
MARK = "§"
_KINDS = {"csv": "spreadsheet", "ods": "spreadsheet", "xls": "spreadsheet", "xlsx": "spreadsheet", "jpeg": "photo", "jpg": "photo", "png": "photo", "tiff": "photo", "docx": "document", "odt": "document", "rtf": "document", "odp": "slides", "pptx": "slides", "htm": "web page", "html": "web page"}
#: A pdf with fewer characters of text is a scan.
SCAN_CHARS = 200


def tokens(text: Column) -> Column:
    """Tokens in order; none for a null text. Hyphens that join nothing go first, so that no pattern has to repeat a group."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?<![{CHARS}])-|-(?![{CHARS}])"), F.lit(" "))
    return F.regexp_extract_all(plain, F.lit(f"[{CHARS}-]+"), F.lit(0))


def path_tokens(path: Column) -> Column:
    return tokens(F.regexp_replace(path, F.lit(r"[./_-]"), F.lit(" ")))


def in_words(token: Column, words=STOPWORDS) -> Column:
    return token.isin(*sorted(words))


def is_stopword(token: Column) -> Column:
    return in_words(token, STOPWORDS)


def is_negator(token: Column) -> Column:
    return in_words(token, NEGATORS)


def is_noise(token: Column) -> Column:
    """Short or numeric tokens that no one wants to see as a concept."""
    return (F.length(token) < 3) | token.rlike("^[0-9.,%€-]+$")


def is_code(token: Column, mixed: int = 5, digits: int = 6, pattern: str | None = None) -> Column:
    """Letters and digits of ``mixed`` signs at least, or ``digits`` digits at least; ``pattern`` replaces both."""
    bare = F.regexp_replace(token, F.lit(NOT_CODE), F.lit(""))
    if pattern:
        return bare.rlike(f"^(?:{pattern})$")
    return ((F.length(bare) >= mixed) & bare.rlike("[A-Za-z]") & bare.rlike("[0-9]")) | ((F.length(bare) >= digits) & bare.rlike("^[0-9]+$"))


def codes(text: Column, mixed: int = 5, digits: int = 6, pattern: str | None = None) -> Column:
    """Reference codes of a text: bare, in capitals, each once in order of appearance, MAX_CODES at most."""
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CODE if pattern else _DIGITAL), F.lit(0)), lambda t: is_code(t, mixed, digits, pattern))
    return F.slice(F.array_distinct(F.transform(found, lambda t: F.upper(F.regexp_replace(t, F.lit(NOT_CODE), F.lit(""))))), 1, MAX_CODES)


def _date(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), F.concat_ws("-", *(F.regexp_extract(text, pattern, k) for k in (1, 2, 3))))


def path_date(path: Column) -> Column:
    """YYYY-MM-DD from a path: with dashes in the name, in the path, then compact in either; else YYYY-MM-00 from folders; else NO_DATE."""
    whole = F.regexp_replace(path, F.lit(r"\\"), F.lit("/"))
    name = F.regexp_extract(whole, "([^/]*)$", 1)
    month = F.when(whole.rlike(FOLDER), F.concat(F.regexp_extract(whole, FOLDER, 1), F.lit("-"), F.regexp_extract(whole, FOLDER, 2), F.lit("-00")))
    return F.coalesce(_date(name, DASHED), _date(path, DASHED), _date(name, COMPACT), _date(path, COMPACT), month, F.lit(NO_DATE))


def document_kind(path: Column, text_length: Column | None = None, extra: dict[str, str] | None = None) -> Column:
    """What a file is by its extension; ``extra`` goes first. A pdf is a scan if little text came out of it."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))
    kinds = _KINDS | {k.lower().lstrip("."): v for k, v in (extra or {}).items()}
    known = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    length = F.coalesce(text_length, F.lit(0)) if text_length is not None else F.lit(0)
    pdf = F.when(ext == "pdf", F.when(length < SCAN_CHARS, "scanned pdf").otherwise("digital pdf"))
    return F.coalesce(known[ext], pdf, F.lit("note"))


def fragments(word: Column, n: int = 3) -> Column:
    """Marked character n-grams of ^word$; none if the word has ``n`` characters or fewer."""
    framed = F.concat(F.lit("^"), word, F.lit("$"))
    return F.when(F.length(word) > n, F.transform(F.sequence(F.lit(1), F.length(word) + 3 - n), lambda i: F.concat(F.lit(MARK), F.substring(framed, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def with_fragments(words: Column, n: int = 3) -> Column:
    """The tokens, then the fragments of each."""
    return F.concat(words, F.flatten(F.transform(words, lambda w: fragments(w, n)))) if n > 0 else words


def entity(text: Column) -> Column:
    return F.array_join(tokens(text), "_")


def folded(text: Column) -> Column:
    """ASCII letters in lower case, all others as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_contains(path: Column, part: str) -> Column:
    """``part`` anywhere in the path, its signs literal, without regard to the case of ASCII letters."""
    return F.contains(folded(path), folded(F.lit(part)))
