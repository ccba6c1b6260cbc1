"""Main text of web pages by the distribution of text over line blocks, in built-in expressions only."""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a block.
BLOCK = 3
#: Characters, white space apart, of a block from which a region begins, and below which it ends.
SURGE, DIVE = 86, 65
_GONE = ("script", "style", "noscript", "template", "svg", "iframe", "title")
#: Comments and elements without prose, to their end or the page's; the one that opens first wins, so a script may hold "<!--".
HIDDEN = r"(?is)<!--.*?(?:-->|\z)" + "".join(rf"|<{t}\b.*?(?:</{t}[ \t\r\n]*>|\z)" for t in _GONE)
_BLOCKS = "address|article|aside|blockquote|body|br|center|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|menu|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|tr|ul"
BREAKS = rf"(?i)</?(?:{_BLOCKS})(?:[ \t\r\n/][^>]*)?>"
TAGS = r"<[a-zA-Z/!?][^>]*>"
#: All named references of HTML that end in a semicolon, and what bytes of an old code page stand for as numbers; a hard space is a space.
NAMED = {name[:-1]: sign.replace("\xa0", " ") for name, sign in html5.items() if name.endswith(";")}
NUMBERED = {160: " "} | {0x80 + i: c for i, c in enumerate(bytes(range(0x80, 0xA0)).decode("cp1252", "replace")) if c != "\ufffd"}
REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"


def _table(pairs: dict, kind: str) -> Column:
    """A constant map, written as one literal so that plans stay small."""
    return F.from_json(F.lit(json.dumps(pairs)), kind)


def decoded(parts: Column) -> Column:
    """A text with its references decoded, each once; what is no reference, or stands for no character, stays as it is.

    ``parts``: the text, split at "&".
    """
    letters = sorted({n[0] for n in NAMED})
    names = _table({c: {n: s for n, s in NAMED.items() if n[0] == c} for c in letters}, "map<string,map<string,string>>")
    numbers = _table(NUMBERED, "map<string,string>")
    named = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.struct(F.regexp_extract(p, REFERENCE, 1).alias("name"), p.alias("part")))

    def one(x: Column) -> Column:
        name, part = x["name"], x["part"]
        hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
        number = F.when(hexadecimal, F.conv(F.substring(name, F.lit(3), F.lit(8)), 16, 10).cast("int")).otherwise(F.substring(name, F.lit(2), F.lit(8)).cast("int"))
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        coded = F.when(valid, F.coalesce(numbers[number.cast("string")], F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")))
        sign = F.when(F.startswith(name, F.lit("#")), coded).when(name != "", names[F.substring(name, 1, 1)][name])
        return F.coalesce(F.concat(sign, F.substring(part, F.length(name) + 2, F.length(part))), F.concat(F.lit("&"), part))

    return F.concat(parts[0], F.array_join(F.transform(named, one), ""))


def lines_of(html: DataFrame) -> DataFrame:
    """(page_id, lines) of (page_id, html): hidden elements go, block tags break the line, other tags go, references are decoded.

    A step at a time, so that no expression is there twice.
    """
    text = F.regexp_replace("html", F.lit(HIDDEN), F.lit(" "))
    text = F.regexp_replace(text, F.lit(BREAKS), F.lit("\n"))
    text = F.regexp_replace(text, F.lit(TAGS), F.lit(""))
    rows = html.select("page_id", F.split(text, "&").alias("parts"))
    rows = rows.select("page_id", decoded(F.col("parts")).alias("text"))
    text = F.regexp_replace("text", F.lit(r"[ \t\r\f]+"), F.lit(" "))
    return rows.select("page_id", F.split(F.regexp_replace(text, F.lit(r" ?\n ?"), F.lit("\n")), "\n").alias("lines"))


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))), parts)


def _most(parts: list[Column]) -> Column:
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)), parts)


def main_text(pages: DataFrame, block: int = BLOCK, surge: int = SURGE, dive: int = DIVE) -> DataFrame:
    """(page_id, text, n_lines, n_kept, n_regions, first_line, last_line) for every row of ``pages``.

    A block is ``block`` lines from each line on, and a line is as dense as the longest block that covers it. A region begins at a line
    where this reaches ``surge`` characters and ends before the first line where it is under ``dive``; the lines of all regions are
    kept, blank ones left out. On a page without a block of ``surge`` characters the longest block stands for both. n_kept counts lines
    that aren't blank, first_line and last_line are 0-based bounds of the regions. A null html has a null text and no lines; a page
    without text has an empty text and null bounds. page_id keeps its type. Repeated rows and null page_ids are rows like others,
    whatever their number; other columns are not read, whatever their names. Pages are read whole, however long. An empty table gives
    an empty result.
    """
    rows = lines_of(pages.select("page_id", "html"))
    rows = rows.select("*", F.transform("lines", lambda x: F.length(F.replace(x, F.lit(" "), F.lit("")))).alias("lens"))
    ahead = [F.col("lens")] + [F.slice("lens", k + 1, F.greatest(F.size("lens"), F.lit(1))) for k in range(1, block)]
    rows = rows.select("page_id", "lines", _total(ahead).alias("blocks"))
    zeros = [F.concat(F.array_repeat(F.lit(0), k), F.col("blocks")) for k in range(block)]
    longest = F.greatest(F.lit(1), F.array_max("blocks"))
    rows = rows.select("page_id", "lines", _most(zeros).alias("reach"), F.struct(F.least(F.lit(surge), longest).alias("high"), F.least(F.lit(dive), longest).alias("low")).alias("level"))
    # a letter a line: S where a region may begin, D where it may go on; a region is what "S[SD]*" matches. What is constant on a page
    # is passed in an array: inside a lambda it would be worked out for each line.
    n = F.size("lines")
    letter = F.zip_with(F.slice("reach", 1, n), F.array_repeat("level", n), lambda x, v: F.when(x >= v["high"], "S").when(x >= v["low"], "D").otherwise("."))
    parts = F.regexp_extract_all(F.array_join(letter, ""), F.lit("S[SD]*|D+|[.]+"), F.lit(0))
    marks = F.array_join(F.transform(parts, lambda p: F.repeat(F.when(F.startswith(p, F.lit("S")), "K").otherwise("."), F.length(p))), "")
    rows = rows.select("page_id", "lines", marks.alias("marks"))
    inside = F.zip_with("lines", F.split("marks", ""), lambda x, m: F.when(m == "K", F.trim(x)))
    rows = rows.select("page_id", "lines", "marks", F.filter(inside, lambda x: x.isNotNull() & (x != "")).alias("kept"))
    some, none = F.size("kept") > 0, F.col("lines").isNull()
    return rows.select(
        "page_id",
        F.when(~none, F.array_join("kept", "\n")).alias("text"),
        F.when(none, 0).otherwise(F.size("lines")).alias("n_lines"),
        F.when(some, F.size("kept")).otherwise(0).alias("n_kept"),
        F.when(some, F.size(F.regexp_extract_all("marks", F.lit("K+"), F.lit(0)))).otherwise(0).alias("n_regions"),
        F.when(some, F.instr("marks", "K") - 1).alias("first_line"),
        F.when(some, F.length("marks") - F.instr(F.reverse("marks"), "K")).alias("last_line"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _map_sql(pairs: dict) -> str:
    return "map([" + ", ".join(_quoted(k) if isinstance(k, str) else str(k) for k in pairs) + "], [" + ", ".join(map(_quoted, pairs.values())) + "])"


def main_text_sql(block: int = BLOCK, surge: int = SURGE, dive: int = DIVE) -> str:
    """``main_text`` over pages, by windows over unnested lines: a region is the part of a run of lines over ``dive`` from its first surge on."""
    text = f"regexp_replace(regexp_replace(regexp_replace(html, {_quoted(HIDDEN)}, ' ', 'g'), {_quoted(BREAKS)}, chr(10), 'g'), {_quoted(TAGS)}, '', 'g')"
    number = "case when lower(substr(name, 2, 1)) = 'x' then ('0x' || substr(name, 3))::int else substr(name, 2)::int end"
    clean = r"regexp_replace(regexp_replace(text, '[ \t\r\f]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')"
    return f"""
with p as (select page_id, html, row_number() over () as row_id from pages),
t as (select page_id, row_id, string_split({text}, '&') as parts from p),
u as (select row_id, unnest(parts[2:]) as part, unnest(range(1, len(parts))) as nth from t),
v as (select *, regexp_extract(part, {_quoted(REFERENCE)}, 1) as name from u),
names as (select unnest(map_entries({_map_sql(NAMED)})) as e), numbers as (select unnest(map_entries({_map_sql(NUMBERED)})) as e),
w as (select *, case when name like '#%' then {number} end as code from v),
x as (select row_id, nth, part, name, coalesce(case when code > 0 and code <= 1114111 and not code between 55296 and 57343 then coalesce(numbers.e.value, chr(code)) end, names.e.value) as sign
  from w left join numbers on numbers.e.key = code left join names on names.e.key = name),
y as (select row_id, string_agg(case when sign is null then '&' || part else sign || substr(part, length(name) + 2) end, '' order by nth) as rest from x group by 1),
z as (select page_id, row_id, case when parts is not null then parts[1] || coalesce(rest, '') end as text from t left join y using (row_id)),
s as (select page_id, row_id, string_split({clean}, chr(10)) as lines from z),
l as (select row_id, unnest(lines) as line, unnest(range(len(lines))) as i from s),
n as (select *, length(replace(line, ' ', '')) as len from l),
b as (select *, sum(len) over (partition by row_id order by i rows between current row and {block - 1} following) as dense from n),
r as (select *, max(dense) over (partition by row_id order by i rows between {block - 1} preceding and current row) as reach,
      greatest(1, max(dense) over (partition by row_id)) as longest from b),
d as (select *, i - row_number() over (partition by row_id order by i) as run from r where reach >= least({dive}, longest)),
k as (select * from (select *, min(case when reach >= least({surge}, longest) then i end) over (partition by row_id, run) as begins from d) where i >= begins),
g as (select row_id, string_agg(trim(line, ' '), chr(10) order by i) filter (len > 0) as text, count(*) filter (len > 0) as n_kept,
      count(distinct run) as n_regions, min(i) as first_line, max(i) as last_line from k group by row_id)
select page_id, case when lines is null then null else coalesce(g.text, '') end as text, coalesce(len(lines), 0)::int as n_lines,
  coalesce(n_kept, 0)::int as n_kept, coalesce(n_regions, 0)::int as n_regions, first_line::int as first_line, last_line::int as last_line
from s left join g using (row_id)"""
