"""Chat formatting: conversations as windows of whole turns within a token budget, with masked targets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Tokens of a window, of the history that it repeats at most, and of a turn's frame.
BUDGET, HISTORY, FRAME = 384, 128, 4
#: The role whose turns are targets.
TARGET = "assistant"
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_COLUMNS = [("window", T.IntegerType()), *((c, T.LongType()) for c in ("first_turn", "new_turn", "last_turn")), ("n_turns", T.IntegerType()), ("n_tokens", T.LongType()), ("n_target_tokens", T.LongType())]
_COLUMNS += [("oversize", T.BooleanType()), ("text", T.StringType()), ("targets", _SPANS)]


def spans(tokens: list[int], room: int, history: int = HISTORY) -> list[tuple[int, int, int]]:
    """(first turn, first new turn, end) of each window: new turns follow on each other, and turns before them are repeated.

    From prefix sums: history takes the most whole turns that fit in ``history`` tokens beside the first new turn; then the most new
    turns that fit in ``room`` follow, one at least, so that a turn over the room is a window by itself.
    """
    total, out, start = [0, *accumulate(tokens)], [], 0
    while start < len(tokens):
        spare = min(history, room - tokens[start])
        first = start
        while first and total[start] - total[first - 1] <= spare:
            first -= 1
        end = start + 1
        while end < len(tokens) and total[end + 1] - total[first] <= room:
            end += 1
        out.append((first, start, end))
        start = end
    return out


def framed(role: str, text: str) -> tuple[str, int, int]:
    """(turn in the template, start and end of its text with the end mark, which a target is trained on)."""
    head = f"<|{role}|>\n"
    return f"{head}{text}<|end|>\n", len(head), len(head) + len(text) + len("<|end|>")


def _conversation(conv, turns: list[tuple[int, str, str, int]], budget: int, history: int) -> Iterator[tuple]:
    system = turns[:1] if turns[0][1] == "system" else []
    rest = turns[len(system) :]
    kept = sum(t[3] for t in system)
    for n, (first, new, end) in enumerate(spans([t[3] for t in rest], budget - kept, history) or [(0, 0, 0)]):
        parts, targets, at, wanted = [], [], 0, 0
        shown = system + rest[first:end]
        for i, (_, role, text, tokens) in enumerate(shown):
            piece, a, b = framed(role, text)
            if role == TARGET and i - len(system) + first >= new:
                targets.append({"start": at + a, "end": at + b})
                wanted += tokens - FRAME
            parts.append(piece)
            at += len(piece)
        turn = [t[0] for t in rest[first:end]] or [system[0][0]]
        used = sum(t[3] for t in shown)
        yield conv, n, turn[0], rest[new][0] if rest else turn[0], turn[-1], len(shown), used, wanted, used > budget, "".join(parts), targets


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: str | None = None) -> DataFrame:
    """A row for each window of each conversation: its turns, tokens, formatted text and the spans of that text to train on.

    A turn has FRAME tokens and one for each word between white space, or as many as the column ``tokens`` says, by any tokenizer. If the first turn's role is system it begins every window and
    counts in the budget; other system turns are turns like others. Every other turn is new in one window. Targets are the new turns
    of the TARGET role; what a window repeats is masked. A turn that doesn't fit with the system turn is a window by itself, whole
    and marked ``oversize``. Rows with a null conv_id or turn are left out; a null role is "user", a null text is empty. Equal rows
    are one turn; unequal rows of one turn number follow by role, then text. A conversation of a system turn alone is one window
    without targets. conv_id keeps its type. Other columns are not read, whatever their names. Texts are taken whole, however long. An
    empty table gives an empty result.
    """
    count = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\r\n]+")) if tokens is None else F.coalesce(F.col(f"`{tokens}`"), F.lit(0))
    rows = conversations.where("conv_id is not null and turn is not null").select(
        (count + FRAME).cast("bigint").alias("tokens"), "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = F.array_sort(F.array_distinct(F.collect_list(F.struct("turn", "role", "text", "tokens"))))
    grouped = rows.groupBy("conv_id").agg(turns.alias("turns"))
    schema = T.StructType([rows.schema["conv_id"], *(T.StructField(*c) for c in _COLUMNS)])
    kinds, names = [to_arrow_type(f.dataType) for f in schema.fields], schema.names

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            held, chars = [], 0
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in _conversation(conv, [tuple(t.values()) for t in turns.as_py()], budget, history):
                    held.append(row)
                    chars += len(row[9])
                    if chars > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                        held, chars = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return grouped.mapInArrow(batches, schema)


def flat(rows: DataFrame) -> DataFrame:
    """``windows`` with the target spans as a string, "start:end" with spaces between."""
    text = F.array_join(F.transform("targets", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), " ")
    return rows.withColumn("targets", text)


def windows_sql(budget: int = BUDGET, history: int = HISTORY) -> str:
    """``flat(windows(conversations))``: windows follow each other by recursion over prefix sums."""
    return rf"""
with recursive d as (
  select distinct conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null),
t as (
  select *, row_number() over (partition by conv_id order by turn, role, text) - 1 as k,
    len(regexp_extract_all(text, '[^ \t\r\n]+')) + {FRAME} as tokens from d),
s as (select conv_id, turn as system_turn, tokens as system_tokens, text as system_text from t where k = 0 and role = 'system'),
r as (
  select t.conv_id, turn, role, text, tokens, row_number() over w - 1 as i, sum(tokens) over w as upto, coalesce(system_tokens, 0) as system_tokens, system_text
  from t left join s using (conv_id) where not (k = 0 and role = 'system') window w as (partition by t.conv_id order by k)),
w as (
  select conv_id, 0 as n, 0::bigint as start from r where i = 0
  union all
  select w.conv_id, w.n + 1, x.stop from w, lateral (
    select max(e.i) + 1 as stop from r e
      join r b on b.conv_id = e.conv_id and b.i = w.start
      join (select min(h.i) as first from r h join r c on c.conv_id = h.conv_id and c.i = w.start where h.conv_id = w.conv_id and h.i <= w.start
            and (h.i = w.start or (c.upto - c.tokens) - (h.upto - h.tokens) <= least({history}, {budget} - c.system_tokens - c.tokens))) f on true
      join r g on g.conv_id = e.conv_id and g.i = f.first
      where e.conv_id = w.conv_id and e.i >= w.start and (e.i = w.start or e.upto - (g.upto - g.tokens) <= {budget} - e.system_tokens)) x
  where exists (select 1 from r z where z.conv_id = w.conv_id and z.i = x.stop)),
n as (
  select w.*, coalesce(lead(start) over (partition by conv_id order by n), (select count(*) from r where r.conv_id = w.conv_id)) as stop from w),
f as (
  select n.*, (select min(h.i) from r h, r c where h.conv_id = n.conv_id and c.conv_id = n.conv_id and c.i = n.start and h.i <= n.start
    and (h.i = n.start or (c.upto - c.tokens) - (h.upto - h.tokens) <= least({history}, {budget} - c.system_tokens - c.tokens))) as first from n),
p as (
  select f.conv_id, f.n, i, turn, role, text, tokens, i >= start as fresh, i = start as opens from f join r on r.conv_id = f.conv_id and i >= first and i < stop
  union all
  select f.conv_id, f.n, -1, system_turn, 'system', system_text, system_tokens, false, false from f join s using (conv_id)
  union all
  select conv_id, 0, -1, system_turn, 'system', system_text, system_tokens, false, false from s where conv_id not in (select conv_id from r)),
q as (
  select *, length(role) + 5 as head, sum(length(role) + length(text) + 13) over (partition by conv_id, n order by i) - (length(role) + length(text) + 13) as pos,
    role = '{TARGET}' and fresh as target from p)
select conv_id, n::int as "window", coalesce(min(turn) filter (i >= 0), min(turn)) as first_turn, coalesce(min(turn) filter (opens), min(turn)) as new_turn,
  max(turn) as last_turn, count(*)::int as n_turns, sum(tokens)::bigint as n_tokens, coalesce(sum(tokens - {FRAME}) filter (target), 0)::bigint as n_target_tokens,
  sum(tokens) > {budget} as oversize, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by i) as text,
  coalesce(string_agg((pos + head)::bigint || ':' || (pos + head + length(text) + 7)::bigint, ' ' order by i) filter (target), '') as targets
from q group by conv_id, n"""
