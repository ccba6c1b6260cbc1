"""Best-fit packing with large-item matching, planned on the histogram of sizes and carried out by rank."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import checkpointed, join_checked, local_table

#: Tokens in a bin.
CAPACITY = 2048
#: Items of one size are ranked in shares of about so many, so that a frequent size isn't one task's work.
SHARE_ROWS = 1 << 20


class _Gaps:
    """Bins by their gap: for each gap the groups (first bin, bins) that have it, in order."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.groups: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, bins: int) -> None:
        if bins <= 0 or gap <= 0:
            return
        if gap not in self.groups:
            self.groups[gap] = []
            insort(self.sizes, gap)
        insort(self.groups[gap], (first, bins))

    def tightest(self, size: int) -> tuple[int, int, int] | None:
        """Take out (gap, first bin, bins) of the least gap of ``size`` or more."""
        i = bisect_left(self.sizes, size)
        if i == len(self.sizes):
            return None
        gap = self.sizes[i]
        first, bins = self.groups[gap].pop(0)
        if not self.groups[gap]:
            del self.groups[gap], self.sizes[i]
        return gap, first, bins


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(steps, number of bins) for the number of items of each size from 1 to ``capacity``.

    A step (size, rank, items, bin, per_bin, offset) puts the items of that size whose ranks are rank, rank + 1, ... into bins
    from bin on, per_bin to each, the first at offset. Large items are those over a third of the capacity. From the largest down, each
    opens a bin and takes as partner the largest other large item that fits, so a bin has two at most. The others, from the largest
    down, go to the bin with the least gap that holds them, or to a new one; among equal gaps to the first bin. Items of one size are
    alike, so steps move whole counts, and their number depends on the sizes, not on the number of items.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    used: dict[int, int] = defaultdict(int)
    steps: list[tuple[int, int, int, int, int, int]] = []
    gaps, bins = _Gaps(), 0
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        i = bisect_right(large, capacity - size)
        partner = large[i - 1] if i else None
        if partner == size and left[size] == 1:
            partner = large[i - 2] if i > 1 else None
        if partner is None:
            n = left[size]
            steps.append((size, used[size], n, bins, 1, 0))
            gaps.add(capacity - size, bins, n)
        elif partner == size:
            n = left[size] // 2
            steps.append((size, used[size], 2 * n, bins, 2, 0))
            gaps.add(capacity - 2 * size, bins, n)
            used[size] += n
            left[size] -= n
        else:
            n = min(left[size], left[partner])
            steps += [(size, used[size], n, bins, 1, 0), (partner, used[partner], n, bins, 1, size)]
            gaps.add(capacity - size - partner, bins, n)
            used[partner] += n
            left[partner] -= n
            if not left[partner]:
                large.remove(partner)
        bins += n
        used[size] += n
        left[size] -= n
        if not left[size]:
            large.remove(size)
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n, rank = left[size], 0
        while n:
            found = gaps.tightest(size)
            if found is None:
                each = capacity // size
                found = (capacity, bins, -(-n // each))
                bins += found[2]
            gap, first, have = found
            each = gap // size
            full = min(have, n // each)
            if full:
                steps.append((size, rank, full * each, first, each, capacity - gap))
                gaps.add(gap - each * size, first, full)
                rank, n, first, have = rank + full * each, n - full * each, first + full, have - full
            if n and have and n < each:
                steps.append((size, rank, n, first, each, capacity - gap))
                gaps.add(gap - n * size, first, 1)
                rank, n, first, have = rank + n, 0, first + 1, have - 1
            gaps.add(gap, first, have)
    return steps, bins


def token_counts(text):
    """Words between white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def pack(docs: DataFrame, capacity: int = CAPACITY, size: str | None = None) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, bin, offset): where every token of ``docs`` goes.

    Tokens are words between white space, or as many as the column ``size`` says, by any tokenizer. A document longer than a bin gives
    full pieces and a rest; a full piece is a bin by itself. Items of one size are taken share by share (hash values of doc_id and
    piece), within a share by doc_id and piece, nulls first. A document without tokens (null and empty texts, a null ``size``) has one
    row with n_tokens 0 and no bin. doc_id keeps its type. Rows that repeat a doc_id are items of their own; which of those of one size
    comes first is of no effect on the bins' sizes. Other columns are not read, whatever their names. An empty table gives an empty
    result. The driver holds a row for each size (``capacity`` at most) and for each SHARE_ROWS items.
    """
    count = token_counts(F.col("text")) if size is None else F.coalesce(F.greatest(F.col(f"`{size}`"), F.lit(0)), F.lit(0))
    sized = docs.select("doc_id", count.cast("bigint").alias("n"))
    last = F.greatest(F.lit(0), F.floor((F.col("n") - 1) / capacity)).cast("int")
    items = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece").cast("bigint") * capacity
    items = checkpointed(items.select("doc_id", "piece", first.alias("first_token"), F.least(F.lit(capacity), F.col("n") - first).alias("n_tokens")))
    histogram = {r[0]: r[1] for r in items.where("n_tokens > 0").groupBy("n_tokens").count().collect()}  # capacity rows at most
    spark = docs.sparkSession
    parts = local_table(spark, [(s, 1 + n // SHARE_ROWS) for s, n in sorted(histogram.items())], "_size bigint, _parts bigint")
    ranked = items.join(F.broadcast(parts), F.col("n_tokens") == F.col("_size"))  # capacity rows at most
    ranked = ranked.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_parts")))
    # the rank counts shares one after the other; within a share it follows doc_id and piece
    local = F.row_number().over(Window.partitionBy("n_tokens", "share").orderBy("doc_id", "piece")) - 1
    ranked = checkpointed(ranked.select("doc_id", "piece", "first_token", "n_tokens", "share", local.alias("local")))
    counts = sorted(ranked.groupBy("n_tokens", "share").count().collect())  # a row for each SHARE_ROWS items
    before, upto = [], defaultdict(int)
    for n_tokens, part, n in counts:
        before.append((n_tokens, part, upto[n_tokens]))
        upto[n_tokens] += n
    steps: dict[int, list] = defaultdict(list)
    for n_tokens, rank, _n, first_bin, each, offset in sorted(plan(histogram, capacity)[0]):
        steps[n_tokens].append((rank, first_bin, each, offset))
    table = local_table(spark, [(s, [x[0] for x in v], v) for s, v in steps.items()], "_size bigint, _ranks array<bigint>, _steps array<struct<rank:bigint,first:bigint,each:bigint,offset:bigint>>")
    bases = local_table(spark, before, "_of bigint, _share bigint, _base bigint")
    rows = join_checked(ranked, bases, (F.col("n_tokens") == F.col("_of")) & (F.col("share") == F.col("_share")), "inner", row_bytes=48, rows=len(before))
    rows = rows.join(F.broadcast(table), F.col("n_tokens") == F.col("_size"))  # a row a size; its steps depend on the sizes alone
    rows = rows.withColumn("_rank", F.col("local") + F.col("_base"))
    rows = rows.withColumn("_step", F.element_at("_steps", F.size(F.filter("_ranks", lambda r: r <= F.col("_rank")))))
    done = F.col("_rank") - F.col("_step.rank")
    where = (F.col("_step.first") + F.floor(done / F.col("_step.each"))).cast("bigint"), (F.col("_step.offset") + F.pmod(done, F.col("_step.each")) * F.col("n_tokens")).cast("bigint")
    placed = rows.select("doc_id", "piece", "first_token", "n_tokens", where[0].alias("bin"), where[1].alias("offset"))
    nothing = F.lit(None).cast("bigint")
    return placed.unionByName(items.where("n_tokens <= 0").select("doc_id", "piece", "first_token", "n_tokens", nothing.alias("bin"), nothing.alias("offset")))


def bins(places: DataFrame) -> DataFrame:
    """(bin, n_tokens, pieces): a row for each bin of ``pack``, with its pieces (offset, doc_id, piece, first_token, n_tokens) in order.

    ``offset`` is where a piece begins in the bin, so the offsets are the boundaries that attention must not cross; the pieces follow on
    each other without a gap, and what is left of the bin is behind them. A bin has as many pieces as tokens at most. Documents without
    tokens are in no bin.
    """
    piece = F.struct("offset", "doc_id", "piece", "first_token", "n_tokens")
    return places.where("bin is not null").groupBy("bin").agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(piece)).alias("pieces"))
