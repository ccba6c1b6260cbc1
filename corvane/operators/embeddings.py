"""Word embeddings: document sums, projection by hashed signs, removal of the common directions, a low-rank basis and a map of words."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that the driver may hold for a decomposition.
MAX_TRAINED = 20_000


def from_text(lines: DataFrame, keep: int | None = None, extra: DataFrame | None = None) -> DataFrame:
    """(word, vec) from lines "word x y z": lower case, the first line of a word wins; the first ``keep`` words, in the order of lines.

    ``lines``: (line_no, value), as of ``read_lines``. A heading of two numbers is no word. Words of ``extra`` (word) are kept wherever
    they stand.
    """
    parts = F.split(F.trim("value"), " +")
    rows = lines.where(F.size(parts) > 2).select("line_no", F.lower(parts[0]).alias("word"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.cast("float")).alias("vec"))
    first = rows.groupBy("word").agg(F.min_by("vec", "line_no").alias("vec"), F.min("line_no").alias("line_no"))
    kept = first.orderBy("line_no").limit(keep) if keep else first
    if keep and extra is not None:
        kept = kept.unionByName(first.join(extra.select(F.lower("word").alias("word")).distinct(), "word", "left_semi")).distinct()
    return kept.select("word", "vec")


def read_lines(spark, path: str) -> DataFrame:
    """(line_no, value) of a text file, packed by gzip or not; a packed file is one task's work, as it can't be split."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def digest(table: DataFrame) -> str:
    """A number of (word, vec) that doesn't depend on the order of rows, as hexadecimal digits."""
    row = F.xxhash64("word", "vec").cast("decimal(38,0)")
    n, total = table.agg(F.count("*"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{n}:{int(total)}".encode()).hexdigest()


def write_table(table: DataFrame, path: str, removed: int = 0) -> None:
    """(word, vec) as Parquet, with its digest and how many common directions were ``removed`` from it."""
    table.select("word", "vec").write.parquet(f"{path}/vectors")
    spark = table.sparkSession
    stored = spark.read.parquet(f"{path}/vectors")
    spark.createDataFrame([(digest(stored), removed)], "digest string, removed int").coalesce(1).write.parquet(f"{path}/about")


def open_table(spark, path: str, removed: int = 0, check: bool = True) -> DataFrame:
    """(word, vec) of ``write_table``; refused if other directions were removed than ``removed``, or the vectors aren't those written."""
    about = spark.read.parquet(f"{path}/about").first()
    table = spark.read.parquet(f"{path}/vectors")
    if about.removed != removed:
        raise ValueError(f"the table has {about.removed} common directions removed, not {removed}")
    if check and digest(table) != about.digest:
        raise ValueError("the vectors aren't those that were written")
    return table


def text_vectors(docs: DataFrame, encoder, text: str = "text") -> DataFrame:
    """(doc_id, vec): unit vectors of texts by ``encoder``, a function of a list of texts that gives a row of numbers for each.

    The numbers pass through 16 bits, as they are kept so. A null text counts as empty; a zero row stays zero.
    """

    @F.pandas_udf("array<float>")
    def encoded(column):
        import pandas as pd

        if not len(column):
            return pd.Series([], dtype=object)
        v = np.asarray(encoder(["" if t is None else t for t in column]), np.float64)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return pd.Series(list((v / np.where(n > 0, n, 1)).astype(np.float16).astype(np.float32)))

    return docs.select("doc_id", encoded(text).alias("vec"))


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def document_sums(terms: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, vec): the unit vector of the sum of idf * vector over a document's distinct content words. ``terms``: (doc_id, token, idf)."""
    places = terms.join(table.select(F.col("word").alias("token"), "vec"), "token").select("doc_id", "idf", F.posexplode("vec").alias("i", "x"))
    sums = places.groupBy("doc_id", "i").agg(F.sum(F.col("idf") * F.col("x")).alias("x"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])
    return sums.groupBy("doc_id").agg(unit(vec).alias("vec"))


def sign_matrix(d: int, dim: int, seed: str = "projection") -> np.ndarray:
    """Entries -1, 0, 1 with odds 1 : 4 : 1 from hashes of their place."""
    raw = b"".join(hashlib.sha256(f"{seed}:{i}:{b}".encode()).digest() for i in range(d) for b in range(-(-dim // 32)))
    r = np.frombuffer(raw, np.uint8).reshape(d, -1)[:, :dim]
    return np.where(r < 43, -1, np.where(r < 86, 1, 0)).astype(np.int8)


def projected(table: DataFrame, d: int, dim: int, vec: str = "vec") -> DataFrame:
    """``table`` with vec projected to ``dim`` places, scaled by sqrt(3 / dim)."""
    m = sign_matrix(d, dim).astype(np.float64) * (3 / dim) ** 0.5

    @F.pandas_udf("array<double>")
    def project(column):
        import pandas as pd

        return pd.Series(list(np.stack(column.to_numpy()).astype(np.float64) @ m)) if len(column) else column

    return table.withColumn(vec, project(vec))


def _moments(table: DataFrame, vec: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sum, sum of outer products), added up in batches where the rows are."""

    def batches(it):
        import pyarrow as pa

        n, s, m = 0, None, None
        for batch in it:
            x = np.array(batch.column(0).to_pylist(), np.float64)
            if len(x):
                n += len(x)
                s = x.sum(0) + (0 if s is None else s)
                m = x.T @ x + (0 if m is None else m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s]), pa.array([m.ravel()])], ["n", "s", "m"])

    rows = table.select(vec).mapInArrow(batches, "n bigint, s array<double>, m array<double>").collect()  # one row a task, of d * d numbers
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    d = len(rows[0][1])
    return sum(r[0] for r in rows), np.sum([r[1] for r in rows], 0), np.sum([np.reshape(r[2], (d, d)) for r in rows], 0)


def without_common(table: DataFrame, k: int = 2, vec: str = "vec") -> DataFrame:
    """``table`` less the mean and the first ``k`` principal directions; a direction's largest entry is made positive."""
    n, s, m = _moments(table, vec)
    if not n:
        return table
    mean = s / n
    _, axes = np.linalg.eigh(m / n - np.outer(mean, mean))
    top = axes[:, ::-1][:, :k].T
    top = top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(1)])[:, None]

    @F.pandas_udf("array<double>")
    def reduced(column):
        import pandas as pd

        x = np.stack(column.to_numpy()).astype(np.float64) - mean
        return pd.Series(list(x - x @ top.T @ top))

    return table.withColumn(vec, reduced(vec))


def nearest(table: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """(qid, doc_id, rank, score) of the words nearest to each asked word by cosine, itself left out. Both: (word, vec)."""
    from corvane.operators.vectors import cosine_scores, ranked

    scores = cosine_scores(table, asked, k + 1, doc_id="word", doc_vec="vec", query_id="word", query_vec="vec").where("qid <> doc_id")
    return ranked(scores, k).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


def smoothed(vectors: np.ndarray, rank: int, oversample: int = 10, seed: int = 7) -> np.ndarray:
    """The best approximation of ``rank`` by a randomized range finder; rank <= 0 gives the rows back. MAX_TRAINED rows at most."""
    if len(vectors) > MAX_TRAINED:
        raise ValueError(f"{len(vectors)} words are more than the driver may hold; {MAX_TRAINED} at most")
    if rank <= 0 or not len(vectors):
        return vectors
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(vectors @ rng.standard_normal((vectors.shape[1], min(rank + oversample, *vectors.shape))))
    for _ in range(2):
        q, _ = np.linalg.qr(vectors @ (vectors.T @ q))
    u, s, vt = np.linalg.svd(q.T @ vectors, full_matrices=False)
    return (q @ u[:, :rank]) * s[:rank] @ vt[:rank]


def word_map(table: DataFrame, side: int = 16, rounds: int = 30, seed: int = 42, vec: str = "vec", word: str = "word") -> DataFrame:
    """(token, cell): a self-organizing map of side * side cells, trained in batch rounds with a neighbourhood that narrows geometrically.

    Each round sends the prototypes out and adds up, where the rows are, what every cell wins; the words themselves stay distributed.
    """
    from pyspark.sql import SparkSession

    n, s, m = _moments(table, vec)
    spark = SparkSession.active()
    if not n:
        return spark.createDataFrame([], "token string, cell int")
    d = len(s)
    rng = np.random.default_rng(seed)
    mean = s / n
    cov = m / n - np.outer(mean, mean) + 1e-12 * np.eye(d)
    cells = rng.multivariate_normal(mean, cov, side * side, method="eigh")
    grid = np.stack(np.divmod(np.arange(side * side), side), 1)
    apart = ((grid[:, None] - grid[None]) ** 2).sum(2)
    wide = max(side / 8, 1.0)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(cells)

        def batches(it, shared=shared):
            import pyarrow as pa

            c = shared.value
            won, count = np.zeros_like(c), np.zeros(len(c))
            for batch in it:
                x = np.array(batch.column(0).to_pylist(), np.float64)
                if len(x):
                    at = (((c**2).sum(1)) - 2 * x @ c.T).argmin(1)
                    np.add.at(won, at, x)
                    count += np.bincount(at, minlength=len(c))
            yield pa.RecordBatch.from_arrays([pa.array([won.ravel()]), pa.array([count])], ["won", "count"])

        rows = table.select(vec).mapInArrow(batches, "won array<double>, count array<double>").collect()  # one row a task
        won, count = np.sum([r[0] for r in rows], 0).reshape(cells.shape), np.sum([r[1] for r in rows], 0)
        sigma = wide * (0.8 / wide) ** (r / max(1, rounds - 1))
        near = np.exp(-apart / (2 * sigma * sigma))
        mass = near @ count
        cells = np.where(mass[:, None] > 1e-9, near @ won / np.maximum(mass, 1e-9)[:, None], cells)
    final = spark.sparkContext.broadcast(cells)

    @F.pandas_udf("int")
    def cell(column):
        import pandas as pd

        c = final.value
        x = np.stack(column.to_numpy()).astype(np.float64)
        return pd.Series(((c**2).sum(1) - 2 * x @ c.T).argmin(1))

    return table.select(F.col(word).cast("string").alias("token"), cell(vec).alias("cell"))


def like(vectors: DataFrame, sets: DataFrame, k: int = 10, ident: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(sid, doc_id, rank, score): for each set what resembles its document, or the mean direction of its documents; these are left out.

    ``sets``: (sid, ident), each source once a set. Sources that aren't there are passed over; a set without any gives no row.
    """
    from corvane.operators.vectors import cosine_scores, ranked

    pairs = sets.select("sid", F.col(ident)).distinct()
    places = pairs.join(vectors.select(ident, vec), ident).select("sid", F.posexplode(unit(F.col(vec))).alias("i", "x"))
    means = places.groupBy("sid", "i").agg(F.avg("x").alias("x")).groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("q"))
    own = pairs.groupBy(ident).agg(F.collect_list("sid").alias("_own"))
    rows = vectors.select(ident, F.col(vec).cast("array<double>").alias("_vec")).join(own, ident, "left")
    scores = cosine_scores(rows, means, k, doc_id=ident, doc_vec="_vec", query_id="sid", own="_own")
    return ranked(scores, k).select(F.col("qid").alias("sid"), "doc_id", "rank", F.round("score", 6).alias("score"))
