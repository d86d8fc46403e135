"""Texts to embed, vectors written back, and exact nearest episodes by cosine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_loom.operators import nearby
from catalog_loom.sources.files import written
from catalog_loom.sources.keyed import KeyedTable


def to_embed(episodes: DataFrame) -> DataFrame:
    return episodes.where("embedding is null and description is not null")


def labelled_text(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))


def embedding_text(docs: DataFrame) -> DataFrame:
    """docs(episode_id, title, series_name, description, genres array, speakers array) with the text to embed; absent
    parts are left out."""
    joined = lambda c: F.array_join(c, ", ")
    parts = [labelled_text("Titel: ", F.col("title")), labelled_text("Serie: ", F.col("series_name")), labelled_text("Beschreibung: ", F.col("description")),
             labelled_text("Genre: ", joined(F.col("genres"))), labelled_text("Sprecher: ", joined(F.array_sort(F.array_distinct(F.col("speakers")))))]
    return docs.select("episode_id", F.concat_ws(" | ", *parts).alias("text"))


ATTEMPTS = "episode_id bigint, embedding array<float>, error string, attempt int"


def embed(texts: DataFrame, batch_function: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """episode_id, embedding, error and attempt of texts(episode_id, text, and attempt if there were any before). A batch whose
    call fails is halved until the texts that fail by themselves are found; these have the error and no vector, and stop no
    others. The rows are written, so that no call is made twice."""

    def called(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            vectors = batch_function(texts)
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors of {len(texts)} texts")
            return [(v, None) for v in vectors]
        except Exception as e:  # noqa: BLE001  the caller's function may fail in any way
            if len(texts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            half = len(texts) // 2
            return called(texts[:half]) + called(texts[half:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                vectors, errors = zip(*called(part["text"].to_pylist()), strict=True)
                columns = [part["episode_id"], pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string()), part["attempt"]]
                yield pa.RecordBatch.from_arrays(columns, ["episode_id", "embedding", "error", "attempt"])

    attempt = (F.coalesce("attempt", F.lit(0)) + 1 if "attempt" in texts.columns else F.lit(1)).cast("int").alias("attempt")
    return written(texts.select(F.col("episode_id").cast("long").alias("episode_id"), "text", attempt).mapInArrow(run, ATTEMPTS), "attempts")


def failures(attempts: DataFrame) -> DataFrame:
    """episode_id, error, attempt of the texts that have no vector yet."""
    return attempts.where("error is not null").select("episode_id", "error", "attempt")


def to_resume(texts: DataFrame, ledger: DataFrame) -> DataFrame:
    """episode_id, text and attempt of what has no vector in ledger(episode_id, embedding, error, attempt): texts that failed, and
    new ones."""
    last = ledger.select("episode_id", "attempt", F.col("error").isNull().alias("done"))
    rows = texts.select("episode_id", "text").join(last, "episode_id", "left").where("done is null or not done")
    return rows.select("episode_id", "text", F.coalesce("attempt", F.lit(0)).alias("attempt"))


def embed_into(ledger: KeyedTable, texts: DataFrame, batch_function: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """Embed what has no vector in the ledger, a table of ATTEMPTS by episode_id, and put the outcome there; only buckets with such
    texts are written. Returns what failed."""
    attempts = embed(to_resume(texts, ledger.read()), batch_function, batch)
    ledger.upsert(attempts)
    return failures(attempts)


def write_back(episodes: DataFrame, vectors: DataFrame) -> DataFrame:
    new = vectors.select(F.col("episode_id").alias("id"), F.col("embedding").alias("new_embedding"))
    return episodes.join(new, "id", "left").withColumn("embedding", F.coalesce("new_embedding", "embedding")).select(episodes.columns)


def cosine(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), zero, lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """id, similarity of the k nearest; allowed(id) is applied before any scoring. Spark keeps k rows in each task."""
    rows = vectors.where("embedding is not null")
    if allowed is not None:
        rows = rows.join(allowed.select("id").distinct(), "id", "left_semi")
    wanted = F.array(*[F.lit(float(x)) for x in query])
    return rows.select("id", cosine(F.col("embedding"), wanted).alias("similarity")).orderBy(F.desc_nulls_last("similarity"), "id").limit(k)


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, similarity, rank: the k nearest of each of many queries(query_id, embedding); see nearby."""
    return nearby.search(vectors, queries, k)[0]


def hit_context(hits: DataFrame) -> DataFrame:
    """query_id, episode_id, place, text of each hit: a line with title, series, number and year, then the description."""
    year = F.when(F.col("release_year").isNotNull(), F.concat(F.lit("("), F.col("release_year").cast("string"), F.lit(")")))
    number = F.when(F.col("episode_number").isNotNull(), F.concat(F.lit("Folge "), F.col("episode_number").cast("string")))
    head = F.concat_ws(" | ", F.concat(F.lit("**"), "episode_title", F.lit("**")), labelled_text("Serie: ", F.col("series_name")), number, year)
    return hits.select("query_id", "episode_id", "place", F.concat_ws("\n", head, "description").alias("text"))


def context(texts: DataFrame, query: str = "query_id") -> DataFrame:
    """query, context: all hits of each query as one text, divided by blank lines. A query has k hits at most."""
    rows = F.array_sort(F.collect_list(F.struct("place", "episode_id", "text")))
    return texts.groupBy(query).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("context"))
