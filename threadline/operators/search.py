"""Generated DDL, the unified DDL table, and ranked text search."""

from __future__ import annotations

import re
import unicodedata

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadline.functions import ddl
from threadline.functions import stem as stemming

# Ranking parameters, result limit and snippet length.
BM25_K = 1.2
BM25_B = 0.75
SEARCH_RESULTS = 100
SNIPPET_CHARS = 150


def table_ddl(columns: DataFrame) -> DataFrame:
    """CREATE TABLE text per table with columns (``correct_object_id`` known), in column order."""
    line = ddl.column_line(*[F.col(c) for c in ("column_name", "data_type", "max_length", "precision", "scale", "is_nullable")])
    body = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("column_id", line.alias("line")))), lambda x: x["line"]), ",\n"
    )
    return (
        columns.where("correct_object_id IS NOT NULL")
        .groupBy(F.col("correct_object_id").alias("object_id"), "schema_name", F.col("table_name").alias("object_name"))
        .agg(body.alias("_body"))
        .select(
            "object_id",
            "schema_name",
            "object_name",
            F.lit("Table").alias("object_type"),
            ddl.create_table(F.col("schema_name"), F.col("object_name"), F.col("_body")).alias("ddl_text"),
        )
    )


def fallback_ddl(objects: DataFrame, columns: DataFrame) -> DataFrame:
    """A placeholder text for tables without any known column."""
    described = columns.where("correct_object_id IS NOT NULL").select(F.col("correct_object_id").alias("object_id")).distinct()
    return (
        objects.where("object_type = 'Table'")
        .join(described, "object_id", "left_anti")
        .select(
            "object_id",
            "schema_name",
            "object_name",
            "object_type",
            ddl.create_table(F.col("schema_name"), F.col("object_name"), F.lit(ddl.NO_COLUMNS)).alias("ddl_text"),
        )
    )


def unified_ddl(objects: DataFrame, definitions: DataFrame, columns: DataFrame) -> DataFrame:
    """Text of every object: stored text of procedures and views, generated text of tables."""
    coded = objects.where(F.col("object_type").isin("Stored Procedure", "View")).select(
        "object_id", "schema_name", "object_name", "object_type"
    )
    stored = coded.join(definitions, "object_id").withColumnRenamed("definition", "ddl_text")
    return stored.unionByName(table_ddl(columns)).unionByName(fallback_ddl(objects, columns))


def get_ddl(unified: DataFrame, object_id: int) -> DataFrame:
    return unified.where(F.col("object_id") == object_id)


def _accent_map() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decompositions."""
    plain = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii() and base.isalpha():
            plain[chr(code)] = base
    return "".join(plain), "".join(plain.values())


def pieces(text: Column, fold_accents: bool = False) -> Column:
    """The text cut at everything but a-z after lower-casing, optionally with accents folded first."""
    if fold_accents:
        text = F.translate(text, *_accent_map())
    return F.split(F.lower(text), "[^a-z]+")


def stem(terms: Column | str) -> Column:
    """Porter stems of a word column."""
    # Shipped by value, so executors need no installed copy of this package.
    cloudpickle.register_pickle_by_value(stemming)
    # Declared non-deterministic so that the optimizer does not copy the call into filters.
    return F.pandas_udf(stemming.stem_batches, T.StringType()).asNondeterministic()(terms)


class TextIndex:
    """Postings (term, id, tf, length) and document lengths (id, length) of a text collection.

    Postings repeat the document length, so ranking needs no lookup per hit. How the texts were cut
    into terms belongs to the index and is stored with it, so that queries are cut alike.
    """

    def __init__(
        self, postings: DataFrame, lengths: DataFrame, stemmed: bool, fold_accents: bool, stop_words: tuple[str, ...] = ()
    ):
        self.postings = postings
        self.lengths = lengths
        self.stemmed = stemmed
        self.fold_accents = fold_accents
        self.stop_words = tuple(stop_words)

    def document_frequencies(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def write(self, folder: str, buckets: int = 64) -> None:
        """Persist the index with postings partitioned by a hash of the term, so that a query
        reads only the folders of its own terms. Buckets are evened out by size, so the postings
        of a frequent term are spread over as many files as their size asks for."""
        spark = self.postings.sparkSession
        keyed = self.postings.withColumn("bucket", term_bucket(F.col("term"), buckets))
        keyed.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{folder}/postings")
        self.lengths.write.parquet(f"{folder}/lengths")
        settings = (self.stemmed, self.fold_accents, list(self.stop_words), buckets)
        spark.createDataFrame([settings], SETTINGS).coalesce(1).write.parquet(f"{folder}/settings")

    @staticmethod
    def load(spark: SparkSession, folder: str, query: str | None = None) -> TextIndex:
        """A written index; with a ``query`` only the folders that can hold its words are read."""
        own = spark.read.schema(SETTINGS).parquet(f"{folder}/settings").first()
        index = TextIndex(
            spark.read.parquet(f"{folder}/postings"),
            spark.read.parquet(f"{folder}/lengths"),
            own["stemmed"],
            own["fold_accents"],
            tuple(own["stop_words"]),
        )
        if query is not None:
            terms = query_terms(query, index)
            hit = F.lit(False)
            for term in terms:
                hit = hit | (F.col("bucket") == term_bucket(F.lit(term), own["buckets"]))
            index.postings = index.postings.where(hit & F.col("term").isin(*terms) if terms else F.lit(False))
        index.postings = index.postings.drop("bucket")
        return index


SETTINGS = "stemmed boolean, fold_accents boolean, stop_words array<string>, buckets int"


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(
    docs: DataFrame,
    id_col: str,
    text_cols: list[str],
    stop_words: list[str] | None = None,
    stemmed: bool = False,
    fold_accents: bool = False,
) -> TextIndex:
    """Index the joined text columns of every document, whole texts."""
    none = F.array().cast("array<string>")
    cut = F.flatten(F.array(*[F.coalesce(pieces(F.col(c), fold_accents), none) for c in text_cols]))
    base = docs.select(F.col(id_col).alias("id"), cut.alias("pieces"))
    # Exploding an expression, not a column, keeps the optimizer from deriving a size filter
    # that would cut every text twice.
    words = F.filter("pieces", lambda w: (w != "") & ~w.isin(*stop_words) if stop_words else w != "")
    # The length is fixed below the explode; next to it, it would be computed per word.
    sized = base.select("id", F.size(words).cast("bigint").alias("length"), "pieces")
    lengths = sized.select("id", "length")
    term_rows = sized.select("id", "length", F.explode(words).alias("term"))
    # All words of a document are in one task, so counting merges them before the shuffle.
    postings = term_rows.groupBy("id", "term").agg(F.count("*").alias("tf"), F.max("length").alias("length"))
    if stemmed:
        stems = postings.withColumn("term", stem("term"))
        postings = stems.groupBy("id", "term").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
    return TextIndex(postings.select("term", "id", "tf", "length"), lengths, stemmed, fold_accents, tuple(stop_words or ()))


def query_words(text: str, fold_accents: bool = False) -> list[str]:
    """The words of a query in order, cut as :func:`pieces` cuts texts."""
    text = text.lower()
    if fold_accents:
        text = text.translate(str.maketrans(*_accent_map()))
    return [w for w in re.split("[^a-z]+", text) if w]


def query_terms(query: str, index: TextIndex) -> list[str]:
    """The words of a query as the index has them; its stop words count for nothing."""
    words = [w for w in query_words(query, index.fold_accents) if w not in index.stop_words]
    return sorted({stemming.porter_stem(w) if index.stemmed else w for w in words})


def search(
    index: TextIndex,
    query: str,
    k: int | None = SEARCH_RESULTS,
    mode: str = "any",
    k1: float = BM25_K,
    b: float = BM25_B,
) -> DataFrame:
    """(id, score) by BM25, best first, ties by id.

    ``any`` ranks documents with at least one term, ``all`` those with every term, ``prefix``
    takes each query word as the start of a term. ``k=None`` returns every hit.
    """
    terms = query_terms(query, index)
    if mode == "prefix":
        hit = F.lit(False)
        for term in terms:
            hit = hit | F.col("term").startswith(term)
    elif mode in ("any", "all"):
        hit = F.col("term").isin(*terms) if terms else F.lit(False)
    else:
        raise ValueError(f"unknown mode: {mode}")
    found = index.postings.where(hit)
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    if mode != "prefix":
        df = F.broadcast(df)  # one row per query word at most
    stats = index.lengths.agg(F.struct(F.count("*").alias("n"), F.avg("length").alias("mean")).alias("stats")).scalar()
    total, mean = stats["n"], stats["mean"]
    idf = F.log((total - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    scored = (
        found.join(df, "term")
        .groupBy("id")
        .agg(F.round(F.sum(idf * weight), 6).alias("score"), F.count_distinct("term").alias("_terms"))
    )
    if mode == "all":
        scored = scored.where(F.col("_terms") == len(terms))
    ranked = scored.select("id", "score").orderBy(F.desc("score"), "id")
    return ranked if k is None else ranked.limit(k)


def search_phrase(docs: DataFrame, phrase: str, id_col: str, text_col: str) -> DataFrame:
    """Documents that have the words of the phrase one after another, whatever stands between them but letters."""
    words = [w for w in re.split("[^a-z]+", phrase.lower()) if w]
    if not words:
        return docs.limit(0).select(F.col(id_col).alias("id"))
    pattern = "(?<![a-z])" + "[^a-z]+".join(words) + "(?![a-z])"
    return docs.where(F.lower(text_col).rlike(pattern)).select(F.col(id_col).alias("id"))


def with_snippets(hits: DataFrame, docs: DataFrame, id_col: str, text_col: str, chars: int = SNIPPET_CHARS) -> DataFrame:
    """Hits with the first characters of their text. The hits are the small side: filter first."""
    texts = docs.select(F.col(id_col).alias("id"), F.substring(text_col, 1, chars).alias("snippet"))
    return hits.join(texts, "id")


def scored_search(nodes: DataFrame, term: str) -> DataFrame:
    """Substring search: name start 10 or inside 5, description 2, text 1.

    The snippet is the name, the start of the description (preferred when it matches), or the
    text around its first match.
    """
    needle = F.lit(term.lower())
    name, description, text = F.lower("name"), F.lower("description"), F.lower("ddl_text")
    in_name = F.coalesce(F.contains(name, needle), F.lit(False))
    in_description = F.coalesce(F.contains(description, needle), F.lit(False))
    in_text = F.coalesce(F.contains(text, needle), F.lit(False))
    score = (
        F.when(in_name & name.startswith(term.lower()), 10).when(in_name, 5).otherwise(0)
        + F.when(in_description, 2).otherwise(0)
        + F.when(in_text, 1).otherwise(0)
    )
    at = F.instr(text, needle) - 1
    begin = F.greatest(at - 50, F.lit(0))
    around = F.concat(F.lit("..."), F.substring(F.col("ddl_text"), begin + 1, at + 100 - begin), F.lit("..."))
    snippet = (
        F.when(in_description, F.substring("description", 1, SNIPPET_CHARS)).when(in_name, F.col("name")).when(in_text, around)
    )
    return (
        nodes.withColumn("score", score)
        .where("score > 0")
        .select("id", "name", F.col("object_type").alias("type"), "schema", "score", snippet.alias("snippet"))
    )


def filter_hits(hits: DataFrame, schemas: list[str] | None = None, types: list[str] | None = None, ordered: bool = True) -> DataFrame:
    """Hits of the chosen schemas and types (None or empty: all), best first."""
    if schemas:
        hits = hits.where(F.col("schema").isin(*schemas))
    if types:
        hits = hits.where(F.col("type").isin(*types))
    return hits.orderBy(F.desc("score"), "id") if ordered else hits
