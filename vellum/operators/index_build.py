"""From documents to an inverted index, in built-in expressions but for texts of which tokens are only counted or sought (``functions.scan``).

Tables of an index (a snapshot holds one DataFrame of each):

    docs         segment_id, doc_ord, doc_id, doc       the stored fields as a struct
    postings     segment_id, field, term, doc_ord, tf, positions, length
    term_stats   segment_id, field, term, df
    field_stats  segment_id, field, doc_count, avg_length
    meta         segment_id, seg_ord, doc_count
    tombstones   segment_id, doc_id
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import IndexConfig
from vellum.functions.analysis import Analyzer
from vellum.functions.render import render

TABLES = ("docs", "postings", "term_stats", "field_stats", "meta", "tombstones")
#: Whether the postings of a field and a term are asked for.
Wanted = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Listed:
    """Wants the postings of some terms, of whatever field."""

    terms: tuple[str, ...]

    def __call__(self, field: Column, term: Column) -> Column:
        return term.isin(*self.terms) if self.terms else F.lit(False)


@dataclass
class Snapshot:
    docs: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    field_stats: DataFrame
    meta: DataFrame
    tombstones: DataFrame | None
    fields: list[str]
    deleted: int | None = None  # how many tombstones and segments there are, where that is known
    segments: int | None = None
    source: tuple[DataFrame, IndexConfig] | None = None  # documents without stored postings: a search makes those that it asks for

    def persist(self) -> Snapshot:
        """Keeps what every search reads; ``unpersist`` lets it go."""
        return replace(self, source=None, **{t: getattr(self, t).persist() for t in TABLES[1:5]})

    def select(self, wanted: Wanted) -> DataFrame:
        """The postings that are asked for, with df."""
        if self.source is None:
            hit = wanted(F.col("field"), F.col("term"))
            return self.postings.where(hit).join(self.term_stats.where(hit), ["segment_id", "field", "term"])
        # All postings of a wanted term are there, so they are counted where they meet, and documents are analyzed once.
        return postings(*self.source, wanted).withColumn("df", F.count("*").over(Window.partitionBy("segment_id", "field", "term")))

    def unpersist(self) -> None:
        for t in TABLES[1:5]:
            getattr(self, t).unpersist()


def with_ids(docs: DataFrame, segment: Column, ordinal: Column) -> DataFrame:
    """Adds segment_id, doc_ord and doc_id (``id`` as text, or ``doc-<ordinal>`` where it is missing)."""
    given = render(F.col("id"), docs.schema["id"].dataType) if "id" in docs.columns else F.lit(None).cast("string")
    return docs.select("*", segment.cast("string").alias("segment_id"), ordinal.cast("bigint").alias("doc_ord")).withColumn("doc_id", F.coalesce(given, F.concat(F.lit("doc-"), F.col("doc_ord").cast("string"))))


def stored(docs: DataFrame, config: IndexConfig) -> DataFrame:
    """(segment_id, doc_ord, doc_id, doc): fields that are stored; ``id`` always is."""
    keep = [c for c in docs.columns if c not in ("segment_id", "doc_ord", "doc_id", "id") and c not in config.no_store]
    return docs.select("segment_id", "doc_ord", "doc_id", F.struct(F.col("doc_id").alias("id"), *[F.col(c) for c in keep]).alias("doc"))


def tokens(docs: DataFrame, config: IndexConfig) -> DataFrame:
    """(segment_id, doc_ord, field, term, position) of every kept token of every indexed field."""
    names = [c for c in docs.columns if c not in ("segment_id", "doc_ord", "doc_id") and c not in config.no_index]
    per_field = [F.struct(F.lit(c).alias("field"), config.analyzer(c).column(render(F.col(c), docs.schema[c].dataType)).alias("tokens")) for c in names]
    if not per_field:
        return docs.select("segment_id", "doc_ord", F.lit("").alias("field"), F.lit("").alias("term"), F.lit(0).alias("position")).limit(0)
    each = docs.select("segment_id", "doc_ord", F.explode(F.array(*per_field)).alias("f"))
    return each.select("segment_id", "doc_ord", F.col("f.field").alias("field"), F.explode_outer("f.tokens").alias("t")).where("t is not null").select("segment_id", "doc_ord", "field", "t.term", "t.position")


def field_lengths(toks: DataFrame) -> DataFrame:
    return toks.groupBy("segment_id", "doc_ord", "field").agg(F.count("*").cast("int").alias("length"))


def field_stats(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("segment_id", "field").agg(F.count("*").alias("doc_count"), F.avg("length").alias("avg_length"))


def indexed(docs: DataFrame, config: IndexConfig) -> list[tuple[str, Analyzer, Column]]:
    """Name, analyzer and text of every indexed field."""
    names = [c for c in docs.columns if c not in ("segment_id", "doc_ord", "doc_id") and c not in config.no_index]
    return [(c, config.analyzer(c), render(F.col(c), docs.schema[c].dataType)) for c in names]


def analyzed(docs: DataFrame, config: IndexConfig, wanted: Wanted | None = None) -> DataFrame | None:
    """(segment_id, doc_ord, field, tokens, length) of every document and indexed field; None where no field is indexed.

    With ``wanted``, of those alone that have a wanted token, and with these tokens alone.  No other is made or leaves its document, as a row
    with all tokens of a text is several times the text.
    """
    fields = indexed(docs, config)
    if not fields:
        return None
    if wanted is None:
        per_field = F.array(*[F.struct(F.lit(c).alias("field"), a.column(text).alias("tokens")) for c, a, text in fields])
        each = docs.select("segment_id", "doc_ord", F.explode(per_field).alias("f")).select("segment_id", "doc_ord", "f.field", "f.tokens")
        return each.withColumn("length", F.size("tokens"))

    def of(name: str, found: Column) -> Column:
        return F.transform(found, lambda h: F.struct(F.lit(name).alias("field"), h["tokens"].alias("tokens"), h["length"].alias("length")))

    terms = wanted.terms if isinstance(wanted, Listed) else None
    sought = [of(c, a.sought(text, partial(wanted, F.lit(c)), terms)) for c, a, text in fields]
    return docs.select("segment_id", "doc_ord", F.explode(F.flatten(F.array(*sought))).alias("f")).select("segment_id", "doc_ord", "f.field", "f.tokens", "f.length")


def lengths_of(docs: DataFrame, config: IndexConfig) -> DataFrame:
    """(segment_id, field, doc_ord, length) of every field with a token, made without a shuffle, postings or tokens."""
    fields = indexed(docs, config)
    if not fields:
        return docs.sparkSession.createDataFrame([], "segment_id string, field string, doc_ord bigint, length int")
    counts = F.array(*[F.struct(F.lit(c).alias("field"), a.count(text).alias("length")) for c, a, text in fields])
    each = docs.select("segment_id", "doc_ord", F.explode(counts).alias("f"))
    return each.select("segment_id", "f.field", "doc_ord", "f.length").where("length > 0")


def postings(docs: DataFrame, config: IndexConfig, wanted: Wanted | None = None) -> DataFrame:
    """(segment_id, field, term, doc_ord, tf, positions, length), made without a shuffle; ``wanted`` says which, all of them by default.

    A document's tokens of a field are one array, so term frequencies, positions and the field's length come from that array alone.
    """
    each = analyzed(docs, config, wanted)
    schema = "segment_id string, field string, term string, doc_ord bigint, tf int, positions array<int>, length int"
    if each is None:
        return docs.sparkSession.createDataFrame([], schema)
    # Sorted by (term, position), tokens of one term stand together: each run is one posting.  Postings are made before the array is
    # exploded, so that no row carries the tokens of its document along.
    each = each.withColumn("tokens", F.sort_array("tokens")).withColumn("kept", F.size("tokens"))
    at = F.when(F.col("kept") > 0, F.sequence(F.lit(0), F.col("kept") - 1)).otherwise(F.array().cast("array<int>"))
    each = each.withColumn("heads", F.filter(at, lambda i: (i == 0) | (F.get("tokens", i)["term"] != F.get("tokens", i - 1)["term"])))
    ends = F.concat(F.slice("heads", 2, F.greatest(F.size("heads") - 1, F.lit(0))), F.array("kept"))
    places = lambda a, z: F.transform(F.slice("tokens", a + 1, z - a), lambda t: t["position"])
    made = F.zip_with("heads", ends, lambda a, z: F.when(a.isNotNull(), F.struct(F.get("tokens", a)["term"].alias("term"), (z - a).alias("tf"), places(a, z).alias("positions"))))
    each = each.select("segment_id", "doc_ord", "field", "length", F.explode_outer(made).alias("p")).where("p is not null")
    return each.select("segment_id", "field", "p.term", "doc_ord", "p.tf", "p.positions", "length")


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("segment_id", "field", "term").agg(F.count("*").alias("df"))


def spread(docs: DataFrame) -> DataFrame:
    """The same rows in as many partitions as there are cores at least: a small table of one file is one task, however long it takes."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def segment_meta(docs: DataFrame) -> DataFrame:
    return docs.groupBy("segment_id").agg(F.count("*").alias("doc_count"), F.min("doc_ord").alias("seg_ord"))


def snapshot(docs: DataFrame, config: IndexConfig, fields: list[str] | None = None) -> Snapshot:
    """The index of documents that carry segment_id, doc_ord and doc_id."""
    post = postings(docs, config)
    lengths = post.select("segment_id", "field", "doc_ord", "length").distinct()
    names = fields or [c for c in docs.columns if c not in ("segment_id", "doc_ord", "doc_id") and c not in config.no_index]
    return Snapshot(stored(docs, config), post, term_stats(post), field_stats(lengths), segment_meta(docs), None, names)


def unstored(docs: DataFrame, config: IndexConfig) -> Snapshot:
    """The same index with nothing kept but the statistics of fields and segments: each search makes the postings of its terms from the documents."""
    snap = snapshot(docs, config)
    stats = field_stats(lengths_of(docs, config)).persist()
    return replace(snap, field_stats=stats, meta=snap.meta.persist(), source=(docs, config))
