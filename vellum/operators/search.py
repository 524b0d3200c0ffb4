"""Search of one query: match, score, exclude, filter, top K.

The plan reads the postings of the query's terms alone (the term list reaches the scan), aggregates once by document, and joins the stored
documents after the top K where no filter needs them before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.config import IndexConfig
from vellum.operators.index_build import Listed, Snapshot
from vellum.operators.scoring import BM25, Scorer
from vellum.plans.ast import Node
from vellum.plans.compile import Compiled, Condition, Leaf, PhraseIn, compile_query, wildcard_regex
from vellum.plans.parser import parse


TIE = 6
#: Rows up to which a side of a join is sent to all tasks.
BROADCAST_ROWS = 200_000


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False)) if conditions else F.lit(False)


def leaf_condition(leaf: Leaf, field: Column | None = None, term: Column | None = None) -> Column:
    """Whether a posting belongs to the leaf.  Patterns that only begin or end with a star become prefix, suffix or substring tests."""
    field, term = F.col("field") if field is None else field, F.col("term") if term is None else term
    if not leaf.regex:
        hit = term == leaf.term
    else:
        p = leaf.term.lower()
        core = p.strip("*")
        plain = core and "*" not in core and "?" not in core and core.isascii()
        if plain and p == core + "*":
            hit = term.startswith(core)
        elif plain and p == "*" + core:
            hit = term.endswith(core)
        elif plain and p == "*" + core + "*":
            hit = term.contains(core)
        else:
            hit = term.rlike(wildcard_regex(leaf.term))
    return hit if leaf.field is None else (field == leaf.field) & hit


def phrase_fits(phrase: PhraseIn, places: dict[tuple[str, str], Column]) -> Column:
    """Whether some place of the first word has every other word at its offset from there, within the slop."""
    (first, zero), rest = phrase.words[0], phrase.words[1:]
    have = reduce(lambda a, b: a & b, [places[phrase.field, t].isNotNull() for t, _ in phrase.words])

    def near(term: str, target: Column) -> Column:
        return F.exists(places[phrase.field, term], lambda p: F.abs(p - target) <= phrase.slop)

    def fits(start: Column) -> Column:
        tests = [near(t, start + (offset - zero)) for t, offset in rest]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    return F.coalesce(have & F.exists(places[phrase.field, first], fits), F.lit(False))


def relevant(snap: Snapshot, c: Compiled) -> DataFrame:
    """Postings that the query touches, with df, segment size and average length."""
    leaves = list(dict.fromkeys([*(leaf for leaf, _ in c.scores), *c.leaves(), *c.excluded, *(Leaf(p.field, t) for p in c.phrases() for t, _ in p.words), *(c.loaded if c.uses_active() else ())]))
    listed, patterns = Listed(tuple(sorted({leaf.term for leaf in leaves if not leaf.regex}))), [leaf for leaf in leaves if leaf.regex]

    def wanted(field: Column, term: Column) -> Column:
        return _any([listed(field, term), *(leaf_condition(leaf, field, term) for leaf in patterns)])

    return snap.select(wanted if patterns else listed).join(snap.meta.select("segment_id", F.col("doc_count").alias("n_docs"), "seg_ord"), "segment_id").join(snap.field_stats.select("segment_id", "field", "avg_length"), ["segment_id", "field"], "left")


def matches(snap: Snapshot, query: str | Node, config: IndexConfig, scorer: Scorer | None = None) -> DataFrame:
    """(segment_id, seg_ord, doc_ord, score) of every hit before deletions, filter and limit."""
    scorer = scorer or BM25()
    c = compile_query(parse(query) if isinstance(query, str) else query, snap.fields, config)
    rows = relevant(snap, c)
    boosts: dict[Leaf, float] = {}
    for leaf, boost in c.scores:
        boosts[leaf] = boosts.get(leaf, 0.0) + boost
    weight = reduce(lambda a, b: a + b, [F.when(leaf_condition(leaf), F.lit(b)).otherwise(0.0) for leaf, b in boosts.items()], F.lit(0.0))
    of_field = F.lit(1.0)
    for name, boost in config.boost.items():
        of_field = F.when(F.col("field") == name, F.lit(float(boost))).otherwise(of_field)
    part = scorer.contribution(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("length"), F.col("avg_length")) * of_field * F.col("weight")
    rows = rows.withColumn("weight", weight)
    leaves, phrases = c.leaves(), c.phrases()
    places = list(dict.fromkeys((p.field, t) for p in phrases for t, _ in p.words))
    aggs = [F.sum(part).alias("score"), F.first("seg_ord").alias("seg_ord"), F.max(_any([leaf_condition(x) for x in c.excluded])).alias("x")]
    aggs += [F.max(leaf_condition(x)).alias(f"m{i}") for i, x in enumerate(leaves)]
    aggs += [F.max(F.when((F.col("field") == f) & (F.col("term") == t), F.col("positions"))).alias(f"p{i}") for i, (f, t) in enumerate(places)]
    found = rows.groupBy("segment_id", "doc_ord").agg(*aggs)
    if c.uses_active():
        loaded = rows.where(_any([leaf_condition(x) for x in c.loaded]))
        found = found.join(loaded.groupBy("segment_id").agg(F.collect_set("field").alias("active")), "segment_id", "left")
    flag = {leaf: F.col(f"m{i}") for i, leaf in enumerate(leaves)}
    place = {key: F.col(f"p{i}") for i, key in enumerate(places)}

    def holds(x: Condition) -> Column:
        kind = x[0]
        if kind == "leaf":
            return flag[x[1]]
        if kind == "phrase":
            return phrase_fits(x[1], place)
        if kind == "active":
            return F.coalesce(F.array_contains("active", x[1]), F.lit(False))
        if kind in ("and", "or"):
            return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), map(holds, x[1]))
        return F.lit(kind == "true")

    return found.where((F.col("score") > 0) & ~F.col("x") & holds(c.condition)).select("segment_id", "seg_ord", "doc_ord", "score")


def without_deleted(found: DataFrame, snap: Snapshot) -> DataFrame:
    """Documents whose id any segment's tombstones name are no hits, in whatever segment they stand."""
    if snap.tombstones is None:
        return found
    return found.join(deleted_places(snap), ["segment_id", "doc_ord"], "left_anti")


def deleted_places(snap: Snapshot) -> DataFrame:
    """(segment_id, doc_ord) of the documents that tombstones name; only their ids are read, and while tombstones are few no document moves."""
    named = snap.tombstones.select("doc_id").distinct()
    few = F.broadcast(named) if snap.deleted is not None and snap.deleted <= BROADCAST_ROWS else named
    return snap.docs.select("segment_id", "doc_ord", "doc_id").join(few, "doc_id", "left_semi").select("segment_id", "doc_ord")


def top(found: DataFrame, limit: int | None) -> DataFrame:
    """Best first; scores that agree to ``TIE`` decimals are ties, in order of segments, then of documents, so that the order doesn't
    depend on how a sum was taken."""
    order = (F.desc(F.round("score", TIE)), "seg_ord", "doc_ord")
    return found.orderBy(*order) if limit is None else found.orderBy(*order).limit(max(0, limit))


def search(snap: Snapshot, query: str | Node, config: IndexConfig, top_k: int | None = 10, filter: Column | None = None, scorer: Scorer | None = None) -> DataFrame:
    """(doc, score, doc_id, segment_id) of the best hits.  ``filter`` is a condition on the stored fields, applied before the limit."""
    found = without_deleted(matches(snap, query, config, scorer), snap)
    key = ["segment_id", "doc_ord"]
    if filter is not None:
        kept = snap.docs.select(*key, "doc.*").where(filter).select(*key)
        found = found.join(kept, key, "left_semi")
    best = top(found, top_k)
    # The best are at most top_k; sent to all tasks, they leave out the folders of segments without one of them.
    best = F.broadcast(best) if top_k is not None and top_k <= BROADCAST_ROWS else best
    return top(snap.docs.join(best, key), None).select("doc", "score", "doc_id", "segment_id")
