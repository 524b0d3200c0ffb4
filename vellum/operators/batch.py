"""Search of many queries in one job.

Queries are parsed once, where they lie; each becomes rows of what it needs (terms with weights, patterns, phrases, excluded words) and a
condition over numbered leaves, kept as an "or of ands" or an "and of ors", whichever is shorter, or where both are long as a tree.

The wanted terms are found first and counted.  While they are few they are sent to the scans of postings and statistics, and the fewest as a
list that reaches the files; beyond that both sides are shuffled by term.  One pass over the postings serves all queries.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import IndexConfig
from vellum.operators.index_build import Listed, Snapshot
from vellum.operators.scoring import BM25, Scorer
from vellum.operators.search import BROADCAST_ROWS, TIE, deleted_places
from vellum.plans.compile import Compiled, Condition, Leaf, compile_query, wildcard_regex
from vellum.plans.parser import contains_range, parse

#: The most sets of a normal form; a longer condition is kept as a tree.  The most terms that go to the files as a list.
#: The most terms that are looked up in a set where postings are made on demand.
LONGEST, LISTED, SET = 64, 2000, 20_000
#: Leaves in one word of a mask.
WORD = 62
NEED = "query_id string, role string, field string, term string, regex boolean, boost double, bit int, idx int, off int, n int, slop int"
FORMULA = "query_id string, ands boolean, formula array<array<int>>, tree string"


def normal_form(c: Condition, number: dict, outer: str) -> list[frozenset[int]] | None:
    """The condition as an ``outer`` ("or" or "and") of sets of leaf numbers; None where it would be too long."""
    kind = c[0]
    if kind in ("true", "false"):
        # An empty or is false, an empty and true; the other value is one empty set.
        return [] if (kind == "true") == (outer == "and") else [frozenset()]
    if kind not in ("and", "or"):
        return [frozenset([number[c]])]
    parts = [normal_form(x, number, outer) for x in c[1]]
    if None in parts:
        return None
    if kind == outer:
        return list(dict.fromkeys(itertools.chain(*parts)))
    size = 1
    for p in parts:
        size *= len(p)
    return list(dict.fromkeys(frozenset().union(*x) for x in itertools.product(*parts))) if size <= LONGEST else None


def atoms(c: Condition) -> dict[Condition, int]:
    out: dict[Condition, int] = {}

    def walk(x: Condition) -> None:
        if x[0] in ("and", "or"):
            for y in x[1]:
                walk(y)
        elif x[0] not in ("true", "false"):
            out.setdefault(x, len(out))

    walk(c)
    return out


def query_rows(query_id: str, c: Compiled) -> tuple[list[tuple], tuple]:
    number = atoms(c.condition)
    rows: list[tuple] = []

    def leaf(role: str, x: Leaf, boost: float = 0.0, bit: int | None = None) -> None:
        rows.append((query_id, role, x.field, wildcard_regex(x.term) if x.regex else x.term, x.regex, boost, bit, None, None, None, None))

    for x, boost in c.scores:
        leaf("score", x, boost)
    for x in c.excluded:
        leaf("not", x)
    for a, bit in number.items():
        if a[0] == "leaf":
            leaf("bit", a[1], bit=bit)
        elif a[0] == "phrase":
            rows.extend((query_id, "phrase", a[1].field, t, False, 0.0, bit, i, off, len(a[1].words), a[1].slop) for i, (t, off) in enumerate(a[1].words))
        else:
            rows.append((query_id, "active", a[1], None, False, 0.0, bit, None, None, None, None))
    if c.uses_active():
        for x in c.loaded:
            leaf("load", x)
    ors, ands = normal_form(c.condition, number, "or"), normal_form(c.condition, number, "and")
    if ors is None and ands is None:
        return rows, (query_id, None, None, json.dumps(numbered(c.condition, number)))
    use_and = ors is None or ands is not None and len(ands) < len(ors)
    return rows, (query_id, use_and, [sorted(s) for s in (ands if use_and else ors)], None)


def numbered(c: Condition, number: dict):
    """The condition with its leaves' numbers: a number, true, false, or [kind, parts]."""
    if c[0] in ("and", "or"):
        return [c[0], [numbered(x, number) for x in c[1]]]
    return c[0] == "true" if c[0] in ("true", "false") else number[c]


def holds(tree, have: set[int]) -> bool:
    if isinstance(tree, bool):
        return tree
    if isinstance(tree, int):
        return tree in have
    return (all if tree[0] == "and" else any)(holds(x, have) for x in tree[1])


def _with_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose tree holds."""
    known: dict[str, object] = {}
    for b in batches:
        keep = []
        for text, have in zip(b.column("tree").to_pylist(), b.column("have").to_pylist()):
            if text not in known:
                known.clear() if len(known) > 1000 else None
                known[text] = json.loads(text)
            keep.append(holds(known[text], set(have)))
        yield b.filter(pa.array(keep, pa.bool_()))


def parsed(queries: DataFrame, fields: list[str], config: IndexConfig) -> DataFrame:
    """(query_id, ands, formula, tree, needs) of each query that can be searched; blank ones and ranges can't, and find nothing."""
    need_type = "array<struct<" + ",".join(f"{n}:{t}" for n, t in (x.split() for x in NEED.split(", "))) + ">>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}[t]) for n, t in (x.split() for x in NEED.split(", "))]))
        names = [x.split()[0] for x in NEED.split(", ")]
        for b in batches:
            ids, ands, formulas, trees, needs = [], [], [], [], []
            for q, text in zip(b.column("query_id").to_pylist(), b.column("text").to_pylist()):
                node = parse(text or "")
                if contains_range(node):
                    continue
                rows, (_, use_and, formula, tree) = query_rows(q, compile_query(node, fields, config))
                ids.append(q)
                ands.append(use_and)
                formulas.append(formula)
                trees.append(tree)
                needs.append([dict(zip(names, r)) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(ands, pa.bool_()), pa.array(formulas, pa.list_(pa.list_(pa.int32()))), pa.array(trees, pa.string()), pa.array(needs, kind)], names=["query_id", "ands", "formula", "tree", "needs"])

    texts = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"{FORMULA}, needs {need_type}")


def _mask(bits: Column, k: int) -> Column:
    """The k-th word of the mask of an array of leaf numbers."""
    mine = F.filter(bits, lambda b: F.floor(b / WORD) == k)
    return F.aggregate(mine, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (b - k * WORD).cast("int"))))


def _few(df: DataFrame, rows: int | None) -> DataFrame:
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def search_many(snap: Snapshot, queries: DataFrame, config: IndexConfig, top_k: int = 10, scorer: Scorer | None = None) -> DataFrame:
    """(query_id, rank, doc_id, segment_id, score) of the best hits of each query (query_id, text).

    The parsed queries are kept while the session has room for them, as several steps need them.
    """
    scorer = scorer or BM25()
    plans = parsed(queries, snap.fields, config).persist()
    need = plans.select(F.explode("needs").alias("n")).select("n.*")
    seen = need.agg(F.count("*").alias("rows"), F.count_if("regex").alias("wild"), F.count_if(F.col("role") == "phrase").alias("phrase"), F.count_if(F.col("role") == "active").alias("active"), F.coalesce(F.max("bit"), F.lit(0)).alias("bit")).first()
    # A document's true leaves are words of a mask, so that they are combined as numbers are.
    masks = [f"have{k}" for k in range(seen["bit"] // WORD + 1)]
    every = F.array(*[F.lit(f) for f in snap.fields]) if snap.fields else F.array().cast("array<string>")
    rows = need.where("not regex and role <> 'active'").withColumn("field", F.explode(F.when(F.col("field").isNull(), every).otherwise(F.array("field"))))
    count = seen["rows"] * max(1, len(snap.fields))
    if seen["wild"]:
        # Each different pattern meets each term of the dictionary once.
        patterns = need.where("regex").select(F.col("field").alias("of"), F.col("term").alias("pattern")).distinct()
        dictionary = snap.term_stats.select("field", "term").distinct()
        fits = dictionary.join(_few(patterns, seen["wild"]), F.expr("(of is null or of = field) and term rlike pattern"))
        wild = need.where("regex").withColumnsRenamed({"field": "of", "term": "pattern"}).alias("w").join(fits.alias("f"), F.expr("w.of <=> f.of and w.pattern = f.pattern"))
        rows = rows.unionByName(wild.select("w.query_id", "w.role", "f.field", "f.term", "w.regex", "w.boost", "w.bit", "w.idx", "w.off", "w.n", "w.slop")).persist()
        count = rows.count()
    bits = F.array_distinct(F.collect_list(F.when(F.col("role") == "bit", F.col("bit"))))
    wanted = rows.where("role <> 'phrase'").groupBy("query_id", "field", "term").agg(F.sum("boost").alias("weight"), bits.alias("bits"), F.max(F.col("role") == "not").alias("x"), F.max(F.col("role") == "load").alias("load"))
    wanted = wanted.select("query_id", "field", "term", "weight", "x", "load", *[_mask(F.col("bits"), k).alias(m) for k, m in enumerate(masks)])
    words = rows.select("field", "term").distinct()
    longest = LISTED if snap.source is None else SET
    listed = [r["term"] for r in rows.select("term").distinct().limit(longest + 1).collect()]
    is_listed = Listed(tuple(listed)) if len(listed) <= longest else lambda field, term: F.lit(True)
    segments = snap.segments if snap.source is None else snap.meta.count()
    dims = snap.meta.select("segment_id", F.col("doc_count").alias("n_docs"), "seg_ord").join(snap.field_stats.select("segment_id", "field", "avg_length"), "segment_id")
    dims = _few(dims, segments * max(1, len(snap.fields)) if segments is not None else None)
    if snap.source is None:
        post = snap.postings.where(is_listed(F.col("field"), F.col("term"))).join(_few(words, count), ["field", "term"], "left_semi")
        stats = snap.term_stats.where(is_listed(F.col("field"), F.col("term"))).join(_few(words, count), ["field", "term"], "left_semi")
        # What a posting's contribution needs beside the posting is joined term by term first.
        known = post.join(stats.join(dims, ["segment_id", "field"]), ["segment_id", "field", "term"])
    else:
        post = snap.select(is_listed).join(_few(words, count), ["field", "term"], "left_semi")
        known = post.join(dims, ["segment_id", "field"])
    of_field = F.lit(1.0)
    for name, boost in config.boost.items():
        of_field = F.when(F.col("field") == name, F.lit(float(boost))).otherwise(of_field)
    worth: Column = scorer.contribution(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("length"), F.col("avg_length")) * of_field
    known = known.select("segment_id", "seg_ord", "doc_ord", "field", "term", worth.alias("worth"))
    key = ["query_id", "segment_id", "doc_ord"]
    if count <= BROADCAST_ROWS:
        # The postings of a document meet before each is copied for its queries; what follows is summed up where it stands.
        known = known.repartition("segment_id", "doc_ord")
    hits = known.join(_few(wanted, count), ["field", "term"])
    scored = hits.select(*key, "seg_ord", (F.col("worth") * F.col("weight")).alias("part"), *masks, "x")
    if seen["phrase"]:
        phrase = rows.where("role = 'phrase'").select("query_id", "field", "term", "bit", "idx", "off", "n", "slop")
        found = post.join(_few(phrase, count), ["field", "term"]).groupBy(*key, "bit", "field", "n", "slop").agg(F.array_sort(F.collect_list(F.struct("idx", "off", "positions"))).alias("w")).where("size(w) = n")
        head, rest = F.get("w", F.lit(0)), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0)))
        fits = F.exists(head["positions"], lambda s: F.forall(rest, lambda r: F.exists(r["positions"], lambda p: F.abs(p - (s + r["off"] - head["off"])) <= F.col("slop"))))
        scored = scored.unionByName(found.where(fits).select(*key, F.lit(None).cast("bigint").alias("seg_ord"), F.lit(0.0).alias("part"), *[_mask(F.array("bit"), k).alias(m) for k, m in enumerate(masks)], F.lit(False).alias("x")))
    total = scored.groupBy(*key).agg(F.sum("part").alias("score"), F.max("seg_ord").alias("seg_ord"), *[F.bit_or(m).alias(m) for m in masks], F.max("x").alias("x")).where("score > 0 and not x")
    if seen["active"]:
        active = hits.where("load").select("query_id", "segment_id", "field").distinct().join(need.where("role = 'active'").select("query_id", "field", "bit"), ["query_id", "field"]).groupBy("query_id", "segment_id").agg(F.collect_set("bit").alias("more"))
        more = F.coalesce("more", F.array().cast("array<int>"))
        total = total.join(active, ["query_id", "segment_id"], "left").withColumns({m: F.col(m).bitwiseOR(_mask(more, k)) for k, m in enumerate(masks)}).drop("more")
    sets = F.transform("formula", lambda s: F.struct(*[_mask(s, k).alias(m) for k, m in enumerate(masks)]))
    total = total.join(_few(plans.select("query_id", "ands", sets.alias("sets"), "tree"), seen["rows"]), "query_id")
    every_bit = lambda s: reduce(lambda a, b: a & b, [F.col(m).bitwiseAND(s[m]) == s[m] for m in masks])
    any_bit = lambda s: reduce(lambda a, b: a | b, [F.col(m).bitwiseAND(s[m]) != 0 for m in masks])
    true = F.when(F.col("ands"), F.forall("sets", any_bit)).otherwise(F.exists("sets", every_bit))
    kept = total.where("tree is null").where(true).select(*key, "seg_ord", "score")
    if not plans.where("tree is not null").isEmpty():
        have = F.concat(*[F.filter(F.array(*[F.when(F.col(m).bitwiseAND(1 << i) != 0, F.lit(k * WORD + i)) for i in range(WORD)]), lambda b: b.isNotNull()) for k, m in enumerate(masks)])
        long = total.where("tree is not null").select(*key, "seg_ord", "score", have.alias("have"), "tree")
        kept = kept.unionByName(long.mapInArrow(_with_trees, long.schema).select(*key, "seg_ord", "score"))
    if snap.tombstones is not None:
        kept = kept.join(deleted_places(snap), ["segment_id", "doc_ord"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", TIE)), "seg_ord", "doc_ord")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return ranked.join(snap.docs.select("segment_id", "doc_ord", "doc_id"), ["segment_id", "doc_ord"]).select("query_id", "rank", "doc_id", "segment_id", "score")
