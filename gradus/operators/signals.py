"""Signals of pairs of concepts: order, co-occurrence, mention in definitions, similarity; their merge and fusion.

All pair operators work within a domain, which keeps a concept's partners to those of its own domain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.text import sections
from gradus.operators.blocks import Common, Strips, cosine_pairs, pairs_of_repeated
from gradus.session import Scratch

#: Weights of the fused score: order, definition mention, co-occurrence, plausibility.
WEIGHTS = {"s_order": 0.25, "s_def": 0.35, "s_cooc": 0.10, "s_plaus": 0.30}

#: Characters of a domain's texts that one call searches for all names of the domain.
CALL_CHARS = 4_000_000


def concept_names(concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(domain_id, concept_id, name): lower-case names and resolved aliases of each concept, each once, none empty."""
    own = concepts.select("domain_id", "concept_id", F.lower("canonical_name").alias("name"))
    other = aliases.where("concept_id is not null").select("concept_id", F.lower("alias").alias("name")).join(concepts.select("concept_id", "domain_id").distinct(), "concept_id").select("domain_id", "concept_id", "name")
    return own.unionByName(other).where(F.length(F.trim("name")) >= 1).distinct()


def _holding(texts: DataFrame, names: DataFrame, key: str, scratch: Scratch | None = None) -> DataFrame:
    """(<key>, concept_id, pos): the names (domain_id, concept_id, name) in each text (domain_id, <key>, text) of their domain, with their first place from 0.

    A domain's texts are cut into parts of about ``CALL_CHARS`` characters; each part meets the domain's distinct names
    once, in one automaton that finds all of them in a single pass over the text. Work goes with the text and what is found in it.
    """
    scratch = scratch or Scratch(texts.sparkSession, "mentions")
    texts = scratch.keep(texts.where("domain_id is not null and text is not null").select("domain_id", F.col(key).alias("key"), "text"))
    parts = texts.groupBy("domain_id").agg(F.ceil(F.sum(F.length("text")) / CALL_CHARS).alias("parts")).where("parts > 0")
    cut = texts.join(parts, "domain_id").select("domain_id", F.pmod(F.xxhash64("key"), "parts").alias("part"), "key", "text")
    listed = names.select("domain_id", "name").distinct()
    each = listed.join(parts, "domain_id").select(F.col("domain_id").alias("d2"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part2"), "name")

    def run(own: pa.Table, words: pa.Table) -> pa.Table:
        import ahocorasick

        search = ahocorasick.Automaton()
        for w in words.column("name").to_pylist():
            search.add_word(w, w)
        at, found, places = [], [], []
        if len(search):
            search.make_automaton()
            for row, text in enumerate(own.column("text").to_pylist()):
                first: dict[str, int] = {}
                for end, w in search.iter(text):
                    first.setdefault(w, end - len(w) + 1)
                at += [row] * len(first)
                found += first.keys()
                places += first.values()
        domain = own.column("domain_id").combine_chunks().take(pa.array(at, type=pa.int64()))
        key_ = own.column("key").combine_chunks().take(pa.array(at, type=pa.int64()))
        return pa.table({"domain_id": domain, "key": key_, "name": pa.array(found, type=pa.string()), "pos": pa.array(places, type=pa.int32())})

    kind = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in ("domain_id", "key")) + ", name string, pos int"
    hits = cut.groupBy("domain_id", "part").cogroup(each.groupBy("d2", "part2")).applyInArrow(run, kind)
    return hits.join(names, ["domain_id", "name"]).select(F.col("key").alias(key), "concept_id", "pos")


def mentions(names: DataFrame, texts: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(unit, concept_id, pos): least position, from 0, of a concept's names in a text unit (domain_id, unit, text) of its domain."""
    found = _holding(texts.select("domain_id", "unit", F.lower("text").alias("text")), names, "unit", scratch)
    return found.groupBy("unit", "concept_id").agg(F.min("pos").alias("pos"))


def _pairs(m: DataFrame) -> DataFrame:
    """Ordered pairs of different concepts in one unit."""
    a = m.select("unit", F.col("concept_id").alias("src"), F.col("pos").alias("pa"), *[c for c in ("w",) if c in m.columns])
    b = m.select("unit", F.col("concept_id").alias("dst"), F.col("pos").alias("pb"))
    return a.join(b, "unit").where("src <> dst")


def order_signal(mentioned: DataFrame, weights: DataFrame) -> DataFrame:
    """(src, dst, s_order): weighted share of the units with both in which src comes first; a tie counts for neither."""
    p = _pairs(mentioned.join(weights.select("unit", "w"), "unit"))
    return p.groupBy("src", "dst").agg((F.sum(F.when(F.col("pa") < F.col("pb"), F.col("w")).otherwise(0)) / F.sum("w")).alias("s_order"))


def cooccurrence_signal(mentioned: DataFrame, n_units: DataFrame) -> DataFrame:
    """(src, dst, s_cooc) for src < dst: normalised pointwise mutual information over units, moved to 0..1.

    ``n_units`` is one row with the number n of all units. A pair that stands in every unit has 1.
    """
    single = mentioned.groupBy("concept_id").agg(F.count("*").alias("k"))
    both = _pairs(mentioned).where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("kab"))
    j = both.join(single.select(F.col("concept_id").alias("src"), F.col("k").alias("ka")), "src").join(single.select(F.col("concept_id").alias("dst"), F.col("k").alias("kb")), "dst").crossJoin(F.broadcast(n_units))
    pab = F.col("kab") / F.col("n")
    pmi = F.log(pab / ((F.col("ka") / F.col("n")) * (F.col("kb") / F.col("n"))))
    npmi = F.when(F.col("kab") == F.col("n"), 1.0).otherwise(F.try_divide(pmi, -F.log(pab)))
    return j.select("src", "dst", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (npmi + 1) / 2)).alias("s_cooc"))


def definition_signal(names: DataFrame, concepts: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(src, dst, s_def): src is named in the definition of dst; 1 at its start, towards 0.5 at its end."""
    d = concepts.where("length(definition) > 0").select("domain_id", F.col("concept_id").alias("dst"), F.lower("definition").alias("text"))
    # A text is its own key: a concept in several rows has several definitions.
    found = _holding(d.withColumn("row", F.struct("dst", "text")), names, "row", scratch).select("concept_id", "pos", "row.*").where("concept_id <> dst")
    return found.groupBy(F.col("concept_id").alias("src"), "dst").agg(F.max(0.5 + 0.5 * (1 - F.col("pos") / F.length("text"))).alias("s_def"))


def similarity_signal(vectors: DataFrame, floor: float = 0.15) -> DataFrame:
    """(src, dst, s_sim) for src < dst of one domain with a cosine of at least ``floor``, from (domain_id, concept_id, embedding)."""
    rows = vectors.select(F.col("domain_id").alias("grp"), F.col("concept_id").alias("id"), F.col("embedding").alias("vec"))
    return cosine_pairs(rows, floor).withColumnRenamed("score", "s_sim")


def merge_signals(order: DataFrame, cooc: DataFrame, definition: DataFrame, similarity: DataFrame) -> DataFrame:
    """(src, dst, ...) for src < dst: all pairs with any signal; directed ones as forward and backward; 0 where absent."""
    parts = []
    for df, name in ((order, "order"), (definition, "def")):
        c = F.col(f"s_{name}")
        parts.append(df.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.when(F.col("src") < F.col("dst"), c).alias(f"{name}_fwd"), F.when(F.col("src") > F.col("dst"), c).alias(f"{name}_rev")))
    parts.append(cooc.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("s_cooc").alias("cooc")))
    parts.append(similarity.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("s_sim").alias("sim")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    columns = ("order_fwd", "order_rev", "def_fwd", "def_rev", "cooc", "sim")
    return union.groupBy("u", "v").agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in columns)).select(F.col("u").alias("src"), F.col("v").alias("dst"), *columns)


def sparse_signals(order: DataFrame, cooc: DataFrame, definition: DataFrame) -> DataFrame:
    """The merged pairs of the signals that few pairs have: all but similarity."""
    none = order.sparkSession.createDataFrame([], "src bigint, dst bigint, s_sim double")
    return merge_signals(order, cooc, definition, none).drop("sim")


#: Columns of the merged pairs besides the pair, and their schema.
MERGED = ("order_fwd", "order_rev", "def_fwd", "def_rev", "cooc", "sim")
_KINDS = "src bigint, dst bigint, " + ", ".join(f"{c} double" for c in MERGED)


@dataclass(frozen=True)
class Evidence:
    """What texts say of pairs, not yet counted: kept mentions of documents (unit, concept_id, pos, w) and of sections (unit (doc_id, n), concept_id, pos), the number of
    all sections, and the definition signal. The pairs of what stands in one unit are many times the mentions; they are made where they are counted."""

    documents: DataFrame
    sections: DataFrame
    n: int
    definition: DataFrame

    @classmethod
    def found(cls, names: DataFrame, own: DataFrame, docs: DataFrame, sections: DataFrame, concepts: DataFrame) -> Evidence:
        """Of (domain_id, concept_id, name) in (domain_id, unit, text, w), and of own names in sections; texts are kept no longer than they are searched."""
        scratch = Scratch(names.sparkSession, "evidence", tidy=True)

        def kept(find) -> DataFrame:
            texts = Scratch(names.sparkSession, "mentions", tidy=True)
            out = scratch.keep(find(texts))
            texts.drop_all()
            return out

        weighed = kept(lambda t: mentions(names, docs, t).join(docs.select("unit", "w"), "unit"))
        return cls(weighed, kept(lambda t: mentions(own, sections, t)), sections.count(), kept(lambda t: definition_signal(names, concepts, t)))

    def table(self) -> DataFrame:
        """``sparse_signals`` as a table of pairs."""
        n_units = self.documents.sparkSession.createDataFrame([(self.n,)], "n bigint")
        weights = self.documents.select("unit", "w").distinct()
        return sparse_signals(order_signal(self.documents.drop("w"), weights), cooccurrence_signal(self.sections, n_units), self.definition)

    def directed(self) -> DataFrame:
        """(src, dst, def_fwd, def_rev) for src < dst."""
        fwd, rev = (F.max(F.when(F.col("src") < F.col("dst") if ahead else F.col("src") > F.col("dst"), F.col("s_def"))) for ahead in (True, False))
        of = self.definition.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
        return of.agg(F.coalesce(fwd, F.lit(0.0)).alias("def_fwd"), F.coalesce(rev, F.lit(0.0)).alias("def_rev")).select(F.col("u").alias("src"), F.col("v").alias("dst"), "def_fwd", "def_rev")

    def common(self) -> list[Common]:
        n = self.n

        def cooc(both, before, after, ka, kb):
            pab = both / n
            with np.errstate(divide="ignore", invalid="ignore"):
                npmi = np.where(both == n, 1.0, np.log(pab / ((ka / n) * (kb / n))) / -np.log(pab))
            return [np.clip((npmi + 1) / 2, 0.0, 1.0)]

        documents = self.documents.select(F.col("concept_id").alias("id"), "unit", F.lit(0).alias("part"), "pos", "w")
        sections = self.sections.select(F.col("concept_id").alias("id"), F.col("unit.doc_id").alias("unit"), F.col("unit.n").alias("part"), F.lit(0).alias("pos"), F.lit(1).alias("w"))
        return [Common(documents, ("order_fwd", "order_rev"), lambda both, before, after, ka, kb: [before / both, after / both]), Common(sections, ("cooc",), cooc)]


class _Merged:
    """Strips with the signals beside their pairs, and the merged pairs that hold a concept of several vectors, ``rest``, which counts with the best of them."""

    def __init__(self, vectors: DataFrame, about: DataFrame | Evidence, floor: float, verdicts: DataFrame | None = None):
        self.floor = floor
        self.strips = Strips(vectors.select(F.col("domain_id").alias("grp"), F.col("concept_id").alias("id"), F.col("embedding").alias("vec")))
        many, self.rest = self.strips.repeated(), None
        if not many.isEmpty():
            rows = self.strips.rows.select("grp", "id", "vec")
            best = pairs_of_repeated(rows, rows.join(many, "id", "left_semi"), floor).groupBy("src", "dst").agg(F.max("score").alias("sim"))
            table = about.table() if isinstance(about, Evidence) else about
            self.rest = best.join(table, ["src", "dst"], "left").select("src", "dst", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in MERGED))
            self.strips.without(many)
        common = about.common() if isinstance(about, Evidence) else []
        pairs = about.directed() if isinstance(about, Evidence) else about.select("src", "dst", *MERGED[:-1])
        columns = [*MERGED[:-1]]
        if verdicts is not None:
            own = pairs.columns[2:]
            pairs = pairs.unionByName(verdicts, allowMissingColumns=True).groupBy("src", "dst").agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in (*own, *verdicts.columns[2:])))
            columns += verdicts.columns[2:]
        self.strips.beside(pairs, common, columns)

    def pairs(self) -> DataFrame:
        made = self.strips.pairs(self.floor, lambda src, dst, sim, row, n: [src, dst, *n.values(), sim], _KINDS)
        return made if self.rest is None else made.unionByName(self.rest)


def pruned(vectors: DataFrame, about: DataFrame | Evidence, floor: float = 0.15) -> DataFrame:
    """``prune(merge_signals(...))`` of the sparse signals and the similarity of (domain_id, concept_id, embedding), for a floor above 0.

    Most pairs have no signal but similarity: they are made where they are compared, beside the few signals, and never shuffled. Of
    ``Evidence``, order and co-occurrence are counted there as well.
    """
    return _Merged(vectors, about, floor).pairs()


def _heuristic(n: dict) -> np.ndarray:
    h = WEIGHTS["s_order"] * np.maximum(n["order_fwd"], n["order_rev"]) + WEIGHTS["s_def"] * np.maximum(n["def_fwd"], n["def_rev"]) + WEIGHTS["s_cooc"] * n["cooc"]
    return np.floor(h * 1e6 + 0.5) / 1e6


def _places(row: np.ndarray, dst: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places 1, 2, ... within each row by (-h, dst), of rows in order with ascending dst; only what is above 0 is sorted."""
    some = h > 0
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    grp = np.cumsum(np.r_[True, row[1:] != row[:-1]]) - 1
    above, zeros = np.add.reduceat(some.astype(np.int64), starts), np.cumsum(~some)
    place = above[grp] + zeros - (zeros - ~some)[starts][grp]
    at = np.flatnonzero(some)
    at = at[np.lexsort((dst[at], -h[at], row[at]))]
    place[at] = np.arange(len(at)) - (np.cumsum(above) - above)[grp[at]] + 1
    return place


def pruned_order(vectors: DataFrame, about: DataFrame | Evidence, floor: float = 0.15) -> DataFrame:
    """``heuristic_order(pruned(...))``: all pairs of a source are made in one task, which ranks them as it makes them."""
    merged = _Merged(vectors, about, floor)
    if merged.rest is not None:
        return heuristic_order(merged.pairs())

    def finish(src, dst, sim, row, n):
        h = _heuristic(n)
        return [src, dst, *n.values(), sim, h, _places(row, dst, h)]

    return merged.strips.pairs(floor, finish, f"{_KINDS}, heuristic double, place bigint")


def pruned_plausible(vectors: DataFrame, about: DataFrame | Evidence, verdicts: DataFrame, floor: float = 0.15, most: int = 300, default: float = 0.5) -> DataFrame:
    """``plausible(pruned(...), verdicts)``: verdicts stand beside their pairs as the signals do."""
    v = verdicts.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("s").cast("double").alias("verdict"))
    merged = _Merged(vectors, about, floor, v.where("verdict is not null").withColumn("judged", F.lit(1.0)))
    if merged.rest is not None:
        made = merged.strips.pairs(floor, lambda src, dst, sim, row, n: [src, dst, *(n[c] for c in MERGED[:-1]), sim], _KINDS)
        return plausible(made.unionByName(merged.rest), verdicts, most, default)

    def finish(src, dst, sim, row, n):
        verdict, judged = n.pop("verdict"), n.pop("judged")
        asked = (judged > 0) & (_places(row, dst, _heuristic(n)) <= most)
        return [src, dst, *n.values(), sim, np.where(asked, verdict, default)]

    return merged.strips.pairs(floor, finish, f"{_KINDS}, s_plaus double")


def signal_profile(vectors: DataFrame, about: DataFrame | Evidence, floor: float = 0.15, buckets: int = 2048) -> DataFrame:
    """(signal, least, median, most, n) of each column of the pruned pairs, the median exact, of two middle values their mean.

    The pairs are made twice and never kept: first they are counted by buckets of the values, and then the values of the bucket that holds the
    middle are counted one by one.
    """
    merged = _Merged(vectors, about, floor)
    rest = merged.rest if merged.rest is not None else vectors.sparkSession.createDataFrame([], _KINDS)
    rest = Scratch(vectors.sparkSession, "profile", tidy=True).keep(rest.select(F.explode(F.array(*(F.struct(F.lit(c).alias("signal"), F.col(c).alias("x")) for c in MERGED))).alias("e")).select("e.*"))
    bucket = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor(F.col("x") * buckets))).cast("bigint")

    def columns(n: dict, sim: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for c, x in (*n.items(), ("sim", sim)):
            yield c, x, np.clip(np.floor(x * buckets), 0, buckets - 1).astype(np.int64)

    def counted(src, dst, sim, row, n):
        out = [[], [], [], [], []]
        for c, x, b in columns(n, sim):
            k = np.bincount(b, minlength=buckets)
            at = np.flatnonzero(k)
            for o, v in zip(out, ([c] * len(at), at, k[at], np.full(len(at), x.min()), np.full(len(at), x.max())), strict=True):
                o.extend(v)
        return out

    kind = "signal string, bucket bigint, n bigint, least double, most double"
    first = merged.strips.pairs(floor, counted, kind).unionByName(rest.groupBy("signal", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most")))
    counts = first.groupBy("signal", "bucket").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("signal", "bucket").collect()
    total, spans = {}, {}
    for r in counts:
        t = total.setdefault(r["signal"], [0, r["least"], r["most"]])
        total[r["signal"]] = [t[0] + r["n"], min(t[1], r["least"]), max(t[2], r["most"])]
    for c, (n, _, _) in total.items():
        before, held = 0, []
        for r in counts:
            if r["signal"] == c:
                if before <= n // 2 and before + r["n"] > (n - 1) // 2:
                    held.append((before, r["bucket"]))
                before += r["n"]
        spans[c] = held[0][0], held[0][1], held[-1][1]

    def middle(src, dst, sim, row, n):
        out = [[], [], []]
        for c, x, b in columns(n, sim):
            v, k = np.unique(x[(b >= spans[c][1]) & (b <= spans[c][2])], return_counts=True)
            for o, a in zip(out, ([c] * len(v), v, k), strict=True):
                o.extend(a)
        return out

    facts = vectors.sparkSession.createDataFrame([(c, lo, hi, n, *spans[c]) for c, (n, lo, hi) in total.items()], "signal string, least double, most double, n bigint, before bigint, b1 bigint, b2 bigint")
    if not total:
        return facts.select("signal", "least", F.col("least").alias("median"), "most", "n")
    held = rest.join(F.broadcast(facts), "signal").where(bucket.between(F.col("b1"), F.col("b2"))).select("signal", "x", F.lit(1).cast("bigint").alias("k"))
    values = merged.strips.pairs(floor, middle, "signal string, x double, k bigint").unionByName(held).groupBy("signal", "x").agg(F.sum("k").alias("k"))
    upto = Window.partitionBy("signal").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.withColumn("upto", F.sum("k").over(upto)).join(F.broadcast(facts), "signal")
    value = lambda k: F.min(F.when(F.col("before") + F.col("upto") > F.floor(k), F.col("x")))
    of = ranked.groupBy("signal", "least", "most", "n").agg(value((F.col("n") - 1) / 2).alias("a"), value(F.col("n") / 2).alias("b"))
    return of.select("signal", "least", (F.col("a") + (F.col("b") - F.col("a")) * 0.5).alias("median"), "most", "n")


def prune(merged: DataFrame, floor: float = 0.15) -> DataFrame:
    """The merged pairs whose similarity reaches the floor; a pair without similarity has 0."""
    return merged.where(F.col("sim") >= floor)


def plausible(merged: DataFrame, verdicts: DataFrame | None = None, most: int = 300, default: float = 0.5) -> DataFrame:
    """The merged pairs with ``s_plaus``: the verdict (src, dst, s) of an outside judge on the ``most`` best pairs of each source, else the default.

    Best is by the sum of what the other signals say (the heuristic order), ties by target; verdicts on other pairs do not count. Without
    verdicts all pairs have the default.
    """
    if verdicts is None:
        return merged.withColumn("s_plaus", F.lit(default))
    v = verdicts.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("s").alias("_s"))
    asked = heuristic_order(merged).where(F.col("place") <= most)
    return asked.drop("place", "heuristic").join(v, ["src", "dst"], "left").withColumn("s_plaus", F.coalesce("_s", F.lit(default))).drop("_s").unionByName(
        heuristic_order(merged).where(F.col("place") > most).drop("place", "heuristic").withColumn("s_plaus", F.lit(default))
    )


def heuristic_order(merged: DataFrame) -> DataFrame:
    """The merged pairs with ``heuristic``, the weighted sum of their better directions, and ``place`` among the pairs of their source by it."""
    h = WEIGHTS["s_order"] * F.greatest("order_fwd", "order_rev") + WEIGHTS["s_def"] * F.greatest("def_fwd", "def_rev") + WEIGHTS["s_cooc"] * F.col("cooc")
    w = Window.partitionBy("src").orderBy(F.desc("heuristic"), "dst")
    return merged.withColumn("heuristic", F.floor(h * 1e6 + 0.5) / 1e6).withColumn("place", F.row_number().over(w))


def fuse(merged: DataFrame, plausibility: Column, weights: dict[str, float] | None = None, least: float = 0.10, keep: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, s_corr, forward): weighted mean of each signal's better direction; pairs below ``least`` are left out.

    ``keep`` names further columns of the result; ``forward`` tells whether src to dst is the likelier direction by definition and order (a tie counts as forward).
    """
    w = weights or WEIGHTS
    total = sum(w.values())
    best = {"s_order": F.greatest("order_fwd", "order_rev"), "s_def": F.greatest("def_fwd", "def_rev"), "s_cooc": F.col("cooc"), "s_plaus": plausibility}
    score = sum((F.lit(w[k]) * c for k, c in best.items()), F.lit(0.0)) / F.lit(total)
    ahead = F.lit(w["s_def"]) * F.col("def_fwd") + F.lit(w["s_order"]) * F.col("order_fwd") >= F.lit(w["s_def"]) * F.col("def_rev") + F.lit(w["s_order"]) * F.col("order_rev")
    return merged.select("src", "dst", score.alias("s_corr"), ahead.alias("forward"), *keep).where(F.col("s_corr") >= least)


def section_units(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(domain_id, unit, text): sections of documents as text units."""
    return docs.where("text is not null").select("domain_id", "doc_id", F.posexplode(sections(F.col("text"), separator)).alias("n", "text")).select("domain_id", F.struct("doc_id", "n").alias("unit"), "text")
