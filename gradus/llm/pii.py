"""Personal data in free text: contextual extraction bootstrapped from seeds.

One pass over the texts lists candidates, each with its make-up (the shape of a number, the names of a person) and the pattern of the context it
stands in. Candidates and patterns form a bipartite graph. Starting from seeds, Spark scores it in turns: patterns that hold several trusted
make-ups become trusted, make-ups in several trusted patterns too. What is trusted on both sides is found, also where the
seeds say nothing of it. A second pass puts placeholders in the place of what was found.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.mentions import Mention, mentions
from gradus.session import Scratch

KINDS = ("email", "address", "id_number", "phone", "person")
PLACEHOLDERS = {"email": "[EMAIL]", "address": "[ADDRESS]", "id_number": "[ID_NUMBER]", "phone": "[PHONE]", "person": "[PERSON]"}
#: Seed patterns of telephone and identity numbers: labels before the number.
PHONE_SEEDS = ("phone:", "tel", "tel.", "tel.:", "tél.", "tél", "telefon:", "teléfono:", "call")
ID_SEEDS = ("ssn", "ssn:", "(ssn", "passport", "(passport")

SPANS = "doc string, start int, end int, kind string, text string, shape string, left string, right string, tail string"


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Candidates of all texts, whole; ``doc`` is the key as a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, rows = [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = list(mentions(t))
                docs_ += [d] * len(own)
                rows += own
            cols = [pa.array([r[i] for r in rows], type=pa.int32() if i < 2 else pa.string()) for i in range(len(Mention._fields))]
            yield pa.record_batch([pa.array(docs_, type=pa.string()), *cols], names=["doc", *Mention._fields])

    return docs.where(F.col(key).isNotNull() & (F.length(text) > 4)).select(F.col(key).cast("string").alias("doc"), F.col(text).alias("text")).mapInArrow(run, SPANS)


def _grown(scratch: Scratch, links: DataFrame, seeds: DataFrame, node: str, pattern: str, nodes_needed: int, patterns_needed: int, share: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Trusted nodes and trusted patterns of the bipartite graph ``links`` (node, pattern, n), grown from seed nodes to the fixpoint.

    Each side is scored by the other: the score of a pattern is the share of its mentions that trusted nodes make up, and that of
    a node the share of its mentions in trusted patterns. A pattern is trusted with a score above ``share`` from ``nodes_needed`` nodes, a
    node with one above ``share`` from ``patterns_needed`` patterns. Seeds stay trusted, so that both sets only grow, and
    the rounds end when no node is added.
    """
    nodes = scratch.keep(seeds.select(node).distinct())
    trusted, before = nodes.count(), -1
    while trusted != before:
        before = trusted
        flag = nodes.select(node, F.lit(1).alias("good"))
        by_pattern = links.join(flag, node, "left").groupBy(pattern).agg(F.count("good").alias("k"), (F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("part"))
        patterns = by_pattern.where((F.col("k") >= nodes_needed) & (F.col("part") > share)).select(pattern)
        flag = patterns.select(pattern, F.lit(1).alias("good"))
        by_node = links.join(flag, pattern, "left").groupBy(node).agg(F.count("good").alias("k"), (F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("part"))
        nodes = scratch.keep(by_node.where((F.col("k") >= patterns_needed) & (F.col("part") > share)).select(node).union(seeds.select(node)).distinct())
        patterns, trusted = scratch.keep(patterns), nodes.count()
    return nodes, patterns


def _rather_given(read: DataFrame, given: DataFrame) -> DataFrame:
    """Those of the words ``given`` that are read (given, family, pattern) as given names in more ways than as families of such words.

    The more texts there are, the more family names stand before a capital in two contexts; that alone makes none a given name.
    """
    own = read.join(given, "given", "left_semi")
    family = own.groupBy(F.col("family").alias("given")).agg(F.count("*").alias("m"))
    return own.groupBy("given").agg(F.count("*").alias("n")).join(family, "given", "left").where(F.col("n") > F.coalesce("m", F.lit(0))).select("given")


def _persons(scratch: Scratch, spans: DataFrame) -> DataFrame:
    """Persons: a trusted given name, or an initial in a trusted pattern, with a family name of a trusted ending."""
    parts = F.split("shape", r"\|")
    p = spans.where("kind = 'person'").select("doc", "start", "end", "kind", "text", "tail", parts[0].alias("given"), parts[1].alias("family"), parts[2].alias("style"), F.concat_ws("|", "left", "right", F.when(F.col("text") == F.lower("text"), "low")).alias("pattern"))
    p = p.withColumn("ending", F.regexp_extract("family", r"(...)$", 1)).withColumn("initial", F.length("given") <= 2)
    read = scratch.keep(p.where("not initial").groupBy("given", "family", "pattern").agg(F.count("*").alias("n"), F.bool_or(F.col("tail") == "seed").alias("seed")))
    # By chance any word stands before two families of e-mail addresses, once the texts are many: it must do so as a given name does.
    asked = read.groupBy("given").agg(F.count_distinct(F.when(F.col("seed"), F.col("family"))).alias("k"), (F.count_if("seed") / F.count("*")).alias("part"), F.count("*").alias("m")).where("k >= 2")
    usual = asked.agg((F.sum(F.col("part") * F.col("m")) / F.sum("m")).alias("usual"))
    seeds = scratch.keep(_rather_given(read.where("seed"), asked.crossJoin(usual).where("part >= usual / 2").select("given")))
    links = read.groupBy("given", "pattern").agg(F.sum("n").alias("n"))
    # Mentions as a family name count against a given name: each of them stands in a pattern of its own, which nothing makes trusted.
    against = read.join(seeds, "given", "left_semi").groupBy(F.col("family").alias("given")).agg(F.sum("n").alias("n")).join(links, "given", "left_semi")
    links = scratch.keep(links.unionByName(against.select("given", F.concat(F.lit("~family "), "given").alias("pattern"), "n")))
    given, patterns = _grown(scratch, links, seeds, "given", "pattern", 2, 2, 0.3)
    given = scratch.keep(_rather_given(read, given))
    # A verb or label before names is followed by given names, a given name by family names.
    second = p.where("style = 'f' and not initial").join(given, "given", "left_semi").join(given.select(F.col("given").alias("family"), F.lit(1).alias("s")), "family", "left")
    given = scratch.keep(second.groupBy("given").agg((F.count("s") / F.count("*")).alias("part")).where("part <= 0.3").select("given"))
    known = p.join(given.withColumn("good_given", F.lit(True)), "given", "left").join(patterns.withColumn("good_pattern", F.lit(True)), "pattern", "left")
    known = known.select("*", F.coalesce("good_given", F.lit(False)).alias("g"), F.coalesce("good_pattern", F.lit(False)).alias("h"))
    # Each context of a name counts once, however often its text is stored.
    contexts = known.select("ending", "family", "given", "pattern", "initial", "g").distinct()
    families = contexts.groupBy("ending", "family").agg(F.count_if("g").alias("n"), (F.count_if("initial") / F.count("*")).alias("part"))
    endings = families.where("n > 0").groupBy("ending").agg(F.count("*").alias("k")).where("k >= 3").select("ending")
    # A family name is no given name and stands with given names or initials, not with words of all kinds.
    own = families.where("n > 0 or part > 0.3").select("family").join(given.select(F.col("given").alias("family")), "family", "left_anti")
    good = known.where("g or (initial and h)").join(endings, "ending", "left_semi").join(own, "family", "left_semi")
    return good.select("doc", "start", "end", "kind", "text")


def _phones(scratch: Scratch, spans: DataFrame) -> DataFrame:
    """Numbers of a trusted shape in a trusted context; a context with one shape only (a kind of serial number) is none.

    Numbers in words are candidates of the same graph, with the language as their shape: as no serial number is spelt out, a
    trusted shape is enough for them.
    """
    p = spans.where("kind = 'phone'").withColumn("context", F.concat_ws("|", "left", "right"))
    links = scratch.keep(p.groupBy("shape", "context").agg(F.count("*").alias("n")))
    seeds = scratch.keep(links.where(F.split("context", r"\|")[0].isin(*PHONE_SEEDS)).groupBy("shape").agg(F.sum("n").alias("n")).where("n >= 2").select("shape"))
    shapes, contexts = _grown(scratch, links, seeds, "shape", "context", 2, 2)
    good = p.join(shapes, "shape", "left_semi")
    found = good.where("shape not like 'spoken%'").join(contexts, "context", "left_semi").select(p.columns)
    return found.unionByName(good.where("shape like 'spoken%'").select(p.columns)).select("doc", "start", "end", "kind", "text")


def _label() -> Column:
    """The last word before a code, without brackets and colons."""
    return F.regexp_replace(F.element_at(F.split("left", " "), -1), "[:,(|]", "")


def _ids(scratch: Scratch, spans: DataFrame) -> DataFrame:
    """Codes of a trusted shape behind a trusted label or in a trusted frame (what opens the label, and what follows)."""
    words = F.concat_ws(" ", F.element_at(F.split("tail", " "), -1), F.element_at(F.split("left", " "), -1))
    opening = F.coalesce(F.nullif(F.regexp_extract(F.concat_ws(" ", "tail", F.element_at(F.split("left", " "), -1)), r"([(,|])[^(,|]*$", 1), F.lit("")), F.regexp_extract(words, r"^(\S+)", 1))
    p = spans.where("kind = 'id_number'").withColumn("frame", F.concat_ws("~", opening, "right")).withColumn("label", _label())
    links = scratch.keep(p.groupBy("shape", "frame").agg(F.count("*").alias("n")))
    seeds = scratch.keep(p.where(F.element_at(F.split("left", " "), -1).isin(*ID_SEEDS)).groupBy("shape").count().where("count >= 2").select("shape"))
    shapes, frames = _grown(scratch, links, seeds, "shape", "frame", 2, 2)
    shaped = p.join(shapes, "shape", "left_semi").join(frames.withColumn("good", F.lit(True)), "frame", "left")
    labels = shaped.groupBy("label").agg(F.count("good").alias("n"), (F.count("good") / F.count("*")).alias("part")).where("n >= 2 and part >= 0.3").select("label", F.lit(True).alias("labelled"))
    return shaped.join(labels, "label", "left").where("labelled").select("doc", "start", "end", "kind", "text")


def _emails(scratch: Scratch, spans: DataFrame) -> DataFrame:
    """Addresses written in a trusted way: with an @ and dots (the seed), or as what stands in the contexts of those."""
    e = spans.where("kind = 'email'").withColumn("context", F.concat_ws("|", "left", "right"))
    links = scratch.keep(e.groupBy("shape", "context").agg(F.count("*").alias("n")))
    ways, _ = _grown(scratch, links, links.where("shape = '@|.'").select("shape"), "shape", "context", 1, 2)
    return e.join(ways, "shape", "left_semi").select("doc", "start", "end", "kind", "text")


def _addresses(scratch: Scratch, spans: DataFrame) -> DataFrame:
    """Streets with house numbers of a trusted kind; a town without postal code belongs to them if it stands with one elsewhere.

    Seeds are the kinds of street that stand with a postal code; other kinds are trusted by the contexts that they share with these.
    """
    a = spans.where("kind = 'address'")
    links = scratch.keep(a.where("shape <> 'open'").groupBy(F.col("tail").alias("street"), F.col("right").alias("context")).agg(F.count("*").alias("n")))
    seeds = a.where("shape = 'full'").select(F.col("tail").alias("street")).distinct()
    streets, _ = _grown(scratch, links, seeds, "street", "context", 1, 2)
    a = a.join(streets.select(F.col("street").alias("tail")), "tail", "left_semi").select(a.columns)
    towns = a.where("shape = 'full' and left <> ''").groupBy("left").count().where("count >= 2").select("left")
    found = a.where("shape <> 'open'").unionByName(a.where("shape = 'open'").join(towns, "left", "left_semi").select(a.columns))
    return found.select("doc", "start", "end", "kind", "text")


def _apart(found: DataFrame) -> DataFrame:
    """(doc, spans): what is found in each text, without overlaps: by kind, then the longer and then the earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(1).to_pylist():
                taken: list[dict] = []
                for s in sorted(spans, key=lambda s: (KINDS.index(s["kind"]), "," in s["text"] and s["kind"] == "person", s["start"] - s["end"], s["start"])):
                    if all(s["end"] <= t["start"] or t["end"] <= s["start"] for t in taken):
                        taken.append(s)
                out.append(sorted(taken, key=lambda s: s["start"]))
            yield pa.record_batch([batch.column(0), pa.array(out, type=batch.column(1).type)], names=["doc", "spans"])

    kind = "array<struct<start:int,end:int,kind:string,text:string>>"
    return found.groupBy("doc").agg(F.collect_set(F.struct("start", "end", "kind", "text")).alias("spans")).mapInArrow(run, f"doc string, spans {kind}")


def find(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, spans) for each text with personal data: position, kind and words of each item; ``doc`` is the key as a string."""
    scratch = Scratch(docs.sparkSession, "pii")
    spans = scratch.keep(scan(docs, key, text))
    parts = [_emails(scratch, spans), _addresses(scratch, spans), _ids(scratch, spans), _phones(scratch, spans), _persons(scratch, spans)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return _apart(found)


def found_items(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, found_text): each distinct item of each text, exactly as it stands there.

    Null, empty and short texts hold none, and rows without key are left out. Rows that repeat a key are looked at one
    by one and their items put together.
    """
    items = find(docs, key, text).select(F.col("doc").cast(docs.schema[key].dataType).alias(key), F.inline("spans"))
    return items.select(key, "kind", F.col("text").alias("found_text")).distinct()


def redact(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): every row of ``docs`` with placeholders in the place of what is found and the rest unchanged.

    Rows that repeat a key with different texts get the same replacements by words, not by position; null stays null.
    """
    spans = find(docs, key, text).withColumnRenamed("doc", "found_doc").withColumnRenamed("spans", "found_spans")
    joined = docs.select(F.col(key), F.col(text).alias("text")).join(spans, F.col(key).cast("string") == F.col("found_doc"), "left").select(key, "text", "found_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for s in reversed(own or []):
                    if t is not None and t[s["start"] : s["end"]] == s["text"]:
                        t = t[: s["start"]] + PLACEHOLDERS[s["kind"]] + t[s["end"] :]
                out.append(t)
            yield pa.record_batch([batch.column(0), pa.array(out, type=pa.string())], names=[key, "text"])

    return joined.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, text string")
