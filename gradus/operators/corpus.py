"""Corpus operators: documents to phrases, definitions and canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions import text as tx

#: Verbs after a term in a sentence that defines it, and the form of phrases.
DEFINING = ("is", "are", "was", "were", "refers to", "denotes", "represents", "consists of", "deals with", "involves", "focuses on", "covers")
PHRASE = r"\b(?:[A-Z][a-z]+(?:[ \t\r\n]+[A-Z][a-z]+)+|[a-z]+(?:[ \t\r\n]+[a-z]+){1,2})\b"


def first_of_key(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """One row for each key, the first in the given order; rows with a null key are kept apart by null as one key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def ascii_words(text: Column) -> Column:
    """The text with signs as bars, and digits and letters beyond ASCII as zeros, so that word borders are where they are for every engine."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_ \t\r\n]+", "|"), r"[^A-Za-z| \t\r\n]", "0")


def phrases(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, phrase): distinct noun-phrase candidates of whole words, cleaned and well formed."""
    found = docs.select(key, F.explode(F.regexp_extract_all(ascii_words(F.col(text)), F.lit(PHRASE), F.lit(0))).alias("p")).select(key, tx.clean_phrase(F.col("p")).alias("phrase"))
    return found.where(F.col("phrase").isNotNull() & tx.well_formed(F.col("phrase"))).distinct()


def spaced(text: Column) -> Column:
    """Lower-case words and signs with one blank around each, to look for words that stand together."""
    t = F.regexp_replace(F.lower(text), r"([^\p{L}\p{N}_ \t\r\n])", " $1 ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " ")), F.lit(" "))


def definitions(names: DataFrame, docs: DataFrame) -> DataFrame:
    """(concept_id, kind, definition): of each name and its source document the best sentence.

    First a sentence of 20 characters or more in which the name, as whole words, is followed by a defining verb (kind 1), else one of 25
    to 300 characters that has the name (kind 2), else the 250 characters from the name on (kind 3); in order of the text. Names that the
    document does not hold have no row.
    """
    both = names.join(docs.select(F.col("doc_id").alias("source_doc_id"), "text"), "source_doc_id").where(F.contains(F.lower("text"), F.lower("name")))
    low = F.lower("name")
    cut = both.select("concept_id", "name", "text", F.posexplode_outer(tx.sentences(F.col("text"))).alias("at", "s"))
    cut = cut.withColumn("words", spaced(F.col("s"))).withColumn("term", spaced(F.col("name")))
    verb = F.exists(F.array(*map(F.lit, DEFINING)), lambda v: F.contains("words", F.concat("term", v, F.lit(" "))))
    kind = F.when(verb, 1).when(F.contains(F.lower("s"), low) & F.length("s").between(25, 300), 2).otherwise(3)
    best = first_of_key(cut.withColumn("kind", kind), F.col("concept_id"), F.col("kind"), F.col("at"))
    snippet = F.substring("text", F.expr("locate(lower(name), lower(text))"), F.lit(250))
    body = F.trim(F.when(F.col("kind") == 3, snippet).otherwise(F.col("s")))
    end = F.when(F.col("kind") == 3, F.lit("...")).when(body.endswith("."), F.lit("")).otherwise(F.lit("."))
    return best.select("concept_id", "kind", F.concat(body, end).alias("definition"))


def canonical_groups(names: DataFrame) -> DataFrame:
    """(norm, canonical_id, canonical_name, definition, n_forms): the chosen row of each normalised form.

    ``names``: (id, name, definition, source_doc_id, ord). A row with source comes before one without, whatever else they have; then
    one with definition, then the more frequent spelling, the shorter one, and the earlier row. The first definition in row order is inherited.
    """
    rows = names.withColumn("norm", tx.normalize_name(F.col("name")))
    freq = rows.groupBy("norm", "name").agg(F.count("*").alias("freq"))
    rows = rows.join(freq, ["norm", "name"])
    has_text = F.coalesce(F.length(F.trim("definition")) > 0, F.lit(False))
    best = first_of_key(rows, F.col("norm"), F.col("source_doc_id").isNull(), ~has_text, F.desc("freq"), F.length("name"), F.col("ord"))
    groups = rows.groupBy("norm").agg(F.min(F.when(has_text, F.struct("ord", "definition"))).alias("d"), F.count_distinct("name").alias("n_forms"))
    return best.select("norm", F.col("id").alias("canonical_id"), F.col("name").alias("canonical_name")).join(groups, "norm").select("norm", "canonical_id", "canonical_name", F.col("d.definition").alias("definition"), "n_forms")


def aliases_of(names: DataFrame) -> DataFrame:
    """(norm, alias): the spellings of each normalised form beside the chosen one."""
    chosen = canonical_groups(names).select("norm", F.col("canonical_name").alias("alias"))
    return names.select(tx.normalize_name(F.col("name")).alias("norm"), F.col("name").alias("alias")).distinct().join(chosen, ["norm", "alias"], "left_anti")


def rejected(names: DataFrame, size: int = 1) -> DataFrame:
    """(norm, id, name, reason): what the choice of a form leaves out, and why: the form itself, the missing source or definition, frequency, or length.

    ``size``: forms with fewer rows are a lone spelling and reject nothing. The reason is the first of the orders of ``canonical_groups`` that tells the row from the chosen one.
    """
    rows = names.withColumn("norm", tx.normalize_name(F.col("name")))
    rows = rows.join(rows.groupBy("norm", "name").agg(F.count("*").alias("freq")), ["norm", "name"])
    has_text = F.coalesce(F.length(F.trim("definition")) > 0, F.lit(False))
    rows = rows.select("norm", "id", "name", F.col("source_doc_id").isNull().alias("bare"), (~has_text).alias("mute"), "freq", F.length("name").alias("n"))
    best = canonical_groups(names).select("norm", "canonical_id").join(rows.select(F.col("norm").alias("k"), F.col("id").alias("i"), *(F.col(c).alias(f"best_{c}") for c in ("name", "bare", "mute", "freq", "n"))), (F.col("k") == F.col("norm")) & (F.col("i") == F.col("canonical_id")))
    j = rows.join(best.drop("k", "i"), "norm").where("id <> canonical_id")
    reason = F.when(F.col("name") == F.col("best_name"), "same_form").when(F.col("bare") != F.col("best_bare"), "no_source").when(F.col("mute") != F.col("best_mute"), "no_definition").when(F.col("freq") != F.col("best_freq"), "less_frequent").when(F.col("n") != F.col("best_n"), "longer").otherwise("later")
    return j.select("norm", "id", "name", reason.alias("reason"))


def degenerate(names: DataFrame) -> DataFrame:
    """The names (id, name) that are no concept: empty after cleaning, amounts, page words, edge words at an end, three characters or less."""
    p = tx.clean_phrase(F.col("name"))
    return names.where(p.isNull() | ~tx.well_formed(p))


def verified(concepts: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """The concepts that an outside check keeps: those without a verdict (key, keep) stay, as do those with a null one.

    Several verdicts of a concept: one that keeps it is enough.
    """
    v = verdicts.groupBy(key).agg(F.max(F.coalesce(F.col("keep"), F.lit(True)).cast("int")).alias("_keep"))
    return concepts.join(v, key, "left").where("coalesce(_keep, 1) = 1").drop("_keep")


def concepts_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, norm): of each document its phrases as concepts, one for each normal form (the least spelling)."""
    p = phrases(docs, key, text).withColumn("norm", tx.normalize_name(F.col("phrase")))
    return p.where("norm <> ''").groupBy(key, "norm").agg(F.min("phrase").alias("name")).select(key, "name", "norm")
