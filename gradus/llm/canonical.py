"""Mapping freely typed names to a canonical list.

Each distinct typed token is joined to the tokens of the list by keys that all spellings within its edit distance share, and
keeps the tokens it may stand for. Typed names meet entries by the corrected tokens of their rarest word, and each pair is
scored by soft TF-IDF: the sum, over the words of the name, of similarity times the weights of word and token in the
normalised vectors of both. The best entry is kept if it is complete, that is if each of its tokens has a word of its own and no
word is left over. What is joined or torn into other words ("drol hamongraph") is repaired and scored as a name of one token.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.names import FILLERS, distance, edit_keys, entry_keys, fold, similarity, typed_keys
from gradus.session import Scratch

#: A token stands for the tokens of the list that are this much less similar than its best one, at most.
MARGIN = 0.12
#: Least soft TF-IDF similarity of a name and the entry it stands for.
LEAST = 0.5
#: Edits, and least letters, of names compared as one token; shorter ones must be equal.
WHOLE_EDITS, WHOLE_LETTERS = 2, 9


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows over all shuffle partitions: few bytes can be much work for Python, which merged partitions would do in one task.

    Rows are made distinct first, in part before anything is shuffled: a pair that shares a hundred keys is there a hundred times.
    """
    return df.distinct().repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _folded(df: DataFrame, column: str) -> DataFrame:
    """(name, tokens): each distinct non-null name with its folded tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array([fold(x) for x in names], type=pa.list_(pa.string()))], names=["name", "tokens"])

    return _spread(df.select(F.col(column).alias("name")).where("name is not null"), "name").mapInArrow(run, "name string, tokens array<string>")


def _keyed(df: DataFrame, column: str, keys) -> DataFrame:
    """(column, key): the keys of each token, as one number each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, out = [], []
            for t in batch.column(0).to_pylist():
                own = {kind + x for kind, x in keys(t)}
                tokens += [t] * len(own)
                out += own
            yield pa.record_batch([pa.array(tokens, type=pa.string()), pa.array(out, type=pa.string())], names=[column, "key"])

    return df.mapInArrow(run, f"{column} string, key string").select(column, F.xxhash64("key").alias("key"))


def _sharing(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """The rows of both sides that share a key, without it.

    By a sorted join: the planner sizes keys by the texts they are made of, of which each has hundreds, and would send them all through the driver.
    """
    return left.join(right.hint("merge"), "key").select(*columns)


def _scored(pairs: DataFrame) -> DataFrame:
    """(typed, token, sim) of the pairs that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = [similarity(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sims, type=pa.float64())], names=["typed", "token", "sim"])

    return pairs.mapInArrow(run, "typed string, token string, sim double").where("sim > 0")


def content_words(tokens: str) -> Column:
    """The tokens without fillers; all of them if there are only fillers."""
    rest = F.filter(tokens, lambda t: ~t.isin(*FILLERS))
    return F.when(F.size(rest) > 0, rest).otherwise(F.col(tokens))


def repair_tokens(typed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(typed, token, sim): for each distinct typed token, the tokens of the vocabulary that it may stand for.

    A token of the vocabulary stands for itself alone. Of others, all within ``MARGIN`` of the most similar one: what is much less
    alike is another word.
    """
    same = typed.join(vocabulary, F.col("typed") == F.col("token"), "left_semi").select("typed", F.col("typed").alias("token"), F.lit(1.0).alias("sim"))
    other = typed.join(vocabulary, F.col("typed") == F.col("token"), "left_anti")
    pairs = _sharing(_keyed(other, "typed", typed_keys), _keyed(vocabulary.select("token"), "token", entry_keys), "typed", "token")
    pairs = _spread(pairs, "typed", "token")
    best = Window.partitionBy("typed")
    near = _scored(pairs).withColumn("most", F.max("sim").over(best)).where(F.col("sim") >= F.col("most") - MARGIN).drop("most")
    return same.unionByName(near)


def _covered(words: int, links: list[tuple[int, int]], tokens: int) -> bool:
    """Whether each token can have a word of its own among the words it is linked to (by augmenting paths)."""
    by_token: dict[int, list[int]] = {}
    for w, t in links:
        by_token.setdefault(t, []).append(w)
    holder: dict[int, int] = {}

    def place(t: int, seen: set[int]) -> bool:
        for w in by_token.get(t, ()):
            if w not in seen:
                seen.add(w)
                if w not in holder or place(holder[w], seen):
                    holder[w] = t
                    return True
        return False

    return tokens <= words and all(place(t, set()) for t in range(tokens))


def _complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (name, sign, score) whose entry is covered: each of its tokens by a word of its own."""
    for batch in batches:
        good = []
        for hits, tokens in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            place = {t: i for i, t in enumerate(tokens)}
            good.append(_covered(len({h["pos"] for h in hits}), [(h["pos"], place[h["token"]]) for h in hits], len(tokens)))
        yield batch.select(["name", "sign", "score"]).filter(pa.array(good, type=pa.bool_()))


def _by_words(scratch: Scratch, names: DataFrame, listed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(name, sign, score): the complete entries of each name, with their soft TF-IDF similarity.

    A word must be matched unless it is a filler that is no token of the list, or has at most three letters and is
    none. As every other word of a name needs a token of the entry, the entries that hold a correction of its rarest
    one are all that can be complete; so a name meets no more entries than its rarest word has, and none is lost.
    """
    slots = names.select("name", F.posexplode("tokens").alias("pos", "typed"))
    repairs = scratch.keep(repair_tokens(slots.select("typed").distinct(), vocabulary))
    weighed = repairs.join(vocabulary, "token").groupBy("typed").agg(F.max("sim").alias("best"), F.max_by("idf", F.struct("sim", "token")).alias("w"), F.sum("n").alias("cost"))
    own = slots.join(weighed, "typed", "left")
    exact = F.coalesce(F.col("best") == 1, F.lit(False))
    own = own.withColumn("free", ~exact & (F.col("typed").isin(*FILLERS) | (F.length("typed") <= 3)))
    own = own.withColumn("w", F.when(F.col("typed").isin(*FILLERS) & ~exact, 0.0).otherwise(F.coalesce("w", F.lit(1.0))))
    own = scratch.keep(own.select("name", "pos", "typed", "free", "w", "cost"))
    whole = own.groupBy("name").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"), F.count_if(~F.col("free")).alias("must"), F.bool_or(~F.col("free") & F.col("cost").isNull()).alias("lost"))
    whole = scratch.keep(whole.where("not lost and length > 0").drop("lost"))
    least = own.where("not free").groupBy("name").agg(F.min_by("typed", F.struct("cost", "pos")).alias("typed"))
    # Names of short words only have no word that must match, and meet the entries of all of them.
    asked = least.unionByName(own.join(whole.where("must = 0"), "name", "left_semi").select("name", "typed")).join(whole, "name", "left_semi")
    postings = listed.select("sign", F.size("words").alias("size"), F.explode("words").alias("token")).distinct()
    pairs = asked.join(repairs, "typed").join(postings, "token").select("name", "sign").distinct()
    entries = listed.select("sign", "words").distinct()
    lengths = postings.join(vocabulary, "token").groupBy("sign").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    hits = pairs.join(own.select("name", "pos", "typed", "free", "w"), "name").join(repairs, "typed").join(postings.select("sign", "token"), ["sign", "token"]).join(vocabulary.select("token", "idf"), "token")
    part = hits.groupBy("name", "sign", "pos").agg(F.max(F.col("sim") * F.col("w") * F.col("idf")).alias("part"), F.first("free").alias("free"), F.collect_set("token").alias("tokens"))
    links = F.flatten(F.collect_list(F.transform("tokens", lambda t: F.struct(F.col("pos").alias("pos"), t.alias("token")))))
    scored = part.groupBy("name", "sign").agg(F.sum("part").alias("dot"), F.count_if(~F.col("free")).alias("n"), links.alias("hits"))
    scored = scored.join(whole, "name").where("n = must").join(lengths, "sign").withColumn("score", F.col("dot") / (F.col("length") * F.col("norm")))
    scored = scored.where(F.col("score") >= LEAST).join(entries, "sign").select("name", "sign", "score", "hits", "words")
    return scratch.keep(scored.mapInArrow(_complete, "name string, sign string, score double"))


def _whole_keys(listed: bool):
    def keys(s: str) -> Iterator[tuple[str, str]]:
        for x in edit_keys(s, WHOLE_EDITS if len(s) >= WHOLE_LETTERS else 0, listed):
            yield "w", x

    return keys


def _whole(rest: DataFrame, entries: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(name, sign, score) by the name as one token, for names that the word-wise repair left over.

    The vectors of both have one token of weight 1, so their soft TF-IDF is its similarity: one less the edits by length.
    With ``scratch`` the near pairs are kept, so that the shuffles of the keys, which are hundreds of times as many, go before anything else is joined.
    """
    squash, plain = F.array_join(content_words("tokens"), ""), F.array_join("tokens", "")
    infix = F.regexp_replace(plain, "of", "")
    typed = rest.select("name", F.explode(F.array_distinct(F.array(squash, plain, infix))).alias("w")).where("w <> ''")
    known = entries.select("sign", plain.alias("v")).distinct()
    pairs = _sharing(_keyed(typed.select("w").distinct(), "w", _whole_keys(False)), _keyed(known.select("v").distinct(), "v", _whole_keys(True)), "w", "v")
    # Spark's own edit distance first: it has no swaps, which it counts as two.
    near = _spread(pairs.where(F.levenshtein("w", "v", 2 * WHOLE_EDITS) >= 0), "w", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [distance(a, b, WHOLE_EDITS) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(d, type=pa.int32())], names=["w", "v", "d"])

    near = near.mapInArrow(run, "w string, v string, d int").where(F.col("d") <= F.when(F.least(F.length("w"), F.length("v")) >= WHOLE_LETTERS, WHOLE_EDITS).otherwise(0))
    near = scratch.keep(near) if scratch else near
    sim = 1 - F.col("d") / F.greatest(F.length("w"), F.length("v"))
    return typed.join(near, "w").join(known, "v").groupBy("name", "sign").agg(F.max(sim).alias("score")).where(F.col("score") >= LEAST)


def match_names(typed: DataFrame, column: str, entries: DataFrame, entry: str) -> DataFrame:
    """(name, entry, score): each distinct typed name with the entry it stands for; names that stand for none are absent.

    Order of the words, letter case, accents, separators, fillers, plural forms, abbreviations and up to two or three
    edits in a word make no difference; a word that is none of an entry's words does. Null and empty names stand for
    none; repeated names count once; an empty list matches nothing. Words and names of any length are compared. Entries of equal
    score (equal words, order apart) are told apart by the edit distance to the name, then by the smaller text.
    """
    scratch = Scratch(typed.sparkSession, "names", tidy=True)
    listed = _folded(entries, entry).where(F.size("tokens") > 0).select("name", content_words("tokens").alias("tokens"))
    listed = listed.withColumn("words", F.array_sort(F.array_distinct("tokens")))
    listed = scratch.keep(listed.withColumn("sign", F.array_join("words", " ")))
    names = scratch.keep(_folded(typed, column).where(F.size("tokens") > 0))
    total = listed.count()
    vocabulary = listed.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    vocabulary = scratch.keep(vocabulary.select("token", "n", F.log(1 + F.lit(total) / F.col("n")).alias("idf")))
    by_words = _by_words(scratch, names, listed, vocabulary)
    rest = names.join(by_words, "name", "left_anti")
    found = by_words.unionByName(_whole(rest, listed, scratch)).join(listed.select("sign", F.col("name").alias("entry")), "sign")
    order = Window.partitionBy("name").orderBy(F.desc(F.round("score", 6)), F.levenshtein(F.lower("name"), F.lower("entry")), "entry")
    return found.withColumn("r", F.row_number().over(order)).where("r = 1").select("name", "entry", "score")


def map_aliases(aliases: DataFrame, concepts: DataFrame) -> DataFrame:
    """(alias_id, alias, concept_id, score): for each alias_id without concept_id the concept it denotes, or 0.

    Rows without alias_id are left out. Of several rows of an alias_id the least alias counts. Where several concepts
    have the name, one of the alias's domain comes first, then the smallest concept_id.
    """
    open_ = aliases.where("alias_id is not null and concept_id is null").groupBy("alias_id").agg(F.min(F.struct("alias", "domain_id")).alias("a")).select("alias_id", "a.alias", "a.domain_id")
    named = concepts.where("concept_id is not null and canonical_name is not null").select("concept_id", "domain_id", "canonical_name")
    matched = match_names(open_, "alias", named, "canonical_name")
    own = named.groupBy(F.col("canonical_name").alias("entry"), "domain_id").agg(F.min("concept_id").alias("own_id"))
    any_ = named.groupBy(F.col("canonical_name").alias("entry")).agg(F.min("concept_id").alias("any_id"))
    out = open_.join(matched, open_["alias"] == matched["name"], "left").join(own, ["entry", "domain_id"], "left").join(any_, "entry", "left")
    return out.select("alias_id", "alias", F.coalesce("own_id", "any_id", F.lit(0).cast("bigint")).alias("concept_id"), "score")
