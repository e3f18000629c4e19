"""Queries of the text and naming operators over documents, concepts and aliases, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions import text as tx
from gradus.functions.columns import r6
from gradus.operators import corpus
from gradus.sources.tables import table, wide_table


def q_ref_strip(spark: SparkSession, d: str) -> DataFrame:
    t = tx.strip_references(F.col("text"))
    return wide_table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(t.cast("binary")).alias("md5"), F.length(t).alias("n_chars"))


def q_html_clean(spark: SparkSession, d: str) -> DataFrame:
    t = tx.html_to_text(F.col("text"))
    return wide_table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(t.cast("binary")).alias("md5"), F.size(F.split(t, "\n")).alias("n_lines"))


def q_phrase_filters(spark: SparkSession, d: str) -> DataFrame:
    parts = wide_table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", r"[.,;:()\n]+")).alias("p")).where(F.col("p").rlike("[^ ]"))
    return parts.groupBy("doc_id").agg(F.count("*").alias("n_phrases"), F.count_if(tx.is_amount(F.col("p"))).alias("n_amounts"), F.count_if(tx.is_page_word(F.col("p"))).alias("n_page_words"))


def q_phrases(spark: SparkSession, d: str) -> DataFrame:
    p = corpus.phrases(wide_table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").groupBy("doc_id").agg(F.sort_array(F.collect_list("phrase")).alias("p"))
    return p.select("doc_id", F.size("p").alias("n_phrases"), F.element_at("p", 1).alias("first_phrase"), F.md5(F.array_join("p", "\n").cast("binary")).alias("md5"))


def q_doc_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of every document by normal form."""
    return corpus.concepts_of(wide_table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def q_degenerate(spark: SparkSession, d: str) -> DataFrame:
    return corpus.degenerate(_names(spark, d)).select("id", "name")


def q_rejections(spark: SparkSession, d: str) -> DataFrame:
    """What the canonical pick leaves out, with the reason."""
    return corpus.rejected(_names(spark, d))


def q_verify_keep(spark: SparkSession, d: str) -> DataFrame:
    """Concepts after verdicts, here: the merge runs that link a concept to itself or to nothing drop it, unless another row has a score."""
    pairs = table(spark, d, "merge_pairs")
    verdicts = pairs.select(F.col("left_id").alias("concept_id"), F.when(F.col("score").isNotNull(), True).when(F.col("right_id").isNull() | (F.col("right_id") == F.col("left_id")), False).alias("keep"))
    return corpus.verified(table(spark, d, "concepts").select("concept_id", "canonical_name").distinct(), verdicts.where("concept_id is not null"), "concept_id")


def q_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = tx.sentences(F.col("text"))
    return wide_table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.size(s).alias("n_sentences"), F.aggregate(s, F.lit(0), lambda a, x: a + F.length(x)).alias("n_chars"))


def q_sections(spark: SparkSession, d: str) -> DataFrame:
    s = tx.sections(F.col("text"))
    return wide_table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.posexplode(s).alias("section", "s")).select("doc_id", "section", F.length("s").alias("n_chars"))


def q_chunks(spark: SparkSession, d: str) -> DataFrame:
    pieces = wide_table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.posexplode(tx.chunks(F.col("text"))).alias("chunk", "piece"))
    return pieces.select("doc_id", "chunk", F.length("piece").alias("n_chars"), F.md5(F.col("piece").cast("binary")).alias("md5"))


def q_definitions(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "concepts").select("concept_id", F.col("canonical_name").alias("name"), "source_doc_id").distinct()
    return corpus.definitions(names, table(spark, d, "documents")).select("concept_id", "kind", F.md5(F.col("definition").cast("binary")).alias("md5"))


def q_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "concept_aliases").where("alias is not null").select("alias", tx.normalize_name(F.col("alias")).alias("norm")).distinct()


def _names(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "concepts").select(F.col("concept_id").alias("id"), F.col("canonical_name").alias("name"), "definition", "source_doc_id", F.col("concept_id").alias("ord"))
    other = table(spark, d, "concept_aliases").where("alias is not null").select(F.col("alias_id").alias("id"), F.col("alias").alias("name"), F.lit(None).cast("string").alias("definition"), F.lit(None).cast("bigint").alias("source_doc_id"), F.col("alias_id").alias("ord"))
    return own.distinct().unionByName(other.distinct())


def q_canonical_pick(spark: SparkSession, d: str) -> DataFrame:
    return corpus.canonical_groups(_names(spark, d))


def q_aliases(spark: SparkSession, d: str) -> DataFrame:
    return corpus.aliases_of(_names(spark, d))


def q_title_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("title is not null").withColumn("key", F.lower(F.trim("title")))
    rank = F.when(F.col("source_type") == "wikipedia", 0).when(F.col("source_type") == "syllabus", 1).when(F.col("source_type") == "al_cpl", 2).otherwise(3)
    return corpus.first_of_key(docs, F.col("key"), rank, F.col("doc_id")).select("key", "doc_id", "source_type")


def q_concept_text(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "concepts").select("concept_id", "canonical_name", "definition").distinct()
    t = F.concat_ws(" ", F.nullif(F.trim("canonical_name"), F.lit("")), F.nullif(F.trim("definition"), F.lit("")))
    return c.select("concept_id", t.alias("concept_text"), F.substring(F.sha2(t.cast("binary"), 256), 1, 16).alias("cache_key"))


def q_bow_buckets(spark: SparkSession, d: str) -> DataFrame:
    b = wide_table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(tx.bow_buckets(F.col("text"))).alias("bucket")).groupBy("doc_id", "bucket").agg(F.count("*").alias("n"))
    norm = b.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    return b.join(norm, "doc_id").select("doc_id", "bucket", r6(F.col("n") / F.col("norm")).alias("weight"))


def q_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "domains").select("domain_id", tx.slug(F.col("goal_concept")).alias("slug"))


def q_source_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source_type").agg(F.count("*").alias("n_docs"), F.count_distinct("domain_id").alias("n_domains"), F.sum("n_chars").alias("n_chars"))


_S = r"[ \t\r\n]+"
_REF = rf"regexp_replace(%s, '(?is)\n={{2,}} *(?:{'|'.join(tx.REFERENCE_HEADINGS)}) *={{2,}}(?:\n.*)?\z', '')".replace("\\n", "\\n")


def _html(x: str) -> str:
    for tag in tx.SILENT_TAGS:
        x = f"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)</?(?:{'|'.join(tx.LINE_TAGS)})(?: [^>]*)?/?>', chr(10), 'g')"
    x = rf"regexp_replace({x}, '<[^>\n]+>', ' ', 'g')"
    for entity, plain in tx.ENTITIES:
        x = f"replace({x}, '{entity}', '{plain.replace(chr(39), 2 * chr(39))}')"
    x = _REF % x
    return rf"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'))), lambda x: length(x) > 1), chr(10))"


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _amount(p: str) -> str:
    low = f"lower(trim({p}))"
    rest = f"list_filter(string_split_regex(regexp_replace({low}, '[^a-z ]', ' ', 'g'), ' +'), lambda x: x <> '')"
    return rf"(regexp_matches({low}, '^[0-9]+(?:\.[0-9]+)? ?%?(?: ?(?:-|–|to) ?[0-9]+(?:\.[0-9]+)? ?%?)?$') OR NOT regexp_matches({low}, '[a-z]') OR len(list_filter({rest}, lambda x: x NOT IN {_in(tx.AMOUNT_WORDS)})) = 0)"


def _page(p: str) -> str:
    t = f"trim({p})"
    shouted = f"length({t}) >= 3 AND (" + " OR ".join(f"contains(lower({t}), '{s}')" for s in tx.PAGE_STEMS) + ")"
    return f"(lower({t}) IN {_in(tx.PAGE_WORDS)} OR regexp_matches(lower({t}), '^(?:{'|'.join(tx.NUMBERED)}) +(?:[0-9]+|[a-z])$') OR (upper({t}) = {t} AND regexp_matches({t}, '[A-Z]') AND ({shouted})))"


def _formed(p: str) -> str:
    words = f"string_split_regex(lower(trim({p})), '{_S}')"
    return f"(length(trim({p})) > 3 AND {words}[1] NOT IN {_in(tx.EDGE_WORDS)} AND {words}[-1] NOT IN {_in(tx.EDGE_WORDS)} AND NOT {_amount(p)} AND NOT {_page(p)})"


def _spaced(x: str) -> str:
    return rf"(' ' || trim(regexp_replace(regexp_replace(lower({x}), '([^\p{{L}}\p{{N}}_ \t\r\n])', ' \1 ', 'g'), '{_S}', ' ', 'g')) || ' ')"


_CLEAN1 = r"regexp_replace(regexp_replace(trim(p), '(?i)^(?:the|an|a) +', ''), '^[.,;:!?''""()*-]+|[.,;:!?''""()*-]+$', '', 'g')".replace('""', '"')
_CLEAN = f"trim(regexp_replace({_CLEAN1}, '{_S}', ' ', 'g'))"


def _norm(name: str) -> str:
    t = f"regexp_replace(lower(trim({name})), '^(?:a|an|the) +', '')"
    return rf"trim(regexp_replace(regexp_replace({t}, '[''’]s( |$)|[''’]( |$)', '\1\2', 'g'), '{_S}', ' ', 'g'))"


_NORM = rf"""
SELECT *, CASE WHEN last LIKE '%ies' AND length(last) > 3 THEN t[:length(t) - 3] || 'y'
  WHEN regexp_matches(last, '(?:s|x|ch|sh)es$') AND length(last) > 4 THEN t[:length(t) - 2]
  WHEN last LIKE '%s' AND NOT regexp_matches(last, '(?:ss|us|is)$') AND length(last) > 3 THEN t[:length(t) - 1] ELSE t END AS norm
FROM (SELECT *, string_split(t, ' ')[-1] AS last FROM (SELECT *, {_norm('name')} AS t FROM names))
"""
_NAMES = """names AS (
    SELECT DISTINCT concept_id AS id, canonical_name AS name, definition, source_doc_id, concept_id AS ord FROM concepts
    UNION ALL SELECT DISTINCT alias_id, alias, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), alias_id FROM concept_aliases WHERE alias IS NOT NULL
)"""
_GROUPS = f"""WITH {_NAMES}, normed AS ({_NORM}),
scored AS (SELECT *, source_doc_id IS NULL AS bare, NOT coalesce(length(trim(definition)) > 0, false) AS mute, count(*) OVER (PARTITION BY norm, name) AS freq, length(name) AS n FROM normed),
best AS (SELECT norm, id AS canonical_id, name AS canonical_name, bare, mute, freq, n FROM scored QUALIFY row_number() OVER (PARTITION BY norm ORDER BY bare, mute, freq DESC, n, ord) = 1),
grouped AS (SELECT norm, count(DISTINCT name) AS n_forms, arg_min(definition, ord) FILTER (WHERE length(trim(definition)) > 0) AS definition FROM normed GROUP BY norm)"""
_SENT = rf"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?]){_S}', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: length(x) >= 20)"

_PHRASES = rf"""phrases AS (SELECT DISTINCT doc_id, phrase FROM (SELECT doc_id, {_CLEAN} AS phrase FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{N}}_ \t\r\n]+', '|', 'g'), '[^A-Za-z| \t\r\n]', '0', 'g'), '{corpus.PHRASE}')) AS p FROM documents)) WHERE {_formed('phrase')})"""

QUERIES = {f.__name__: f for f in (q_ref_strip, q_html_clean, q_phrase_filters, q_phrases, q_doc_concepts, q_degenerate, q_rejections, q_verify_keep, q_sentences, q_sections, q_chunks, q_definitions, q_normalize, q_canonical_pick, q_aliases, q_title_dedupe, q_concept_text, q_bow_buckets, q_slug, q_source_breakdown)}
SQL = {
    "q_ref_strip": f"SELECT doc_id, md5(t) AS md5, length(t) AS n_chars FROM (SELECT doc_id, {_REF % 'text'} AS t FROM documents)",
    "q_html_clean": f"SELECT doc_id, md5(t) AS md5, CASE WHEN t IS NULL THEN NULL ELSE len(string_split(t, chr(10))) END AS n_lines FROM (SELECT doc_id, {_html('text')} AS t FROM documents)",
    "q_phrase_filters": rf"SELECT doc_id, count(*) AS n_phrases, count(*) FILTER (WHERE {_amount('p')}) AS n_amounts, count(*) FILTER (WHERE {_page('p')}) AS n_page_words FROM (SELECT doc_id, unnest(string_split_regex(text, '[.,;:()\n]+')) AS p FROM documents) WHERE regexp_matches(p, '[^ ]') GROUP BY doc_id",
    "q_phrases": f"WITH {_PHRASES} SELECT doc_id, count(*) AS n_phrases, min(phrase) AS first_phrase, md5(string_agg(phrase, chr(10) ORDER BY phrase)) AS md5 FROM phrases GROUP BY doc_id",
    "q_doc_concepts": f"WITH {_PHRASES}, names AS (SELECT doc_id, phrase AS name FROM phrases) SELECT doc_id, min(name) AS name, norm FROM ({_NORM}) WHERE norm <> '' GROUP BY doc_id, norm",
    "q_degenerate": f"WITH {_NAMES}, c AS (SELECT id, name, (SELECT {_CLEAN} FROM (SELECT name AS p)) AS phrase FROM names) SELECT id, name FROM c WHERE NOT (length(phrase) >= 3 AND NOT regexp_matches(phrase, '[\\[\\]{{}}<>=+]') AND {_formed('phrase')})",
    "q_rejections": f"""{_GROUPS} SELECT s.norm, s.id, s.name, CASE WHEN s.name = b.canonical_name THEN 'same_form' WHEN s.bare <> b.bare THEN 'no_source' WHEN s.mute <> b.mute THEN 'no_definition' WHEN s.freq <> b.freq THEN 'less_frequent' WHEN s.n <> b.n THEN 'longer' ELSE 'later' END AS reason
        FROM scored s JOIN best b USING (norm) WHERE s.id <> b.canonical_id""",
    "q_verify_keep": """WITH v AS (SELECT left_id AS concept_id, bool_or(score IS NOT NULL OR NOT coalesce(right_id IS NULL OR right_id = left_id, false)) AS keep FROM merge_pairs WHERE left_id IS NOT NULL GROUP BY 1)
        SELECT DISTINCT c.concept_id, c.canonical_name FROM concepts c LEFT JOIN v USING (concept_id) WHERE coalesce(keep, true)""",
    "q_sentences": f"SELECT doc_id, len(s) AS n_sentences, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::INT AS n_chars FROM (SELECT doc_id, {_SENT} AS s FROM documents WHERE text IS NOT NULL)",
    "q_sections": "SELECT doc_id, unnest(range(len(s))) AS section, length(unnest(s)) AS n_chars FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x)), lambda x: length(x) >= 20) AS s FROM documents WHERE text IS NOT NULL)",
    "q_chunks": "SELECT doc_id, chunk, length(piece) AS n_chars, md5(piece) AS md5 FROM (SELECT doc_id, chunk, CASE WHEN length(text) > 8000 THEN substring(text, chunk * 6000 + 1, 6000) ELSE text END AS piece FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) > 8000 THEN ceil(length(text) / 6000.0)::BIGINT ELSE 1 END)) AS chunk FROM documents WHERE text IS NOT NULL))",
    "q_definitions": f"""WITH both_ AS (SELECT DISTINCT c.concept_id, c.canonical_name AS name, d.text FROM concepts c JOIN documents d ON d.doc_id = c.source_doc_id WHERE contains(lower(d.text), lower(c.canonical_name))),
        cut AS (SELECT concept_id, name, text, unnest(CASE WHEN len(s) = 0 THEN [CAST(NULL AS VARCHAR)] ELSE s END) AS s, unnest(range(greatest(len(s), 1))) AS place FROM (SELECT *, {_SENT} AS s FROM both_)),
        kinds AS (SELECT *, CASE WHEN {' OR '.join(f"contains({_spaced('s')}, {_spaced('name')} || '{v} ')" for v in corpus.DEFINING)} THEN 1 WHEN contains(lower(s), lower(name)) AND length(s) BETWEEN 25 AND 300 THEN 2 ELSE 3 END AS kind FROM cut),
        best AS (SELECT * FROM kinds QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY kind, place) = 1),
        body AS (SELECT concept_id, kind, trim(CASE WHEN kind = 3 THEN substring(text, instr(lower(text), lower(name)), 250) ELSE s END) AS b FROM best)
        SELECT concept_id, kind, md5(b || CASE WHEN kind = 3 THEN '...' WHEN b LIKE '%.' THEN '' ELSE '.' END) AS md5 FROM body""",
    "q_normalize": f"WITH names AS (SELECT DISTINCT alias AS name FROM concept_aliases WHERE alias IS NOT NULL) SELECT name AS alias, norm FROM ({_NORM})",
    "q_canonical_pick": f"{_GROUPS} SELECT b.norm, canonical_id, canonical_name, definition, n_forms FROM best b JOIN grouped USING (norm)",
    "q_aliases": f"{_GROUPS} SELECT DISTINCT n.norm, n.name AS alias FROM normed n JOIN best b USING (norm) WHERE n.name <> b.canonical_name",
    "q_title_dedupe": "SELECT key, doc_id, source_type FROM (SELECT *, lower(trim(title)) AS key FROM documents WHERE title IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE source_type WHEN 'wikipedia' THEN 0 WHEN 'syllabus' THEN 1 WHEN 'al_cpl' THEN 2 ELSE 3 END, doc_id) = 1",
    "q_concept_text": "SELECT concept_id, t AS concept_text, sha256(t)[:16] AS cache_key FROM (SELECT DISTINCT concept_id, concat_ws(' ', nullif(trim(canonical_name), ''), nullif(trim(definition), '')) AS t FROM concepts)",
    "q_bow_buckets": rf"""WITH b AS (SELECT doc_id, bucket, count(*) AS n FROM (SELECT doc_id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 384)::INT AS bucket FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '{_S}')) AS w FROM documents) WHERE w <> '') GROUP BY ALL)
        SELECT doc_id, bucket, floor(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)::DOUBLE) * 1e6 + 0.5) / 1e6 AS weight FROM b""",
    "q_slug": "SELECT domain_id, regexp_replace(regexp_replace(lower(goal_concept), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM domains",
    "q_source_breakdown": "SELECT source_type, count(*) AS n_docs, count(DISTINCT domain_id) AS n_domains, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source_type",
}
