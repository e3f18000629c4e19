"""Sources and sinks of other forms: CSV folds and gold files, text folders, vectors, JSON artefacts, appends, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD_SCHEMA = "concept_a string, concept_b string, label int"
FOLD_COLUMNS = {"Concept": "concept", "Prerequisite": "prerequisite", "label_prereq": "label"}
VECTOR_SCHEMA = "name string, vec array<float>"


def read_gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """(concept_a, concept_b, label) of a CSV file with a header; rows with a label other than 1, 0 and -1 are left out."""
    return spark.read.csv(path, header=True, schema=GOLD_SCHEMA).where(F.col("label").isin(1, 0, -1))


def read_folds(spark: SparkSession, folder: str) -> DataFrame:
    """(domain, part, fold, concept, prerequisite, label) of all files <domain>_<train|test>_split_<k>.csv of a folder.

    Columns are taken by the names in the header, in whatever order they stand: Concept, Prerequisite and label_prereq. Files of one
    folder have the same header; one with another order of the columns is an error, never a changed meaning.
    """
    raw = spark.read.csv(folder, header=True, pathGlobFilter="*_split_*.csv", enforceSchema=False)
    rows = raw.select(*(F.col(c).cast("int" if name == "label" else "string").alias(name) for c, name in FOLD_COLUMNS.items()))
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    parts = [F.regexp_extract(name, r"^(.*)_(train|test)_split_(\d+)$", i) for i in (1, 2, 3)]
    return rows.select(parts[0].alias("domain"), parts[1].alias("part"), parts[2].cast("int").alias("fold"), "concept", "prerequisite", "label")


def read_texts(spark: SparkSession, folder: str, least: int = 50, domains: dict[str, str] | None = None) -> DataFrame:
    """(path, text, domain) of the text files below a folder with at least ``least`` characters.

    ``domains`` maps a word to a domain; the first word that stands in the path decides, no word gives null.
    """
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{txt,tsv}").select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    domain = F.coalesce(*(F.when(F.contains(F.lower("path"), F.lit(w.lower())), F.lit(x)) for w, x in (domains or {}).items()), F.lit(None).cast("string"))
    return rows.where(F.length(F.trim("text")) >= least).withColumn("domain", domain)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTOR_SCHEMA).parquet(path)


def write_vectors(df: DataFrame, path: str) -> None:
    df.select("name", F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append(df: DataFrame, path: str, *partitions: str) -> None:
    """Adds rows to a Parquet table, partitioned if asked; one job, no batches."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def save_coefficients(model, path: str, spark: SparkSession) -> None:
    """The numbers of a logistic model as a one-row table (weights, bias), from which scoring needs no model class."""
    spark.createDataFrame([([float(x) for x in model.coefficients], float(model.intercept))], "weights array<double>, bias double").write.mode("overwrite").parquet(path)


def load_coefficients(path: str, spark: SparkSession) -> tuple[list[float], float]:
    """Weights and bias that ``save_coefficients`` wrote."""
    row = spark.read.schema("weights array<double>, bias double").parquet(path).head()
    return list(row["weights"]), row["bias"]


def parse_concepts(raw: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, definition) of model answers that should be a JSON list of objects.

    Code fences are taken off; where the list does not parse (cut short, trailing words), each object with a name and a definition, in
    either order, is still found.
    """
    body = F.trim(F.regexp_replace(F.col(text), r"```(?:json)?", ""))
    rows = raw.select(key, body.alias("body"), F.from_json(body, "array<struct<name:string,definition:string>>").alias("j"))
    good = rows.where(F.size("j") > 0).select(key, F.inline("j"))
    q = r'"((?:[^"\\]|\\.)*)"'
    bad = rows.where(F.coalesce(F.size("j"), F.lit(0)) <= 0)
    one = bad.select(key, F.explode(F.regexp_extract_all("body", F.lit(r"\{[^{}]*\}"), F.lit(0))).alias("o"))
    found = one.select(key, F.regexp_extract("o", rf'"name"\s*:\s*{q}', 1).alias("name"), F.regexp_extract("o", rf'"definition"\s*:\s*{q}', 1).alias("definition"))
    return good.unionByName(found.where("name <> ''")).where("name is not null").distinct()


def search_result_urls(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, url): result links of a search page, redirects (uddg=) decoded, binary files left out."""
    links = pages.select(key, F.explode(F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]+)"'), F.lit(1))).alias("u"))
    inner = F.regexp_extract("u", r"[?&]uddg=([^&]+)", 1)
    url = F.when(inner != "", F.url_decode(inner)).otherwise(F.col("u"))
    return links.select(key, url.alias("url")).where(F.col("url").rlike(r"^https?://") & ~F.lower("url").rlike(r"\.(?:pdf|docx?|pptx?|xlsx?|zip|jpg|jpeg|png|gif|mp4)(?:$|\?)")).distinct()
