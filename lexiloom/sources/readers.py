"""Sources. Every reader is lazy; schemas are given, not inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import bucket


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All splits of a named table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def split(df: DataFrame, name: str, column: str = "split") -> DataFrame:
    """One split, compared trimmed and in lower case; the predicate reaches the scan as far as Parquet allows."""
    return df.where(F.lower(F.trim(F.col(column))) == name)


def row_range(df: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """Rows start..stop-1 in the order of a key."""
    return df.orderBy(key).offset(start).limit(stop - start)


def csv(spark: SparkSession, path: str, schema: str, rows: int | None = None, encoding: str = "UTF-8") -> DataFrame:
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
    return df if rows is None else df.limit(rows)


def unescape(column: str):
    """Text read as latin-1 with backslash escapes for what is not ASCII."""

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda t: t.encode("latin-1", "replace").decode("unicode_escape", "replace"), na_action="ignore")

    return run(F.col(column))


def labelled_tree(spark: SparkSession, path: str, labels: dict[str, int] | None = None, validation: int | None = None, seed: int = 42, part: str | None = None) -> DataFrame:
    """(text, split, label[, code]) of a tree split/label/file.txt; with ``validation`` per mille held out by hash, ``part`` training or validation."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    where = F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 2)
    df = df.withColumn("split", where[0]).withColumn("label", where[1])
    if labels is not None:
        pairs = [x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]
        df = df.withColumn("code", F.try_element_at(F.create_map(*pairs), F.col("label")))
    if validation is not None:
        held = bucket(F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1), 1000, seed) < validation
        df = df.where(held if part == "validation" else ~held)
    return df.drop("path")


def category_lines(spark: SparkSession, glob: str) -> DataFrame:
    """(category, line): one record a line, the file's stem as its category; blank lines dropped."""
    df = spark.read.text(glob).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.[^./]+$", 1).alias("category"), F.trim("value").alias("line"))
    return df.where("line <> ''")


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


READING = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string,answer_start:int>>>>>>>>"


def reading_comprehension(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, context, answer, start, answers) of nested question answering JSON; the first answer leads, none gives null."""
    d = spark.read.schema(READING).option("multiLine", True).json(path)
    p = d.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p")).select("p.context", F.explode("p.qas").alias("q"))
    first = F.get("q.answers", F.lit(0))
    return p.select("q.id", "q.question", "context", first["text"].alias("answer"), first["answer_start"].alias("start"), F.col("q.answers.text").alias("answers"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def without_quotes(column: str):
    """A post without its header block, quoted lines and signature."""
    c = F.regexp_replace(F.col(column), r"^(?:[A-Za-z-]+: [^\n]*\n)+\n", "")
    c = F.regexp_replace(c, r"(?m)^>[^\n]*\n?", "")
    return F.regexp_replace(c, r"(?s)\n-- ?\n.*$", "")


def additions(spark: SparkSession, rows: int, digits: int = 3, seed: int = 0) -> DataFrame:
    """(question, answer) of sums, unique up to the order of the operands, padded and reversed."""
    top = 10**digits
    a, b = bucket("id", top, seed), bucket("id", top, seed + 1)
    df = spark.range(rows).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).dropDuplicates(["a", "b"])
    text = F.concat_ws("+", F.col("a").cast("string"), F.col("b").cast("string"))
    return df.select("a", "b", F.reverse(F.rpad(text, 2 * digits + 1, " ")).alias("question"), F.rpad((F.col("a") + F.col("b")).cast("string"), digits + 1, " ").alias("answer"))


def html_elements(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, kind, text) of headings, paragraphs, list items and cells, in order."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<(?:h[1-6]|title|p|li|td)[^>]*>.*?</(?:h[1-6]|title|p|li|td)>)"), 1)
    df = df.select(key, F.posexplode(found).alias("pos", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<([A-Za-z0-9]+)", 1))
    kind = F.when(tag.rlike("^(h[1-6]|title)$"), "Title").when(tag == "li", "ListItem").when(tag == "td", "Cell").otherwise("NarrativeText")
    from lexiloom.functions.text import html_text

    return df.select(key, "pos", kind.alias("kind"), html_text("raw").alias("text")).where("text <> ''")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) as ``writers.vocabulary`` writes it."""
    return spark.read.schema("token string, id long").json(path)


def model(path: str):
    """A fitted Spark ML pipeline."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
