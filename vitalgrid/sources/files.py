"""Readers and writers of the file formats around cohorts, questions, corpora and reasoning traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import Dataset, Registry  # noqa: F401


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """Summary CSV with a header: input, target, input_tokens, target_tokens; rows with any null go."""
    schema = "input string, target string, input_tokens int, target_tokens int"
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"').na.drop("any")


def question_pairs(spark: SparkSession, train: str, test: str, schema: str) -> DataFrame:
    """A train and a test CSV as one table with a split column."""
    read = lambda p, s: spark.read.schema(schema).csv(p, header=True, multiLine=True, escape='"').withColumn("split", F.lit(s))
    return read(train, "train").unionByName(read(test, "test"))


def question_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One CSV of questions with a header."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def split_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question JSON lines with a map of options: question, options as lines 'A. text', answer."""
    q = spark.read.schema("question string, options map<string,string>, answer_idx string").json(path, mode="DROPMALFORMED")
    lines = F.array_sort(F.transform(F.map_entries("options"), lambda e: F.concat(e["key"], F.lit(". "), e["value"])))
    return q.select("question", F.array_join(lines, "\n").alias("options"), F.col("answer_idx").alias("answer"))


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines of a stated schema; blank and broken lines are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").na.drop("all")


def graph_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, triples) from nodes.csv and kg.csv."""
    nodes = spark.read.schema("node_id string, node_type string, node_name string").csv(f"{folder}/nodes.csv", header=True)
    return nodes, spark.read.schema("x_id string, x_type string, relation string, y_id string, y_type string").csv(f"{folder}/kg.csv", header=True)


def benchmark_rows(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Six columns without a header: question, four choices, answer."""
    return spark.read.schema("question string, A string, B string, C string, D string, answer string").csv(path, multiLine=True, escape='"').withColumn("split", F.lit(split))


def subject_categories(spark: SparkSession, path: str) -> DataFrame:
    """(subject, name, category) from a JSON map of subjects."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.explode(F.from_json("value", "map<string,struct<name:string,category:string>>")).alias("subject", "v"))
    return parsed.select("subject", "v.name", "v.category")


def reward_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of four fields parted by a double bar: predicted, gold, reward, parts; other lines are left out."""
    f = F.split("value", "\\|\\|")
    return spark.read.text(path).where(F.size(f) == 4).select(*(F.trim(f[i]).alias(n) for i, n in enumerate(("predicted", "gold", "reward", "parts"))))


def long_names(spark: SparkSession, path: str, schema: str, names: dict[str, str], query: str | None = None) -> DataFrame:
    """Result JSON lines whose keys were shortened, under their long names; only rows of ``query`` if given."""
    rows = json_lines(spark, path, schema).withColumnsRenamed(names)
    return rows if query is None else rows.where(F.col("query") == query)


def schema_profile(df: DataFrame) -> DataFrame:
    """(column, type, level, least, most): nesting depth and, of arrays, the sizes of the outer one; one pass over the table.

    A column without arrays, or without any that is not null, has null sizes.
    """
    fields = df.schema.fields
    size = lambda f: F.size(f.name) if isinstance(f.dataType, T.ArrayType) else F.lit(None).cast("int")
    ends = df.agg(*(g(F.when(F.col(f.name).isNotNull(), size(f))).alias(f"{n}{i}") for i, f in enumerate(fields) for n, g in (("a", F.min), ("b", F.max))))
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(_depth(f.dataType)).alias("level"), F.col(f"a{i}").alias("least"), F.col(f"b{i}").alias("most")) for i, f in enumerate(fields)]
    return ends.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _depth(kind: T.DataType) -> int:
    if isinstance(kind, T.ArrayType):
        return 1 + _depth(kind.elementType)
    if isinstance(kind, T.MapType):
        return 1 + _depth(kind.valueType)
    return 1 + max((_depth(f.dataType) for f in kind.fields), default=0) if isinstance(kind, T.StructType) else 0


def articles(xml: DataFrame, column: str = "xml") -> DataFrame:
    """Article records from markup: id, title, abstract (labelled parts as a map, else a text), three authors, journal."""
    x = lambda p: F.xpath(column, F.lit(p))
    labels, parts = x("//AbstractText/@Label"), x("//AbstractText/text()")
    authors = F.slice(F.zip_with(x("//Author/LastName/text()"), x("//Author/Initials/text()"), lambda a, b: F.concat_ws(" ", a, b)), 1, 3)
    return xml.select(
        F.xpath_string(column, F.lit("//PMID")).alias("id"), F.xpath_string(column, F.lit("//ArticleTitle")).alias("title"),
        F.when(F.size(labels) == 0, F.array_join(parts, " ")).alias("abstract_text"), F.when(F.size(labels) > 0, F.map_from_arrays(labels, parts)).alias("abstract_sections"),
        authors.alias("authors"), F.xpath_string(column, F.lit("//Journal/Title")).alias("journal"),
    )


def chunk_text() -> Column:
    """The abstract as text: as it is, or 'label: part, label: part'."""
    return F.coalesce("abstract_text", F.array_join(F.transform(F.map_entries("abstract_sections"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", "))


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line; nulls are written."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_test_rows(df: DataFrame, path: str) -> None:
    """Test questions as instruction rows: no instruction, the query, the truth."""
    write_json_lines(df.select(F.lit("").alias("instruction"), F.col("query").alias("input"), F.col("groundtruth").alias("output")), path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_predictions(df: DataFrame, path: str, prompt: str = "prompt", predict: str = "predict", label: str = "label") -> None:
    """Generated texts as JSON lines of prompt, predict and label."""
    write_json_lines(df.select(F.col(prompt).alias("prompt"), F.col(predict).alias("predict"), F.col(label).alias("label")), path)
