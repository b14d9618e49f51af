"""CSV, markdown, JSON and listing sources as Spark scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def read_csv_renamed(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """CSV with a header whose columns are renamed by position; all text, so later parsing decides what is bad.

    The byte-order mark of the header does not matter, since names come from the caller.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def read_csv_text(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """All-text CSV with blanks in place of nulls."""
    return read_csv_renamed(spark, path, names).na.fill("")


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def choices_to_map(df: DataFrame, cols: Sequence[str], out: str = "choices") -> DataFrame:
    """Gather choice columns into a map keyed ``1`` to ``n``."""
    keys = F.array(*[F.lit(str(i)) for i in range(1, len(cols) + 1)])
    return df.withColumn(out, F.map_from_arrays(keys, F.array(*[F.col(c).cast("string") for c in cols])))


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of every ``*.md`` below a folder; the path is relative to it."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
    df = reader.text(root, wholetext=True)
    base = root.rstrip("/").split(":", 1)[-1]
    full = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    relative = F.regexp_replace(F.replace(F.url_decode(full), F.lit(base), F.lit("")), "^/+", "")
    return df.select(relative.alias("path"), F.col("value").alias("text"))


# Layout of the grading file.
TRUTH_SCHEMA = (
    "items array<struct<id:string, bucket:string, language:string, expected_answer:struct<"
    "must_contain_any_of:array<array<string>>, must_not_contain:array<string>,"
    "must_not_contain_phone_extension:boolean, must_not_contain_employee_id_pattern:boolean,"
    "all_items_tokens_per_id:map<string,array<string>>, min_items:int, exact_count:int>>>"
)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Grading items from JSON, flattened to the columns the grader takes."""
    raw = spark.read.schema(TRUTH_SCHEMA).option("multiLine", True).json(path)
    e = F.col("i.expected_answer")
    return raw.select(F.explode("items").alias("i")).select(
        "i.id",
        "i.bucket",
        "i.language",
        e["must_contain_any_of"].alias("any_of"),
        e["must_not_contain"].alias("forbidden"),
        e["must_not_contain_phone_extension"].alias("no_extension"),
        e["must_not_contain_employee_id_pattern"].alias("no_employee_id"),
        e["all_items_tokens_per_id"].alias("tokens_per_id"),
        e["min_items"].alias("min_items"),
        e["exact_count"].alias("exact_count"),
    )


def read_sensor_folder(spark: SparkSession, folder: str, schema: T.StructType | str, skip: int | None = None) -> DataFrame:
    """Every CSV of a folder with its file path; optionally without the n-th file in path order."""
    rows = spark.read.schema(schema).option("header", True).csv(folder).withColumn("file", F.col("_metadata.file_path"))
    return rows if skip is None else skip_nth_file(rows, "file", skip)


def skip_nth_file(df: DataFrame, file: str, n: int) -> DataFrame:
    """Leave out the file that is n-th in sorted order; with fewer files nothing is left out."""
    first = df.select(file).distinct().orderBy(file).limit(n)
    nth = first.agg(F.when(F.count(F.lit(1)) == n, F.max(file)).alias("f")).scalar()
    return df.where(~F.coalesce(F.col(file) == nth, F.lit(False)))


def template_path(row_id: Column, pattern: str, sep: str = "_") -> Column:
    """Path of a template id: ``{0}``, ``{1}`` are its parts."""
    parts = F.split(row_id, sep)
    pieces: list[Column] = []
    rest = pattern
    while "{" in rest:
        head, tail = rest.split("{", 1)
        number, rest = tail.split("}", 1)
        pieces += [F.lit(head), F.get(parts, F.lit(int(number)))]
    return F.concat(*pieces, F.lit(rest))


def join_by_path(template: DataFrame, row_id: str, pattern: str, scanned: DataFrame, path: str) -> DataFrame:
    """Match template ids to a scanned table by path, in place of opening one file per row."""
    wanted = template.withColumn(path, template_path(F.col(row_id), pattern))
    return wanted.join(scanned, path, "left")


def list_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Paths below a folder; column pruning keeps the contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path")


def label_from_prefix(name: Column, labels: Sequence[tuple[str, str]]) -> Column:
    """Label of the first prefix that fits; null where none does."""
    out = F.lit(None).cast("string")
    for prefix, label in reversed(labels):
        out = F.when(F.startswith(F.lower(name), F.lit(prefix.lower())), F.lit(label)).otherwise(out)
    return out


def label_from_keyword(path: Column, labels: Sequence[tuple[str, str]]) -> Column:
    """Label of the first keyword, in list order, found anywhere in the path."""
    out = F.lit(None).cast("string")
    for word, label in reversed(labels):
        out = F.when(F.contains(F.lower(path), F.lit(word.lower())), F.lit(label)).otherwise(out)
    return out


def drop_paths_with(df: DataFrame, path: str, words: Mapping | Sequence[str]) -> DataFrame:
    keep = F.lit(True)
    for w in words:
        keep = keep & ~F.contains(F.lower(F.col(path)), F.lit(w.lower()))
    return df.where(keep)
