"""Instance sets: the text form with a header (ARFF), named sets in one table, settings, and stored forests."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of an instance file that are no features begin so.
METADATA, SETTINGS = "Metadata_", "Metadata_Settings_"


def write_arff(rows: DataFrame, path: str, relation: str, features: list[str], metadata: list[str], classes: list[str], decimals: int = 6) -> None:
    """``rows`` (the named columns and class) as instance files: the header in a file of its own, one data line a row. All
    files of the folder together are the instance file, in the order of their names."""
    spark = rows.sparkSession
    header = [f"@relation {relation}", "", *(f"@attribute {METADATA}{m} numeric" for m in metadata), *(f"@attribute {f} numeric" for f in features), f"@attribute class {{{','.join(classes)}}}", "", "@data"]
    numbers = [F.coalesce(F.regexp_replace(F.format_string(f"%.{decimals}f", F.col(c).cast("double")), r"\.?0+$", ""), F.lit("?")) for c in (*metadata, *features)]
    spark.createDataFrame([(x,) for x in header], "value string").coalesce(1).write.text(f"{path}/header")
    rows.select(F.concat_ws(",", *numbers, "class").alias("value")).write.text(f"{path}/data")


#: A value, or an attribute's name: in quotes, in which a backslash escapes, or up to the next space or comma.
_TOKEN = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^\s,'"{}]+"""
_ATTRIBUTE = re.compile(rf"@attribute\s+({_TOKEN})\s+(.*)", re.IGNORECASE | re.DOTALL)


def unquoted(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        text = re.sub(r"\\(.)", r"\1", text[1:-1])
    return text


def arff_header(spark: SparkSession, path: str) -> tuple[str, list[tuple[str, list[str] | None]]]:
    """(relation, attributes in order) of an instance file; an attribute is (name, its values if it is nominal, else None).

    Of several files with a header the first by name gives it; attributes of another that differ raise.
    """
    at = F.lower(F.ltrim("value"))
    found = spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("i")).where(at.startswith("@relation") | at.startswith("@attribute"))
    files = found.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("i", F.trim("value").alias("value")))).alias("lines")).select("file", F.transform("lines", lambda x: x["value"]).alias("lines"))
    only = F.filter("lines", lambda x: F.lower(x).startswith("@attribute"))
    first = files.orderBy("file").select("lines", only.alias("attributes")).first()
    if first is None:
        return "", []
    if files.where(only != F.array(*(F.lit(x) for x in first.attributes))).limit(1).count():
        raise ValueError(f"{path}: instance files with different attributes")
    relation = next((unquoted(x.split(None, 1)[1]) for x in first.lines if x.lower().startswith("@relation") and len(x.split(None, 1)) > 1), "")
    attributes = []
    for line in first.attributes:
        name, kind = _ATTRIBUTE.fullmatch(line).groups()
        nominal = kind.strip().startswith("{")
        attributes.append((unquoted(name), [unquoted(x) for x in re.findall(_TOKEN, kind.strip()[1:-1])] if nominal else None))
    return relation, attributes


def read_arff(spark: SparkSession, path: str, malformed: str = "raise") -> DataFrame:
    """dataset, one column a metadata attribute (without its prefix), features (array, in the header's order), class, its number
    class_id, and weight.

    The class is the attribute named so, or the last one. A feature with nominal values has the number of its value; ``?`` is
    null; values may be in quotes; ``{w}`` after the last value is the instance's weight, else 1. Comments and blank lines are left
    out. No other line is lost: one with too few or too many values, a number that is none or a value that its attribute does
    not have raises, or, with ``malformed="keep"``, is returned in a column ``rejected`` (null for the others) with nulls beside it.
    """
    relation, attributes = arff_header(spark, path)
    if not attributes:
        raise ValueError(f"{path}: no attributes")
    names = [n for n, _ in attributes]
    label = next((i for i, n in enumerate(names) if n.lower() == "class"), len(names) - 1)
    text = spark.read.text(path, recursiveFileLookup=True).where("trim(value) <> '' and not ltrim(value) rlike '^[@%]'")
    weight = F.regexp_extract("value", r",\s*\{\s*([^{}]*?)\s*\}\s*$", 1)
    body = F.regexp_replace("value", r",\s*\{[^{}]*\}\s*$", "")
    # a comma outside quotes: what follows it up to the end holds whole quoted values alone
    parts = F.when(~F.contains(body, F.lit("'")) & ~F.contains(body, F.lit('"')), F.split(body, ",")).otherwise(F.split(body, r""",(?=(?:[^'"]|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")*$)"""))
    rows = text.select("value", weight.alias("w"), F.transform(parts, lambda p: F.trim(p)).alias("p"))
    bare = lambda p: F.when(p.rlike("^'.*'$|^\".*\"$"), F.regexp_replace(F.substring(p, 2, F.length(p) - 2), r"\\(.)", "$1")).otherwise(p)
    numbers, wrong = [], (F.size("p") != len(names)) | ((F.col("w") != "") & F.expr("try_cast(w as double) is null"))
    for i, (_, values) in enumerate(attributes):
        own = F.get("p", i)
        number = F.expr(f"try_cast(p[{i}] as double)") if values is None else (F.array_position(F.array(*(F.lit(v) for v in values)), bare(own)) - 1).cast("double")
        number = F.when((own != "?") & ((number >= 0) if values is not None else F.lit(True)), number)
        numbers.append(number)
        wrong = wrong | ((own != "?") & number.isNull())
    wrong = F.coalesce(wrong, F.lit(True))
    if malformed == "raise":
        rows = rows.where(F.when(wrong, F.raise_error(F.concat(F.lit("not an instance: "), "value")).cast("boolean")).otherwise(True))
        wrong = F.lit(False)
    there = lambda c: F.when(~wrong, c)
    own = [F.lit(relation).alias("dataset")] + [there(v).alias(n[len(METADATA) :]) for n, v in zip(names, numbers, strict=True) if n.startswith(METADATA)]
    features = F.array(*(v for i, (n, v) in enumerate(zip(names, numbers, strict=True)) if not n.startswith(METADATA) and i != label))
    found = bare(F.get("p", label))
    own += [there(features).alias("features"), there(F.when(found != "?", found)).alias("class"), there(numbers[label].cast("long")).alias("class_id"), there(F.coalesce(F.expr("try_cast(w as double)"), F.lit(1.0))).alias("weight")]
    return rows.select(*own, *([F.when(wrong, F.col("value")).alias("rejected")] if malformed == "keep" else []))


def metadata_columns(names: list[str]) -> tuple[list[str], list[str]]:
    """(metadata, features) of a list of attribute names, by the reserved prefix."""
    return [n for n in names if n.startswith(METADATA)], [n for n in names if not n.startswith(METADATA)]


def metadata_out(wide: DataFrame) -> DataFrame:
    """A table with one column an attribute: metadata as a struct ``metadata``, the other numeric ones as ``features``."""
    meta, features = metadata_columns([c for c in wide.columns if c != "class"])
    return wide.select(F.struct(*(F.col(m).alias(m[len(METADATA) :]) for m in meta)).alias("metadata"), F.array(*(F.col(f).cast("double") for f in features)).alias("features"), "class")


def metadata_in(rows: DataFrame, features: list[str]) -> DataFrame:
    """The wide table again."""
    names = [f.name for f in rows.schema["metadata"].dataType.fields]
    return rows.select(*(F.col(f"metadata.{n}").alias(f"{METADATA}{n}") for n in names), *(F.get("features", i).alias(f) for i, f in enumerate(features)), "class")


def put_set(rows: DataFrame, path: str) -> None:
    """Adds named sets (column dataset) to a store, or replaces those of the same name; others stay."""
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.mode("overwrite").partitionBy("dataset").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def combined(sets: list[DataFrame], names: list[str]) -> DataFrame:
    """The union of the named ones among ``sets`` (column dataset); their columns have to agree."""
    found = None
    for rows in sets:
        rows = rows.where(F.col("dataset").isin(names))
        found = rows if found is None else found.unionByName(rows)
    return found


def compatible(a: str, b: str, fields: list[str]) -> Column:
    """Do two settings structs agree in all fields? Null agrees with null."""
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))
    return same


def of_image(rows: DataFrame, images: DataFrame, there: bool = True) -> DataFrame:
    """Instances whose set is named like an image (column dataset), or, if not ``there``, those of no image."""
    return rows.join(images.select("dataset").distinct(), "dataset", "left_semi" if there else "left_anti")


def save_forest(nodes: DataFrame, path: str, settings: dict) -> None:
    """A forest with the settings that it was trained under: nodes as Parquet, settings as one line of text."""
    spark = nodes.sparkSession
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load_forest(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/nodes"), json.loads(spark.read.text(f"{path}/settings").first()[0])
