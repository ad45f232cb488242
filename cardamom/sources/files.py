"""Readers: URL lists, JSON lines, directories of JSON files, map stores, YAML dimensions, images.

All but the YAML readers are Spark readers with a given schema; a missing file or directory is an
empty table where the docstring says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt_record"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is at a path or glob, in any store that Spark reads."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def _empty(spark: SparkSession, schema: str | StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def url_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trimmed lines that are neither blank nor comments."""
    line = F.trim(F.col(column))
    return lines.select(line.alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url): the lines of a text file that are neither blank nor comments. A missing file is an error."""
    return url_lines(spark.read.text(path))


def read_jsonl(spark: SparkSession, path: str, schema: str, broken: str = "fail") -> DataFrame:
    """JSON lines; broken ones 'fail' the job when it runs, or are 'skip'ped. Blank lines don't count."""
    return spark.read.schema(schema).option("mode", {"fail": "FAILFAST", "skip": "DROPMALFORMED"}[broken]).json(path)


def split_json(lines: DataFrame, schema: str, column: str = "value", most: int = 500) -> tuple[DataFrame, DataFrame]:
    """(records, rejects with _raw): lines that parse, and the beginnings of those that don't. Blank lines are in neither."""
    kind = StructType.fromDDL(schema)
    with_raw = StructType([*kind.fields, StructField(CORRUPT, StringType())])
    rest = [c for c in lines.columns if c != column]
    parsed = lines.where(F.trim(F.col(column)) != "").select(*rest, column, F.from_json(column, with_raw, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("__r"))
    good = parsed.where(F.col(f"__r.{CORRUPT}").isNull()).select(*rest, *[F.col(f"__r.{f.name}").alias(f.name) for f in kind.fields])
    bad = parsed.where(F.col(f"__r.{CORRUPT}").isNotNull()).select(*rest, F.left(F.col(column), F.lit(most)).alias("_raw"))
    return good, bad


def read_known_keys(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """(key): the distinct keys of a JSON-lines file, nested ones by dots; broken lines don't count, a missing file has none."""
    if not exists(spark, path):
        return _empty(spark, "key string")
    return read_jsonl(spark, path, schema, "skip").select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()


def read_json_dir(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record for each *.json file of a directory, with its file_path; other files don't count, a missing directory is empty."""
    if not exists(spark, path):
        return _empty(spark, StructType([*StructType.fromDDL(schema).fields, StructField("file_path", StringType())]))
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").option("mode", "FAILFAST").json(path)
    return df.select("*", F.col("_metadata.file_path").alias("file_path"))


def read_cases(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All cases of the directories real|synthetic-clean|dirty under root, with origin and placed_clean."""
    parts = [
        read_json_dir(spark, f"{root}/{origin}-{state}", schema).withColumns({"origin": F.lit(origin), "placed_clean": F.lit(state == "clean")})
        for origin in ("real", "synthetic")
        for state in ("clean", "dirty")
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(case_id, annotation): the map of an annotation store, a row for each key; a missing store is empty."""
    if not exists(spark, path):
        kind = StructType.fromDDL(schema)["annotations"].dataType.valueType
        return _empty(spark, StructType([StructField("case_id", StringType()), StructField("annotation", kind)]))
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("annotations").alias("case_id", "annotation"))


def find_sources(spark: SparkSession, root: str, file: str = "cards.raw.jsonl", excluded: tuple[str, ...] = ("images", "schema")) -> DataFrame:
    """(source, path): directories under root that hold the file."""
    if not exists(spark, f"{root}/*/{file}"):
        return _empty(spark, "source string, path string")
    found = spark.read.format("binaryFile").load(f"{root}/*/{file}").select("path")
    return found.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("source"), "path").where(~F.col("source").isin(*excluded))


def read_images(spark: SparkSession, root: str, most: int = 5 << 20) -> DataFrame:
    """(image_id, path, length, oversize) of a directory of image files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("image_id"), "path", "length", (F.col("length") > most).alias("oversize"))


def to_download(images: DataFrame, have: DataFrame) -> DataFrame:
    """Image records of which no file is there yet, under any extension."""
    return images.join(have.select("image_id"), "image_id", "left_anti")


def _yaml(spark: SparkSession, path: str):
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML needs PyYAML") from missing
    return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])


def read_rules(spark: SparkSession, path: str, pattern: str = r"(TXT|IMG)-\d{2}") -> DataFrame:
    """The rules of a taxonomy file on the driver, with the first line of each description, 200 characters at most.

    An id of another form, an id twice, or an unknown severity is an error.
    """
    import re

    from ..functions.text import short_description
    from ..schemas import RULE, SEVERITY_RANK

    rules = _yaml(spark, path)["rules"]
    ids = [r["id"] for r in rules]
    bad = [i for i in ids if not re.fullmatch(pattern, i)] + [i for i in set(ids) if ids.count(i) > 1] + [r["id"] for r in rules if r["severity"] not in SEVERITY_RANK]
    if bad:
        raise ValueError(f"bad rules: {sorted(bad)}")
    rows = [(r["id"], r["severity"], r.get("category"), r.get("title"), r.get("description")) for r in rules]
    return spark.createDataFrame(rows, RULE).withColumn("description", short_description(F.col("description")))


def read_scope(spark: SparkSession, path: str) -> DataFrame:
    """(rule_id, in_scope, reason) of a scope file."""
    scope = _yaml(spark, path)
    rows = [(i, True, None) for i in scope.get("in_scope") or []] + [(o["id"], False, o.get("reason")) for o in scope.get("out_of_scope") or []]
    return spark.createDataFrame(rows, "rule_id string, in_scope boolean, reason string")


def read_quota(spark: SparkSession, path: str) -> tuple[dict[str, int | None], dict[str, int | None]]:
    """(defaults by severity, overrides by rule); a missing part is empty. Negative or broken numbers are an error."""
    quota = _yaml(spark, path) or {}
    parts = (quota.get("defaults") or {}, quota.get("overrides") or {})
    for p in parts:
        for k, v in p.items():
            if v is not None and (not isinstance(v, int) or v < 0):
                raise ValueError(f"bad quota for {k}: {v}")
    return parts
