"""Configuration files as tables: nested JSON, one document a file, whose entries are checked against rules.

A file holds a list of entries under a name. Each entry becomes a typed row where all its rules hold; every rule that does not
hold is a row of its own, with the file and the path in it. Files are read and checked by Spark, so there may be many of them.

A file that is no JSON, or has no list under that name, has one violation, at the path `$` or the list's name; an entry that is
no object has one as well. A null value is a missing one. Entries of one code are all repeated, in whichever files they stand.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What values of a type are in a file.
SHAPES = {"string": "STRING", "int": "BIGINT", "double": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array<string>": "ARRAY<(?:STRING|VOID)>"}


@dataclass(frozen=True)
class Field:
    """A value of an entry: its path below the entry, its type, and what it must be."""

    path: str
    kind: str
    required: bool = True
    least: float | None = None
    choice: tuple[str, ...] = ()
    pattern: str | None = None
    unique: bool = False

    @property
    def name(self) -> str:
        return self.path.replace(".", "_")


def _at(entry: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(entry, "$." + path, kind)


def _problem(field: Field) -> Column:
    """What is wrong with a field of the entry, null if nothing is."""
    there, value = _at(F.col("entry"), field.path, "variant"), _at(F.col("entry"), field.path, field.kind)
    absent = there.isNull() | F.is_variant_null(there)
    wrong = ~F.coalesce(F.schema_of_variant(there).rlike(f"^(?:{SHAPES[field.kind]})$"), F.lit(False)) | value.isNull()
    checks = [(absent, "missing" if field.required else None), (wrong, f"not a {field.kind}")]
    if field.least is not None:
        checks.append((value < field.least, f"below {field.least:g}"))
    if field.choice:
        checks.append((~value.isin(*field.choice), "not one of " + ", ".join(field.choice)))
    if field.pattern:
        checks.append((~value.rlike(field.pattern), f"not like {field.pattern}"))
    if field.unique:
        checks.append((F.count("*").over(Window.partitionBy(value)) > 1, "repeated"))
    return reduce(lambda out, c: out.when(*c), checks[1:], F.when(*checks[0]))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text) of the JSON files in a folder and below it."""
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def entries(files: DataFrame, under: str) -> tuple[DataFrame, DataFrame]:
    """(file, at, entry) of the list under a name in files (file, text), and the violations of files that have none."""
    read = files.select("file", F.try_parse_json("text").alias("v"))
    read = read.withColumn("list", F.try_variant_get("v", f"$.{under}", "array<variant>"))
    bad = F.when(F.col("v").isNull(), F.struct(F.lit("$").alias("path"), F.lit("not readable").alias("problem"))).when(F.col("list").isNull(), F.struct(F.lit(under).alias("path"), F.lit("missing").alias("problem")))
    return read.select("file", F.posexplode("list").alias("at", "entry")), read.select("file", bad.alias("b")).where("b is not null").select("file", "b.*")


def checked(files: DataFrame, under: str, fields: list[Field]) -> tuple[DataFrame, DataFrame]:
    """(rows, violations): the entries without violations as typed rows with `file`, and (file, path, problem) for all others.

    Fields that no rule knows are violations too.
    """
    rows, broken = entries(files, under)
    here = F.concat(F.lit(f"{under}["), F.col("at"), F.lit("]"))
    is_object = F.schema_of_variant("entry").startswith("OBJECT")
    known = F.array(*[F.lit(name) for name in sorted({f.path.split(".")[0] for f in fields})])
    extra = F.array_except(F.map_keys(F.col("entry").cast("map<string, variant>")), known)
    told = lambda path, problem: F.struct(F.concat(here, F.lit(path)).alias("path"), problem.alias("problem"))
    found = [F.when(is_object, _problem(field)) for field in fields]
    rows = rows.withColumns({f"p{k}": problem for k, problem in enumerate(found)})
    wrong = F.array_compact(F.array(*[F.when(F.col(f"p{k}").isNotNull(), told("." + field.path, F.col(f"p{k}"))) for k, field in enumerate(fields)]))
    unknown = F.transform(F.array_sort(extra), lambda name: F.struct(F.concat(here, F.lit("."), name).alias("path"), F.lit("unknown").alias("problem")))
    rows = rows.withColumn("wrong", F.when(is_object, F.concat(wrong, unknown)).otherwise(F.array(told("", F.lit("not an object")))))
    good = rows.where(F.size("wrong") == 0).select("file", *[_at(F.col("entry"), f.path, f.kind).alias(f.name) for f in fields])
    return good, rows.select("file", F.explode("wrong").alias("w")).select("file", "w.*").unionByName(broken)


def load(spark: SparkSession, folder: str, under: str, fields: list[Field], told: int = 20) -> DataFrame:
    """The rows of a folder's files; refused with the first violations, in order of file and path, where there are any."""
    rows, violations = checked(texts(spark, folder), under, fields)
    first = violations.orderBy("file", "path").limit(told).collect()
    if first:
        raise ValueError("; ".join(f"{v.file}: {v.path}: {v.problem}" for v in first))
    return rows
