"""Which files a request means: literal paths, globs, folders, lists; and reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def glob_regex(pattern: Column) -> Column:
    """A glob as a regular expression: case is ignored, * crosses slashes, a leading dot must be literal.

    A bracket that never closes is itself, and so is one inside brackets.
    """
    escaped = F.regexp_replace(pattern, r"([.^$+(){}|\\&])", r"\\$1")
    for _ in range(3):  # one more bracket inside each pair a time
        escaped = F.regexp_replace(escaped, r"(\[(?:[^\[\]\\]|\\.)*)\[(?=(?:[^\[\]\\]|\\.)*\])", r"$1\\[")
    escaped = F.regexp_replace(escaped, r"(?<!\\)\[(?!!?(?:[^\[\]\\]|\\.)+\])", r"\\[")
    hidden = F.when(pattern.startswith("."), "").otherwise(r"(?!\.)")
    body = F.regexp_replace(F.regexp_replace(escaped, r"\*+", ".*"), r"\?", ".")
    return F.concat(F.lit("(?i)^"), hidden, F.regexp_replace(body, r"(?<!\\)\[!", "[^"), F.lit("$"))


def listed(text: Column, null_separated: bool = False) -> Column:
    """The paths of a list: split, without a trailing carriage return, without empty ones."""
    parts = F.split(text, "\u0000" if null_separated else "\n")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "\r$", "")), lambda p: p != "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def walked(files: DataFrame, readable: list[str], include: list[str], exclude: list[str], path: str = "path") -> DataFrame:
    """Files below a folder that can be read: of a known extension, included, and not excluded."""
    keep = files.filter(extension(F.col(path)).isin(readable))
    matches = lambda globs: [F.col(path).rlike("(?i)^" + _regex(g) + "$") for g in globs]
    for m in matches(exclude):
        keep = keep.filter(~m)
    wanted = matches(include)
    if wanted:
        any_ = wanted[0]
        for m in wanted[1:]:
            any_ = any_ | m
        keep = keep.filter(any_)
    return keep


def _regex(glob: str) -> str:
    """As glob_regex(), of a pattern that is known beforehand."""
    out, at = "" if glob.startswith(".") else r"(?!\.)", 0
    literal = lambda c: "\\" + c if c in ".^$+(){}|\\&[]" else c
    while at < len(glob):
        c = glob[at]
        negated = glob[at + 1 : at + 2] == "!"
        end = glob.find("]", at + 1 + negated) if c == "[" else -1
        if end > at + 1 + negated:
            out += "[" + "^" * negated + "".join(map(literal, glob[at + 1 + negated : end])) + "]"
            at = end
        else:
            out += ".*" if c == "*" else "." if c == "?" else literal(c)
        at += 1
    return out


def first_seen(paths: DataFrame, path: str = "path", order: str = "position") -> DataFrame:
    """Each path once, where it first came."""
    rank = F.row_number().over(Window.partitionBy(path).orderBy(order))
    return paths.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def resolve(arguments: DataFrame, files: DataFrame, readable: list[str], recursive: bool) -> tuple[DataFrame, DataFrame]:
    """(inputs, failures) of arguments (position, argument) over files (path, is_folder).

    A path that exists is taken literally; else it is a glob over files. Folders stand for the
    readable files below them and need recursive. Arguments that match nothing are failures.
    """
    exact = arguments.join(files, F.col("argument") == F.col("path"))
    literal = exact.filter("NOT is_folder").select("position", "argument", "path")
    folders = exact.filter("is_folder").select("position", "argument")
    plain = files.filter("NOT is_folder").select("path")
    rest = arguments.join(exact.select("position").distinct(), "position", "left_anti")
    globs = rest.filter(F.col("argument").rlike(r"[*?\[]"))
    expanded = globs.join(plain, F.regexp_like("path", glob_regex(F.col("argument")))).select("position", "argument", "path")
    below = folders.join(plain.filter(extension(F.col("path")).isin(readable)), F.col("path").startswith(F.concat(F.regexp_replace("argument", "/$", ""), F.lit("/")))).select("position", "argument", "path")
    found = literal.unionByName(expanded)
    if recursive:
        found = found.unionByName(below)
    failures = arguments.join(found.select("position").distinct(), "position", "left_anti")
    named = failures.join(folders.select("position").withColumn("__folder", F.lit(True)), "position", "left")
    failures = named.select("position", "argument", F.when(F.col("__folder"), F.lit("is a folder" if not recursive else "nothing to read in it")).otherwise("no such file or match").alias("reason"))
    ranked = found.withColumn("__order", F.struct("position", "path"))
    return first_seen(ranked, order="__order").drop("__order"), failures


def binary_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, length, content) of files, read where they are."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        read = read.option("pathGlobFilter", glob)
    return read.load(path).select("path", "length", "content")


def from_bytes(spark: SparkSession, data: bytes, name: str = "-") -> DataFrame:
    """One input from bytes, as standard input gives them."""
    return spark.createDataFrame([(name, len(data), bytearray(data))], "path string, length long, content binary")
