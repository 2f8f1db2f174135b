"""Records of outputs, their totals, names of outputs and what may be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A record's columns in order, and a template's placeholders.
FIELDS = [
    "input", "output", "status", "reason", "error", "input_format", "animated", "width", "height", "alpha", "content", "input_bytes", "format", "output_width", "output_height", "backend",
    "tier", "output_bytes", "ratio", "quality", "colors", "lossless", "target", "score", "reached", "capped", "iterations", "trials",
]
PLACEHOLDERS = ["stem", "ext", "width", "height", "format", "quality", "dir", "name"]


def to_json(records: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object a record, in the order of FIELDS, nulls left out."""
    have = [c for c in FIELDS if c in records.columns]
    return records.select(F.to_json(F.struct(*have)).alias(name))


def tally(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by status, and bytes in and out of what was written."""
    count = lambda s: F.count_if(F.col("status") == s)
    written = lambda c: F.coalesce(F.sum(F.when(F.col("status") == "written", F.coalesce(F.col(c), F.lit(0)))), F.lit(0))
    return records.groupBy(*(by or [])).agg(
        *[count(s).alias(s) for s in ("written", "skipped", "planned", "failed")], written("input_bytes").alias("input_bytes"), written("output_bytes").alias("output_bytes")
    )


def write_policy(size: Column, input_size: Column, exists: Column, backup_exists: Column, *, in_place: Column, backup: Column, force: Column) -> Column:
    """struct<status, reason: string> before anything is written."""
    result = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))
    return (
        F.when(~force & (size > input_size), result("skipped", "larger than the input"))
        .when(in_place & backup & backup_exists & ~force, result("failed", "backup exists"))
        .when(~in_place & exists & ~force, result("failed", "output exists"))
        .otherwise(result("written", None))
    )


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folder(path: Column) -> Column:
    """All before the last slash; empty if there is none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """The name before its last dot; a name that only starts with a dot is its own stem."""
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def suffix(path: Column) -> Column:
    """The extension without its dot, or null."""
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"\.([^.]*)$", 1))


def joined(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).otherwise(F.concat(directory, F.lit("/"), name))


def backup_path(path: Column) -> Column:
    name = F.concat(stem(path), F.lit("@backup"), F.coalesce(F.concat(F.lit("."), suffix(path)), F.lit("")))
    return joined(folder(path), name)


def template_problem(template: Column) -> Column:
    """Why a template is refused, or null."""
    keys = F.regexp_extract_all(template, F.lit(r"\{([^}]*)\}"), F.lit(1))
    rest = F.regexp_replace(template, r"\{[^}]*\}", "")
    unknown = F.array_except(keys, F.array(*map(F.lit, PLACEHOLDERS)))
    return F.when(F.size(unknown) > 0, F.concat(F.lit("unknown placeholder "), unknown[0])).when(F.contains(rest, F.lit("{")), "unclosed brace").when(F.contains(rest, F.lit("}")), "stray brace")


def rendered(template: Column, path: Column, extension: Column, fmt: Column, width: Column, height: Column, quality: Column) -> Column:
    """A checked template with its placeholders filled."""
    values = {"stem": stem(path), "ext": extension, "width": width.cast("string"), "height": height.cast("string"), "format": fmt, "quality": quality, "dir": folder(path), "name": file_name(path)}
    out = template
    for key in PLACEHOLDERS:
        out = F.replace(out, F.lit("{" + key + "}"), values[key])
    return out


def quality_tag(value: Column, kind: Column) -> Column:
    return F.when(kind == "lossless", "lossless").when(kind == "lossy", "lossy").when(value.isNotNull(), F.round(value).cast("long").cast("string")).otherwise("auto")


def normalised(path: Column) -> Column:
    """A path without empty, . and .. steps."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    walk = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)))
    return F.array_join(walk, "/")


def destination(path: Column, fmt: Column, input_fmt: Column, extension: Column, width: Column, *, output: Column, in_place: Column, single: Column, relative: Column, width_list: Column, suffix_text: Column) -> Column:
    """struct<path, problem: string> of an output."""
    tag = F.when(width_list, F.concat(F.lit("-"), width.cast("string"), F.lit("w"))).otherwise("")
    name = F.concat(stem(path), F.coalesce(suffix_text, F.lit("")), tag, F.lit("."), extension)
    directory = F.when(output.isNotNull(), F.when(relative == "", output).otherwise(F.concat(output, F.lit("/"), relative))).otherwise(folder(path))
    out = F.when(in_place, path).when(single, output).otherwise(joined(directory, name))
    problem = F.when(in_place & (fmt != input_fmt), "would change the format").when(~in_place & (normalised(out) == normalised(path)), "overwrites the input")
    return F.struct(F.when(problem.isNull(), out).alias("path"), problem.alias("problem"))
