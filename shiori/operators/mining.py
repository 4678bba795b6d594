"""Mining of file names and texts: dates, password candidates, projects of paths, encryption marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Patterns of dates and of passwords in file names.
DATE = r"(20\d{2})[-/年.]?(\d{1,2})[-/月.]?(\d{1,2})"
NAMED_PASSWORD = r"(?i)(?:pw|pass|password)[-_]?([0-9A-Za-z]{6,})"
DATED_PASSWORD = r"([A-Za-z]{2,}\d{8})"


def dates_in(text: Column) -> Column:
    """The distinct dates of a text as yyyymmdd, in order: 20yy, month and day, with or without a mark between them."""
    found = F.regexp_extract_all(text, F.lit(DATE), F.lit(0))

    def normal(d: Column) -> Column:
        part = lambda k: F.lpad(F.regexp_extract(d, DATE, k), 2, "0")
        return F.concat(F.regexp_extract(d, DATE, 1), part(2), part(3))

    return F.array_distinct(F.transform(found, normal))


def password_candidates(files: DataFrame) -> DataFrame:
    """(path, candidate, ord): candidates from the file's stem, then from its aliases and dates by the rule
    DA-alias-date-extension, each once.

    files: path, aliases (array), dates (array). The arrays of a file are combined with each other, never
    with those of another.
    """
    name = F.element_at(F.split("path", "/"), -1)
    stem, extension = F.regexp_replace(name, r"\.[^.]*$", ""), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    named = F.regexp_extract_all(stem, F.lit(NAMED_PASSWORD), F.lit(1))
    dated = F.regexp_extract_all(stem, F.lit(DATED_PASSWORD), F.lit(1))
    rule = lambda a, d: F.concat(F.lit("DA-"), a, F.lit("-"), d, F.lit("-"), extension)
    pairs = F.flatten(F.flatten(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.transform(F.coalesce("dates", F.array().cast("array<string>")), lambda d: F.array(rule(a, d), rule(F.upper(a), d))))))
    return files.select("path", F.posexplode(F.array_distinct(F.concat(named, dated, pairs))).alias("ord", "candidate"))


def project_of(path: Column, marker: str = "プロジェクト") -> Column:
    """The component of a path that follows the marker; null without one."""
    parts = F.split(path, "/")
    return F.get(parts, F.nullif(F.array_position(parts, F.lit(marker)), F.lit(0)).cast("int"))


def is_encrypted(content: Column) -> Column:
    """Whether an Office file of a zip format isn't a zip archive, as encrypted ones aren't."""
    return F.hex(F.substring(content, 1, 4)) != "504B0304"


def aliases_of_projects(projects: DataFrame, glossary: DataFrame) -> DataFrame:
    """(project, alias): aliases whose canonical name contains the project's name or lies within it."""
    from .containment import contains

    inside = contains(projects.select("project").distinct(), "project", "project", glossary.select("alias", "canonical"), "canonical")
    around = contains(glossary.select("canonical").distinct(), "canonical", "canonical", projects.select("project"), "project")
    return inside.select("project", "alias").unionByName(around.join(glossary.select("alias", "canonical"), "canonical").select("project", "alias")).distinct()
