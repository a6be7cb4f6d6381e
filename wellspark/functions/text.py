"""Project ids, path parts and well-known-text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """Forward slashes, inner doubles collapsed (a leading pair marks a share), no trailing one."""
    slashed = F.translate(path, "\\", "/")
    single = F.regexp_replace(slashed, r"(?<=.)(?<!^/)/+", "/")
    return F.when(single.rlike(r"^/+$"), single).otherwise(F.regexp_replace(single, r"/+$", ""))


def path_part(path: Column, position: int) -> Column:
    """A part counted from the end: -1 the name, -2 its home folder; null when there is none."""
    parts = F.split(normal_path(path), "/", -1)
    return F.try_element_at(parts, F.lit(position))


def project_name(path: Column) -> Column:
    return path_part(path, -1)


def project_home(path: Column) -> Column:
    return path_part(path, -2)


def project_label(path: Column) -> Column:
    """`<name>-<home>` with blanks as underscores."""
    return F.translate(F.concat_ws("-", project_name(path), project_home(path)), " ", "_")


def project_id(path: Column) -> Column:
    """Three letters of the name, an underscore, six hex digits of the path's md5; all upper."""
    prefix = F.rpad(F.left(F.upper(project_name(path)), F.lit(3)), 3, "_")
    digest = F.left(F.md5(F.lower(normal_path(path))), F.lit(6))
    return F.upper(F.concat(prefix, F.lit("_"), digest))


def scrub_wkt(text: Column) -> Column:
    """Blanks, dots and slashes to underscores; parentheses and dashes dropped."""
    return F.regexp_replace(F.regexp_replace(text, "[ ./_]", "_"), "[-()]", "")


def wkt_name(wkt: Column, keyword: str) -> Column:
    """First quoted name after a keyword such as GEOGCS, lower case; null when absent."""
    return F.nullif(
        F.lower(F.regexp_extract(wkt, keyword + r'\["(.+?)",', 1)), F.lit("")
    )
