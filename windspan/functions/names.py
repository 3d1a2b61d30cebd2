"""What file names and folder names say: event time, folder date, site tag."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The layout of a snapshot tree, <root>/20240101/2024-01-01_05_00_00.parquet.
# An hour may also be a folder of that name holding part files, as Spark itself writes it,
# and folders may be written in key=value form.
FOLDER_DATE = r"/(?:[^/=]+=)?([0-9]{8})/"
SNAPSHOT_STEM = r"/(?:[^/=]+=)?([^/=]+)\.parquet(?:/[^/]*)?$"
STEM_PARTS = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})_([0-9]{2})_([0-9]{2})_([0-5][0-9])$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_stem(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), SNAPSHOT_STEM, 1)


def below(path: Column | str, root: str) -> Column:
    """What a path says after `root`, counted in folders, whatever the scheme and its spelling."""
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "", root)
    if bare == root and not root.startswith("/"):
        bare = os.path.abspath(root)
    depth = len([part for part in bare.split("/") if part not in ("", ".")])
    whole = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/]*(?=/))?(?:/+[^/]+){%d}(/.*)$" % depth
    return F.regexp_extract(_c(path), whole, 1)


def folder_date_text(path: Column | str, root: str | None = None) -> Column:
    """The all-digits folder in a path, or an empty string; with `root`, below it only."""
    return F.regexp_extract(_c(path) if root is None else below(path, root), FOLDER_DATE, 1)


def stem_time(stem: Column | str) -> Column:
    """Event time held in a file stem; NULL if the name does not say one.

    Put together from its parts, so no session zone shifts it."""
    parts = [F.regexp_extract(_c(stem), STEM_PARTS, i).try_cast("int") for i in range(1, 7)]
    return F.try_make_timestamp_ntz(*parts)


def stem_date_text(stem: Column | str) -> Column:
    """Text before the first underscore, without dashes: 2024-01-01_05.. -> 20240101."""
    return F.regexp_replace(F.substring_index(_c(stem), "_", 1), "-", "")


def stem_tag(stem: Column | str) -> Column:
    """Last underscore-separated part of a stem."""
    return F.element_at(F.split(_c(stem), "_"), -1)


def matched_tag(
    stem: Column | str, pattern: str | None = None, known: Sequence[str] = ()
) -> Column:
    """Tag by `pattern` (its first group) where given, else the last part of the stem that is a
    `known` tag, else its last part."""
    if pattern is not None:
        return F.regexp_extract(_c(stem), pattern, 1)
    if not known:
        return stem_tag(stem)
    parts = F.filter(F.split(_c(stem), "_"), lambda p: p.isin(list(known)))
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), stem_tag(stem))
