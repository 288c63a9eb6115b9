"""File-name and sampling-interval expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_interval(fps: Column, seconds: int = 1) -> Column:
    """Frames between two samples: fps * seconds, truncated."""
    return (fps * F.lit(seconds)).cast("bigint")


def frame_path(directory: str | Column, frame_idx: Column) -> Column:
    folder = F.lit(directory) if isinstance(directory, str) else directory
    return F.concat(folder, F.lit("/frame"), frame_idx.cast("string"), F.lit(".jpg"))


def frame_index(path: Column) -> Column:
    """Inverse of :func:`frame_path`; NULL when the name is not a frame's."""
    digits = F.regexp_extract(path, r"(?:^|/)frame(\d+)\.jpg$", 1)
    return F.when(digits != "", digits.cast("bigint"))


def frame_label(name: Column) -> Column:
    """File name without its last extension; leading dots do not start one."""
    return F.regexp_replace(name, r"^(\.*[^.].*)\.[^.]*$", "$1")


def aug_name(name: Column) -> Column:
    return F.concat(F.lit("aug_"), name)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
