"""File-name and path expressions. All native but the sequence ratio."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Words that say nothing about which script belongs to which video.
STOP_WORDS = ("funscript", "script", "scripts", "video", "vr", "sbs", "tb", "left", "right", "180", "360", "flat",
              "mp4", "mkv", "avi", "mov")
# Suffixes of processed scripts.
PROCESSED_SUFFIXES = (".raw", ".post", "_raw", "_post", "-raw", "-post")
VIDEO_EXTENSIONS = (".mp4", ".mkv", ".avi")


def file_name(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*[/\\]", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]*)$", 1)


def name_tokens(path: Column) -> Column:
    """Lower-case words of the stem without stop words; repeats stay."""
    words = F.split(F.trim(F.regexp_replace(F.lower(stem(path)), "[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; Spark has no built-in for it."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def name_similarity(a: Column, b: Column, tokens_a: Column, tokens_b: Column, ratio: bool = False) -> Column:
    """How well two file names match: equal stems, containment, shared words, and with ``ratio`` the ratio of common runs."""
    na, nb = F.array_join(tokens_a, " "), F.array_join(tokens_b, " ")
    shared = F.size(F.array_intersect(tokens_a, tokens_b))
    union = F.size(F.array_union(tokens_a, tokens_b))
    score = (F.when(F.lower(stem(a)) == F.lower(stem(b)), 10.0).otherwise(0.0)
             + F.when(F.contains(nb, na) | F.contains(na, nb), 5.0).otherwise(0.0)
             + shared * F.lit(2.0) + F.try_divide(shared.cast("double"), union.cast("double")))
    if ratio:
        score = score + sequence_ratio(na, nb)
    return F.when((F.size(tokens_a) == 0) | (F.size(tokens_b) == 0), 0.0).otherwise(score)


def natural_key(text: Column) -> Column:
    """Sort key under which digit runs of any length compare as numbers: each has its number of digits before it."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1)
    digits = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(
        p.rlike(r"^\d+$"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 10, "0"), digits(p))).otherwise(p)), "")


def sanitize_name(text: Column, empty: str = "unnamed") -> Column:
    s = F.regexp_replace(F.trim(text), r"[^A-Za-z0-9_.\-]+", "-")
    s = F.regexp_replace(s, r"^[-._]+|[-._]+$", "")
    return F.when(s == "", empty).otherwise(s)


def normalize_path(text: Column) -> Column:
    """Component path; the names for the whole become the empty path."""
    s = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "^/+|/+$", "")
    return F.when(F.lower(s).isin("", "model", "root", "all"), "").otherwise(F.regexp_replace(s, r"\.+$", ""))


def format_float(x: Column, digits: int = 6) -> Column:
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.format_string(f"%.{digits}f", x)).otherwise("")


def candidate_stems(text: Column) -> Column:
    """The stem, then the stem without each processing suffix it carries; distinct, in order."""
    options = [text] + [F.when(F.endswith(text, F.lit(s)), F.substring(text, F.lit(1), F.length(text) - len(s)))
                        for s in PROCESSED_SUFFIXES]
    return F.filter(F.array_distinct(F.array_compact(F.array(*options))), lambda s: s != "")


def flow_stem(method: Column, features: Column, scale: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", scale), "0+$", ""), r"\.$", "")
    return F.concat(method, F.lit("_f"), features.cast("string"), F.lit("_s"), text)


# ---------------------------------------------------------------- segment names


def segment_id(scene: Column, start_sec: Column, duration_sec: Column) -> Column:
    return F.format_string("scene_%05d_t%05d_%ds", scene.cast("bigint"), F.rint(start_sec).cast("bigint"),
                           duration_sec.cast("bigint"))


SEGMENT_PATTERN = r"^scene_(\d+)_t(\d+)_(\d+)s$"


def parse_segment_id(text: Column) -> dict[str, Column]:
    """Scene, start and duration; null for names without timing."""
    part = lambda n: F.regexp_extract(text, SEGMENT_PATTERN, n).try_cast("bigint")
    return {"scene_id": part(1), "start_sec": part(2).cast("double"), "duration_sec": part(3).cast("double")}


def audit_scene_id(text: Column) -> Column:
    """Integer between the first and second underscore of a scene name, else null."""
    return F.when(F.startswith(text, F.lit("scene_")), F.split(text, "_")[1].try_cast("int"))
