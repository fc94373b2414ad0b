"""Scalar column functions: names, paths, results, pixels, time and group ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    """P10: what follows the last slash, else the last backslash, else all of it."""
    return F.when(path.contains("/"), F.substring_index(path, "/", -1)).otherwise(F.substring_index(path, "\\", -1))


def base_name(path: Column, extension: bool = False) -> Column:
    """P10: the file name, without its extension unless asked for."""
    name = file_name(path)
    return name if extension else F.regexp_replace(name, r"\.[^.]*$", "")


def image_location(base: Column, name: Column) -> Column:
    """Where a collection keeps an image."""
    return F.concat(base, F.lit("/images/"), name)


def feature_path(image_id: Column, base: str, kind: str, feature: str) -> Column:
    """Two levels of folders of 1024 each, then the padded id: <base>/feats/<kind>/<feature>/0000/0001/000001024.<feature>."""
    upper = F.shiftright(image_id, 20)
    middle = F.shiftright(image_id - F.shiftleft(upper, 20), 10)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(F.lit(f"{base}/feats/{kind}/{feature}/"), pad(upper, 4), F.lit("/"), pad(middle, 4), F.lit("/"), pad(image_id, 9), F.lit(f".{feature}"))


def group_start(image_id: Column, size: int = 4) -> Column:
    """The first id of the group of ``size`` consecutive images."""
    return F.floor(image_id / F.lit(size)).cast("long") * size


def result_csv(names: Column) -> Column:
    """Names joined by commas, -1 where there is none."""
    return F.when(F.size(names) > 0, F.array_join(names, ",")).otherwise(F.lit("-1"))


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01."""
    return F.unix_seconds(ts.cast("timestamp"))


#: Weights of red, green and blue in luminance.
LUMA = (0.299, 0.587, 0.114)


def gray(r: Column, g: Column, b: Column, weights: tuple[float, float, float] = LUMA) -> Column:
    """Luminance, rounded to 0..255; for pixels decoded as blue, green, red give the weights in that order."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(r * weights[0] + g * weights[1] + b * weights[2] + 0.5).cast("int")))


def match_line(ids: Column, most: int = 8) -> Column:
    """The first matches in short form."""
    return F.array_join(F.transform(F.slice(ids, 1, most), lambda x: x.cast("string")), " ")


def bow_line(pairs: Column) -> Column:
    """``<w, v>`` pairs of a bag of words, given an array of (word_id, value) structs."""
    return F.array_join(F.transform(pairs, lambda p: F.format_string("<%d, %.6f>", p["word_id"], p["value"])), " ")


def border(score: Column) -> Column:
    """The colour of a result's border."""
    return F.when(score > 0, "green").when(score < 0, "red").otherwise("black")
