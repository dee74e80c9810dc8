"""Text functions as column expressions: exposure values as they are written, keys, paths and name templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def shutter_text(s: Column) -> Column:
    """1/n up to half a second, whole seconds as they are, others with one decimal."""
    return F.when((s > 0) & (s <= 0.5), F.concat(F.lit("1/"), F.floor(1 / s + 0.5).cast("string"))).when(s == F.floor(s), F.floor(s).cast("string")).otherwise(F.format_string("%.1f", F.bround(s, 1)))


def shutter_parse(t: Column) -> Column:
    """Seconds from `a/b` or a number; a zero denominator, or what is no number, gives 0."""
    parts = F.split(t, "/")
    number = lambda k: F.coalesce(F.get(parts, F.lit(k)).try_cast("double"), F.lit(0.0))
    return F.when(F.contains(t, F.lit("/")), F.coalesce(F.try_divide(number(0), number(1)), F.lit(0.0))).otherwise(number(0))


def aperture_text(f: Column) -> Column:
    return F.format_string("%.1f", F.bround(f, 1))


def aperture_parse(t: Column) -> Column:
    return F.coalesce(t.try_cast("double"), F.lit(0.0))


def compensation_text(v: Column, mask_zero: bool) -> Column:
    text = F.format_string("%.2f", F.bround(v, 2))
    return F.when(F.abs(v) < 0.005, "").otherwise(text) if mask_zero else text


def significant(v: Column, digits: int) -> Column:
    """Rounded to so many significant digits, so that settings nearly alike share a key."""
    places = digits - 1 - F.floor(F.log10(F.abs(v)))
    scale = F.pow(F.lit(10.0), places)
    return F.when(v == 0, 0.0).otherwise(F.floor(v * scale + 0.5) / scale)


def dark_frame_key(make: Column, model: Column, iso: Column, shutter: Column) -> Column:
    return F.concat_ws(" ", F.rpad(F.upper(make), 10, " "), F.rpad(F.upper(model), 10, " "), F.lpad(iso.cast("string"), 5, " "), F.format_string("%.6f", significant(shutter, 2)))


def flat_field_key(make: Column, model: Column, lens: Column, focal: Column, aperture: Column) -> Column:
    return F.concat_ws(" ", make, model, lens, F.format_string("%.2f", focal), F.format_string("%.2f", aperture))


def extension(path: Column) -> Column:
    """What follows the last dot of the last part, empty without one."""
    return F.regexp_extract(path, r"\.([^./\\]+)$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def normalise_lens(name: Column) -> Column:
    return F.regexp_replace(name, r"\s*-\s*", "-")


def clut_parts(name: Column) -> tuple[Column, Column]:
    """Name and profile suffix of `name_profile.ext`."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.regexp_replace(stem, r"_[A-Za-z]+$", ""), F.regexp_extract(stem, r"_([A-Za-z]+)$", 1)


def relative_path(path: Column, directory: str) -> Column:
    """Paths within a directory lose it; others stay."""
    return F.regexp_replace(path, "^" + re.escape(directory.rstrip("/")) + "/", "")


def image_type(pixel_shift: Column, hdr: Column) -> Column:
    return F.when(pixel_shift, "PS").when(hdr, "HDR").otherwise("STD")


def cache_name(path: Column, ext: str) -> Column:
    """Base name and a digest of the path: equal names in different places stay apart."""
    return F.concat_ws(".", base_name(path), F.md5(path), F.lit(ext))


def name_template(template: str, path: Column, rank: Column, sequence: Column, taken: Column) -> Column:
    """An output name: %f base name, %e extension, %pN the Nth folder from the end, %d the last folder, %r rank, %sN the number in N digits, %tF the date, %tY the year; %% a percent sign."""
    folders = F.split(F.regexp_replace(path, r"/[^/]*$", ""), "/")
    out = []
    for token in re.findall(r"%t[FYmd]|%[ps]\d|%[fder%]|[^%]+|%", template):
        if token == "%f":
            out.append(base_name(path))
        elif token == "%e":
            out.append(extension(path))
        elif token == "%d":
            out.append(F.coalesce(F.try_element_at(folders, F.lit(-1)), F.lit("")))
        elif token.startswith("%p"):
            out.append(F.coalesce(F.try_element_at(folders, F.lit(-int(token[2]))), F.lit("")))
        elif token == "%r":
            out.append(rank.cast("string"))
        elif token.startswith("%s"):
            out.append(F.lpad(sequence.cast("string"), int(token[2]), "0"))
        elif token.startswith("%t"):
            out.append(F.date_format(taken, {"F": "yyyy-MM-dd", "Y": "yyyy", "m": "MM", "d": "dd"}[token[2]]))
        else:
            out.append(F.lit(token.replace("%%", "%")))
    return F.concat(*out)
