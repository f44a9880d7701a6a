"""Rule-based classes as chains of conditions: the first that holds decides, a null condition doesn't hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def habitat_class(depth: Column, cover: Column, wrack_share: Column, sand: Column) -> Column:
    """0 none, 1 plants, 2 wrack, 3 bare sand, 4 sparse, 5 deep."""
    return (
        F.when((depth > 3) & ~sand, 5).when(depth > 5, 5).when((cover >= 30) & (wrack_share < 30), 1).when((cover >= 30) & (wrack_share >= 30) & (depth <= 3), 2)
        .when((cover < 30) & sand & (depth < 5), 3).when(cover < 30, 4).otherwise(0)
    )


def bottom_cover_class(elevation: Column, ndvi: Column, bottom: Column, cover: Column) -> Column:
    """By depth, greenness, the bottom's name and plant cover; elevation is negative under water."""
    return F.when(elevation < -2, 6).when(ndvi > 0.3, 4).when(bottom.startswith("sand"), 1).when(bottom.startswith("soft"), 2).when(bottom.startswith("hard"), 3).when(cover > 30, 5).otherwise(0)


def vegetation_class(elevation: Column, ndvi: Column, cover: Column) -> Column:
    return F.when(elevation < -4.5, 3).when(cover < 30, 2).when(cover >= 30, 1).when(ndvi > 0.3, 4)


def species_class(depth: Column, species: Column, cover: Column, target: str) -> Column:
    return F.when(depth >= 6, 3).when((species == target) & (cover >= 30), 1).when(cover >= 30, 2).when(cover < 30, 0)


def presence(total: Column) -> Column:
    return F.when(total > 0, 1).otherwise(0)


def turbid_class(depth: Column, ndti: Column) -> Column:
    """Deep from 3.5 m; turbid water from 3 m overrides."""
    return F.when((ndti >= -0.35) & (depth >= 3), "turbid").when(depth >= 3.5, "deep").otherwise("shallow")


def postclass(cls: Column, ndvi: Column, valid: Column, top: int = 6) -> Column:
    """Predictions corrected by greenness: 8 plants on land, 9 shore, 0 where nothing is valid or the class is unknown."""
    return F.when(~valid, 0).when(ndvi >= 0.2, 8).when(ndvi >= 0, 9).when(cls > top, 0).otherwise(cls)


def remap(cls: Column, to: dict[int, int | None]) -> Column:
    """Classes renamed; a class mapped to None becomes null."""
    out = cls
    for old, new in to.items():
        out = F.when(cls == old, F.lit(new)).otherwise(out)
    return out


def change_code(before: Column, after: Column, cls: str) -> Column:
    """1 stayed, 2 lost, 3 gained, 0 neither; 0 too where either has no data."""
    was, now = before == cls, after == cls
    return F.when(before.isNull() | after.isNull(), 0).when(was & now, 1).when(was, 2).when(now, 3).otherwise(0)


def over_threshold(p: Column, t: float) -> Column:
    return F.when(p >= t, 1).otherwise(0)


def parse_depth(text: Column) -> Column:
    """Second part of a range 'a-b', decimal commas allowed; otherwise the number without its sign."""
    number = lambda c: F.regexp_replace(F.trim(c), ",", ".").try_cast("double")
    return F.when(text.rlike(r"^\s*[0-9.,]+\s*-\s*[0-9.,]+\s*$"), number(F.element_at(F.split(text, "-"), 2))).otherwise(F.abs(number(text)))


def clean_na(text: Column, missing: tuple[str, ...] = ("NA", "None", "")) -> Column:
    return F.when(~F.trim(text).isin(*missing), F.trim(text))
