"""Text built from type counts, zones and ranked results.

Counts arrive as ``array<struct<n:bigint, first:bigint, name:string>>``: one
entry per damage type, so its length is bounded by the taxonomy.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import title


def by_count(counts: Column) -> Column:
    """Order by count descending, then by first appearance."""
    keyed = F.transform(counts, lambda c: F.struct((-c["n"]).alias("neg"), c["first"], c["name"], c["n"]))
    return F.sort_array(keyed)


def by_first(counts: Column) -> Column:
    """Order by first appearance only."""
    return F.sort_array(F.transform(counts, lambda c: F.struct(c["first"], c["name"], c["n"])))


def plural(n: Column) -> Column:
    return F.when(n > 1, F.lit("s")).otherwise(F.lit(""))


def _counted(counts: Column, name=lambda c: c) -> Column:
    return F.transform(counts, lambda c: F.concat(c["n"].cast("string"), F.lit(" "), name(c["name"]), plural(c["n"])))


def describe_damage(counts: Column, zone_desc: Column, zone_area: Column, mode: str = "full") -> Column:
    """Damage sentence in one of four wordings.

    full / short   parts joined by " and " ("no defects" when empty); short
                   leaves out the word "area"
    v1             parts joined by ", "; without damage only a fixed phrase
    v2             as v1 with spaces for underscores; without damage the zone is named
    """
    spaced = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    ordered = by_count(counts)
    place = F.concat(F.lit(" on "), zone_desc, F.lit(" ("), zone_area, F.lit(" area)"))
    empty = counts.isNull() | (F.size(counts) == 0)
    if mode == "full" or mode == "short":
        parts = F.array_join(_counted(ordered), " and ")
        tail = place if mode == "full" else F.concat(F.lit(" on "), zone_desc, F.lit(" ("), zone_area, F.lit(")"))
        return F.concat(F.when(empty, F.lit("no defects")).otherwise(parts), tail)
    if mode == "v1":
        return F.when(empty, F.lit("no visible damage")).otherwise(
            F.concat(F.array_join(_counted(ordered), ", "), place)
        )
    if mode == "v2":
        return F.when(empty, F.concat(F.lit("no visible damage"), place)).otherwise(
            F.concat(F.array_join(_counted(ordered, spaced), ", "), place)
        )
    raise ValueError(f"unknown description mode: {mode}")


def describe_clean(zone_desc: Column, zone_area: Column) -> Column:
    return F.concat(F.lit("No visible damage on "), zone_desc, F.lit(" ("), zone_area, F.lit(" area)"))


def describe_crop(has_damage: Column, counts: Column, zone_desc: Column, zone_area: Column) -> Column:
    """Crop sentence: damaged, damaged without listed defects, or clean.

    Types keep the order of their first appearance.
    """
    place = F.concat(zone_desc, F.lit(" ("), zone_area, F.lit(")."))
    ordered = by_first(counts)
    names = F.array_join(F.transform(ordered, lambda c: c["name"]), ", ")
    damaged = F.concat(
        F.array_join(_counted(ordered), " and "),
        F.lit(" on "),
        place,
        F.lit(" Specific defects visible: "),
        names,
        F.lit("."),
    )
    return (
        F.when(~has_damage, F.concat(F.lit("Clean surface of "), place, F.lit(" No defects visible. Inspection grid section.")))
        .when(
            counts.isNull() | (F.size(counts) == 0),
            F.concat(F.lit("Damaged surface on "), place, F.lit(" Unspecified defects.")),
        )
        .otherwise(damaged)
    )


def topic_text(damage_type: Column) -> Column:
    return F.concat(F.replace(damage_type, F.lit("_"), F.lit(" ")), F.lit(" damage"))


def format_spatial(counts: Column) -> Column:
    """``2 defects in Top Left, 1 defect in ...`` by count, then by first appearance."""
    parts = F.transform(
        by_count(counts),
        lambda c: F.concat(c["n"].cast("string"), F.lit(" defect"), plural(c["n"]), F.lit(" in "), title(c["name"])),
    )
    return F.when(counts.isNull() | (F.size(counts) == 0), F.lit("distributed across image")).otherwise(
        F.array_join(parts, ", ")
    )


def truncate_text(text: Column, limit: int = 500, note: str = "...\n\n*(Truncated)*") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(note))).otherwise(text)


def strip_fence(answer: Column) -> Column:
    """Answer without a surrounding code fence."""
    body = F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*", "")
    return F.regexp_replace(body, r"\s*```$", "")


def answer_or_error(answer: Column, error: Column) -> Column:
    """Stored answer, or an empty-damages record when there is none or it failed."""
    failed = lambda why, text: F.to_json(
        F.struct(
            F.array().cast("array<string>").alias("damages"),
            F.lit(text).alias("summary"),
            why.alias("error"),
        )
    )
    return (
        F.when(error.isNotNull(), failed(error, "Error"))
        .when(F.coalesce(answer, F.lit("")) == "", failed(F.coalesce(answer, F.lit("")), "Analysis failed"))
        .when(F.startswith(answer, F.lit("Error:")), failed(answer, "Analysis failed"))
        .otherwise(answer)
    )


def verdict(value: Column, bands: list[tuple[float, str]], rest: str) -> Column:
    """First band whose lower bound lies below the value."""
    chain = None
    for bound, name in bands:
        chain = F.when(value > bound, name) if chain is None else chain.when(value > bound, name)
    return chain.otherwise(F.lit(rest))
