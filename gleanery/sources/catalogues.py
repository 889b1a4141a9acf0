"""Records of a picture catalogue's replies: open licences, a maker's works, no known pictures, large enough, numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.groups import settle
from gleanery.operators.history import ordinals
from gleanery.operators.joins import contained_needles, small

ITEM = "locations array<struct<url: string, license: struct<id: string>>>, source struct<id: string, title: string>"


def listed_works(items: DataFrame, item_col: str = "item") -> DataFrame:
    """Adds work, title, licence, url and image_id (the last path segment but one of the first location's url) of JSON items."""
    told = items.withColumn("_item", F.from_json(item_col, ITEM)).withColumn("_first", F.get("_item.locations", F.lit(0)))
    steps = F.split(F.regexp_replace("_first.url", r"/+\z", ""), "/")
    image = F.when(F.size(steps) > 1, F.get(steps, F.size(steps) - 2))
    made = told.withColumns({"work": F.col("_item.source.id"), "title": F.coalesce("_item.source.title", F.lit("")), "licence": F.col("_first.license.id"), "url": F.col("_first.url"), "image_id": F.nullif(image, F.lit(""))})
    return made.drop("_item", "_first", item_col)


def catalogue_records(items: DataFrame, order: list[Column], infos: DataFrame, known: DataFrame, known_col: str, licences: dict[str, str], who: str, first_index: int = 0, least_side: int = 0, most: int | None = None) -> DataFrame:
    """image, title, licence, work, image_id, url, width and height of the works to add.

    items: JSON items and what orders them; infos: image_id, width, height; known: texts that name the pictures that
    are there. A work needs one of the licences, the maker's name in its title, whatever its case, and a picture that no
    known text names; a picture of unknown size counts as 0 wide. What is left is numbered in order from first_index, of
    which ``most`` stay.
    """
    names = F.create_map(*[F.lit(x) for pair in licences.items() for x in pair])
    works = listed_works(items).withColumn("licence", F.try_element_at(names, F.col("licence")))
    # the pages are read once
    works = settle(works.filter(F.col("licence").isNotNull() & F.lower("title").contains(who.lower()) & F.col("image_id").isNotNull()))
    works = works.join(contained_needles(works, "image_id", known, known_col), "image_id", "left_anti")
    sized = works.join(small(infos.select("image_id", "width", "height")), "image_id", "left")
    if least_side:
        sized = sized.filter(F.least(F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))) >= least_side)
    numbered = ordinals(sized, order, "_number")
    if most is not None:
        numbered = numbered.filter(F.col("_number") < most)
    image = F.concat(F.lpad((F.col("_number") + first_index).cast("string"), 4, "0"), F.lit(".jpg"))
    long = F.when(F.col("_number") + first_index > 9999, F.concat((F.col("_number") + first_index).cast("string"), F.lit(".jpg"))).otherwise(image)
    return numbered.select(long.alias("image"), "title", "licence", "work", "image_id", "url", "width", "height")
