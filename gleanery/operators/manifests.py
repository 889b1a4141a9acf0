"""Checks of a prepared training manifest: what the trainer will read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.texts import token_count

#: What stands in captions that nobody has made.
PLACEHOLDERS = ("unknown", "no VLM")


def manifest_problems(rows: DataFrame, trigger: str, order: str, image: str = "image", text: str = "text", width: str = "width", height: str = "height", most_tokens: int = 77, cost: Callable[[Column], Column] | None = token_count, placeholders: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    """image, severity, category, message of every problem of every row.

    A picture without a width or height can't be read; sides are multiples of 8; a caption begins with the trigger,
    holds no placeholder and leaves two tokens of the window free (without a cost that is not judged). A caption that an
    earlier row has, by ``order``, is a warning that names the first one's image; the others are errors. A null caption is empty.
    """
    said, w, h = F.coalesce(F.col(text), F.lit("")), F.col(width), F.col(height)
    issue = lambda test, category, message, severity="error": F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), message.alias("message")))
    readable = w.isNotNull() & h.isNotNull()
    found = [
        issue(~readable, "unreadable_image", F.lit("image missing or unreadable")),
        issue(readable & ((w % 8 != 0) | (h % 8 != 0)), "bad_size", F.concat(w.cast("string"), F.lit("x"), h.cast("string"), F.lit(" is not a multiple of 8"))),
        issue(~said.startswith(trigger), "missing_trigger", F.lit(f"caption does not start with {trigger}")),
        issue(F.greatest(F.lit(False), *[said.contains(p) for p in placeholders]), "placeholder_caption", F.lit("caption contains placeholder text")),
    ]
    if cost is not None:
        found.append(issue(cost(said) > most_tokens - 2, "caption_too_long", F.concat(cost(said).cast("string"), F.lit(f" tokens of {most_tokens - 2}"))))
    # digests of captions meet, so that a common one moves no text; the first holder of each is one small row
    held = rows.withColumn("_digest", F.sha2(said, 256))
    first = held.groupBy("_digest").agg(F.min_by(image, order).alias("_first"), F.min(order).alias("_order"), F.count("*").alias("_n")).filter("_n > 1")
    own = held.select(image, F.explode(F.array_compact(F.array(*found))).alias("i")).select(image, "i.*")
    again = held.select(image, order, "_digest").join(first, "_digest").filter(F.col(order) > F.col("_order"))
    again = again.select(image, F.lit("warning").alias("severity"), F.lit("duplicate_caption").alias("category"), F.concat(F.lit("same caption as "), F.col("_first")).alias("message"))
    return own.unionByName(again)


def accepted(rows: DataFrame, problems: DataFrame, image: str = "image") -> DataFrame:
    """Rows without an error."""
    return rows.join(problems.filter("severity = 'error'").select(image).distinct(), image, "left_anti")
