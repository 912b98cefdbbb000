"""Schedule feeds: a day's answer is JSON of no fixed shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text


def told(entry: Column, path: str) -> Column:
    """A field of an entry as text; null where it is absent or no scalar."""
    return F.try_variant_get(entry, path, "string")


def schedule_items(days: DataFrame, poster: str = fixed.POSTER_URL) -> DataFrame:
    """source_key, day, place (in the day's array), external_id, show, times, description, url, poster_url and text of the entries of days (source_key, day as YYYY-MM-DD, body: JSON).

    Bodies that are no JSON or no array give nothing, and so do entries that are no objects; a field of another shape than it should have is as if it were absent: a show without a name has a label, one without a description
    its name, one without times none. Entries of a day with one number and name have one external_id."""
    entries = F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>")
    e = days.select("source_key", "day", F.posexplode(entries).alias("place", "entry")).where(F.startswith(F.schema_of_variant("entry"), F.lit("OBJECT")))
    show = F.coalesce(text.compact(told(F.col("entry"), "$.nombre")), F.lit(fixed.UNNAMED_SHOW))
    number = told(F.col("entry"), "$.idcontenido")
    times = F.coalesce(F.filter(F.try_variant_get("entry", "$.horasdeinicio", "array<string>"), lambda t: t.isNotNull()), F.array().cast("array<string>"))
    e = e.select("source_key", "day", "place", show.alias("show"), number.alias("number"), times.alias("times"), told(F.col("entry"), "$.descripcion").alias("raw"), told(F.col("entry"), "$.urlweb").alias("url"))
    e = e.withColumn("description", F.coalesce(text.compact(text.html_text(F.col("raw"))), F.col("show")))
    whole = F.concat_ws(" ", "show", "day", F.array_join("times", " "), "description")
    return e.select(
        "source_key", "day", "place", F.concat_ws(":", "day", text.empty(F.col("number")), "show").alias("external_id"), "show", "times", "description", "url",
        F.when(~F.coalesce(F.col("number").isin("", "0"), F.lit(True)), F.concat(F.lit(poster), "number", F.lit(".jpg"))).alias("poster_url"), whole.alias("text"),
    )
