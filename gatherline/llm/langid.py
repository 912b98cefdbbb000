"""Language identification by compression.

Each language has a raw-content dictionary of sampled text; a text is compressed in pieces with every language's dictionary
and goes to the language whose output is smallest. Where the smallest and the second are too close the text is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ddl, sliced, with_text

#: The fit: so many labelled rows of a language at most (those with the least hash), so many characters of each from a hashed place, and so many languages at most (those with most rows, of equals the first in code-point order).
SAMPLE_ROWS, SAMPLE_CHARS, MOST_LANGUAGES = 400, 300, 200
#: A text is compressed in pieces of so many bytes, so that its own earlier parts don't stand in for the dictionary, at this level, with matches from three bytes on.
PIECE_BYTES, LEVEL, MIN_MATCH = 4096, 4, 3
#: Least relative difference of the smallest and the second output for a text to be kept.
MARGIN = 0.0005


def fit(docs: DataFrame, labelled: Column) -> dict[str, bytes]:
    """Dictionaries by language from a bounded, documented sample of the rows of docs (doc_id, text, lang) where labelled holds. Equal rows give equal dictionaries, however they are dealt out."""
    rows = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()]
    at = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int")
    pieces = rows.where(F.col("lang").isin(langs)).select("lang", F.xxhash64("doc_id", F.lit("langid")).alias("h"), F.substring("text", at + 1, F.lit(SAMPLE_CHARS)).alias("piece"))
    for part in (F.col("h") % 64, F.lit(0)):  # in parts first, so that no task meets a language's rows of all tasks
        first = Window.partitionBy("lang", part).orderBy("h", "piece")
        pieces = pieces.withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_ROWS)
    parts: dict[str, list] = {}
    for r in sorted(pieces.select("lang", "h", "piece").collect()):  # SAMPLE_ROWS of MOST_LANGUAGES at most
        parts.setdefault(r["lang"], []).append(r["piece"])
    return {lang: letters("\n".join(p)) for lang, p in parts.items()}


#: What is compressed: letters in lower case, other characters' runs as one blank.
OTHERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return OTHERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.by_lang = []
        for lang, content in sorted(dictionaries.items()):
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, dict_size=len(content), source_size=PIECE_BYTES)
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            self.by_lang.append((lang, zstandard.ZstdCompressor(compression_params=p, dict_data=d)))

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (0 to 1: how much smaller the best output is than the second) and whether the text is rejected."""
        if text is None or not self.by_lang or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        data = letters(text)
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        sizes = sorted((sum(len(c.compress(p)) for p in pieces), lang) for lang, c in self.by_lang)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], margin, margin < MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The columns in keep and lang_pred, score (0 to 1) and rejected of every row of docs, from its whole text alone.

    A text that is null or has no letter is und, scores 0 and is rejected; ties go to the language first in code-point order
    and are rejected; with nothing learnt all are und. Repeated rows are judged alike; the result has a row for each row. Only learnt languages
    are predicted: of a table with more than MOST_LANGUAGES those with most rows (raise it to learn more; each is a dictionary of bounded size)."""

    chosen, name = with_text(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in sliced(batches):
            found = [model.classify(t.as_py()) for t in batch.column(name)]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                names=[*keep, "lang_pred", "score", "rejected"],
            )

    return chosen.mapInArrow(run, ddl(docs.select(*keep), "lang_pred string, score double, rejected boolean"))
