"""Language identification by compression: each text is compressed with every language's raw-content dictionary.

Every language of the training documents has a dictionary: DICT_BYTES of its text, drawn from at most SAMPLE_ROWS documents
(those of the smallest hash of their doc_id). Texts of MIN_SAMPLE_CHARS to MAX_SAMPLE_CHARS come first, then the beginnings
of longer ones, then shorter ones, of which up to SHORT_ROWS are taken. A text is compressed whole, in pieces of PIECE bytes so that the dictionary counts for
all of it, and the language of the smallest total is chosen. Where the runner-up is within MIN_MARGIN of it, the result
is marked as rejected; the choice itself stays visible.

Null texts, and texts without any letter (marks and numerals aren't letters), are `und` with score 0. Ties go to the more
frequent language, then the one that sorts first. Repeated rows are judged alike. Rows without an id are judged like all
others, but not learned from; a doc_id that repeats within a language is learned from once. Without training rows all is
`und`. What the driver holds is bounded for each language, and grows with their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE_ROWS, DICT_BYTES, PIECE = 120, 65_536, 16_384
#: Level of compression: high, as of short texts a few bytes decide.
LEVEL = 12
MIN_MARGIN = 0.01
SIGNS = regex.compile(r"[^\p{L}\p{M}\s]+")
MIN_SAMPLE_CHARS, MAX_SAMPLE_CHARS, SHORT_ROWS = 200, 20_000, 2_000
#: Up to this number of languages, the ids drawn are broadcast.
BROADCAST_LANGS = 200


def learn(training: DataFrame, sample_rows: int = SAMPLE_ROWS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries by language from rows of (doc_id, text, lang)."""
    known = training.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    n = F.length("text")
    light = known.select("doc_id", "lang", F.when(n < MIN_SAMPLE_CHARS, 2).when(n > MAX_SAMPLE_CHARS, 1).otherwise(0).alias("kind"))
    # Spark keeps the first rows of each group on the map side already.
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("kind", F.xxhash64("doc_id"), "doc_id"))
    drawn = light.withColumn("nth", nth).where(F.col("nth") <= max(sample_rows, SHORT_ROWS)).where((F.col("nth") <= sample_rows) | (F.col("kind") == 2)).select("doc_id", "lang", "nth")
    texts_of = known.select("doc_id", "lang", F.substring("text", 1, MAX_SAMPLE_CHARS).alias("text"))
    joined = texts_of.join(F.broadcast(drawn) if len(langs) <= BROADCAST_LANGS else drawn, ["doc_id", "lang"])
    rows = joined.groupBy("lang", "doc_id").agg(F.min("nth").alias("nth"), F.min("text").alias("text")).select("lang", "nth", "text").collect()  # for each language, sample_rows texts of MAX_SAMPLE_CHARS and SHORT_ROWS short ones at most
    by_lang: dict[str, list] = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append((r["nth"], r["text"]))
    out: dict[str, bytes] = {}
    for lang in langs:
        data = plain("\n".join(dict.fromkeys(t for _, t in sorted(by_lang.get(lang, [])))))
        if data:
            out[lang] = data[:dict_bytes]
    return out


def plain(text: str) -> bytes:
    """What is compressed: letters in lower case and single blanks; signs and digits would hide the language."""
    return " ".join(SIGNS.sub("", text).lower().split()).encode("utf-8", "replace")


class Sizer:
    """dictionaries: the most frequent language first."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        made = [zstandard.ZstdCompressionDict(dictionaries[x], dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x in self.langs]
        for d in made:
            d.precompute_compress(level=LEVEL)
        self.compressors = [zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False) for d in made]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score from 0 to 1, and the margin of the runner-up."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        data = plain(text)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]
        least = min(sizes)
        best = sizes.index(least)
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0
        margin = (min(x for i, x in enumerate(sizes) if i != best) - least) / least
        return self.langs[best], 1 - 0.5 * math.exp(-margin / 0.05), margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin and rejected for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizer = Sizer(shared.value)
        for part in parts:
            found = [sizer.predict(t if isinstance(t, str) else None) for t in part["text"].tolist()]
            yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "margin": [x[2] for x in found], "rejected": [x[0] == "und" or x[2] < min_margin for x in found]})

    kind = docs.schema["doc_id"].dataType
    found = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, lang_pred string, score double, margin double, rejected boolean")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))  # a null among numbers would make pandas round them
