"""Language identification by compression.

Each language has a raw-content dictionary of its most frequent words. A text is encoded with every dictionary, and
the language whose dictionary makes it smallest is chosen; a narrow margin between the best two is a rejection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bounds of the fit: labelled rows per language, words and bytes per dictionary, languages.
SAMPLE_ROWS, DICTIONARY_WORDS, DICTIONARY_BYTES, MOST_LANGUAGES = 200, 20_000, 1 << 16, 500
#: A text is encoded in blocks of so many bytes, each with the fresh dictionary, so long texts count in full.
BLOCK = 4096
#: Least lead over the second, as a share of its size.
MARGIN = 0.005
#: Stands at the end of every dictionary and before every block: so even short texts are encoded by matches.
LEAD = b"5#@1+9%*2&7$=0^8!4~6?3<;>:[%1]{0}|7/2#9"
OTHER = re.compile(r"[^\w]+|[\d_]+")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def held_out(id_col: str) -> Column:
    """Rows that are never learned from; a null id counts as empty text, which isn't held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def letters(text: str) -> str:
    """Lower-case words of letters, one space between them."""
    return OTHER.sub(" ", text.lower()).strip()


def encoder(words: list[str]) -> zstandard.ZstdCompressor:
    """``words`` come by descending frequency; the most frequent stand last, where matches are cheapest."""
    content = " ".join(reversed(words)).encode()[-DICTIONARY_BYTES:] + LEAD
    parameters = zstandard.ZstdCompressionParameters(
        window_log=19, chain_log=18, hash_log=18, search_log=3, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=dictionary)


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, list[str]]]:
    """(language, words by descending frequency) of every label; the label with the most rows comes first.

    The words are counted over the whole texts of ``SAMPLE_ROWS`` rows per language, those with the smallest hashes of
    their ids. The driver gets at most ``DICTIONARY_WORDS`` words for each of ``MOST_LANGUAGES`` languages.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    rows = labelled.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    sizes = rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    chosen = rows.select("_lang", "_id").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE_ROWS)
    sample = rows.join(F.broadcast(chosen.select("_lang", "_id").distinct()), ["_lang", "_id"])
    words = sample.select("_lang", F.explode(F.split(F.lower("_text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counts = words.groupBy("_lang", "word").count()
    frequent = Window.partitionBy("_lang").orderBy(F.desc("count"), "word")
    top = counts.withColumn("_n", F.row_number().over(frequent)).where(F.col("_n") <= DICTIONARY_WORDS).orderBy("_lang", "_n")
    found: dict[str, list[str]] = {row["_lang"]: [] for row in sizes}
    for row in top.select("_lang", "word").collect():
        found[row["_lang"]].append(row["word"])
    return list(found.items())


class Classifier:
    def __init__(self, model: list[tuple[str, list[str]]]):
        self.languages = [lang for lang, _ in model]
        self.encoders = [encoder(words) for _, words in model]

    def sizes(self, text: str) -> list[int]:
        data = text.encode()
        blocks = [LEAD + data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
        return [sum(len(e.compress(b)) for b in blocks) for e in self.encoders]

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and rejection. Of equal sizes the language with more labelled rows wins."""
        words = letters(text or "")
        if not self.languages or not any(map(str.isalpha, words)):
            return "und", 0.0, True
        sizes = self.sizes(words)
        best = min(sizes)
        score = 1 / sum(2.0 ** -min(8 * (n - best), 1000) for n in sizes)
        second = sorted(sizes)[1] if len(sizes) > 1 else None
        return self.languages[sizes.index(best)], score, second is not None and second - best < MARGIN * second


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row.

    ``score`` weighs the languages by 2^-bits of their encodings, so it is 1 for a clear lead and 1/n for a tie of n. Null,
    empty or letterless texts, and all texts if nothing is labelled, get ``und``, score 0, rejected. Repeated rows and
    null ids stay. Labels, sources and ids aren't inputs of a prediction; other columns aren't read.
    """
    model = learn(docs, id_col, text_col, lang_col)

    def classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(model)
        for batch in batches:
            found = [classifier.classify(text) for text in batch.column("text").to_pylist()]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], [c.split()[0] for c in SCHEMA.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(classified, SCHEMA)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns; each is classified in place, without a join."""
    model = learn(docs, id_col, text_col, lang_col)

    @F.pandas_udf("boolean")
    def keeps(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        classifier = Classifier(model)
        for texts in batches:
            yield texts.map(lambda text: not classifier.classify(text)[2])

    return docs.where(keeps(F.col(text_col)))
