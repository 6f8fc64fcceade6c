"""Finding terms in word boxes: by a look at all boxes, or through an index of character trigrams that is built once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HIT = ("doc_id", "line_num", "word_num", "left_px", "top_px", "text")


def boxes_of(words: DataFrame) -> DataFrame:
    """Boxes of words: level 5, text that isn't blank."""
    return words.where("level = 5 AND trim(text) <> ''").select(*HIT)


def _folded(term: str, spark: SparkSession) -> str:
    if not term:
        raise ValueError("an empty term")
    return spark.range(1).select(F.lower(F.lit(term))).first()[0]  # in the words of the column's own lower()


def scan(words: DataFrame, term: str) -> DataFrame:
    """Boxes (HIT) whose text contains `term`, in any case, by a look at every box. A box is one word, so a term with a space is in none."""
    return boxes_of(words).where(F.contains(F.lower("text"), F.lit(_folded(term, words.sparkSession))))


def grams_of(word: Column) -> Column:
    """The different runs of three characters of a word."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(word) - 2), lambda i: F.substring(word, i, F.lit(3))))


@dataclass(frozen=True)
class SearchIndex:
    """grams: gram, part and ids (sorted numbers of the part's words that have it); vocabulary: word, id and part; boxes: id and HIT.

    Numbers are 64-bit hashes of lower-case words, and parts are ranges of them, so an array holds a part's words at most, however common the gram. Words are verified, so equal numbers do no harm.
    """

    grams: DataFrame
    vocabulary: DataFrame
    boxes: DataFrame

    def save(self, path: str) -> SearchIndex:
        """Writes the index: grams and numbers in order, so that a search reads few row groups; the boxes of a very common word over several files."""
        self.vocabulary.repartitionByRange("part", "id").sortWithinPartitions("part", "id").write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.grams.repartitionByRange("gram", "part").sortWithinPartitions("gram", "part").write.mode("overwrite").parquet(f"{path}/grams")
        self.boxes.repartitionByRange("id", "doc_id").sortWithinPartitions("id", "doc_id").write.mode("overwrite").parquet(f"{path}/boxes")
        return SearchIndex.open(self.grams.sparkSession, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> SearchIndex:
        return SearchIndex(*[spark.read.parquet(f"{path}/{t}") for t in ("grams", "vocabulary", "boxes")])

    def words(self, term: str) -> DataFrame:
        """Words that contain `term`: those of each part that have all of its grams, verified. Terms under three characters are sought in the vocabulary itself."""
        term = _folded(term, self.grams.sparkSession)
        fits = self.vocabulary.where(F.contains("word", F.lit(term)))
        if len(term) < 3:
            return fits.select("word", "id")
        asked = sorted({term[i : i + 3] for i in range(len(term) - 2)})
        found = self.grams.where(F.col("gram").isin(asked)).groupBy("part").agg(F.collect_list("ids").alias("lists"))  # as many arrays as grams of the term
        both = F.aggregate(F.slice("lists", 2, len(asked)), F.get("lists", 0), lambda a, b: F.array_intersect(a, b))
        ids = found.where(F.size("lists") == len(asked)).select("part", F.explode(both).alias("id"))
        return fits.join(ids, ["part", "id"]).select("word", "id")

    def search(self, term: str) -> DataFrame:
        """Boxes (HIT) whose text contains `term`, in any case."""
        found = self.words(term).select(F.col("id").alias("w_id"), "word")
        return self.boxes.join(found, (F.col("id") == F.col("w_id")) & (F.lower("text") == F.col("word"))).select(*HIT)


def build_index(words: DataFrame, parts: int | None = None, part_words: int = 50_000) -> SearchIndex:
    """An index of the word boxes of `words` (level and HIT). Save it to search more than once. Its `parts`, if not given, grow with the vocabulary (counted about, in one look at the boxes), so that each holds some `part_words` words; 16 at least. Null and blank texts are left out."""
    boxes = boxes_of(words).select(F.xxhash64(F.lower("text")).alias("id"), *HIT)
    if parts is None:
        parts = max(16, -(-boxes.agg(F.approx_count_distinct("id")).first()[0] // part_words))
    part = F.floor((F.shiftrightunsigned("id", 32) * parts) / F.lit(2**32)).cast("int")
    vocabulary = boxes.select(F.lower("text").alias("word"), "id").distinct().withColumn("part", part)
    gram = vocabulary.where(F.char_length("word") >= 3).select("part", "id", F.explode(grams_of(F.col("word"))).alias("gram"))
    return SearchIndex(gram.groupBy("gram", "part").agg(F.sort_array(F.collect_set("id")).alias("ids")), vocabulary, boxes)
