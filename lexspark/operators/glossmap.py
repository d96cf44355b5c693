"""Map from Mandarin words to codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as T


def gloss_map(rows: DataFrame) -> DataFrame:
    """(mandarin, kip) from (hoabun, kip, priority, hanlo, seq).

    For a word the best of: being the gloss itself, as many syllables as characters, the source's priority, and the earliest row. Characters of words come in only where no word maps them; there, priority and the earliest row decide after the syllable count.
    """
    words = rows.select("*", T.gloss_words(F.col("hoabun")).alias("words"))
    named = words.select("kip", "priority", "seq", "hanlo", F.size("words").alias("n"), F.posexplode("words").alias("at", "mandarin"))
    code = F.replace("kip", F.lit("-"), F.lit(" "))
    fits = F.size(F.filter(F.split(code, r"\s+"), lambda x: x != "")) == F.regexp_count("mandarin", F.lit(T.HAN))
    primary = (F.col("n") == 1) | (F.col("mandarin") == F.col("hanlo"))
    order = F.struct((~primary).alias("p"), (~fits).alias("f"), (-F.col("priority")).alias("w"), "seq", "at")
    by_word = named.groupBy("mandarin").agg(F.min_by(code, order).alias("kip"))
    pairs = named.select("priority", "seq", "at", F.posexplode(T.characters_with_syllables(F.col("mandarin"), F.col("kip"))).alias("place", "c"))
    pairs = pairs.select(F.col("c.character").alias("mandarin"), F.col("c.syllable").alias("kip"), "priority", "seq", "at", "place")
    first = F.struct("seq", "at", "place")  # a character once mapped isn't mapped again
    by_character = pairs.groupBy("mandarin").agg(F.min_by("kip", first).alias("kip"))
    return by_word.unionByName(by_character.join(by_word.select("mandarin"), "mandarin", "left_anti"))
