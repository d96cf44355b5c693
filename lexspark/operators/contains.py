"""Which words of a list texts contain: an Aho-Corasick automaton, one pass over each text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words, and bytes of them, that one automaton holds at most; longer lists are cut into several, which texts go through one after the other.
WORDS, BYTES = 500_000, 32 << 20

_HELD: dict[int, Broadcast] = {}


@lru_cache(maxsize=4)
def _automaton(key: int):
    """The automaton of a broadcast part of a list, built once a worker; None of an empty one."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, tag in _HELD[key].value:
        out.add_word(word, (*(out.get(word, ())), (word, tag)))
    if not len(out):
        return None
    out.make_automaton()
    return out


def _payloads(key: int, part: Broadcast, text: str) -> Iterator[tuple[str, str | None]]:
    _HELD[key] = part
    automaton = _automaton(key)
    if automaton is not None and text:
        for _, found in automaton.iter(text):
            yield from found


def _finder(part: Broadcast, pick: int) -> Callable[[Column], Column]:
    """What an automaton finds in texts: words (0) or tags (1), each once."""
    key = part._jbroadcast.id()

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({x[pick] for x in _payloads(key, part, t)} - {None}), na_action="ignore")

    return found


class WordList:
    """A list of words as broadcast parts of bounded size. Null and empty words, and repeats, are left out."""

    def __init__(self, words: DataFrame, word: str = "word", tag: str | None = None):
        spark = words.sparkSession
        rows = words.select(F.col(word).alias("word"), (F.col(tag).cast("string") if tag else F.lit(None).cast("string")).alias("tag")).where("word <> ''").distinct()
        self.parts: list[Broadcast] = []
        part, size = [], 0
        for row in rows.toLocalIterator():  # a task's rows at a time
            n = len(row.word.encode())
            if part and (len(part) >= WORDS or size + n > BYTES):
                self.parts.append(spark.sparkContext.broadcast(part))
                part, size = [], 0
            part.append((row.word, row.tag))
            size += n
        self.parts.append(spark.sparkContext.broadcast(part))

    def _column(self, text: Column, pick: int) -> Column:
        columns = [F.coalesce(_finder(part, pick)(text), F.array().cast("array<string>")) for part in self.parts]
        return columns[0] if len(columns) == 1 else F.array_sort(F.array_distinct(F.concat(*columns)))

    def found(self, text: Column) -> Column:
        """The words of the list that a text contains, each once, sorted; none of a null text. Linear in the text and its matches."""
        return self._column(text, 0)

    def tags(self, text: Column) -> Column:
        """The tags of the words that a text contains, each once, sorted."""
        return self._column(text, 1)


def contains_join(df: DataFrame, words: DataFrame, text: str = "text", word: str = "word") -> DataFrame:
    """df with each word of the list that its text contains: a row for each; rows without any go. Nothing is shuffled, and no pairs are tried."""
    return df.select("*", F.explode(WordList(words, word).found(F.col(text))).alias(word))
