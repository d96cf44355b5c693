"""A chain of translators and filters declared by a schema, composed into one plan; look-ups as table functions of SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import candidates, lookup

Translator = Callable[["Context", DataFrame], DataFrame]
Filter = Callable[["Context", DataFrame], DataFrame]

TRANSLATORS: dict[str, Translator] = {}
FILTERS: dict[str, Filter] = {}


@dataclass
class Context:
    """What the parts of a chain work with: tables by name (lexicon, reverse, light_rules, lo_words, recommended) and options (mode, recommend, day)."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    options: dict = field(default_factory=dict)

    @property
    def mode(self) -> int:
        return self.options.get("mode", 0)


def translator(name: str) -> Callable[[Translator], Translator]:
    """Registers a translator: (context, queries) -> candidates. queries: (query_id, input); candidates: (query_id, pos, text, comment, quality)."""
    return lambda f: TRANSLATORS.setdefault(name, f) if name not in TRANSLATORS else _taken(name)


def filter_(name: str) -> Callable[[Filter], Filter]:
    """Registers a filter: (context, candidates) -> candidates."""
    return lambda f: FILTERS.setdefault(name, f) if name not in FILTERS else _taken(name)


def _taken(name: str):
    raise ValueError(f"{name} is registered already")


def _candidates(df: DataFrame, text, comment, quality, pos="pos") -> DataFrame:
    return df.select("query_id", F.col(pos).cast("int").alias("pos"), text.alias("text"), comment.alias("comment"), quality.cast("double").alias("quality"))


def _bracket(c) -> F.Column:
    return F.concat(F.lit(" ["), c, F.lit("]"))


@translator("script_translator")
def _plain(context: Context, queries: DataFrame) -> DataFrame:
    """Exact codes and their derived spellings; sentences aren't composed."""
    asked = queries.where(lookup.route(F.col("input")) == "plain")
    found = lookup.fuzzy(asked, lookup.spellings(context.tables["lexicon"]))
    return _candidates(found, F.col("hanlo"), _bracket(F.col("rime_key")), F.col("weight"))


@translator("reverse_lookup_translator")
def _reverse(context: Context, queries: DataFrame) -> DataFrame:
    """`~code` against the reverse lexicon (hanlo, rime_key, reading, weight): the words of a code with their readings."""
    asked = queries.where(lookup.route(F.col("input")) == "reverse").select("query_id", F.substring("input", F.lit(2), F.length("input")).alias("input"))
    return _candidates(lookup.exact(asked, context.tables["reverse"]), F.col("hanlo"), _bracket(F.col("reading")), F.col("weight"))


@translator("phrase")
def _phrase(context: Context, queries: DataFrame) -> DataFrame:
    found = lookup.phrase(queries, context.tables["lexicon"])
    return _candidates(found.withColumn("pos", F.coalesce("pos", F.lit(1))), F.coalesce("hanlo", F.lit("")), F.coalesce(_bracket(F.col("rime_key")), F.lit("")), F.lit(0.0))


@translator("wildcard")
def _wildcard(context: Context, queries: DataFrame) -> DataFrame:
    found = candidates.repositioned(lookup.wildcard(queries, context.tables["lexicon"]), "seq", "code")
    return _candidates(found, F.col("code"), F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(")")), F.lit(0.0))


def _static(*keys: str) -> Translator:
    def rows(context: Context, queries: DataFrame) -> DataFrame:
        asked = queries.where(F.col("input").isin(*keys) if keys else F.startswith("input", F.lit("`")))
        return _candidates(lookup.static_rows(asked).withColumn("pos", F.col("seq") + 1), F.col("text"), F.col("comment"), F.lit(0.0))

    return rows


translator("help")(_static("vvh"))
translator("speedup")(_static("vvsp"))
translator("symbols")(_static())


@translator("date")
def _date(context: Context, queries: DataFrame) -> DataFrame:
    found = lookup.dates(queries, F.lit(context.options["day"]).cast("date") if "day" in context.options else F.current_date())
    return _candidates(found.withColumn("pos", F.col("seq") + 1), F.col("text"), F.lit(""), F.lit(0.0))


filter_("lighttone")(lambda context, df: candidates.with_light_tones(df, context.tables["light_rules"]))
filter_("filter")(lambda context, df: candidates.rewritten(df, context.tables["lo_words"], context.mode))
filter_("lookup")(lambda context, df: candidates.with_both_spellings(df))
filter_("recommend")(lambda context, df: candidates.recommended(df, context.tables["recommended"], context.options.get("recommend", True)))
filter_("synonym")(lambda context, df: candidates.synonyms(df))
filter_("long_word")(lambda context, df: candidates.long_words_first(df))
filter_("reverse_format")(lambda context, df: candidates.formatted_readings(df, context.mode in (1, 3)))
filter_("uniquifier")(lambda context, df: candidates.unique(df))


@dataclass
class Declared:
    """The parts of a schema by name, in order, and the entries that nothing is registered for (parts of the host, for instance)."""

    translators: list[str]
    filters: list[str]
    unknown: list[str]


def _resolved(entry: str, known: dict) -> str | None:
    """An entry is `kind` or `kind@name`. A kind that is registered counts; else, for script modules (`lua_...@*name`), the longest registered name that the module's name ends with, behind an underscore."""
    kind, _, name = entry.partition("@")
    if kind in known:
        return kind
    if not kind.startswith("lua_"):
        return None
    name = name.lstrip("*")
    return max((k for k in known if name == k or name.endswith(f"_{k}")), key=len, default=None)


def declared(lines: list[str]) -> Declared:
    """The engine block of a schema in YAML: lists of entries below `translators:` and `filters:`."""
    found, unknown, part, inside = {"translators": [], "filters": []}, [], None, False
    for line in lines:
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        if not bare.startswith(" "):
            inside, part = bare == "engine:", None
        elif inside and (m := re.fullmatch(r"\s+(\w+):", bare)):
            part = m[1] if m[1] in found else None
        elif inside and part and (m := re.fullmatch(r"\s+-\s*(\S+)", bare)):
            name = _resolved(m[1], TRANSLATORS if part == "translators" else FILTERS)
            (found[part] if name else unknown).append(name or m[1])
    return Declared(found["translators"], found["filters"], unknown)


def read_schema(spark: SparkSession, path: str) -> Declared:
    """The declared chain of a schema file, from any store that Spark reads."""
    rows = spark.read.option("wholetext", True).text(path).collect()
    return declared("\n".join(r.value for r in rows).splitlines())


def composed(chain: Declared, context: Context, queries: DataFrame) -> DataFrame:
    """Candidates of all translators, those of the first before those of the second, through all filters: one plan."""
    unknown = [n for n in chain.translators if n not in TRANSLATORS] + [n for n in chain.filters if n not in FILTERS]
    if unknown or not chain.translators:
        raise ValueError(f"no such part: {unknown}" if unknown else "a chain without translators")
    out = candidates.merged(*(TRANSLATORS[n](context, queries) for n in chain.translators))
    for name in chain.filters:
        out = FILTERS[name](context, out)
    return out


def filtered(chain: Declared, context: Context, df: DataFrame) -> DataFrame:
    """Candidates at hand through the filters of a chain."""
    for name in chain.filters:
        df = FILTERS[name](context, df)
    return df


def sql_functions(spark: SparkSession, lexicon: DataFrame, reverse: DataFrame | None = None) -> None:
    """Look-ups as temporary table functions of SQL: code_entries(code), spelling_entries(spelling) and, with a reverse lexicon, reverse_entries(code). They are parts of the plan that calls them; lateral joins of them are equi-joins."""
    lexicon.createOrReplaceTempView("lexicon_entries")
    lookup.spellings(lexicon).createOrReplaceTempView("lexicon_spellings")
    table = "RETURNS TABLE (hanlo STRING, rime_key STRING, weight INT) RETURN SELECT hanlo, rime_key, CAST(weight AS INT) FROM"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION code_entries(code STRING) {table} lexicon_entries WHERE rime_key = code")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION spelling_entries(asked STRING) {table} lexicon_spellings WHERE spelling = asked")
    if reverse is not None:
        reverse.createOrReplaceTempView("reverse_lexicon")
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION reverse_entries(code STRING) RETURNS TABLE (hanlo STRING, reading STRING, weight INT) RETURN SELECT hanlo, reading, CAST(weight AS INT) FROM reverse_lexicon WHERE rime_key = code")
