"""Problem 6: free-entered names to a canonical list, by token repair and soft TF-IDF.

Distinct values only. A value is brought to one spelling and read as tokens; every distinct
token is joined with the tokens of the reference names by edit distance (through shared
deletion variants or, for long tokens, shared parts, so no cross join), and the repaired tokens rank complete
reference names by soft TF-IDF. A name can be meant if all its tokens and all tokens of the
value meet within `MOST_EDITS` edits in all (one less for names under six letters); of these the one of the
highest score is; a tie between different entries is not guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.glyphs import bare
from duelframe.session import Scratch

MOST_EDITS = 2
#: Longer tokens are compared by parts; shorter ones by deletion variants, which grow with the square of the length.
LONG_TOKEN = 24


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of letters and digits; apostrophes and dots join, all else parts."""
    joined = F.regexp_replace(text, "['’‘`.:]", "")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(joined, F.lit("([a-z0-9]+)"), F.lit(1))))


def readings(values: DataFrame) -> DataFrame:
    """(entered, reading, tokens) of distinct values; hidden forms and values without tokens give none.

    What follows '@' or a comma is detail. 'a (b)' is read as 'a b', then as b, then as a. A
    reading that ends in '-*' hides its form.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(bare("entered")), r"\s*@.*$", ""), r"\s*,.*$", "")
    inner = F.regexp_extract("plain", r"^(.*?)\s*\(([^()]*)\)\s*$", 2)
    outer = F.regexp_extract("plain", r"^(.*?)\s*\(([^()]*)\)\s*$", 1)
    split = F.when(F.trim(inner) != "", F.array(F.concat_ws(" ", outer, inner), inner, outer)).otherwise(F.array("plain"))
    rows = values.select("entered", plain.alias("plain")).where(~F.col("plain").rlike(r"[-_ ]\s*\*\s*\)?\s*$"))
    rows = rows.select("entered", F.posexplode(split).alias("reading", "text"))
    return rows.select("entered", "reading", tokens(F.col("text")).alias("tokens")).where("size(tokens) > 0")


def _deletions(token: str) -> Column:
    """The token and all it becomes when one or two characters are taken out; never ''."""
    once = f"transform(sequence(1, length({token})), i -> concat(substr({token}, 1, i - 1), substr({token}, i + 1)))"
    twice = f"flatten(transform({once}, d -> IF(length(d) = 0, array(''), transform(sequence(1, length(d)), i -> concat(substr(d, 1, i - 1), substr(d, i + 1))))))"
    return F.array_remove(F.expr(f"array_distinct(concat(array({token}), {once}, {twice}))"), "")


def _parts(word: str) -> Column:
    """The three parts of a word with their place: two edits leave one part whole."""
    return F.expr(f"transform(sequence(0, 2), i -> struct(length({word}) AS size, i AS part, substr({word}, (i * length({word})) div 3 + 1, ((i + 1) * length({word})) div 3 - (i * length({word})) div 3) AS text))")


def _probes(token: str) -> Column:
    """The parts that words within two edits of a token can have, where they can stand."""
    part = f"substr({token}, (i * n) div 3 + 1 + d, ((i + 1) * n) div 3 - (i * n) div 3)"
    each = f"transform(filter(sequence(-2, 2), d -> (i * n) div 3 + d >= 0), d -> struct(n AS size, i AS part, {part} AS text))"
    return F.expr(f"array_distinct(flatten(transform(sequence(length({token}) - 2, length({token}) + 2), n -> flatten(transform(sequence(0, 2), i -> {each})))))")


def repaired(typed: DataFrame, vocabulary: DataFrame, long: int = LONG_TOKEN) -> DataFrame:
    """(token, word, edits): vocabulary words within two edits of a token, one edit if one of both is a single character.

    Tokens of up to `long` characters meet through shared deletion variants, longer ones through shared
    parts; both find all words within two edits. Numbers meet equal numbers only.
    """
    tokens_, words = typed.select("token").distinct(), vocabulary.select("word").distinct()
    spread = lambda df, name: df.where(F.length(name) <= long).select(name, F.explode(_deletions(name)).alias("part"))
    met = spread(tokens_, "token").join(spread(words, "word"), "part").select("token", "word")
    held = words.where(F.length("word") >= long - 1).select("word", F.explode(_parts("word")).alias("part"))
    asked = tokens_.where(F.length("token") >= long - 1).select("token", F.explode(_probes("token")).alias("part"))
    met = met.unionByName(asked.join(held, "part").select("token", "word"))
    met = met.distinct().withColumn("edits", F.levenshtein("token", "word"))
    kind = lambda c: F.col(c).rlike("^[0-9]+$")
    short = F.least(F.length("token"), F.length("word"))
    allowed = F.when((F.col("token") == F.col("word")), 0).when(kind("token") | kind("word"), -1).when(short <= 1, 0).otherwise(MOST_EDITS)
    return met.where(F.col("edits") <= allowed)


def ranked(asked: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """(entered, means): the accepted target of each value; values without one are absent.

    asked: readings. targets: (tokens, means, rank), where means may be '' for a known name
    that has no entry; at equal scores a lower rank wins. Steps that are read more than once are
    written to the scratch folder, which keeps the plans small.
    """
    targets = scratch.save(targets.groupBy("tokens", "rank").agg(F.min("means").alias("means")).withColumn("target", F.xxhash64("tokens", "rank")))
    size = targets.agg(F.count(F.lit(1)).cast("double").alias("n"))
    posting = targets.select("target", F.size("tokens").alias("words"), F.explode("tokens").alias("word"))
    idf = posting.groupBy("word").agg(F.countDistinct("target").alias("df")).join(F.broadcast(size)).select("word", F.log(1 + F.col("n") / F.col("df")).alias("idf"))
    posting = scratch.save(posting.join(idf, "word").withColumn("norm", F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("target")))))
    single = asked.select("entered", "reading", F.size("tokens").alias("typed"), F.explode("tokens").alias("token"))
    fixes = scratch.save(repaired(single, posting))
    near = single.join(fixes, "token").join(posting, "word")
    best = near.groupBy("entered", "reading", "typed", "target", "words", "norm", "token").agg(F.min(F.struct("edits", "word", "idf")).alias("m"))
    close = 1 - F.col("m.edits") / F.greatest(F.length("token"), F.length("m.word"))
    whole = best.groupBy("entered", "reading", "typed", "target", "words").agg(
        F.sum("m.edits").alias("edits"), F.sum(F.length("m.word")).alias("letters"), F.count(F.lit(1)).alias("met"), F.countDistinct("m.word").alias("used"),
        F.sum(close * F.col("m.idf") * F.col("m.idf") / (F.col("norm") * F.col("norm"))).alias("score"),
    ).where("met = typed AND used = words AND met = used").where((F.col("edits") <= MOST_EDITS) & ((F.col("edits") == 0) | (F.col("letters") >= 3 * F.col("edits"))))
    told = whole.join(targets.select("target", "means", "rank"), "target")
    # a value that is a name as a whole is that name; else its parts are ranked together
    order = Window.partitionBy("entered").orderBy(F.col("reading") > 0, F.desc(F.round("score", 9)), "reading", "rank")
    first = told.withColumn("place", F.rank().over(order)).where("place = 1")
    return scratch.save(first.groupBy("entered").agg(F.when(F.min("means") == F.max("means"), F.min("means")).otherwise(F.lit("")).alias("means")))


def entered_values(slots: DataFrame, overrides: DataFrame) -> DataFrame:
    """(field, entered): distinct non-null values of the three fields, as stored."""
    return (
        slots.select(F.lit("pokemon_name").alias("field"), F.col("pokemon_name").alias("entered"))
        .unionByName(overrides.select(F.lit("showdown_name").alias("field"), F.col("showdown_name").alias("entered")))
        .unionByName(overrides.select(F.lit("pokemon").alias("field"), F.col("pokemon").alias("entered")))
        .where("entered IS NOT NULL").distinct()
    )


def found(slots: DataFrame, stats: DataFrame, overrides: DataFrame, fakes: DataFrame) -> DataFrame:
    """(field, entered, pokemon): the canonical entry of each distinct value, '' where there is none.

    First the overrides' pokemon are mapped to entries; then entries, override names (meaning
    what their pokemon means) and non-canonical names (meaning nothing) are the targets of all
    values. An override name of several entries means the first in order; a blank value, a null canonical
    name or an empty list means nothing.
    """
    scratch = Scratch(slots.sparkSession, "p6")
    values = scratch.save(entered_values(slots, overrides))
    lists = [stats.select(F.col("pokemon").alias("entered")), fakes.select(F.col("showdown_name").alias("entered"))]
    every = values.select("entered").union(lists[0]).union(lists[1]).where("entered IS NOT NULL").distinct()
    read = scratch.save(readings(every))
    named = lambda df, col: df.select(F.col(col).alias("entered")).distinct().join(read.where("reading = 0"), "entered")
    asked = lambda fields: read.join(values.where(F.col("field").isin(fields)).select("entered").distinct(), "entered", "left_semi")
    entries = named(stats, "pokemon").select("tokens", F.col("entered").alias("means"), F.lit(1).alias("rank"))
    meant = ranked(asked(["pokemon"]), entries, scratch)
    shown = overrides.select("showdown_name", F.col("pokemon").alias("entered")).join(meant, "entered", "left")
    shown = shown.select(F.col("showdown_name"), F.coalesce("means", F.lit("")).alias("means")).distinct()
    aliases = named(overrides, "showdown_name").join(shown.withColumnRenamed("showdown_name", "entered"), "entered").select("tokens", "means", F.lit(0).alias("rank"))
    nothing = named(fakes, "showdown_name").select("tokens", F.lit("").alias("means"), F.lit(2).alias("rank"))
    mapped = ranked(asked(["pokemon_name", "showdown_name", "pokemon"]), entries.unionByName(aliases).unionByName(nothing), scratch)
    return values.join(mapped, "entered", "left").select("field", "entered", F.coalesce("means", F.lit("")).alias("pokemon"))
