"""How often every term occurs and in how many records, with marks for the too rare and the too common.

A record is a row. One scan emits the entries of every record, its metric and the pairs of its tags. Entries that are
alike are counted by hash within each map task before they are shuffled, so one held by a third of all rows travels as
one partial count per task. Every distinct entry then emits its terms, each with its occurrences and, apart from that,
once for the record, times the records that hold the entry; these are combined and summed the same way. The number of
records is counted in the same aggregations, as a term of its own that every record holds.

Defined cases: null, empty and blank words are no terms; a null or empty tag map and null tag values give none;
a word repeated in a record counts as several occurrences and one record; ``key=word`` strings that several
keys of one record produce are one term; keys stay as written, words are folded (spaces at both ends removed,
lower case); an empty table gives no rows; other columns are ignored. A term that is both too rare and too
common (tiny tables) is marked rare. The separator is taken literally, whatever it means in a regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE_BELOW = 5
COMMON_ABOVE = 0.4


def folded(text: Column) -> Column:
    return F.trim(F.lower(text))


def _counted(words: Column) -> Column:
    """Every word once per occurrence and, apart from that, once per record: (word, occurrences, records)."""
    row = lambda n, r: lambda w: F.named_struct(F.lit("word"), w, F.lit("n"), F.lit(n), F.lit("r"), F.lit(r))
    return F.concat(F.transform(words, row(1, 0)), F.transform(F.array_distinct(words), row(0, 1)))


#: Kinds of entries: the record itself, its metric, a pair of its tags, all of its tags at once.
RECORD, METRIC, TAG, TAGS = 0, 1, 2, 3


def record_entries(records: DataFrame, metric: str, tags: str) -> DataFrame:
    """(kind, key, held) per entry of a record. Keys of a map differ, so a term repeats within a record only among the
    words of one value, unless a key itself contains ``=``: the tags of such a record are one entry, as JSON."""
    none = F.lit(None).cast("string")
    entry = lambda key, held: F.struct(key.alias("key"), held.alias("value"))
    odd = F.coalesce(F.instr(F.array_join(F.map_keys(F.col(tags)), " "), "=") > 0, F.lit(False))
    pairs = F.when(odd, F.array(entry(none, F.to_json(tags)))).otherwise(F.map_entries(F.col(tags)))
    # the order of the entries and the lack of a key tell their kinds
    always = F.array(entry(none, F.lit("record")), entry(none, F.col(metric)))
    every = F.concat(always, F.coalesce(pairs, F.slice(always, 1, 0)))
    rows = records.select(F.posexplode(every).alias("place", "entry")).where(F.col("entry.value").isNotNull())
    kind = F.when(F.col("place") < TAG, F.col("place")).otherwise(F.when(F.col("entry.key").isNull(), TAGS).otherwise(TAG))
    return rows.select(kind.alias("kind"), F.col("entry.key").alias("key"), F.col("entry.value").alias("held"))


def entry_terms(separator: str) -> Column:
    """(word, n, r) of an entry: the words of a tag's value, the terms of a record's tags, or a metric as a whole. No row
    carries more than its own word, so values of any number of words take memory in proportion."""
    mark = "\\Q" + separator + "\\E"
    words = lambda held: F.split(held, mark)
    clean = lambda e: F.filter(F.transform(words(e["value"]), folded), lambda w: w != "")
    pairs = F.map_entries(F.from_json("held", "map<string,string>"))
    made = F.transform(pairs, lambda e: F.transform(clean(e), lambda w: F.concat(e["key"], F.lit("="), w)))
    known = F.flatten(F.filter(made, lambda t: t.isNotNull()))
    one = F.array(F.named_struct(F.lit("word"), folded(F.col("held")), F.lit("n"), F.lit(1), F.lit("r"), F.lit(1)))
    several = (F.col("kind") == TAG) & (F.instr("held", separator) > 0)
    return (
        F.when(F.col("kind") == TAGS, _counted(known))
        .when(several, _counted(F.transform(words(F.lower("held")), lambda w: F.trim(w))))
        .otherwise(one)
    )


def term_frequencies(
    records: DataFrame,
    metric: str = "metric",
    tags: str = "tags",
    rare_below: int = RARE_BELOW,
    common_above: float = COMMON_ABOVE,
    separator: str = ";",
) -> DataFrame:
    """(field, term, n_occurrences, n_records, mark) of every term; mark is rare, common or null."""
    entries = record_entries(records, metric, tags).groupBy("kind", "key", "held").agg(F.count(F.lit(1)).alias("c"))
    words = entries.select("kind", "key", "c", F.inline(entry_terms(separator)))
    term = F.when(F.col("key").isNotNull(), F.concat("key", F.lit("="), "word")).otherwise(F.col("word"))
    counts = (
        words.where(F.col("word") != "")
        .groupBy(F.least("kind", F.lit(TAG)).alias("of"), term.alias("term"))
        .agg(
            F.sum(F.col("n") * F.col("c")).alias("n_occurrences"),
            F.sum(F.col("r") * F.col("c")).alias("n_records"),
            F.max("kind").alias("kind"),
        )
    )
    # both the marks and the total read all the counts, so that one shuffle serves both
    held = F.least("n_records", "n_occurrences")
    total = counts.select(F.max(F.when(F.col("kind") == RECORD, held))).scalar()
    mark = F.when(held < rare_below, "rare").when(held > common_above * total, "common")
    return counts.where(F.col("kind") != RECORD).select(
        F.when(F.col("kind") == METRIC, "metric").otherwise("tags").alias("field"), "term", "n_occurrences", "n_records",
        mark.alias("mark"),
    )
