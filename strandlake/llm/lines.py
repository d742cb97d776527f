"""Line dedup by winnowing (operator 8), in DataFrame functions only.

The lines with a word in a text form a sequence of hashes. Of each two neighbouring
2-line grams the one with the lesser hash (the earlier of equal ones) is selected as a
fingerprint, so every run of three lines holds one, at a place that depends on the run
alone; a long line is a fingerprint by itself. Positions of equal fingerprints are joined
and extended by a line to the side where the run goes on: those that agree there too are
one repeated run. All but its first occurrence are deleted; deleted runs that overlap or
touch make up a longer repeated run.

Fingerprints and sides are grouped before anything is joined, so a line that very many
texts share is split by its neighbours and pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Lines in a gram, grams in a window: runs of at least GRAM + WINDOW - 1 lines are found.
GRAM, WINDOW = 2, 2
RUN = GRAM + WINDOW - 1
#: Characters from which a line is a repeated run by itself.
LONG = 60
SPACES = " \t\x0b\x0c\r"
#: To which side of the fingerprint the run goes on; a long line has no side.
LEFT, RIGHT, ALONE = 0, 1, 2


def _bare(line):
    """A line without white space at its ends, all white space alike."""
    return F.trim(F.translate(line, SPACES, " " * 5))


def _lines(text):
    """(place, hash, whether it is long) of the lines with a word."""
    bare = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), _bare(x).alias("s")))
    return F.transform(F.filter(bare, lambda e: e["s"] != ""), lambda e: F.struct(e["i"].alias("i"), F.xxhash64(e["s"]).alias("h"), (F.length(e["s"]) >= LONG).alias("long")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _key, fp, side, other, at: the selected places, with the line to the side that a run of RUN lines goes on.

    _key is the hash of id and text, so a row that repeats another one is the same document.
    at holds the places of the run's lines in the text.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key")
    d = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), key, _lines(F.col(text_col)).alias("l"))
    line, none = F.col("l"), F.array().cast("array<long>")
    grams = F.transform(F.sequence(F.lit(0), F.size(line) - GRAM), lambda i: F.xxhash64(*[F.get(line, i + k)["h"] for k in range(GRAM)]))
    d = d.withColumn("g", F.when(F.size(line) >= RUN, grams).otherwise(none))
    g = F.col("g")
    row = lambda fp, side, other, i, n: F.struct(fp.alias("fp"), F.lit(side).alias("side"), other.alias("other"), F.array(*[F.get(line, i + k)["i"] for k in range(n)]).alias("at"))
    # the window of grams i and i + 1 selects one, and its run goes on to the other side
    window = lambda i: F.when(F.get(g, i) <= F.get(g, i + 1), row(F.get(g, i), RIGHT, F.get(line, i + GRAM)["h"], i, RUN)).otherwise(row(F.get(g, i + 1), LEFT, F.get(line, i)["h"], i, RUN))
    runs = F.when(F.size(g) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(g) - WINDOW), window)).otherwise(F.array())
    places = F.filter(F.transform(line, lambda e, i: F.struct(e["h"].alias("h"), F.when(e["long"], i).alias("i"))), lambda e: e["i"].isNotNull())
    alone = F.transform(places, lambda e: row(e["h"], ALONE, F.lit(0).cast("long"), e["i"], 1))
    return d.select("_id", "_key", F.explode(F.concat(runs, alone)).alias("r")).select("_id", "_key", "r.*")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_key, places): for each document with deletions, the places of its deleted lines.

    Documents are in order of id (null first) and _key, lines in order within them.
    """
    found = cut(fingerprints(docs, id_col, text_col))  # hashes and places only: the texts are read once for them
    place, run = F.struct("_id", "_key", "at"), ["fp", "side", "other"]
    first = cut(found.groupBy(*run).agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    later = found.join(first, run).filter(place > F.col("first"))
    return later.select("_key", F.explode("at").alias("i")).groupBy("_key").agg(F.collect_set("i").alias("places"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text's later repeated runs deleted, and n_lines, n_removed.

    A run is three or more consecutive lines with a word (blank lines between don't count
    and stay), or one line of 60 characters or more; lines are equal but for white space at
    their ends and the kind of white space. n_lines counts all \\n-split lines. A null text
    stays null with zeros; an empty text is one blank line. Equal rows are one document:
    none is later than the other, and both are edited alike. Columns of the names made here
    are replaced, others stay. No rows give no rows.
    """
    text = F.col(text_col)
    docs = docs.drop("n_lines", "n_removed", "_key", "_places", "_lines")
    gone = repeated_lines(docs, id_col, text_col)
    d = docs.withColumn("_key", F.xxhash64(F.col(id_col), text)).join(gone.withColumnRenamed("places", "_places").hint("shuffle_hash"), "_key", "left")
    d = d.withColumn("_lines", F.split(text, "\n"))
    lines = F.col("_lines")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_places"))
    kept = F.when(F.col("_places").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return d.select(
        *[kept.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_places"), F.lit(0)).cast("long").alias("n_removed"),
    )
