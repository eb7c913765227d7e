"""Cross-site line deduplication by distinct-site spread.

A line (text between ``\\n``, surrounding spaces and tabs cut off) is boilerplate if it occurs
on at least ``min_sites`` different sites. Per line hash a HyperLogLog sketch of its sites is
aggregated (merged map-side, so a line that fills a third of the corpus moves as one sketch a
task). Where the estimate is so near the threshold that the sketch's error could decide, the
exact number of distinct sites decides instead. Lines with fewer occurrences than that are counted only.

The first occurrence of a boilerplate line in the corpus stays (smallest id, null last, then a
hash of the text, the row and the position); all others are removed. So one copy of a widely copied text survives whole.

Rows are numbered, and their lines hashed, once, in a table written to the shared folder; everything after that goes by
row number, never by id. Lines are known by a 128-bit hash (two seeded 64-bit hashes). All
plans are DataFrame operations; the only shuffle of whole texts is the last join by row.

Defined cases: a null text stays null and has no lines; blank lines are never boilerplate and
stay; a null site counts as one site of its own; every row is a document of its own, also
where ids are null or repeated; an empty table gives an empty result; further columns pass
through untouched, whatever their names (but the two counts replace columns of their names).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise, release
from .joins import few

NULL_SITE = "\x00null"
COUNTS = ("__n_lines", "__n_cut")


def _bare(line):
    return F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")


def numbered(docs: DataFrame, text: str = "text", site: str = "source", key: str = "doc_id") -> DataFrame:
    """(row, first, site, lines, doc) as a written table: ``lines`` holds (pos, h1, h2) of every line
    that isn't blank, ``first`` what puts rows in order, ``doc`` all columns."""
    split = F.transform(F.split(F.col(text), "\n", -1), lambda line, i: F.struct(i.alias("pos"), _bare(line).alias("line")))
    hashed = F.transform(F.filter(split, lambda x: x["line"] != ""), lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["line"]).alias("h1"), F.xxhash64(F.lit(7), x["line"]).alias("h2")))
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("hash"))
    return materialise(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            order.alias("first"),
            F.coalesce(F.col(site).cast("string"), F.lit(NULL_SITE)).alias("site"),
            hashed.alias("lines"),
            F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in COUNTS)).alias("doc"),
        ),
        "lines",
    )


def spread(rows: DataFrame, min_sites: int, lg_k: int = 10) -> DataFrame:
    """(h1, h2, keep) of the lines on ``min_sites`` sites or more; ``keep`` is the first occurrence.

    lg_k: the sketches have 2**lg_k registers; the error allowed for is four standard errors.
    """
    frequent = materialise(rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h1", "h2"), "frequent")
    # Where they are few, the rows of a line that fills a third of the corpus are sketched where they lie.
    sketched = rows.join(few(frequent), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("about"),
        F.min(F.struct("first", "row", "pos")).alias("keep"),
    )
    slack = 1 + min_sites * 4 * 1.04 / 2 ** (lg_k / 2)
    kept = materialise(sketched.where(F.col("about") >= min_sites - slack).select("h1", "h2", "about", F.struct("keep.row", "keep.pos").alias("keep")), "line-spread")
    sure = kept.where(F.col("about") > min_sites + slack)
    near = kept.where(F.col("about") <= min_sites + slack)
    # Distinct (line, site) pairs are few however often a line occurs: partial aggregation meets them first.
    exact = rows.join(few(near.select("h1", "h2")), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    decided = near.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi")
    found = materialise(sure.unionByName(decided).select("h1", "h2", "keep"), "boilerplate")
    release(kept, frequent)
    return found


def removals(table: DataFrame, min_sites: int = 10) -> DataFrame:
    """(row, cut): the lines that each row of a numbered table loses, as bits of an array of 64-bit words."""
    rows = table.select("row", "first", "site", F.explode("lines").alias("line")).select("row", "first", "site", "line.*")
    found = spread(rows, min_sites)
    hit = rows.select("row", "pos", "h1", "h2").join(few(found), ["h1", "h2"])
    later = hit.where((F.col("row") != F.col("keep.row")) | (F.col("pos") != F.col("keep.pos")))
    words = later.groupBy("row", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    held = words.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"), F.max("word").alias("last"))
    # Dense, so that a line's bit is looked up in one step however many lines a text has.
    return held.select("row", F.transform(F.sequence(F.lit(0), F.col("last")), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long"))).alias("cut"))


def dedup_lines(docs: DataFrame, min_sites: int = 10, text: str = "text", site: str = "source", key: str = "doc_id") -> DataFrame:
    """The documents with ``text`` rid of boilerplate, and the counts __n_lines and __n_cut."""
    table = numbered(docs, text, site, key)
    joined = table.select("row", F.size("lines").alias("n"), "doc").join(removals(table, min_sites), "row", "left")
    body = F.col("doc").getField(text)
    uncut = lambda _, i: F.coalesce(F.getbit(F.get("cut", F.floor(i / 64).cast("int")), i % 64), F.lit(0)) == 0
    kept = F.when(F.col("cut").isNull(), body).otherwise(F.array_join(F.filter(F.split(body, "\n", -1), uncut), "\n"))
    others = [(kept if c == text else F.col("doc").getField(c)).alias(c) for c in docs.columns if c not in COUNTS]
    n_cut = F.coalesce(F.aggregate("cut", F.lit(0), lambda n, w: n + F.bit_count(w)), F.lit(0))
    return joined.select(*others, F.greatest(F.col("n"), F.lit(0)).cast("long").alias(COUNTS[0]), n_cut.cast("long").alias(COUNTS[1]))
