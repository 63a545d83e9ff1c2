"""Cross-site boilerplate lines by distinct-site spread.

Each line, trimmed of blanks, tabs and carriage returns, is hashed to 128 bits. A HyperLogLog sketch of the sites of
each line hash is built map-side and merged by aggregation. Lines whose estimate is well over SITES are boilerplate,
those well under aren't; lines near the threshold get an exact distinct count. Boilerplate lines are then taken out of
every text; blank lines stay.

Only hashes and positions are exploded; texts are joined to the removed positions by their digest, so that equal texts
share one list. A bitmap of fixed size lets texts with nothing to remove past that join, so they are never shuffled. Lines
are joined to the boilerplate under SALTS copies of each of its hashes, as these are the most frequent lines. Taking lines
out of a text takes time in proportion to its lines. Defined results: a null text stays null and has no lines; an empty one stays empty; a null site is a
site of its own; repeated rows and repeated lines in one text count once for a site, and all are removed or kept alike;
null doc_ids are kept; extra columns stay unless they bear an output name, which is replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .neardup import Places

SITES, LOG_K, SALTS = 5, 12, 16
BLANKS = " \t\r"


def lines_of(docs: DataFrame, site: str) -> DataFrame:
    """(k1, k2, pos, h1, h2, site): a row per line that isn't blank."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Keys are made before lines are exploded: beside the explode they would be made again for every line.
    keyed = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), F.coalesce(F.concat(F.lit("="), F.col(site)), F.lit("")).alias("site"), text.alias("text"))
    each = keyed.select("k1", "k2", "site", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    line = F.btrim(F.col("line"), F.lit(BLANKS))
    return each.where(line != "").select("k1", "k2", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), "site")


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(b1, b2): hashes of the lines seen in at least ``sites`` distinct sites."""
    margin = max(1.0, 4 * 1.04 / 2 ** (LOG_K / 2) * sites)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch"))
    judged = stored(spread.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("about")).where(F.col("about") >= sites - margin), "line-spread")
    sure = judged.where(F.col("about") > sites + margin).select(F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    near = judged.where(F.col("about") <= sites + margin).select(F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    exact = lines.select("h1", "h2", "site").join(near, (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2"))).select("b1", "b2", "site").distinct()
    exact = exact.groupBy("b1", "b2").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("b1", "b2")
    return stored(sure.union(exact), "boilerplate")


def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines at the given positions; null where there are none."""

    def one(t, places):
        if places is None:
            return None
        out = set(places)
        return "\n".join(line for i, line in enumerate(t.split("\n")) if i not in out)

    return pd.Series([one(t, places) for t, places in zip(text, gone, strict=True)], dtype=object)


def removals(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(__g1, __g2, __gone): the positions to remove from each text that has any."""
    salted = found.withColumn("bs", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    same = (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2")) & (F.pmod("k1", F.lit(SALTS)) == F.col("bs"))
    per_text = lines.join(salted, same).groupBy("k1", "k2").agg(F.collect_set("pos").alias("__gone"))
    return stored(per_text.select(F.col("k1").alias("__g1"), F.col("k2").alias("__g2"), "__gone"), "removed-lines")


def remove_boilerplate(docs: DataFrame, sites: int = SITES, site: str = "source") -> DataFrame:
    """docs with text cleaned, and n_lines (not blank) and n_removed."""
    bounded_batches(docs.sparkSession)
    lines = stored(lines_of(docs, site), "lines")
    gone = removals(lines, boilerplate(lines, sites))
    places = Places(gone.select("__g1"), "__g1")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text = F.coalesce(F.col("text"), F.lit(""))
    full = F.size(F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    keyed = docs.drop("n_lines", "n_removed").withColumns({"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit(1), text), "n_lines": full.cast("long")})
    keyed = places.flagged(keyed, "__k1", "__maybe")
    joined = keyed.where("__maybe").join(gone, (F.col("__k1") == F.col("__g1")) & (F.col("__k2") == F.col("__g2")), "left")
    left = F.pandas_udf(_without, "string")(F.when(F.col("__gone").isNotNull(), F.col("text")), F.col("__gone"))
    counted = joined.withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long")).withColumn("__left", left)
    changed = counted.withColumn("text", F.when(F.col("n_removed") > 0, F.col("__left")).otherwise(F.col("text")))
    same = keyed.where("NOT __maybe").withColumn("n_removed", F.lit(0).cast("long"))
    names = [*[F.col(f"`{c}`") for c in kept], "n_lines", "n_removed"]
    return changed.select(*names).unionByName(same.select(*names))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS s, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, s, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS body FROM l),
b AS (SELECT body FROM t WHERE body <> '' GROUP BY body HAVING count(DISTINCT s) >= {SITES})
SELECT t.doc_id, count(*) FILTER (t.body <> '') AS n_lines, count(b.body) AS n_removed,
  md5(coalesce(string_agg(t.line, chr(10) ORDER BY t.pos) FILTER (b.body IS NULL), '')) AS clean_md5
FROM t LEFT JOIN b ON t.body = b.body GROUP BY t.doc_id
"""
