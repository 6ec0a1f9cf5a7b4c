"""Operator 9: line deduplication, in DataFrame functions only.

Each document's lines are normalised and hashed where the document is read.
The hashes (128 bits) are exploded, and each document counts once for a hash;
map-side sums shrink a line that a third of all documents share before the
shuffle. Lines over the threshold are joined back, and each document is put
together again from the positions of its other lines.

Nulls and ties: a null or empty text is one empty line; lines with an empty
key always stay; repeated rows count as documents of their own; rows with
equal doc_id are told apart by their text; null ids are ids like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, sealed, table

#: Tasks to which one line's rows are dealt when they meet the lines to drop.
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """`line` without ASCII white space at both ends, A-Z in lower case."""
    bare = F.trim(line, F.lit(SPACES))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """`docs` with the columns n_lines, n_dropped and kept, the text without lines found in `min_docs` or more rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_text"), F.transform(F.split(text, "\n", -1), line_key).alias("_keys"))
    hashed = keyed.select("_id", "_text", F.filter(F.transform("_keys", lambda k, i: F.when(F.length(k) >= min_chars, F.struct(F.md5(k).alias("h"), i.alias("i")))), lambda p: p.isNotNull()).alias("_p"))
    # Sorted by hash, so that the first of equal lines in a document is known without comparing all pairs.
    hashed = hashed.withColumn("_s", F.sort_array("_p")).drop("_p")
    first = F.transform("_s", lambda p, j: F.struct(p["h"].alias("h"), p["i"].alias("i"), ((j == 0) | (F.get("_s", j - 1)["h"] != p["h"])).cast("int").alias("first")))
    lines = hashed.select("_id", "_text", F.inline(first).alias("h", "i", "first"))
    often = lines.groupBy("h").agg(F.sum("first").alias("_n")).filter(F.col("_n") >= min_docs)
    # A line of very many documents is dealt to SALTS tasks, and waits there in each.
    often = often.select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salted = lines.withColumn("s", F.pmod(F.xxhash64("_id", "_text"), F.lit(SALTS)).cast("int"))
    gone = salted.join(often, ["h", "s"]).groupBy("_id", "_text").agg(F.collect_set("i").alias("_gone"))
    rows = docs.withColumns({"_t": text, "_k": F.xxhash64(text)})
    joined = rows.join(gone.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(gone["_id"]) & (F.col("_k") == F.col("_text")), "left").drop("_id", "_text", "_k")
    joined = joined.withColumn("_lines", F.split("_t", "\n", -1))
    joined = joined.withColumn("_stay", F.when(F.col("_gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")))
    out = sealed(joined, {
        "n_lines": F.size("_lines").cast("long"),
        "n_dropped": F.when(F.col("_stay").isNull(), 0).otherwise(F.size("_lines") - F.size("_stay")).cast("long"),
        "kept": F.when(F.col("_stay").isNull(), F.col("_t")).otherwise(F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n")),
    })
    return out.drop("_t", "_gone", "_lines", "_stay")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, o.key IS NOT NULL AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
