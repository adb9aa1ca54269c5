"""Line dedup with content-defined chunks (native: DataFrame functions only).

A polynomial rolling hash over the hashes of the last three lines ends a chunk where it is divisible by DIVISOR and the
one before was not. Boundaries depend on nearby lines only, so an inserted line moves few of them. Chunks of two and
more lines whose bytes occur more than once in the corpus stay where they come first, by doc_id and place, and go
elsewhere. Chunks are grouped by their whole text, which compares bytes; the 128-bit key under which the removals
travel is used only where it stands for one text.

Nulls: a null text stays null and has no lines. An empty text is one empty line. Empty table: empty result. Rows that
agree in doc_id and text are treated alike: they don't remove each other's chunks. A text whose chunks all go becomes
empty; its row stays. Very long texts are cut whole; arrays hold the lines of one text. Ties: of chunks at the same place of
rows that agree in doc_id and text, both stay. Extra columns pass through untouched, whatever their names; only __lines and
__removed are replaced.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import joined_on, saved, table

DIVISOR, LEAST_LINES, BASE = 3, 2, 31


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def chunks(text: Column) -> Column:
    """The chunks of a text in order, as structs (text, lines)."""
    lines = F.split(text, "\n", -1)

    def cut(h: Column) -> Column:
        at = lambda i: F.when(i >= 1, F.get(h, i - 1)).otherwise(F.lit(0))
        rolled = lambda i: (i >= 1) & ((at(i) + BASE * at(i - 1) + BASE * BASE * at(i - 2)) % DIVISOR == 0)
        return F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: (i == F.size(h)) | (rolled(i) & ~rolled(i - 1)))

    # each part is bound to a name by a one-element transform, so that it is computed once a text
    def build(parts: Column) -> Column:
        l, ends = parts["l"], parts["ends"]
        return F.transform(ends, lambda e, k: _chunk(l, F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(0)), e))

    hashed = F.transform(F.array(lines), lambda l: F.struct(l.alias("l"), F.transform(l, _line_hash).alias("h")))
    cuts = F.transform(hashed, lambda s: F.struct(s["l"].alias("l"), cut(s["h"]).alias("ends")))
    return F.when(text.isNotNull(), F.get(F.transform(cuts, build), F.lit(0)))


def _chunk(lines: Column, before: Column, end: Column) -> Column:
    return F.struct(F.array_join(F.slice(lines, before + 1, end - before), "\n").alias("text"), (end - before).alias("lines"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("__id"), F.xxhash64(F.col(text)).alias("__th"), F.col(text).alias("__text"))


def _occurrences(keyed: DataFrame) -> DataFrame:
    each = keyed.where("__text is not null").select("__id", "__th", F.posexplode(chunks(F.col("__text"))).alias("at", "c"))
    return each.where(F.col("c.lines") >= LEAST_LINES).select(F.struct("__id", "__th", "at").alias("place"), F.xxhash64("c.text").alias("h"), F.xxhash64("c.text", F.lit(1)).alias("g"), F.col("c.text").alias("chunk"))


def repeats(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(__id, __th, __gone): the places of the chunks that go from a text."""
    found = _occurrences(_keyed(docs, doc_id, text))
    texts = found.groupBy("h", "g", "chunk").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    known = texts.groupBy("h", "g").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.count("*").alias("texts")).where("n > 1 and texts = 1")
    known = saved(known.select("h", "g", "n", "first"), "chunks")
    gone = joined_on(found.drop("chunk"), known, ["h", "g"], "n", F.col("place")).where("place <> first")
    return gone.groupBy("place.__id", "place.__th").agg(F.collect_set("place.at").alias("__gone"))


def deduped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text that stays, and the columns __lines and __removed with numbers of lines."""
    rest = [c for c in docs.columns if c not in ("__lines", "__removed")]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    gone = repeats(docs, doc_id, text).select(F.col("__id").alias("gid"), F.col("__th").alias("gth"), F.col("__gone").alias("gone"))
    same = F.col("id").eqNullSafe(F.col("gid")) & (F.xxhash64("text") == F.col("gth"))
    all_ = row.join(gone, same, "left").withColumn("chunks", F.when(F.col("gone").isNotNull(), chunks(F.col("text"))))
    stays = F.filter("chunks", lambda c, k: ~F.array_contains("gone", k))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    removed = F.aggregate(F.filter("chunks", lambda c, k: F.array_contains("gone", k)), F.lit(0), lambda a, c: a + c["lines"])
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stays, lambda c: c["text"]), "\n"))
    out = all_.select("row", kept.alias("kept"), lines.cast("long").alias("__lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("__removed"))
    return out.select(*[F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`") for c in rest], "__lines", "__removed")


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP4_KEPT_SQL = r"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {docs} WHERE text IS NOT NULL),
v AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS v FROM l),
r AS (SELECT *, (v + 31 * lag(v, 1, 0) OVER w + 961 * lag(v, 2, 0) OVER w) % 3 = 0 AS hit FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, CASE WHEN hit AND NOT lag(hit, 1, false) OVER w THEN 1 ELSE 0 END AS cut FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
g AS (SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM k GROUP BY ALL),
o AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY t, n >= 2 ORDER BY doc_id, chunk) > 1 AS gone FROM g),
kept AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_removed, coalesce(string_agg(t, chr(10) ORDER BY chunk) FILTER (NOT gone), '') AS text FROM o GROUP BY doc_id)
"""

OP4_SQL = f"""
WITH {OP4_KEPT_SQL.format(docs="documents")}
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
