"""Line dedup with a log-template tree, in DataFrame operations only.

A line is parsed to a fixed depth: by its number of tokens, then by a run of its tokens. A token with a digit is a variable field. Two
leaves are tried: that of the leading tokens, as many as make LEADING of them (rounded up), which leaves fields at the end open; and
for lines of LONG tokens or more that of as many closing tokens, which leaves fields at the front open, of whatever letters. So a template has
at most 30 % of open places, and those together. A template of MIN_TOKENS or more tokens that stands in MIN_DOCS or more documents
recurs; its lines stay in the document of least doc_id and are dropped from all others. A line goes if one of its templates says so.

Only hashes of leaves travel for the counts; texts are shuffled once, to meet the flags of their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.runtime import cut, fresh

LEADING, MIN_TOKENS, MIN_DOCS = 0.7, 3, 3
LONG = 6
FIELD = r"[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*"


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def templates(line: Column) -> Column:
    """The hashes of the leaves that a line reaches, one or two; null if it has fewer than MIN_TOKENS tokens.

    With one space between tokens, a leaf's tokens are a prefix or a suffix of the line: no token needs to be cut out."""
    untidy = F.lit(False)
    for c in ("  ", "\t", "\r", "\x0b", "\x0c"):
        untidy = untidy | F.contains(line, F.lit(c))
    tidy = F.trim(F.when(untidy, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))
    masked = F.when(tidy.rlike("[0-9]"), F.regexp_replace(tidy, FIELD, "<*>")).otherwise(tidy)
    n = F.octet_length(masked) - F.octet_length(F.replace(masked, F.lit(" "), F.lit(""))) + 1
    most = F.ceil(n * LEADING).cast("int")
    run = lambda k: F.call_function("substring_index", masked, F.lit(" "), k)
    lead, close = F.xxhash64(n, run(most)), F.xxhash64(n, F.lit("close"), run(-most))
    return F.when(n >= LONG, F.array(lead, close)).when(n >= MIN_TOKENS, F.array(lead))


def flags(docs: DataFrame) -> DataFrame:
    """d, h, keep: for each document (doc_id and hash of its text) that loses lines, which of them stay."""
    found = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    found = cut(found.select("d", "h", "pos", templates(F.col("line")).alias("leaves")))
    found = found.select("d", "h", "pos", F.explode_outer("leaves").alias("leaf"))
    known = found.where("leaf is not null")
    recurring = known.groupBy("leaf", "d").agg(F.count("*").alias("c")).groupBy("leaf").agg(F.count("*").alias("docs"), F.min("d").alias("first")).where(F.col("docs") >= MIN_DOCS)
    # a join key of its own, so that adaptive execution can split the lines of one very common template
    recurring = recurring.select(F.shiftleft("leaf", 0).alias("again"), "first")
    dropped = found.join(recurring, F.col("leaf") == F.col("again"), "left").select("d", "h", "pos", F.coalesce(F.col("d") == F.col("first"), F.lit(True)).alias("keep"))
    by_doc = dropped.groupBy("d", "h").agg(F.collect_set(F.struct("pos", "keep")).alias("all"), F.min("keep").alias("whole")).where("not whole")
    # in order of lines, those that go first: of a line's templates the first entry decides
    sorted_ = by_doc.select("d", "h", F.sort_array("all").alias("all"))
    first = F.filter("all", lambda x, i: (i == 0) | (F.get("all", i - 1)["pos"] != x["pos"]))
    return sorted_.select("d", "h", F.transform(first, lambda x: x["keep"]).alias("keep"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the recurring lines taken out of text, and n_lines and n_dropped (long) beside its columns (in place of columns so named).

    A null text stays null, with 0 lines; an empty text is one empty line; rows without doc_id stay as they are and count
    nowhere; repeated rows are one document and lose the same lines; very long texts are parsed whole; an empty table gives no rows."""
    d, h, keep = fresh(docs, "__d", "__h", "__keep")
    f = flags(docs).toDF(d, h, keep)
    own = docs.join(f, (docs["doc_id"] == F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h)), "left")
    parts, known = lines(F.col("text")), F.col(keep).isNotNull()
    kept = F.filter(parts, lambda _, i: F.get(F.col(keep), i))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    gone = F.when(known, F.size(F.filter(F.col(keep), lambda k: ~k))).otherwise(0).cast("long")
    text = F.when(known, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return own.withColumns({"n_lines": n, "n_dropped": gone, "text": text}).drop(d, h, keep)


ORACLE = r"""
WITH base AS (SELECT doc_id, text FROM documents),
lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM base),
parsed AS (
  SELECT doc_id, text, line, pos, regexp_extract_all(regexp_replace(line, '[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[^\x20\x09-\x0D]+') AS tokens FROM lines),
leaves AS (
  SELECT doc_id, text, line, pos, CASE WHEN len(tokens) >= 3 THEN (len(tokens), tokens[1:CAST(ceil(len(tokens) * CAST(0.7 AS DOUBLE)) AS BIGINT)])::VARCHAR END AS leaf FROM parsed
  UNION ALL SELECT doc_id, text, line, pos, (len(tokens), 'close', tokens[len(tokens) - CAST(ceil(len(tokens) * CAST(0.7 AS DOUBLE)) AS BIGINT) + 1 : len(tokens)])::VARCHAR FROM parsed WHERE len(tokens) >= 6),
recurring AS (SELECT leaf, min(doc_id) AS first_doc FROM leaves WHERE leaf IS NOT NULL GROUP BY leaf HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.doc_id, any_value(l.line) AS line, l.pos, bool_or(r.leaf IS NOT NULL AND r.first_doc <> l.doc_id) AS gone FROM leaves l LEFT JOIN recurring r ON l.leaf = r.leaf GROUP BY l.doc_id, l.pos),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept_text FROM marked GROUP BY doc_id)
SELECT b.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped,
  CASE WHEN b.text IS NOT NULL THEN CAST(length(k.kept_text) AS BIGINT) END AS kept_chars, CASE WHEN b.text IS NOT NULL THEN md5(k.kept_text) END AS kept_md5
FROM base b LEFT JOIN kept k ON b.doc_id = k.doc_id
"""
