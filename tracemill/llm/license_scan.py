"""Licence scans: TF-IDF cosine to templates, then inheritance down directories.

1. Segments: each line of a text that holds a licence cue, each block of lines
   that does, and each run of neighbouring blocks that do, as the notice at the
   head of a file or a licence text of several paragraphs.  Between blocks are
   lines of nothing but space and comment marks.  Whole texts are searched.
   Equal segments are compared once, however many documents hold them.
2. TF-IDF: a term weighs its count in the segment times ln((1 + N) / (1 + df)) + 1,
   with df the documents of the whole corpus that hold it, counted for every
   term of the segments and the templates: a term that a constant share of the
   documents holds weighs the same, however many documents there are.
3. A segment has the licence of the template (licences.py) with the greatest
   cosine, MIN_COSINE at least; ties go to the template that is named first.  A
   document has that of its longest segment with one - more words say more -
   and then the greatest cosine.  An SPDX-License-Identifier names the licence
   itself and goes before; its cosine is 1, and "-only", "-or-later" and "+" are
   left out of its name.
4. Licence files - by name (LICENSE, COPYING, ...), or because at least
   FILE_SHARE of their words are the matching segment - give their licence to
   their directory; of several, the greatest cosine and then the least doc_id
   decides.
5. A document without a licence of its own inherits from the nearest directory
   above it that has one.  That is worked out for each distinct directory, by a
   join of its ancestors with the licensed directories, and joined to the
   documents by directory.

Only built-in functions are used.  Documents are read for step 2 and for the
segments; their texts are never shuffled, only counts of terms are.

Defined cases: a null or empty text has no segment and may still inherit; a
null path has no directory and inherits nothing; null doc_ids are kept, ids may
be of any type; very long texts are searched whole; rows that repeat are each reported; an empty
table gives no rows; further columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.cluster import prepare, settle
from tracemill.llm.columns import identified
from tracemill.llm.licences import TEMPLATES

MIN_COSINE, FILE_SHARE = 0.7, 0.3
CUE = r"(?i)licen[cs]|copyright|rights reserved|public domain|permission (?:is|to)|redistribution|creative commons|warrant|unencumbered"
#: Between blocks.
GAP = r"\n[ \t\r\n/*#;%!|=~-]*\n"
SPDX = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9][A-Za-z0-9.+-]*(?:[ \t]+(?:OR|AND|WITH)[ \t]+[A-Za-z0-9.+-]+)*)"
SUFFIX = r"-only|-or-later|\+"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|copyright)([.-][a-z0-9.-]*)?$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def segments(text: Column) -> Column:
    """The lines, blocks and runs of blocks of text that hold a cue."""
    cued = lambda x: x.rlike(CUE)
    blocks = F.split(text, GAP)
    runs = F.split(F.array_join(F.transform(blocks, lambda b: F.when(cued(b), b).otherwise("\x01")), "\n\n"), "\x01")
    return F.array_distinct(F.filter(F.concat(F.split(text, "\n"), blocks, F.transform(runs, lambda r: F.btrim(r, F.lit("\n")))), cued))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template int, licence string, wording string").select("template", "licence", terms(F.col("wording")).alias("terms"))


def _counted(bags: DataFrame, key: str) -> DataFrame:
    """(key, term, tf)."""
    return bags.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _weighed(counted: DataFrame, key: str, idf: DataFrame, unseen: Column) -> DataFrame:
    """(key, term, weight) with weights of unit length for each key."""
    w = counted.join(idf, "term", "left").select(key, "term", (F.col("tf") * F.coalesce("idf", unseen)).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def scan(files: DataFrame) -> DataFrame:
    """doc_id, path, own licence and cosine, is_file, inherited licence and its directory, and the licence that holds."""
    spark = prepare(files.sparkSession)
    templates = _templates(spark)
    # A cue has no line break: a text without one has no segment, and isn't cut up.
    cued = F.col("text").rlike(CUE)
    cues = files.select(
        identified(files, "doc_id")[0].alias("doc_id"), "path",
        F.when(cued, segments(F.col("text"))).alias("segments"),
        F.when(cued, F.regexp_replace(F.nullif(F.regexp_extract("text", SPDX, 1), F.lit("")), SUFFIX, "")).alias("tag"),
        F.when(cued, F.size(terms(F.col("text")))).alias("n_terms"),
    )
    # (doc_id, path, segments): the texts are left behind here.
    cues = settle(cues.withColumn("row", F.monotonically_increasing_id()))
    # A segment goes by its digest: its words would else be carried with each of its terms.
    said = cues.select("row", F.explode("segments").alias("said")).withColumn("segment", F.md5("said"))
    found = said.select("row", "segment", F.size(terms(F.col("said"))).alias("size"))
    distinct = said.groupBy("segment").agg(F.any_value("said").alias("said")).select("segment", terms(F.col("said")).alias("terms"))
    counted, wording = _counted(distinct, "segment"), _counted(templates, "template")
    # Terms are counted in each task before they are sent; how many there are depends on the segments, so nothing is broadcast by force.
    held = files.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = F.lit(float(1 + files.count()))
    wanted = counted.select("term").union(wording.select("term")).distinct()
    idf = settle(held.join(wanted, "term", "left_semi").select("term", (F.log(n / (F.col("df") + 1)) + 1).alias("idf")))
    unseen = F.log(n) + 1
    left = _weighed(counted, "segment", idf, unseen)
    right = _weighed(wording, "template", idf, unseen).select("template", "term", F.col("w").alias("v"))
    cosine = left.join(F.broadcast(right), "term").groupBy("segment", "template").agg(F.round(F.sum(F.col("w") * F.col("v")), 6).alias("cosine")).filter(F.col("cosine") >= MIN_COSINE)
    named = cosine.join(F.broadcast(templates.select("template", "licence")), "template")
    # A document's best segment is its longest one with a template.
    best = found.join(named.groupBy("segment").agg(F.max(F.struct("cosine", (-F.col("template")).alias("last"), "licence")).alias("b")), "segment")
    own = best.groupBy("row").agg(F.max(F.struct("size", F.col("b.cosine").alias("cosine"), F.col("b.last").alias("last"), F.col("b.licence").alias("licence"))).alias("b"))
    licence = F.coalesce("tag", "b.licence")
    docs = cues.join(own, "row", "left").select(
        "doc_id", "path", licence.alias("own_licence"), F.when(F.col("tag").isNotNull(), 1.0).otherwise(F.col("b.cosine")).alias("cosine"),
        (licence.isNotNull() & (F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)) | F.coalesce(F.col("b.size") >= FILE_SHARE * F.col("n_terms"), F.lit(False)))).alias("is_file"),
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"),
    )
    docs = settle(docs)
    licensed = docs.filter("is_file AND path IS NOT NULL").groupBy("directory").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("doc_id").isNull().alias("none"), "doc_id", "own_licence")).alias("b")).select(F.col("directory").alias("from_directory"), F.col("b.own_licence").alias("inherited"))
    depth = F.size(F.split("directory", "/"))
    up = docs.filter("path IS NOT NULL").select("directory").distinct().select(
        "directory", F.explode(F.transform(F.sequence(F.lit(0), depth), lambda k: F.array_join(F.slice(F.split("directory", "/"), F.lit(1), k), "/"))).alias("from_directory")).distinct()
    nearest = up.join(licensed, "from_directory").groupBy("directory").agg(F.max(F.struct(F.length("from_directory").alias("n"), "from_directory", "inherited")).alias("b")).select("directory", "b.from_directory", "b.inherited")
    joined = docs.join(nearest, "directory", "left")
    lacks = F.col("own_licence").isNull()
    return joined.select(
        "doc_id", "path", "own_licence", "cosine", "is_file",
        F.when(lacks, F.col("inherited")).alias("inherited_licence"), F.when(lacks, F.col("from_directory")).alias("inherited_from"),
        F.coalesce("own_licence", "inherited").alias("licence"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no paths: a document lies at source/lang/doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text"))


def sql() -> str:
    """The scan of documents in DuckDB's SQL."""
    rows = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
    cued = lambda x: f"regexp_matches({x}, '{CUE}')"
    return rf"""
WITH files AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, text, nullif(regexp_extract(text, '{SPDX}', 1), '') AS tag FROM documents),
templates AS (SELECT template, licence, regexp_extract_all(lower(wording), '{TERM}') AS terms FROM (VALUES {rows}) v(template, licence, wording)),
held AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{TERM}'))) AS term FROM files),
total AS (SELECT count(*)::DOUBLE AS n FROM files),
idf AS (SELECT term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM held CROSS JOIN total GROUP BY term),
blocks AS (SELECT doc_id, unnest(regexp_split_to_array(text, '{GAP}')) AS block, generate_subscripts(regexp_split_to_array(text, '{GAP}'), 1) AS k FROM files),
islands AS (SELECT doc_id, block, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS island FROM blocks WHERE {cued("block")}),
found AS (SELECT DISTINCT doc_id, segment FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS segment FROM files UNION ALL SELECT doc_id, block FROM islands
  UNION ALL SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY k) FROM islands GROUP BY doc_id, island) WHERE {cued("segment")}),
segments AS (SELECT DISTINCT segment, regexp_extract_all(lower(segment), '{TERM}') AS terms FROM found),
bags AS (SELECT 's' || segment AS bag, unnest(terms) AS term FROM segments UNION ALL SELECT 't' || template, unnest(terms) FROM templates),
weights AS (SELECT bag, term, count(*) * coalesce(any_value(idf), ln(1 + any_value(n)) + 1) AS w FROM bags LEFT JOIN idf USING (term) CROSS JOIN total GROUP BY bag, term),
norms AS (SELECT bag, sqrt(sum(w * w)) AS norm FROM weights GROUP BY bag),
units AS (SELECT bag, term, w / norm AS w FROM weights JOIN norms USING (bag)),
cosines AS (SELECT substr(a.bag, 2) AS segment, substr(b.bag, 2)::INT AS template, round(sum(a.w * b.w), 6) AS cosine FROM units a JOIN units b USING (term) WHERE a.bag[1] = 's' AND b.bag[1] = 't' GROUP BY ALL HAVING round(sum(a.w * b.w), 6) >= {MIN_COSINE}),
best AS (SELECT doc_id, licence, cosine, len(s.terms) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY len(s.terms) DESC, cosine DESC, template) AS k FROM found JOIN segments s USING (segment) JOIN cosines USING (segment) JOIN templates USING (template)),
docs AS (SELECT f.doc_id, path, coalesce(regexp_replace(tag, '{SUFFIX}', '', 'g'), licence) AS own_licence, CASE WHEN tag IS NULL THEN cosine ELSE 1.0 END AS cosine,
  coalesce(size >= {FILE_SHARE} * len(regexp_extract_all(lower(text), '{TERM}')), false) OR (coalesce(tag, licence) IS NOT NULL AND coalesce(regexp_matches(path, '{FILE_NAME}'), false)) AS is_file, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM files f LEFT JOIN best b ON b.doc_id = f.doc_id AND k = 1),
licensed AS (SELECT directory AS from_directory, arg_max(own_licence, (cosine, -doc_id)) AS inherited FROM docs WHERE is_file GROUP BY directory),
nearest AS (SELECT d.directory, arg_max(from_directory, len(from_directory)) AS from_directory, arg_max(inherited, len(from_directory)) AS inherited FROM (SELECT DISTINCT directory FROM docs) d JOIN licensed l ON d.directory = from_directory OR starts_with(d.directory, from_directory || '/') GROUP BY d.directory)
SELECT doc_id, path, own_licence, cosine, is_file, CASE WHEN own_licence IS NULL THEN inherited END AS inherited_licence, CASE WHEN own_licence IS NULL THEN from_directory END AS inherited_from, coalesce(own_licence, inherited) AS licence
FROM docs LEFT JOIN nearest USING (directory)
"""
