"""Merges, incremental stores and sinks' plans (M1-M11, K1-K8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge, validation
from ..session import shared_path
from ..sources import sinks
from ..sources.keyindex import KeyedTable
from .registry import load, query


def _old(spark, d):
    return load(spark, d, "labels").where("doc_id % 3 <> 0").select("doc_id", "quality", "toxic", F.lit(0).cast("long").alias("seq"))


def _new(spark, d):
    return load(spark, d, "labels").where("doc_id % 2 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), "toxic", (F.col("doc_id") % 7 + 1).alias("seq"))


STORES = "old AS (SELECT doc_id, quality, toxic, 0::BIGINT AS seq FROM labels WHERE doc_id % 3 <> 0), new AS (SELECT doc_id, 1 - quality AS quality, toxic, doc_id % 7 + 1 AS seq FROM labels WHERE doc_id % 2 = 0)"


@query(f"WITH {STORES} SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (doc_id)")
def m1_upsert(spark, d):
    return merge.upsert(_old(spark, d), _new(spark, d), "doc_id", "seq")


@query(f"WITH {STORES} SELECT old.doc_id, coalesce(new.quality, old.quality) AS quality, old.toxic, old.seq FROM old LEFT JOIN new USING (doc_id)")
def m2_column_merge(spark, d):
    return merge.merge_columns(_old(spark, d), _new(spark, d), "doc_id", ["quality"])


BATCH = "batch AS (SELECT doc_id % 400 AS id, doc_id AS seq FROM documents)"


@query(f"WITH {BATCH}, {STORES} SELECT id, batch.seq, CASE WHEN o.doc_id IS NOT NULL OR row_number() OVER (PARTITION BY id ORDER BY batch.seq) > 1 THEN 'error' ELSE 'ok' END AS status FROM batch LEFT JOIN old o ON o.doc_id = id")
def m3_append_status(spark, d):
    batch = load(spark, d, "documents").select((F.col("doc_id") % 400).alias("id"), F.col("doc_id").alias("seq"))
    return merge.append_status(batch, _old(spark, d).select(F.col("doc_id").alias("id")), "id", "seq")


@query("SELECT 'good' AS batch, count(*) AS written FROM labels WHERE toxic = 0 UNION ALL SELECT 'bad', 0")
def m4_all_or_nothing(spark, d):
    labels = load(spark, d, "labels")

    def written(name, rows, bad):
        marked = rows.withColumn("status", F.when(bad, F.lit("error")).otherwise(F.lit("ok")))
        return merge.committed(marked).agg(F.lit(name).alias("batch"), F.count("*").alias("written"))

    return written("good", labels.where("toxic = 0"), F.lit(False)).unionByName(written("bad", labels, F.col("toxic") == 1))


@query("SELECT CASE WHEN quality IS NULL THEN 'skip' WHEN toxic = 1 AND quality = 1 THEN 'error' ELSE 'ok' END AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def m5_skip_rule(spark, d):
    docs, labels = load(spark, d, "documents", "labels")
    status = F.when(F.col("quality").isNull(), F.lit("skip")).when((F.col("toxic") == 1) & (F.col("quality") == 1), F.lit("error")).otherwise(F.lit("ok"))
    return docs.join(labels, "doc_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'synth_' || doc_id AS card_id, lang FROM documents")
def m6_id_normalise(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.struct(F.lit("x").alias("id"), "lang").alias("card"))
    fixed = docs.withColumn("card", F.col("card").withField("id", F.concat(F.lit("synth_"), F.col("doc_id").cast("string"))))
    return fixed.select("doc_id", F.col("card.id").alias("card_id"), "card.lang")


@query("WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, array_to_string([x FOR x, i IN w IF list_position(w, x) = i], ' ') AS words FROM w")
def m7_ordered_distinct(spark, d):
    return load(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@query("SELECT l_partkey, l_quantity AS width, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_quantity >= 20 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber) = 1")
def m8_keep_best(spark, d):
    rows = load(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").alias("width"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return merge.keep_best(rows, "l_partkey", "width", "seq", 20)


@query("WITH RECURSIVE r AS (SELECT DISTINCT source AS rule_id FROM documents) SELECT rule_id, list_extract(['critical', 'high', 'medium', 'low'], CAST(substr(rule_id, 4) AS INT) % 4 + 1) AS severity, regexp_matches(rule_id, '^src\\d{1,2}$') AS valid FROM r ORDER BY rule_id")
def m9_rule_table(spark, d):
    from .base import rules

    return rules(spark, d).select("rule_id", "severity", F.rlike("rule_id", F.lit(r"^src\d{1,2}$")).alias("valid"))


@query("SELECT 'case_' || doc_id AS case_id, 'text' AS kind, source, CASE WHEN doc_id % 2 = 1 THEN 'gen-v1' END AS generator, lang, quality = 1 AS expected_clean, CASE WHEN doc_id % 3 = 0 THEN toxic = 0 END AS expected_image_clean, '' AS notes FROM documents JOIN labels USING (doc_id)")
def m10_case_build(spark, d):
    docs, labels = load(spark, d, "documents", "labels")
    return docs.join(labels, "doc_id").select(
        F.concat(F.lit("case_"), F.col("doc_id").cast("string")).alias("case_id"), F.lit("text").alias("kind"), "source", F.when(F.col("doc_id") % 2 == 1, F.lit("gen-v1")).alias("generator"), "lang",
        (F.col("quality") == 1).alias("expected_clean"), F.when(F.col("doc_id") % 3 == 0, F.col("toxic") == 0).alias("expected_image_clean"), F.lit("").alias("notes"),
    )


@query("WITH a AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 3 <> 1), b AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 3 <> 2) SELECT source, lang, CASE WHEN y IS NULL THEN 'cons' WHEN x IS NULL THEN 'aggr' ELSE 'both' END AS found_by FROM (SELECT *, 1 AS x FROM a) FULL JOIN (SELECT *, 1 AS y FROM b) USING (source, lang)")
def m11_two_passes(spark, d):
    # of three documents the first pass has two and the second two, so that every document is in one
    docs = load(spark, d, "documents").withColumn("turn", F.col("doc_id") % 3)
    return merge.two_passes(docs.where("turn <> 1"), docs.where("turn <> 2"), ["source", "lang"])


@query(f"WITH {STORES} SELECT doc_id, toxic FROM new ANTI JOIN old USING (doc_id)")
def k1_new_rows(spark, d):
    return merge.new_rows(_new(spark, d).select("doc_id", "toxic"), _old(spark, d), "doc_id")


@query(f"""WITH {STORES} SELECT doc_id, CASE WHEN o.toxic IS NULL THEN 'I' WHEN n.toxic IS NULL THEN 'D' WHEN o.quality <> n.quality THEN 'M' WHEN o.toxic <> n.toxic THEN 'U' ELSE 'none' END AS change
FROM (SELECT * FROM old) o FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN quality ELSE 1 - quality END AS quality, CASE WHEN doc_id % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic FROM new) n USING (doc_id)""")
def k4_change_flags(spark, d):
    new = _new(spark, d).withColumn("quality", F.when(F.col("doc_id") % 4 == 0, F.col("quality")).otherwise(1 - F.col("quality"))).withColumn("toxic", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    return merge.change_flags(_old(spark, d), new, "doc_id", ["toxic"], "quality")


@query("SELECT '# ' || source || ': ' || count(*) AS line FROM documents GROUP BY source UNION ALL SELECT url FROM pages")
def k6_url_list(spark, d):
    docs, pages = load(spark, d, "documents", "pages")
    head = docs.groupBy("source").agg(F.count("*").alias("n")).select(F.concat(F.lit("# "), F.col("source"), F.lit(": "), F.col("n").cast("string")).alias("line"))
    return head.unionAll(pages.select("url"))


@query("SELECT doc_id, 1 - quality AS quality, toxic FROM labels WHERE doc_id % 2 = 0")
def k2_replace(spark, d):
    path = shared_path(spark, "k2")
    sinks.replace(_old(spark, d).drop("seq"), path, "parquet")
    sinks.replace(_new(spark, d).drop("seq"), path, "parquet")
    return sinks.current(spark, path)


@query("SELECT doc_id, length(text) < 60 AS rejected, CASE WHEN length(text) < 60 THEN 'text' END AS errors FROM documents")
def k3_split_sink(spark, d):
    path = shared_path(spark, "k3")
    passed, rejected = validation.split(load(spark, d, "documents").select("doc_id", "text"), {"text": F.length("text") >= 60})
    n = sinks.write_split(passed, rejected, path)
    out = sinks.current(spark, path).select("doc_id", F.lit(False).alias("rejected"), F.lit(None).cast("string").alias("errors"))
    if not n:  # nothing was rejected, so no such table was written
        return out
    return out.unionByName(sinks.current(spark, path, "rejected").select("doc_id", F.lit(True).alias("rejected"), F.array_join("_validation_errors", ",").alias("errors")))


@query("SELECT doc_id, min(batch) AS batch FROM (SELECT doc_id, 0 AS batch FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 2 FROM labels) GROUP BY doc_id")
def k1_append_indexed(spark, d):
    """Three batches of overlapping keys appended to a table with a key index: the first that has a key brings its row."""
    docs, labels = load(spark, d, "documents", "labels")
    table = KeyedTable(spark, shared_path(spark, "k1"), "doc_id bigint, batch int", "doc_id")
    for batch, rows in enumerate([docs.where("doc_id % 3 > 0"), docs.where("doc_id % 2 = 0"), labels]):
        table.append(rows.select("doc_id", F.lit(batch).alias("batch")))
    return table.read()


@query("SELECT lpad(source, 8, ' ') || ' | ' || lpad(CAST(count(*) AS VARCHAR), 6, ' ') || ' | ' || rpad(CAST(sum(n_chars) AS VARCHAR), 10, ' ') AS line FROM documents GROUP BY source")
def k5_report_lines(spark, d):
    n = load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return n.select(F.concat_ws(" | ", F.lpad("source", 8, " "), F.lpad(F.col("n").cast("string"), 6, " "), F.rpad(F.col("chars").cast("string"), 10, " ")).alias("line"))


@query("SELECT case_id FROM (SELECT source || '_' || doc_id AS case_id FROM documents) WHERE starts_with(case_id, 'src1_')")
def k7_delete_plan(spark, d):
    ids = load(spark, d, "documents").select(F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("case_id"))
    return merge.delete_plan(ids, "case_id", "src1")


@query("SELECT doc_id, quality, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE toxic END AS toxic, doc_id % 3 = 0 AS touched FROM labels")
def k8_strip_fields(spark, d):
    return merge.strip(load(spark, d, "labels").select("doc_id", "quality", "toxic"), F.col("doc_id") % 3 == 0, ["toxic"])
