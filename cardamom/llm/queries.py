"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backtrack, bpe, decontaminate, divergence, htmltext, language, latemerge, mtree, neardup, privacy, substring, tokencount, toxicity
from .common import table


def byte_vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """Content of a rank file and the pre-token pattern; the installed 50k vocabulary unless a path is given."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    whole = vectors.select("vec_id", mtree.whole_vectors(vectors, "embedding").alias("v"))
    return mtree.top_k(whole, F.pmod("vec_id", F.lit(20)) == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, ~language.held_out())
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), *byte_vocabulary())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.find_components(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of every text: a tenth is cut out, its first words are put in the middle, its end is replaced."""
    n = F.length(F.coalesce("text", F.lit("")))

    def edit(start, end, text):
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"))

    edits = F.array(
        edit(F.floor(n / 4), F.floor(n / 4) + F.floor(n / 10), F.lit("")),
        edit(F.floor(n / 2), F.floor(n / 2), F.coalesce(F.substring("text", 1, 40), F.lit(""))),
        edit(n - F.floor(n / 10) + 20, F.lit(2**31 - 1), F.concat(F.lit(" "), F.coalesce("source", F.lit("")))),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    return tokencount.count_edited(docs, *byte_vocabulary())


def _count_kind(kind: str):
    return F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.extract(table(spark, sf_dir, "documents"))
    counts = [_count_kind(k) for k in privacy.KINDS]
    return found.select("doc_id", *counts, F.sha2(privacy.rendered("base"), 256).alias("base_sha256"), privacy.rendered("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = toxicity.fit(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    found = toxicity.score(docs, chain)
    return found.select("doc_id", "p_low_quality", F.col("is_low_quality").alias("low_quality"), "p_toxic", F.col("is_toxic").alias("toxic"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def json_vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """Content of a JSON vocabulary and the pre-token pattern; the installed 50k vocabulary unless a path is given."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op12_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = backtrack.encode_documents(table(spark, sf_dir, "documents"), *json_vocabulary())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: When a sale counts as late, and how many files all sales fill, about.
LATE_FROM, SALE_FILES = "2024-03-20 00:00:00", 1100


def corrected_sales(sales: DataFrame) -> DataFrame:
    """Sales, and for a third of the ids of every fourth day a later row with another total."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    again = (h % 3 == 0) & (latemerge.utc_day(sales, "sold_at") % 4 == 0)
    copy = F.explode(F.when(again, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("__copy")
    rows = sales.select("*", copy)

    def later(c: str, days) -> Column:
        return F.col(c) + F.make_dt_interval(days.cast("int"))

    new = {"total": F.col("total") + 1, "sold_at": later("sold_at", h % 2), "arrived_at": later("arrived_at", 1 + h % 97)}
    return rows.select(*[F.when(F.col("__copy"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in sales.columns])


def op13_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = table(spark, sf_dir, "sales")
    layout = latemerge.Layout(latemerge.new_folder(spark, "late-overwrite"), sales.columns, "sale_id", "arrived_at", "sold_at", 1 + sales.count() // SALE_FILES)
    rows = corrected_sales(sales)
    early = F.coalesce(latemerge.utc_micros(rows, "arrived_at") < F.unix_micros(F.lit(LATE_FROM + "+00:00").cast("timestamp")), F.lit(False))
    latemerge.create(rows.where(early), layout)
    dirty = latemerge.overwrite(rows.where(~early), layout)
    found = latemerge.files(spark, layout)
    columns = found.columns[4:]
    times = [F.coalesce(latemerge.utc_micros(found, c).cast("string"), F.lit("")) for c in ("sold_at", "arrived_at")]
    crc = F.crc32(F.concat_ws(":", F.coalesce(F.col("sale_id").cast("string"), F.lit("")), *times).cast("binary"))
    rows = latemerge.digest(found, F.col("sale_id"), F.floor(100 * F.col("total") + 0.5).cast("long"), crc)
    return rows.withColumn("columns", F.lit(",".join(columns))).join(dirty.withColumn("rewritten", F.lit(True)), "day", "left").withColumn("rewritten", F.coalesce("rewritten", F.lit(False)))


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_language_id": op2_language_id,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_token_counts": op7_token_counts,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_html_text": op10_html_text,
    "op11_source_divergence": op11_source_divergence,
    "op12_backtracking_bpe": op12_backtracking_bpe,
    "op13_late_overwrite": op13_late_overwrite,
}
