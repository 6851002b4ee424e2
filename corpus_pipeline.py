"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents (doc_id, text, lang, source, n_chars) and work on all the rows they get:

- language_id drops documents without a letter and those hardly like any language.
- line_dedup removes later occurrences of three-line windows; n_chars follows the text. Documents of which
  nothing but white space is left go; those that had none to lose were dropped before.
- near_dedup keeps the document with the smallest id of each group of near copies.
- decontaminate drops documents that hold a benchmark item.
- packing lays the rest out in windows of 1,024 tokens.

Null texts are dropped by the first stage; null ids stay. Empty tables give no rows.
"""

from pyspark.sql import functions as F

from sparkloom.llm import op4_packing, op5_langid, op7_line_dedup, op8_simhash, op10_decontaminate

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark, docs, sf_dir):
    return op5_langid.known_language(docs, op5_langid.train(docs)).select(*COLUMNS)


def line_dedup(spark, docs, sf_dir):
    out = op7_line_dedup.dedup_lines(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark, docs, sf_dir):
    return op8_simhash.one_of_each(docs).select(*COLUMNS)


def decontaminate(spark, docs, sf_dir):
    return op10_decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packing(spark, docs, sf_dir):
    return op4_packing.pack(docs, keep_ids=False).drop("ids")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: Language ID, spaced-seed verification and packing cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    from sparkloom.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
