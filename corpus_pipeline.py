"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; all but the
last return the columns of ``docs``.  ``run`` writes each stage's rows to the shared folder and reads them again.

Defined results: rows that repeat are kept or dropped as one document where a stage decides by id and text; text
that a stage leaves empty stays as an empty document; a null text is rejected by language ID.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from rankloom.llm import decontaminate as d
from rankloom.llm import jaccard_join as j
from rankloom.llm import language_id as lang
from rankloom.llm import line_dedup as lines
from rankloom.llm import sentencepiece as sp
from rankloom.llm.common import NULL_ID, drop_scratch, read_docs, row_id, scratch, strings, tune

ID, TEXT, LANG = "doc_id", "text", "lang"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told stay: those whose text has letters."""
    tune(spark)
    model, languages = lang.train(docs.where(~lang.held_out(ID)), id_col=ID, text_col=TEXT, lang_col=LANG)
    scored = lang.classify(docs.withColumnRenamed("lang_pred", "_lang_pred").withColumnRenamed("score", "_score"), model, languages, text_col=TEXT)
    return scored.where(F.col("lang_pred") != lang.UNKNOWN).drop("lang_pred", "score").toDF(*docs.columns)


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in many documents go; only documents that lose lines get a new text."""
    bitmaps, names = lines.keep_bitmaps(docs, id_col=ID, text_col=TEXT), docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, bitmap in zip(strings(batch.column(TEXT)), batch.column("bitmap").to_pylist(), strict=True):
                if bitmap is not None:
                    parts, keep = text.split("\n"), lines.decode_bitmap(bitmap)
                    text = "\n".join([x for x, k in zip(parts, keep, strict=False) if k] + parts[len(keep) :])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == TEXT else batch.column(c) for c in names], names=names)

    keyed = docs.withColumns({"_id": row_id(ID), "_key": F.xxhash64(F.col(TEXT).cast("string"))}).join(bitmaps, ["_id", "_key"], "left")
    return keyed.select(*names, "bitmap").mapInArrow(kept, docs.schema)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; those without words all stay."""
    groups = scratch(j.jaccard_join(docs, id_col=ID, text_col=TEXT).where("n_shingles > 0").select("_id", "_key", "root"), "groups")
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("_id") == NULL_ID, "_id", "_key")).alias("kept"))
    gone = groups.join(kept, F.col("kept._id").eqNullSafe(groups["_id"]) & (F.col("kept._key") == groups["_key"]), "left_anti").select("_id", "_key").distinct()
    keyed = docs.withColumns({"_id": row_id(ID), "_key": F.xxhash64(F.col(TEXT).cast("string"))})
    return keyed.join(gone, ["_id", "_key"], "left_anti").select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside occurrences of benchmark windows go, with what stands between them.

    All blocks of a large benchmark are searched in the original text; the spans so far travel with the rows.
    """
    blocks, out = d.blocks_of(read_docs(spark, sf_dir, "benchmark"), "item_id", "text", d.BLOCK_WORDS), docs
    block = next(blocks, None)
    while block:
        after = next(blocks, None)
        out = clean_block(spark, out, d.Windows(block), docs.schema, last=not after)
        if after:
            out = scratch(out, "decontaminated")
        block = after
    return out


def clean_block(spark: SparkSession, rows: DataFrame, windows: d.Windows, kind: StructType, last: bool) -> DataFrame:
    """Rows of schema ``kind`` with the spans of this block and those before; after the ``last`` the text without them."""
    shared, names, marks = tune(spark).sparkContext.broadcast(windows), kind.names, ["__starts", "__ends"]
    longs = pa.list_(pa.int64())

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (_, spans, _) in d.judged(shared.value, batches, TEXT):
            texts = strings(batch.column(TEXT))
            if marks[0] in batch.schema.names:
                old = [list(zip(a, b, strict=True)) for a, b in zip(*(batch.column(c).to_pylist() for c in marks), strict=True)]
                spans = [d.merged(a + b) if a else b for a, b in zip(old, spans, strict=True)]
            if last:
                texts = [d.strip_spans(t, [a for a, _ in s], [b for _, b in s]) if s else t for t, s in zip(texts, spans, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == TEXT else batch.column(c) for c in names], names=names)
            else:
                found = [pa.array([[s[k] for s in x] for x in spans], longs) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], names=[*names, *marks])

    return rows.mapInArrow(clean, kind if last else StructType([*kind.fields, *(StructField(c, ArrayType(LongType())) for c in marks)]))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids: 32-bit little-endian) of every document."""
    return sp.encode(docs, id_col=ID, text_col=TEXT, decoded=False).select(sp.public_id().alias(ID), "n_pieces", "ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_frequent_lines),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_benchmark_passages),
    ("sentencepiece", encode_pieces),
]

#: A trained network and a tokenizer's lattice are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over ``documents``."""
    docs, before = read_docs(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_scratch(before)
        before = docs
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
