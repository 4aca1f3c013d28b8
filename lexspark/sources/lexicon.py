"""Lexicon XML (LexicalEntry elements) -> sense graph tables, through the built-in XML source (a task per file; a file has one root element)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators.graph import SenseGraph

_FEAT = "array<struct<_att:string,_val:string>>"
_SCHEMA = f"Lemma struct<FormRepresentation:array<struct<feat:{_FEAT}>>>, Sense array<struct<_id:string,SenseRelation:array<struct<_targets:string,feat:{_FEAT}>>>>"


def _feat(feats: Column, att: str) -> Column:
    return F.get(F.filter(feats, lambda f: f["_att"] == att), F.lit(0))["_val"]


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """entry_no (rises in file order), forms (distinct, in order), pos, lemgram, senses."""
    df = spark.read.format("xml").option("rowTag", "LexicalEntry").schema(_SCHEMA).load(path)
    reps = F.coalesce(F.col("Lemma.FormRepresentation"), F.array().cast(f"array<struct<feat:{_FEAT}>>"))
    first = lambda att: F.get(F.filter(F.transform(reps, lambda r: _feat(r["feat"], att)), lambda v: v.isNotNull()), F.lit(0))
    return df.select(F.monotonically_increasing_id().alias("entry_no"), F.array_distinct(F.filter(F.transform(reps, lambda r: _feat(r["feat"], "writtenForm")), lambda v: v.isNotNull())).alias("forms"), first("partOfSpeech").alias("pos"), first("lemgram").alias("lemgram"), F.col("Sense").alias("senses"))


def read_lexicon(spark: SparkSession, path: str) -> SenseGraph:
    """The graph of a lexicon file: sense (sense, written_form, pos, lemgram), edge, form_sense."""
    e = read_entries(spark, path).select("entry_no", "forms", "pos", "lemgram", F.posexplode("senses").alias("sense_no", "s")).filter("s._id IS NOT NULL")
    sense = e.select(F.col("s._id").alias("sense"), F.get("forms", F.lit(0)).alias("written_form"), "pos", "lemgram")
    order = F.struct("entry_no", "sense_no")
    forms = e.select(F.explode("forms").alias("form"), F.col("s._id").alias("sense"), order.alias("ord"))
    rel = e.select(F.col("s._id").alias("src"), "entry_no", "sense_no", F.posexplode("s.SenseRelation").alias("rel_no", "r"))
    edge = rel.select("src", F.col("r._targets").alias("dst"), _feat(F.col("r.feat"), "label").alias("label"), F.struct("entry_no", "sense_no", "rel_no").alias("ord")).filter("dst IS NOT NULL")
    return SenseGraph(edge, forms, sense)


def save_graph(graph: SenseGraph, path: str, mode: str = "overwrite") -> None:
    """The graph as parquet tables."""
    for name in ("edge", "form_sense", "sense"):
        t = getattr(graph, name)
        if t is not None:
            t.write.mode(mode).parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> SenseGraph:
    return SenseGraph(*(spark.read.parquet(f"{path}/{n}") for n in ("edge", "form_sense", "sense")))
