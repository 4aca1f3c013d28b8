"""Command line: python -m lexspark COMMAND ... (bnt, svf, fas, regression, calibrate, models, probe, lexicon, sample,
eligibility, analyze, drift, wide)."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import text
from lexspark.operators import agreement, drift, eav, embedding, frequency, graph, regression
from lexspark.plans import pipelines
from lexspark.session import build_session
from lexspark.sources import lexicon, sheets, tables


def _model_options(c: argparse.ArgumentParser) -> None:
    c.add_argument("--model", help="name or folder of an embedding model; the stand-in is used without one")
    c.add_argument("--kind", choices=("pooled", "sentence"), default="sentence")
    c.add_argument("--pooling", choices=("cls", "mean"), default="cls")
    c.add_argument("--mock", action="store_true", help="use the stand-in whatever --model says")


def _vectors(a: argparse.Namespace) -> pipelines.WordVectors:
    if a.mock or not a.model:
        return pipelines.mock_vectors
    return pipelines.model_vectors(embedding.factory({"kind": a.kind, "name": a.model, "pooling": a.pooling}))


def _entries(path: str, only: str | None, skip: str | None) -> list[dict]:
    """The models of a JSON file (a list of entries with a label), those named in `only` without those in `skip`."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    wanted, unwanted = (set(x.split(",")) if x else set() for x in (only, skip))
    return [e for e in found if (not wanted or e["label"] in wanted) and e["label"] not in unwanted]


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexspark")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("bnt", "svf", "fas"):
        c = sub.add_parser(name, help=f"score a {name} sheet (.xlsx or .csv)")
        c.add_argument("--data", required=True)
        c.add_argument("--sheet", default="0")
        c.add_argument("--output", required=True)
        c.add_argument("--frequencies")
        if name == "svf":
            c.add_argument("--threshold", type=float, default=0.45)
        if name != "fas":
            _model_options(c)
    c = sub.add_parser("regression", help="features of a scored table against mmse")
    c.add_argument("--input", required=True)
    c.add_argument("--kind", choices=("svf", "fas"), default="svf")
    c.add_argument("--output-dir", required=True)
    c.add_argument("--random-seed", type=int, default=0)
    c.add_argument("--dry-run", action="store_true", help="check the table and show the correlations, write nothing")
    c = sub.add_parser("calibrate", help="sweep the cluster threshold over an svf sheet")
    c.add_argument("--data", required=True)
    c.add_argument("--output", required=True)
    _model_options(c)
    for o, v in (("--min-threshold", 0.3), ("--max-threshold", 0.7), ("--step", 0.025)):
        c.add_argument(o, type=float, default=v)
    c = sub.add_parser("models", help="score a sheet with every model of a configuration")
    for o in ("--config", "--data", "--output-dir"):
        c.add_argument(o, required=True)
    c.add_argument("--tests", choices=("bnt", "svf"), default="bnt")
    for o in ("--models", "--skip"):
        c.add_argument(o, help="labels, separated by commas")
    for o in ("--dry-run", "--skip-existing"):
        c.add_argument(o, action="store_true")
    c = sub.add_parser("probe", help="health of every model of a configuration on probe words")
    c.add_argument("--config", required=True)
    c.add_argument("--words", required=True, help="CSV with word and label")
    for o in ("--models", "--skip"):
        c.add_argument(o, help="labels, separated by commas")
    c = sub.add_parser("lexicon", help="lexicon XML to graph tables")
    c.add_argument("--input", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--rebuild", action="store_true", help="read the XML even if the tables are there")
    c.add_argument("--senses", type=int, help="how many senses there must be")
    c = sub.add_parser("sample", help="blinded rater sheets from a scored bnt table")
    c.add_argument("--input", required=True)
    c.add_argument("--output-dir", required=True)
    c.add_argument("--target-size", type=int, default=200)
    c.add_argument("--raters", type=int, default=2)
    c.add_argument("--model", default="model")
    c = sub.add_parser("eligibility", help="funnel, quartile edges and counts by quartile and diagnosis of a scored bnt table")
    c.add_argument("--input", required=True)
    c.add_argument("--output-dir")
    c = sub.add_parser("analyze", help="reliability, agreement with models and divergence from rating files")
    for o in ("--ratings", "--sampled-pairs", "--models", "--output-dir"):
        c.add_argument(o, required=True)
    c.add_argument("--branch", choices=("multi", "sole_test_retest"), default="multi")
    c.add_argument("--lexicon", help="graph tables for relations between words")
    c = sub.add_parser("drift", help="one consistent table and the list of changes from records of drifting files")
    c.add_argument("--input", required=True)
    c.add_argument("--output-dir", required=True)
    c = sub.add_parser("wide", help="attribute-value entries to one row per entity")
    c.add_argument("--input", required=True)
    c.add_argument("--output", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    """0 if all went well; 1 if a lexicon is not as expected, 2 if no feature is left, 3 if too few rows are."""
    a = _parser().parse_args(argv)
    spark = build_session()
    try:
        return _run(spark, a)
    finally:
        spark.stop()


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    freq = frequency.frequency_table(tables.read_csv(spark, a.frequencies, tables.FREQUENCIES)) if getattr(a, "frequencies", None) else None
    if a.command == "bnt":
        tables.save_csv(pipelines.bnt(spark, a.data, _vectors(a), a.sheet), a.output, ("participant_id", "gender", "age", "diagnosis", "mmse"))
    elif a.command == "svf":
        tables.save_csv(pipelines.sheet_svf(spark, a.data, a.sheet, frequencies=freq, threshold=a.threshold, vectors_of=_vectors(a)), a.output, columns=tables.SVF_COLUMNS)
    elif a.command == "fas":
        tables.save_csv(pipelines.sheet_fas(spark, a.data, a.sheet, frequencies=freq), a.output, columns=tables.FAS_COLUMNS)
    elif a.command == "regression":
        names = ("total_words", "mean_cluster_size", "switch_count", "mean_consecutive_similarity", "mean_word_frequency") if a.kind == "svf" else ("total_fas_score", "mean_cluster_size", "switch_count_total", "mean_word_frequency")
        scored = spark.read.option("header", True).option("inferSchema", True).csv(a.input)
        if a.dry_run:
            print(tables.to_markdown(regression.correlation_table(agreement.check_missing_share(scored, ["mmse"]), names)))
        try:
            results = {} if a.dry_run else pipelines.mmse_regression(scored, names, a.random_seed)
        except pipelines.NoFeature as x:
            print(x)
            return 2
        except ValueError as x:
            print(x)
            return 3
        for name, df in results.items():
            tables.save_csv(df, f"{a.output_dir}/{name}")
    elif a.command == "calibrate":
        words, meta = sheets.load_svf(sheets.read_sheet(spark, a.data))
        sweep, best = pipelines.calibrate_threshold(words, meta, _vectors(a), low=a.min_threshold, high=a.max_threshold, step=a.step)
        tables.save_csv(sweep, a.output)
        print(tables.to_markdown(best))
    elif a.command == "models":
        entries = _entries(a.config, a.models, a.skip)
        run = (lambda v: pipelines.bnt(spark, a.data, v)) if a.tests == "bnt" else (lambda v: pipelines.sheet_svf(spark, a.data, vectors_of=v))
        said = {e["label"]: "to do" for e in entries} if a.dry_run else pipelines.model_sweep(entries, run, a.output_dir, a.skip_existing)
        print("\n".join(f"{label}: {x}" for label, x in said.items()))
    elif a.command == "probe":
        words = [(r["word"], r["label"]) for r in tables.read_csv(spark, a.words, "word string, label string").limit(1000).collect()]
        print(tables.to_markdown(pipelines.probe_models(spark, _entries(a.config, a.models, a.skip), words)))
    elif a.command == "lexicon":
        if a.rebuild or not tables.exists(f"{a.output}/edge"):
            lexicon.save_graph(lexicon.read_lexicon(spark, a.input), a.output)
        g = lexicon.load_graph(spark, a.output)
        found = graph.graph_stats(g, graph.depths(g))
        print(tables.to_markdown(found))
        wrong = graph.check_graph(found, a.senses)
        if wrong:
            print("\n".join(wrong))
            return 1
    elif a.command == "sample":
        scored = tables.read_csv(spark, a.input, tables.SCORED)
        for name, df in pipelines.rater_samples(scored, a.model, a.raters, a.target_size // 4).items():
            tables.save_csv(df, f"{a.output_dir}/{name}")
    elif a.command == "eligibility":
        scored = tables.read_csv(spark, a.input, tables.SCORED)
        report = pipelines.eligibility_report(scored)
        print(report)
        if a.output_dir:
            tables.save_text(spark, report, f"{a.output_dir}/eligibility.md")
    elif a.command == "analyze":
        rated = tables.read_ratings(spark, a.ratings, a.branch == "sole_test_retest").withColumn("is_compound", text.truthy(F.col("is_compound")))
        files = [rated.filter(F.col("rater_id") == r[0]) for r in rated.select("rater_id").distinct().orderBy("rater_id").collect()]
        sample = spark.read.option("header", True).option("inferSchema", True).csv(a.sampled_pairs)
        models = tables.read_csv(spark, a.models, tables.SCORED).withColumn("model_name", tables.rater_id(F.input_file_name()))
        known = lexicon.load_graph(spark, a.lexicon) if a.lexicon else None
        results = pipelines.rating_analysis(files, sample, models, known, a.branch == "sole_test_retest")
        for name, df in results.items():
            tables.save_csv(df, f"{a.output_dir}/{name}")
        tables.save_text(spark, pipelines.analysis_report(results), f"{a.output_dir}/report.md")
    elif a.command == "drift":
        records: DataFrame = spark.read.parquet(a.input)
        drift.consistent_table(records).write.mode("overwrite").parquet(f"{a.output_dir}/records")
        drift.schema_changes(records).orderBy("series_id", "file_seq", "field", F.col("change_kind")).write.mode("overwrite").parquet(f"{a.output_dir}/changes")
    elif a.command == "wide":
        eav.pivot_wide(spark.read.parquet(a.input)).write.mode("overwrite").parquet(a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
