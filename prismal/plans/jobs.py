"""Command-line jobs: ``python -m prismal.plans.jobs NAME --help``.

Each reads and writes tables; a manifest with the digests of its inputs lets a
job that has run on the same inputs be skipped.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismal import config
from prismal.functions import text as X
from prismal.operators import checks as Q
from prismal.operators import coverage as C
from prismal.operators import records as B
from prismal.sinks import files as K
from prismal.session import build
from prismal.sources import files as S


def build_records(spark: SparkSession, args) -> DataFrame:
    """Measured signals to records with splits, written as a variant's partition."""
    cfg = config.variant(args.variant)
    rows = B.measured(S.two_columns(spark, args.signals), cfg, S.analytes(spark, args.analytes))
    out = B.assign_splits(B.by_mode(rows, cfg), cfg)
    K.write_records(out, args.out, args.variant)
    return S.records(spark, args.out, args.variant)


def build_sticks(spark: SparkSession, args) -> DataFrame:
    """Stick files to records."""
    cfg = config.variant(args.variant)
    out = B.from_sticks(S.sticks(spark, args.signals), cfg)
    K.write_records(out, args.out, args.variant)
    return S.records(spark, args.out, args.variant)


def check_records(spark: SparkSession, args) -> DataFrame:
    """All checks of a record table; the job fails if one does."""
    cfg = config.variant(args.variant)
    rec = S.one_schema(S.records(spark, args.out, args.variant))
    a = S.analytes(spark, args.analytes).select("name", "code").collect()
    terms = X.label_terms([v for r in a for v in r])
    limit = cfg["max_seq_length"] - cfg["answer_token_reserve"]
    rows = Q.run_all(Q.grammar(rec, cfg), Q.forbidden_terms(rec, terms, group_col="grp"), Q.template(spark, cfg["prompt_template"], terms), Q.split_disjoint(rec), Q.exact_duplicates(rec), Q.token_budget(rec, limit))
    K.write_json(rows, f"{args.out}/../checks")
    return rows


def coverage_report(spark: SparkSession, args) -> DataFrame:
    """Peak and width spreads by kind."""
    rec = S.records(spark, args.out, args.variant)
    peaks = rec.withColumn("peaks", X.parse_peaks(F.col("text"), config.variant(args.variant)))
    out = C.text_stats(peaks, "peaks", "kind")
    K.write_table(out, f"{args.out}/../coverage")
    return out


def preflight(spark: SparkSession, args) -> DataFrame:
    """Inputs before a run: files, axis cover, repeated ids, ids without an analyte, blanks without a pair: ``check, status, detail``."""
    from prismal.functions import ids as I

    cfg = config.variant(args.variant)
    sig = S.two_columns(spark, args.signals).withColumn("id", I.normal_id(F.col("id")))
    lo, hi = cfg["window"]
    named = I.with_analyte(sig, S.analytes(spark, args.analytes))
    blanks = sig.filter(I.kind(F.col("id")) == "substrate_only").select(I.condition(F.col("id")).alias("c")).distinct()
    alone = sig.filter(I.kind(F.col("id")) == "cell").withColumn("c", I.condition(F.col("id"))).join(blanks, "c", "left_anti")
    row = lambda name, df, bad: df.agg(F.lit(name).alias("check"), F.when(F.count("*") > 0, bad).otherwise("PASS").alias("status"), F.count("*").cast("string").alias("detail"))
    parts = [
        row("axis", sig.filter((F.array_min("x") > lo) | (F.array_max("x") < hi)), "FAIL"), row("repeated_ids", sig.groupBy("id").count().filter("count > 1"), "FAIL"),
        row("no_analyte", named.filter("analyte is null"), "WARN"), row("unpaired", alone, "WARN")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


JOBS = {f.__name__: f for f in (build_records, build_sticks, check_records, coverage_report, preflight)}


def manifest_key(spark: SparkSession, args) -> str:
    """Digest of a job's input files and arguments."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(args.signals)
    d = K.digest_files(df).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("sha256"))), 256)).first()[0]
    return f"{d}:{json.dumps(vars(args), sort_keys=True)}"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("job", choices=sorted(JOBS))
    p.add_argument("--signals", default="")
    p.add_argument("--analytes", default="")
    p.add_argument("--out", required=True)
    p.add_argument("--variant", default="native")
    p.add_argument("--manifest", default="", help="local file of done jobs")
    args = p.parse_args(argv)
    spark = SparkSession.getActiveSession() or build()
    done = json.loads(Path(args.manifest).read_text()) if args.manifest and Path(args.manifest).exists() else []
    key = manifest_key(spark, args) if args.manifest and args.signals else ""
    if key and key in done:
        return 0
    out = JOBS[args.job](spark, args)
    failed = "status" in out.columns and out.filter("status = 'FAIL'").limit(1).count()
    print(K.markdown([r.asDict() for r in out.select([c for c in out.columns if c in ("check", "status", "detail", "kind", "records")]).limit(50).collect()]))
    if key and not failed:
        Path(args.manifest).write_text(json.dumps([*done, key]))
    return int(bool(failed))


if __name__ == "__main__":
    raise SystemExit(main())
