"""Data-quality checks: each gives one row ``check, status, detail, examples``.

Statuses are PASS, WARN, FAIL and SKIP.  Examples hold at most five ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.functions import text as X

EXAMPLES = 5




def _first(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("_id")).distinct().orderBy("_id").limit(EXAMPLES).agg(F.array_sort(F.collect_list("_id")).alias("examples"))


def result(name: str, counts: DataFrame, status: Column, detail: Column, bad: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """Assemble a check's row from one row of counts and the offending rows."""
    row = counts.select(F.lit(name).alias("check"), status.alias("status"), detail.alias("detail"))
    if bad is None:
        return row.withColumn("examples", F.array().cast("array<string>"))
    return row.crossJoin(_first(bad, id_col))


def grammar(records: DataFrame, cfg: dict, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """FAIL for a null or empty text, one off the grammar, or one that parsing and writing changes."""
    t = F.col(text_col)
    fine = X.matches_grammar(t, cfg) & (X.peaks_text(X.parse_peaks(t, cfg, strict=False), cfg) == t)
    bad = records.filter(~F.coalesce(fine, F.lit(False)))
    n = records.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("bad"))
    return result("grammar", n, F.when(F.col("bad") > 0, "FAIL").otherwise("PASS"), F.format_string("%d of %d texts are off the grammar", "bad", "n"), bad, id_col)


def forbidden_terms(records: DataFrame, terms: list[str], id_col: str = "id", text_col: str = "text", group_col: str | None = None) -> DataFrame:
    """FAIL where a text holds a term, or a whole token that is an id or a group of the table."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    by_term = records.filter(t.rlike(X.term_pattern(terms))).select(id_col)
    names = records.select(F.lower(F.col(id_col).cast("string")).alias("_n"))
    if group_col:
        names = names.unionByName(records.select(F.lower(F.col(group_col).cast("string")).alias("_n")))
    tokens = records.select(id_col, F.explode(F.array_distinct(F.split(F.lower(t), r"[\s|,;]+"))).alias("_n")).filter(~F.col("_n").rlike(r"^[0-9.]*$"))
    by_name = tokens.join(names.distinct(), "_n", "left_semi").select(id_col)
    bad = by_term.unionByName(by_name).distinct()
    n = bad.agg(F.count("*").alias("bad"))
    return result("forbidden_terms", n, F.when(F.col("bad") > 0, "FAIL").otherwise("PASS"), F.format_string("%d texts hold a label term or an id", "bad"), bad, id_col)


def template(spark, text: str, terms: list[str]) -> DataFrame:
    """FAIL unless a prompt template has exactly one ``{text}`` and no term."""
    row = spark.createDataFrame([(text,)], "t string")
    n = (F.length("t") - F.length(F.replace("t", F.lit("{text}"), F.lit("")))) / 6
    status = F.when(n != 1, "FAIL").when(F.col("t").rlike(X.term_pattern(terms)), "FAIL").otherwise("PASS")
    return result("prompt_template", row, status, F.format_string("%d place holders", n.cast("int")))


def split_disjoint(records: DataFrame, id_col: str = "id", group_col: str = "grp", split_col: str = "split") -> DataFrame:
    """FAIL for ids that occur twice or groups in several splits; SKIP without a split."""
    ids = records.groupBy(id_col).count().filter("count > 1").select(F.col(id_col).cast("string").alias("id"))
    groups = records.filter(F.col(split_col).isNotNull()).groupBy(group_col).agg(F.countDistinct(split_col).alias("k")).filter("k > 1").select(F.col(group_col).cast("string").alias("id"))
    n = ids.agg(F.count("*").alias("ids")).crossJoin(groups.agg(F.count("*").alias("groups"))).crossJoin(records.agg(F.count(split_col).alias("known")))
    status = F.when(F.col("known") == 0, "SKIP").when(F.col("ids") + F.col("groups") > 0, "FAIL").otherwise("PASS")
    return result("split_disjoint", n, status, F.format_string("%d repeated ids, %d groups in several splits", "ids", "groups"), ids.unionByName(groups))


def exact_duplicates(records: DataFrame, text_col: str = "text", label_col: str = "analyte", split_col: str = "split", id_col: str = "id") -> DataFrame:
    """FAIL for equal texts of one label in several splits, WARN for equal texts of different labels."""
    # digests stand for the texts, and several values are a least and a greatest that differ
    several = lambda c: F.coalesce(F.min(c) < F.max(c), F.lit(False))
    g = records.filter(F.col(split_col).isNotNull()).groupBy(F.sha2(F.col(text_col).cast("binary"), 256).alias("digest")).agg(
        several(split_col).alias("splits"), several(label_col).alias("labels"), F.min(F.col(id_col).cast("string")).alias("id"))
    across = g.filter("splits")
    n = across.agg(F.count_if(~F.col("labels")).alias("same"), F.count_if("labels").alias("other"))
    status = F.when(F.col("same") > 0, "FAIL").when(F.col("other") > 0, "WARN").otherwise("PASS")
    return result("exact_duplicates", n, status, F.format_string("%d texts of one label and %d of several labels are in several splits", "same", "other"), across)


def near_duplicates(pairs: DataFrame, same_label: str = "same_label") -> DataFrame:
    """WARN where near pairs across splits exist; ``pairs`` as ``vectors.near_pairs`` gives them, with a flag for equal labels."""
    n = pairs.agg(F.count("*").alias("n"), F.count_if(~F.col(same_label)).alias("other"))
    return result("near_duplicates", n, F.when(F.col("n") > 0, "WARN").otherwise("PASS"), F.format_string("%d near pairs across splits, %d with different labels", "n", "other"), pairs, "left_id")


def token_budget(records: DataFrame, limit: int, text_col: str = "text", id_col: str = "id", overhead: int = 0) -> DataFrame:
    """FAIL where a text's estimated tokens and the overhead exceed the limit."""
    t = X.estimate_tokens(F.col(text_col)) + overhead
    # the median is over one row a distinct count
    sizes = records.groupBy(t.alias("t")).agg(F.count("*").alias("k"))
    n = sizes.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.percentile("t", F.lit(0.5), F.col("k")).alias("mid"), F.max("t").alias("most"), F.coalesce(F.sum(F.when(F.col("t") > limit, F.col("k"))), F.lit(0)).alias("over"))
    detail = F.format_string("median %.1f, most %d, %d over %d", "mid", "most", "over", F.lit(limit))
    return result("token_budget", n, F.when(F.col("over") > 0, "FAIL").otherwise("PASS"), detail, records.filter(t > limit), id_col)


def shuffled_control(real: float, nulls: DataFrame, value: str, majority: float) -> DataFrame:
    """FAIL if the mean accuracy under shuffled labels exceeds the majority rate by two deviations and 0.05."""
    n = nulls.agg(F.avg(value).alias("m"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("s"), ((1 + F.count_if(F.col(value) >= real - 1e-12)) / (1 + F.count(value))).alias("p"))
    status = F.when(F.col("m").isNull(), "SKIP").when(F.col("m") > majority + 2 * F.col("s") + 0.05, "FAIL").otherwise("PASS")
    return result("shuffled_labels", n, status, F.format_string(f"real {real:.3f}, shuffled %.3f (sd %.3f), p %.3f", "m", "s", "p"))


def blank_control(predictions: DataFrame, label: str, pred: str, chance: float, margin: float = 0.1, least: int = 5) -> DataFrame:
    """FAIL if blanks are told apart better than chance by more than ``margin``; SKIP for fewer than ``least`` rows."""
    n = predictions.agg(F.count("*").alias("n"), F.avg((F.col(label) == F.col(pred)).cast("double")).alias("acc"))
    status = F.when(F.col("n") < least, "SKIP").when(F.col("acc") > chance + margin, "FAIL").otherwise("PASS")
    return result("blank_control", n, status, F.format_string(f"accuracy %.3f on %d blanks, chance {chance:.3f}", "acc", "n"))


def legacy_leaks(docs: DataFrame, checks: dict[str, Column], id_col: str = "id") -> DataFrame:
    """``id, leaks``: names of the predicates that hold for a document, joined by semicolons; documents without one are left out."""
    named = F.concat_ws("; ", *(F.when(c, F.lit(k)) for k, c in checks.items()))
    return docs.select(F.col(id_col).alias("id"), named.alias("leaks")).filter(F.col("leaks") != "")


def run_all(*checks: DataFrame) -> DataFrame:
    """The checks' rows in their order."""
    return reduce(lambda a, b: a.unionByName(b), checks)


def worst(results: DataFrame) -> DataFrame:
    """Exit state of a run: 1 if a check failed."""
    return results.agg(F.max((F.col("status") == "FAIL").cast("int")).alias("exit_code"))
