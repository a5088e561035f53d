"""Record builders: signals to peaks, text, labels and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.functions import arrays as A
from prismal.functions import ids as I
from prismal.functions import signal as S
from prismal.functions import text as X
from prismal.operators import coverage, references, resample
from prismal.operators import vectors as V

BANDS = "array<struct<position:double,height:double>>"


def as_record(df: DataFrame, cfg: dict, source: str, grp: Column | None = None) -> DataFrame:
    """Columns of a record from ``id, kind, analyte, smiles, peaks`` and whatever else the rows carry."""
    grp = I.group(F.col("id"), cfg["split"]["group_by"] == "strip_replicate") if grp is None else grp
    return df.withColumn("source", F.lit(source)).withColumn("grp", grp).withColumn("text", X.peaks_text(F.col("peaks"), cfg)).withColumn("n_peaks", F.size("peaks")).withColumn("schema", F.lit(cfg["schema"]))


def refuse_duplicates(df: DataFrame, key: str = "id") -> DataFrame:
    """The table itself; an id that occurs twice raises when it is read."""
    twice = df.groupBy(key).count().filter("count > 1").select(F.first(F.col(key).cast("string")).alias("_d"))
    check = F.when(F.col("_d").isNotNull(), F.raise_error(F.concat(F.lit("duplicate id "), F.col("_d"))).cast("boolean")).otherwise(True)
    return df.crossJoin(F.broadcast(twice)).filter(check).drop("_d")


def measured(loaded: DataFrame, cfg: dict, analytes: DataFrame) -> DataFrame:
    """Signals ``id, x, y`` on the grid, with kind and analyte; not scaled."""
    named = loaded.withColumn("id", I.normal_id(F.col("id")))
    named = refuse_duplicates(named).withColumn("y", S.prepare(F.col("x"), F.col("y"), cfg, "measured")).withColumn("kind", I.kind(F.col("id")))
    return I.with_analyte(named, analytes)


def reference_scaled(rows: DataFrame, cfg: dict, generic: DataFrame | None = None) -> DataFrame:
    """Records of gridded signals ``id, y, kind, analyte, smiles`` on the scale where the reference band is 1.

    Pass one finds each signal's band, and shifts the axis where configured.
    References are the substrate-only rows over their band: means of a
    condition, else the paired row, else the generic consensus (``mean, p90, n``;
    built from the run's references where none is given).  Pass two picks peaks
    and drops those the reference explains; the band itself is always among the
    bands.  Rows without a band are scaled by their maximum and keep all peaks.
    """
    sub, rn = cfg["substrate"], cfg["substrate"]["reference_norm"]
    found = rows.withColumn("_r", S.reference(F.col("y"), cfg))
    if rn["align_axis"]:
        found = found.withColumn("shift", F.lit(rn["ref_cm"]) - F.col("_r.position"))
        found = found.withColumn("y", F.coalesce(S.shift_axis(F.col("y"), F.col("shift"), cfg), F.col("y"))).withColumn("_r", S.reference(F.col("y"), cfg))
    else:
        found = found.withColumn("shift", F.lit(None).cast("double"))
    found = found.withColumn("smoothed", S.smooth(F.col("y"), cfg)).cache()
    scaled = F.transform("smoothed", lambda v: v / F.col("_r.height"))
    refs = found.filter((F.col("kind") == "substrate_only") & F.col("_r.height").isNotNull()).select("id", scaled.alias("v"))
    if generic is None:
        enough = refs.limit(1).count()
        generic = coverage.consensus(refs, "v", "id", sub["generic_cb"]["min_corr"]) if enough else None
    out = references.find_reference(found, refs, "v", sub["pair_by"])
    if generic is not None:
        g = generic.select(F.col("mean").alias("_gm"), F.col(sub["generic_cb"]["height"]).alias("_gh"), F.col("n").alias("_gn"))
        g = g.withColumn("_gb", S.bands_of(F.col("_gm"), cfg, F.col("_gh")))
        out = out.crossJoin(F.broadcast(g))
    else:
        out = out.withColumn("_gm", F.lit(None).cast("array<double>")).withColumn("_gn", F.lit(0)).withColumn("_gb", F.lit(None).cast(BANDS))
    bands = F.coalesce(S.bands_of(F.col("ref"), cfg), F.col("_gb"), F.array().cast(BANDS))
    out = out.withColumn("_bands", bands)
    own = F.array(F.struct(F.col("_r.position").alias("position"), F.lit(1.0).alias("height")))
    covered = F.exists("_bands", lambda b: F.abs(b["position"] - F.col("_r.position")) <= rn["match_tol_cm"])
    out = out.withColumn("_bands", F.when(F.col("_r.position").isNull(), F.array().cast(BANDS)).when(covered, F.col("_bands")).otherwise(F.concat("_bands", own)))
    out = out.withColumn("_peaks", S.find_peaks(F.col("y"), cfg, F.col("_r.height")))
    out = out.withColumn("_s", A.split_explained(F.col("_peaks"), F.col("_bands"), rn["match_tol_cm"], rn["keep_min_excess"], rn["keep_min_ratio"]))
    kept, mode = F.col("_s.kept"), F.when(F.col("_r.height").isNull(), "max_in_window(ref_missing)").otherwise("reference_norm")
    if rn["rescale_to_max_after_discard"]:
        top = F.array_max(F.transform(kept, lambda p: p["intensity"]))
        again = F.transform(kept, lambda p: F.struct(p["position"].alias("position"), (p["intensity"] / top).alias("intensity"), p["width"].alias("width")))
        use = F.col("_r.height").isNotNull() & (F.size(kept) > 0)
        kept, mode = F.when(use, again).otherwise(kept), F.when(use, "reference_norm+rescaled").otherwise(mode)
    label = F.coalesce("ref_label", F.when(F.col("_gb").isNotNull(), F.format_string(f"generic(n=%d, {sub['generic_cb']['height']})", "_gn")), F.lit("none"))
    info = F.struct(
        mode.alias("mode_used"), F.round("_r.height", 6).alias("ref_height"), F.col("_r.position").alias("ref_pos"), label.alias("reference"),
        F.transform(F.array_sort("_bands"), lambda b: F.array(F.round(b["position"], 1), F.round(b["height"], 3))).alias("bands"),
        F.size("_s.dropped").alias("n_masked"), F.col("_s.dropped").alias("discarded"), F.col("shift").alias("shift"), F.lit(None).cast("double").alias("scale"))
    top = F.coalesce(F.col("_r.height"), F.array_max("smoothed"))
    x829 = F.transform("smoothed", lambda v: F.coalesce(F.try_divide(v, top), v))
    curve = F.coalesce("ref", "_gm")
    out = out.select("id", "kind", "analyte", "smiles", kept.alias("peaks"), info.alias("substrate"), x829.alias("x829"), F.when(curve.isNull() | F.col("_r.height").isNull(), x829).otherwise(A.minus(x829, curve)).alias("xsub"))
    return as_record(out, cfg, "sers")


def by_mode(rows: DataFrame, cfg: dict, generic: DataFrame | None = None) -> DataFrame:
    """Records under the configured substrate mode: reference_norm, paired, mean_ref, mask or none.

    ``paired`` subtracts the row's reference and falls back to masking;
    ``mean_ref`` subtracts the mean of all references; ``mask`` drops peaks near
    the references' catalogue positions.
    """
    mode, sub = cfg["substrate"]["mode"], cfg["substrate"]
    if mode == "reference_norm":
        return reference_scaled(rows, cfg, generic)
    refs = rows.filter(F.col("kind") == "substrate_only").select("id", F.col("y").alias("v"))
    if mode == "paired":
        out = references.find_reference(rows, refs, "v", sub["pair_by"])
    elif mode == "mean_ref":
        out = rows.crossJoin(F.broadcast(V.mean_vectors(refs, "v", []).select(F.col("mean").alias("ref")))).withColumn("ref_label", F.lit("mean"))
    elif mode in ("mask", "none"):
        out = rows.withColumn("ref", F.lit(None).cast("array<double>")).withColumn("ref_label", F.lit(None).cast("string"))
    else:
        raise ValueError(f"unknown substrate mode {mode!r}")
    out = out.withColumn("_sub", S.subtract_reference(F.col("y"), F.col("ref"), cfg)).withColumn("_y", F.coalesce("_sub.rest", "y"))
    peaks = S.find_peaks(F.col("_y"), cfg)
    out = out.withColumn("peaks", peaks)
    if mode in ("paired", "mask"):
        # catalogue of the mean reference: one row, from partial sums
        mean = V.mean_vectors(refs.withColumn("v", F.transform("v", lambda x: x / F.greatest(F.array_max("v"), F.lit(1e-12)))), "v", []).select(F.col("mean").alias("_mean"))
        out = out.crossJoin(F.broadcast(mean.select(S.catalogue(F.col("_mean"), cfg).alias("_cat"))))
        out = out.withColumn("peaks", F.when(F.col("ref").isNull(), A.mask_peaks(F.col("peaks"), F.col("_cat"), sub["tol_cm"])).otherwise(F.col("peaks")))
    used = F.when(F.col("ref").isNotNull(), mode).otherwise("mask" if mode == "paired" else mode)
    info = F.struct(used.alias("mode_used"), F.col("ref_label").alias("reference"), F.col("_sub.shift").alias("shift"), F.col("_sub.scale").alias("scale"))
    return as_record(out.select("id", "kind", "analyte", "smiles", "peaks", info.alias("substrate")), cfg, "sers")


def simulated(signals: DataFrame, axis: list[float], molecules: DataFrame, cfg: dict) -> DataFrame:
    """Records of wide simulated signals ``id, y``; ids without a molecule are left out."""
    x = F.array(*(F.lit(float(a)) for a in axis))
    rows = signals.join(molecules.select(F.col("number").alias("id"), "smiles"), "id")
    rows = rows.withColumn("_y", S.prepare(x, F.col("y"), cfg, "simulated")).withColumn("peaks", S.find_peaks(F.col("_y"), cfg)).filter(F.size("peaks") > 0)
    rows = rows.select(F.concat(F.lit("qm9s_"), F.col("id")).alias("id"), F.lit("sim").alias("kind"), F.lit(None).cast("string").alias("analyte"), "smiles", "peaks")
    return as_record(rows, cfg, "qm9s", F.col("id"))


def from_peaklists(lists: DataFrame, cfg: dict, source_floor: float = 0.1, rel_height: float = 0.7, id_col: str = "id") -> DataFrame:
    """Records of ready peak lists ``id, smiles, x, y, w``: cropped, scaled in the window, widths at half height.

    ``effective_floor`` is the source's cut in window units.  Lists without a
    peak in the window are left out.
    """
    lo, hi = cfg["window"]
    p = cfg["peaks"]
    zipped = F.filter(F.arrays_zip("x", "y", "w"), lambda s: s["x"].between(lo, hi))
    rows = lists.withColumn("_z", zipped).filter(F.size("_z") > 0).withColumn("_top", F.array_max(F.transform("_z", lambda s: s["y"])))
    peaks = F.transform("_z", lambda s: F.struct(s["x"].alias("position"), (s["y"] / F.col("_top")).alias("intensity"), A.lorentz_fwhm(s["w"], rel_height).alias("width")))
    peaks = A.top_by_intensity(F.filter(peaks, lambda q: q["intensity"] >= p["min_height"]), p["max_peaks"])
    peaks = F.array_sort(peaks, lambda a, b: F.when(a["position"] < b["position"], -1).when(a["position"] > b["position"], 1).otherwise(0))
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.lit("sim").alias("kind"), F.lit(None).cast("string").alias("analyte"), "smiles", peaks.alias("peaks"),
                       F.round("_top", 3).alias("window_max_global"), F.round(F.least(F.lit(source_floor) / F.col("_top"), F.lit(1.0)), 3).alias("effective_floor"))
    return as_record(rows, cfg, "qm9s", F.col("id"))


def from_sticks(sticks: DataFrame, cfg: dict, molecules: DataFrame | None = None) -> DataFrame:
    """Records of stick lists ``id, freq, inten``; empty drawings are left out."""
    rows = sticks.withColumn("_y", S.prepare(F.col("freq"), F.col("inten"), cfg, "sticks")).filter(F.array_max("_y") > 0).withColumn("peaks", S.find_peaks(F.col("_y"), cfg))
    if molecules is not None:
        rows = rows.join(molecules.select(F.col("name").alias("id"), "smiles"), "id", "left")
    else:
        rows = rows.withColumn("smiles", F.lit(None).cast("string"))
    rows = rows.select(F.concat(F.lit("dft_"), F.col("id")).alias("id"), F.lit("sim").alias("kind"), F.col("id").alias("analyte"), "smiles", "peaks")
    return as_record(rows, cfg, "dft", F.col("id"))


def add_labels(records: DataFrame, labels: DataFrame, key: str = "smiles") -> DataFrame:
    """Add a label map from a table ``smiles, labels``; rows without one keep a null map."""
    return records.drop("labels").join(labels.select(F.col(key).alias("_k"), "labels"), F.col(key) == F.col("_k"), "left").drop("_k")


def assign_splits(records: DataFrame, cfg: dict, label: str = "analyte", group: str = "grp") -> DataFrame:
    """Add ``split``: groups of each label to train and test; substrate-only rows are ``control``."""
    rows = records.drop("split")
    use = rows.filter(F.col("kind") != "substrate_only")
    split = resample.group_split(use, group, label, cfg["split"]["test_fraction"], cfg["split"]["seed"]).withColumnRenamed(group, "_g")
    joined = rows.join(split, rows[group] == F.col("_g"), "left").drop("_g")
    return joined.withColumn("split", F.when(F.col("kind") == "substrate_only", "control").otherwise(F.col("split")))


def top_up(candidates: DataFrame, kept: DataFrame, labels: list[str], want: int, id_col: str = "id") -> DataFrame:
    """Ids of kept rows and, label by label, the lowest-CRC positives that bring each label to ``want``.

    Labels are taken in order, each after what the earlier ones added; the loop
    is over the label list.
    """
    have = kept.select(id_col)
    for name in labels:
        on = candidates.filter(F.coalesce(F.col(name), F.lit(0)) > 0)
        missing = want - on.join(have, id_col, "left_semi").count()
        if missing > 0:
            more = on.join(have, id_col, "left_anti").orderBy(F.crc32(F.col(id_col).cast("string")), id_col).limit(missing).select(id_col)
            have = have.unionByName(more)
    return have
