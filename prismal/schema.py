"""Row types of the engine."""

from pyspark.sql import types as T

PEAK = T.StructType([T.StructField(n, T.DoubleType()) for n in ("position", "intensity", "width")])
PEAKS = T.ArrayType(PEAK)
SIGNAL = T.StructType([T.StructField("id", T.StringType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("y", T.ArrayType(T.DoubleType()))])
SUBSTRATE = T.StructType([
    T.StructField("mode_used", T.StringType()), T.StructField("ref_height", T.DoubleType()), T.StructField("ref_pos", T.DoubleType()),
    T.StructField("reference", T.StringType()), T.StructField("bands", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("n_masked", T.IntegerType()), T.StructField("discarded", PEAKS), T.StructField("shift", T.DoubleType()), T.StructField("scale", T.DoubleType()),
])
RECORD = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("source", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("analyte", T.StringType()), T.StructField("smiles", T.StringType()), T.StructField("grp", T.StringType(), False),
    T.StructField("text", T.StringType()), T.StructField("n_peaks", T.IntegerType()), T.StructField("schema", T.StringType()),
    T.StructField("split", T.StringType()), T.StructField("subset", T.StringType()), T.StructField("rung", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.IntegerType())), T.StructField("substrate", SUBSTRATE),
    T.StructField("window_max_global", T.DoubleType()), T.StructField("effective_floor", T.DoubleType()),
])
CHECK = "check string, status string, detail string, examples array<string>"
