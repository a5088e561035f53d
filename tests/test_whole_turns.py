from pyspark.sql import functions as F

from prismal.plans import queries

SF = "/root/testdata/sf0.001"


def test_tagged_turns_hold_their_whole_text(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").filter("text <> ''").select("conv_id", "turn", "text")
    out = queries.QUERIES["tagged_turns"](spark, SF).join(turns, ["conv_id", "turn"])
    assert out.count() == turns.count() > 0 and out.filter(F.length("text") > 10).count() > 0
    assert out.filter(~F.col("tagged").endswith(F.col("text"))).count() == 0
