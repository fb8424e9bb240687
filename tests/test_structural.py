import math

from foliospark.functions import features as ff


def test_a_text_is_folded_once_for_the_feature_array(spark):
    texts = ["İNVOıCE no 5\nTOTAL due €5\n[ ] a ( )", "Subject: x\nDear Bob, ſubtotal TAX\n2) Which Key", "", None]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string")
    array = frame.select("id", ff.structural_features("text").alias("s"))
    plan = array._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
    counts = {r["id"]: list(r)[1:] for r in frame.select("id", *ff.structural_counts("text")).collect()}
    for row in array.collect():
        assert all(math.isclose(a, math.log1p(n)) for a, n in zip(row["s"], counts[row["id"]], strict=True))
    assert counts[0][:4] == [1, 1, 0, 1] and sum(counts[2]) == sum(counts[3]) == 0
