import pytest

from quire.llm import minhash


@pytest.mark.parametrize("percent", [79, 50])
def test_percent_below_the_bounds_is_refused(spark, percent):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    with pytest.raises(ValueError, match="at least 80"):
        minhash.near_duplicates(docs, percent=percent)
