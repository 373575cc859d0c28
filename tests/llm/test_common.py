import pytest

from plumbline.llm.common import drop_stored, free, store
from plumbline.llm.exact_dedup import exact_dedup


def test_stored_tables_go_when_they_are_freed(spark):
    free(spark)
    docs = spark.createDataFrame([(1, "a"), (2, "a "), (3, "b")], "doc_id long, text string")
    a, b = store(docs, "a"), store(docs, "b")
    drop_stored(a)
    assert b.count() == 3 and free(spark) == 1 and free(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(b.inputFiles()[0] if b.inputFiles() else "file:///none")
    assert exact_dedup(docs).where("kept").count() == 2 and free(spark) > 0
