import pytest
from pyspark.sql import functions as F

from logweave.llm import pii


@pytest.mark.parametrize("local", ["иван.петров", "ελένη", "王小明", "홍길동", "zoë.müller", "𠀋é"])
def test_addresses_are_hidden_and_different(spark, local):
    other = local[:-1] + ("а" if local[-1] != "а" else "б")
    docs = spark.createDataFrame([(1, f"to {local}@example.com"), (2, f"again {local}@example.com"), (3, f"to {other}@example.com")], "doc_id long, text string")
    one, two, three = (r.text.split()[-1].split("@")[0] for r in pii.pseudonymise(docs).orderBy("doc_id").collect())
    assert one == two != three and len(one) == len(local)
    assert not [c for c, d in zip(local, one, strict=True) if c == d and not c.isascii()] and local not in one
