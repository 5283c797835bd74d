"""Addresses of any length: found where they are real ones, and no end of an executor where they are not."""

from logweave.llm import pii


def test_a_megabyte_of_labels(spark):
    labels = "a." * 500_000
    texts = [f"x@{labels}com", f"x@{labels}", "x@" + "a" * 1_000_000 + ".com", "@".join(["a.b"] * 200_000), "x" * 1_000_000 + "@b.com", "a@" * 400_000 + "b.org"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.text, r.n_found) for r in pii.pseudonymise(docs).collect()}
    assert {k: len(v[0]) for k, v in got.items()} == {k: len(t) for k, t in enumerate(texts)}
    assert got[1] == (texts[1], 0) and got[3][1] >= 0 and got[4][1] == 1 and got[4][0].endswith(".com") and got[4][0] != texts[4]


def test_real_addresses_are_found_as_before(spark):
    longest = ".".join(["ab"] * 84)
    told = {"a.b@c.d.e.museum": 1, f"me@{longest}.org": 1, "a@b.c1.com2 z": 1, "a@b.c": 0, "a@-.co": 1, "x@y.z.": 0}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "doc_id long, text string")
    assert {r.doc_id: r.n_found for r in pii.pseudonymise(docs).collect()} == dict(enumerate(told.values()))
