"""Items whose numbers and names were changed throughout are found, also where templates repeat or hold few words."""

import pytest

from logweave.llm import decontamination

CASES = {
    "equal templates": ("take 3 of them then take 5 of them then take 7 of them", "take 4 of them then take 6 of them then take 9 of them"),
    "names at sentence starts": ("Anna buys 3 apples. Anna pays 2 euros.", "Berta buys 5 apples. Berta pays 4 euros."),
    "many numbers": ("Add 3, 5 7 9 11 12 and 14 to 20 or 21 22 23 24 25 26", "Add 4, 6 8 10 31 32 and 34 to 40 or 41 42 43 44 45 46"),
}


@pytest.mark.parametrize("name", list(CASES))
@pytest.mark.parametrize("broadcast_windows", [2_000_000, 0])
def test_found(spark, name, broadcast_windows):
    item, changed = CASES[name]
    docs = spark.createDataFrame([(1, changed), (2, f"Here it is: see. {changed} And so on"), (3, item), (4, "Carl buys the bread and pays for it with 3 coins")], "doc_id long, text string")
    got = decontamination.contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string"), broadcast_windows=broadcast_windows).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 9), (2, 9), (3, 9)]
    assert all(r.n_found == r.n_windows for r in got)


def test_numbers_must_be_consistent(spark):
    docs = spark.createDataFrame([(1, "take 4 of them then take 4 of them then take 9 of them")], "doc_id long, text string")
    assert not decontamination.contaminated(docs, spark.createDataFrame([(9, CASES["equal templates"][0])], "item_id long, text string")).count()
