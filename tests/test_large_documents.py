"""Documents of many parts: one file an owner however lines were dealt before, and files gone through piece by piece."""

import glob
import json

import pytest

from logweave.sources import exports, files
from logweave.sources.pieces import JsonScanner, XmlScanner

SMALL = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4kb", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1kb", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}


@pytest.fixture
def small_tasks(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_one_sound_file_for_each_owner(small_tasks, tmp_path):
    rows = small_tasks.range(6000).selectExpr("id % 25 AS owner", "id", "'dive ' || id AS ref", "array('a}', 'b\"[') AS tags")
    exports.write_documents(exports.json_logbooks(rows, "owner", ["id"], ["ref", "tags"], "log/1"), str(tmp_path / "out"))
    found = glob.glob(f"{tmp_path}/out/owner=*/part-*")
    assert len(found) == 25 and all(len(json.load(open(f))["dives"]) == 240 for f in found)
    codes, dives = files.read_json_logbooks(small_tasks, str(tmp_path / "out"), "log/1")
    assert {r.code for r in codes.collect()} == {None} and codes.count() == 25
    assert sorted(r.source_ref for r in dives.collect()) == sorted(f"dive {i}" for i in range(6000)) and dives.selectExpr("max(at)").first()[0] == 239


@pytest.mark.parametrize(
    ("text", "code"),
    [('{"format": "log/1", "dives": []', "unparseable_json"), ('{"format": "log/1", "dives": [{"ref": "a"},]}', "unparseable_json"), ('{"format": "log/1", "dives": [{"ref": ]}]}', "unparseable_json"), (' {"more": {"dives": [1]}, "format": "log/1", "dives": [{"ref": "a"}]}\n', None)],
)
def test_what_a_json_file_is(spark, tmp_path, text, code):
    (tmp_path / "a.json").write_text(text)
    found, dives = files.read_json_logbooks(spark, str(tmp_path), "log/1")
    assert [r.code for r in found.collect()] == [code] and [r.source_ref for r in dives.collect()] == ["a"] * (code is None)


JSON = b'{"format": "x", "more": [1, {"dives": [1]}], "dives": [{"ref": "r}]\\\\\\"[", "s": [{"x": "s"}]}, {} , null, {"a": {"b": {"c": {"d": {"e": "\xc3\xa9\\\\"}}}}}], "z": {"dives": [3]}}'
XML = b'<?xml version="1.0"?><!-- > --><uddf><a><tankdata id="t>1"/></a><p><g><dive id="1"><b x=">">t &amp; u</b><tankdata><link ref="q"/></tankdata></dive><dive id="&lt;2"/></g></p></uddf>\n'


@pytest.mark.parametrize(("make", "text", "kinds"), [(lambda: JsonScanner("dives"), JSON, ["entry"] * 4 + ["file"]), (lambda: XmlScanner({"uddf/p/g/dive": "dive"}, ("tankdata",)), XML, ["tankdata", "tankdata", "dive", "dive", "file"])])
def test_pieces_of_any_size(make, text, kinds):
    want = None
    for n in range(len(text), 0, -1):
        scan, got = make(), []
        for k in range(0, len(text), n):
            got += scan.feed(text[k : k + n])
        got += scan.close()
        want = want or got
        assert got == want
    assert [k for k, _, _ in want] == kinds


def test_no_more_than_an_element_is_held():
    scan, most = XmlScanner({"uddf/p/dive": "dive"}), 0
    found = list(scan.feed(b"<uddf><p>"))
    for i in range(5000):
        found += scan.feed(f'<dive id="{i}"><x>y</x></dive>'.encode())
        most = max(most, len(scan.buffer))
    found += [*scan.feed(b"</p></uddf>"), *scan.close()]
    assert [at for kind, at, _ in found if kind == "dive"] == list(range(5000)) and found[-1] == ("file", 0, "uddf") and most < 500
