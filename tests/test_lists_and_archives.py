"""Content lists parsed without Python; members of large archives one by one."""

import io
import json
import tracemalloc
import zipfile

import pytest

from foliospark.sources import content as src

VALUES = [
    {"type": "text", "text": "a", "page_idx": 1, "b": {"z": 1, "a": [1, {"y": 2, "x": None}]}}, {}, [], [1, "x", None], "text", "5", "null", '{"a": 1}', 5, -1, 1.0, 1.5, 1e3, True, False, None,
    {"text": "ünïcödé 日本 😀 \\ \" \n \t  "}, {"page_idx": 2**63 - 1}, {"page_idx": 2**63}, {"page_idx": 10**30}, {"page_idx": 1.0}, {"page_idx": True}, {"text": None}, {"": {"": ""}}, " ", "é",
    {"type": "table", "table_caption": ["c", 5, None, {"q": 1}], "table_footnote": "no list", "bbox": [1, 2.5, 3, 4]}, {"text": ""},
]


def lists(spark, *values):
    return spark.createDataFrame([(f"d{k}", v) for k, v in enumerate(values)], "doc_id string, value string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_elements_against_json(spark):
    for spaced in (None, 2):
        got = src.parse_items(lists(spark, json.dumps(VALUES, indent=spaced), json.dumps(VALUES, ensure_ascii=False), "[]")).orderBy("doc_id", "item_index").collect()
        assert [(r.doc_id, r.item_index) for r in got] == [(d, i) for d in ("d0", "d1") for i in range(len(VALUES))]
        for r in got:
            want = VALUES[r.item_index]
            assert json.loads(r.item_json) == want and type(json.loads(r.item_json)) is type(want), r.item_json
            assert list(json.loads(r.item_json)) == list(want) if isinstance(want, dict) else True  # keys in their order
            if isinstance(want, dict):
                page = want.get("page_idx")
                assert r.text == (want.get("text") if isinstance(want.get("text"), str) else None)
                assert r.page_idx == (page if type(page) is int and page < 2**63 else None)
                assert r.text_kind == ("missing" if "text" not in want else "null" if want["text"] is None else "string")


def test_no_python_in_the_plan(spark):
    df = src.parse_items(lists(spark, "[{}]"), objects_only=True)
    assert df.count() == 1
    for word in ("Python", "Arrow", "Pandas"):
        assert word not in plan_of(df)


@pytest.mark.parametrize("value", ["{}", "5", '"[]"', "null", "", " ", "[1", "[1] x", "nonsense", "[1], [2]", "[1]] , [", "[1]} x", '[1], "w": 2'])
def test_what_is_no_array_fails(spark, value):
    with pytest.raises(Exception):
        src.parse_items(lists(spark, "[]", value)).collect()


@pytest.mark.parametrize("value", ["5", "null", '"x"', "[]", "true"])
def test_what_is_no_object_fails_if_asked(spark, value):
    assert src.parse_items(lists(spark, f"[{{}},{value}]")).count() == 2
    with pytest.raises(Exception, match="element 1 is no object"):
        src.parse_items(lists(spark, f"[{{}},{value}]"), objects_only=True).collect()


def test_null_lists_and_keys_that_come_twice(spark):
    assert src.parse_items(lists(spark, None)).collect() == []
    got = src.parse_items(lists(spark, '[{"text": "a", "page_idx": 1, "text": "b"}]')).first()
    assert (got.text, got.page_idx) == ("b", 1) and json.loads(got.item_json)["text"] == "b"


def archive(path, sizes):
    """Members of zeros, stored as they are."""
    with zipfile.ZipFile(path, "w") as z:
        for k, n in enumerate(sizes):
            with z.open(f"dir/m{k:03d}", "w") as f:
                for _ in range(n >> 20):
                    f.write(bytes(1 << 20))
    return str(path)


def test_a_large_archive_is_read_member_by_member(spark, tmp_path):
    path = archive(tmp_path / "big.zip", [20 << 20] * 15)  # 300 MB
    tracemalloc.start()
    with open(path, "rb") as f:
        seen = [(b.num_rows, len(b.column(3)[0].as_py())) for b in src._member_rows(iter([("d", f)]), ())]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == [(1, 20 << 20)] * 15 and peak < 100 << 20
    got = src.read_archives(spark, str(tmp_path / "*.zip")).selectExpr("member_no", "path", "length(content) as n").orderBy("member_no").collect()
    assert [(r.member_no, r.path, r.n) for r in got] == [(k, f"dir/m{k:03d}", 20 << 20) for k in range(15)]


def test_small_members_share_batches_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(src, "BATCH_BYTES", 3 << 20)
    paths = [archive(tmp_path / f"{k}.zip", [1 << 20] * (4 + k)) for k in range(2)]
    rows = [(r["doc_id"], r["member_no"]) for b in src._member_rows(((p, open(p, "rb").read()) for p in paths), ()) for r in b.to_pylist()]
    assert rows == [(p, k) for i, p in enumerate(paths) for k in range(4 + i)]


def test_no_member_leaves_an_unsafe_archive():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("fine", "x")
        z.writestr("../evil", "x")
    given = []
    with pytest.raises(src.ArchiveError):
        for batch in src._member_rows(iter([("d", buffer.getvalue())]), ()):
            given.append(batch)
    assert given == []


def test_damaged_and_empty_archives():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a", b"x" * 1000)
    raw = bytearray(buffer.getvalue())
    raw[200] ^= 255
    with pytest.raises(src.ArchiveError, match="damaged"):
        list(src.archive_members(bytes(raw)))
    for data in (b"", b"PK"):
        with pytest.raises(src.ArchiveError):
            src.archive_members(data)
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    assert list(src.archive_members(empty.getvalue())) == []
