import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from foliospark.operators import content


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("item_index").select(*columns).collect()]


def test_clean_keeps_unknown_and_odd_texts(items):
    got = content.clean(items([{"type": "header", "text": "x"}, {"type": "text", "text": "body"}, {"type": "text", "text": " 　\n"}, {"type": "text"}, {"type": "text", "text": None}, {"type": "text", "text": 7}, {"type": "footer"}, {"type": "page_number"}, {"type": "novel"}, {"type": "image"}, "bare"]))
    assert rows(got, "item_index", "source_index", "type") == [(0, 1, "text"), (1, 3, "text"), (2, 4, "text"), (3, 5, "text"), (4, 8, "novel"), (5, 9, "image"), (6, 10, None)]


def test_statistics_count_strict_integers_only(items):
    df = items([{"type": 9, "page_idx": True}, {"type": "text", "page_idx": "3", "text_level": False}, {"type": "text", "page_idx": 3, "text_level": 1}, {"type": "image", "text_level": 2, "page_idx": 1.0}, "x"])
    got = {(r.facet, r.value): r.n for r in content.statistics(df).collect()}
    assert got == {("type", "text"): 2, ("type", "image"): 1, ("level", "1"): 1, ("page", "3"): 1}


def test_top_level_must_be_an_array(items):
    with pytest.raises(Exception, match="array"):
        items({"d": {}}).collect()


def text(t, page, **more):
    return {"type": "text", "text": t, "page_idx": page} | more


@pytest.mark.parametrize("ending", list(".!?:;"))
def test_a_complete_sentence_is_no_candidate(items, ending):
    assert content.cross_page_candidates(items([text(f"done{ending} ", 0), text("next", 1)])).count() == 0


def test_candidates(items):
    df = items({"a": [text("first  ", 0), text("second", 1), text("third", 2)], "b": [text("。", 0), text("x", 1)], "c": [text("x", 0), text("y", 2)], "d": [text("x", 0, text_level=None), text("y", 1)], "e": [text("x", True), text("y", 2)], "f": [text(" ", 0), text("y", 1)]})
    got = sorted((r.doc_id, r.previous_index, r.next_index, r.previous_text) for r in content.cross_page_candidates(df).collect())
    assert got == [("a", 0, 1, "first  "), ("a", 1, 2, "second"), ("b", 0, 1, "。")]


def test_merge_folds_chains(items):
    df = items([text("  A  ", 0, bbox=[1, 2], custom=1), text(" B", 1), text("C ", 2, bbox=[3, 4]), text("alone.", 5)])
    got = content.merge_cross_pages(df).orderBy("item_index").collect()
    assert [r.text for r in got] == ["  A B C ", "alone."]
    assert got[0].source_page_indices == [0, 1, 2] and got[0].source_bboxes == ["[1,2]", None, "[3,4]"]
    assert [r.merged_cross_page for r in got] == [True, False] and [r.item_index for r in got] == [0, 1]


def test_merge_of_139_items_with_one_candidate(items):
    df = items([text("open" if i == 36 else "done.", i) for i in range(139)])
    assert content.merge_cross_pages(df).count() == 138


def test_candidate_errors(spark, items):
    df = items([text("a", 0), text("b", 1), text(" ", 2), {"type": "image", "page_idx": 3}])
    bad = spark.createDataFrame([("d", 0, 1), ("d", 0, 2), ("d", 1, 2), ("d", 2, 3), ("d", 3, 9), ("d", None, 1)], "doc_id string, previous_index bigint, next_index bigint")
    got = {(r.previous_index, r.next_index): r.error for r in content.candidate_errors(df, bad).collect()}
    assert got[3, 9] == "index out of range" and got[0, 2] == "two successors" and got[None, 1] == "an index is no integer"
    assert content.candidate_errors(df, bad.filter("previous_index = 0 and next_index = 1")).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab .", max_size=6), st.integers(0, 3)), min_size=1, max_size=8))
def test_merging_keeps_all_but_white_space(items, given_rows):
    df = items([text(t, p) for t, p in given_rows])
    squeeze = lambda rs: "".join("".join((r.text or "").split()) for r in rs)
    assert squeeze(content.merge_cross_pages(df).orderBy("item_index").collect()) == squeeze(df.orderBy("item_index").collect())


def test_section_numbers(items):
    got = content.section_numbers(items([text("a", 0), {"type": "image"}, text("b", 0)]))
    assert rows(got, "section_number") == [(1,), (None,), (2,)]
