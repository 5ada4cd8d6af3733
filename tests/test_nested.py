import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitchloom.operators.nested import RecordSpec, StructuralIndex, extract, flatten_json, flatten_lists, whole_number

SPECS = (RecordSpec("e", ("es", "events"), ("id",)), RecordSpec("p", ("ps",), ("pid",), parent="e"))


def strict(text):
    def no(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=no)
    except ValueError:
        return False
    return True


def links(payload):
    got = extract([payload.encode()], SPECS, False)
    return list(zip(got["record_kind"], got["parent"], got["child"], got["ordinal"]))


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=4), c, max_size=4), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(values, st.integers(0, 60), st.sampled_from(["", "}", "]", ",", '"', "\\", "1", ":", " "]), st.booleans()), min_size=1, max_size=6))
def test_validity_is_that_of_the_json_module(cases):
    texts = []
    for value, at, mark, ascii_ in cases:
        text = json.dumps(value, ensure_ascii=ascii_)
        at = min(at, len(text))
        texts.append(text[:at] + mark + text[at:])
    texts = [t for t in texts if t]
    if texts:
        index = StructuralIndex([t.encode("utf-8", "surrogatepass") for t in texts])
        assert index.valid.tolist() == [strict(t) for t in texts]


def test_links_wrappers_and_id_spellings():
    body = '{"es": [{"id": "7", "ps": {"pid": 1.0}}, null, {"id": 8, "ps": [{"pid": " 2 "}, [], {"pid": null}, {"x": 1}]}, {"ps": [{"pid": 9}]}]}'
    want = [("e", None, 7, 0), ("e", None, 8, 1), ("p", 7, 1, 0), ("p", 8, 2, 0)]
    for text in (body, f"[{body}]", '{"data": %s, "v": 2}' % body, json.dumps(body)):
        assert sorted(links(text), key=repr) == sorted(want, key=repr)
    assert links('{"events": {"id": 3}}') == [("e", None, 3, 0)]
    assert links(body[:-1]) == [] and links("") == [] and links("[]") == [] and links('"x"') == []


def test_quotes_brackets_and_escapes_inside_strings():
    assert links('{"n": "a\\\\\\"}]{[", "es": [{"s": "{\\"id\\": 5}", "id": 6}]}') == [("e", None, 6, 0)]


def test_whole_numbers():
    assert [whole_number(t) for t in ("7", " 07 ", "7.0", "7.5", "x", "", "nan", "1e400")] == [7, 7, 7, None, None, None, None, None]


def test_frames_nulls_repeats_long_texts_and_other_columns(spark):
    long = '{"es": [' + ",".join('{"id": %d, "t": "%s"}' % (k, "x" * 200) for k in range(3000)) + "]}"
    rows = [(1, long, 5), (2, None, 5), (3, "", 5), (4, '{"es": []}', 5), (5, '{"es": [{"id": 1}]}', 5), (5, '{"es": [{"id": 1}]}', 5), (None, '{"es": [{"id": 2}]}', 5)]
    df = spark.createDataFrame(rows, "feed long, body string, child_id long")
    out = flatten_json(df, "feed", "body", list(SPECS), with_record=True)
    got = out.collect()
    assert len([r for r in got if r.row_id == 1]) == 3000
    assert len([r for r in got if r.row_id == 5]) == 2
    assert [r.child_id for r in got if r.row_id is None] == [2]
    assert json.loads(next(r.record for r in got if r.row_id == 5)) == {"id": 1}
    assert flatten_json(df.limit(0), "feed", "body", list(SPECS)).count() == 0


def test_typed_lists(spark):
    schema = "frame_id long, period int, home array<struct<jerseyNum:string,x:double>>, child_id string"
    rows = [(1, 1, [("7", 1.0), None, ("07 ", 2.0), ("8.0", 3.0), (None, 4.0), ("null", 5.0), ("", 1.0), ("7.5", 1.0)], "c"), (2, None, None, "c"), (3, 2, [], "c"), (4, 2, [("9", None)], "c")]
    df = spark.createDataFrame(rows, schema)
    out = flatten_lists(df, "frame_id", {"home": "home"}, "jerseyNum", carry=("period",), values=("x",))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("home", 1, 7, 0, 1, 1.0), ("home", 1, 7, 2, 1, 2.0), ("home", 1, 8, 3, 1, 3.0), ("home", 4, 9, 0, 2, None)], key=repr)
    assert flatten_lists(df.limit(0), "frame_id", {"home": "home"}, "jerseyNum").count() == 0


@pytest.mark.parametrize("size", [1, 50, 10_000])
def test_block_size_changes_nothing(spark, size):
    df = spark.createDataFrame([(k, '{"es": [{"id": %d, "ps": [{"pid": %d}]}]}' % (k, -k)) for k in range(200)], "feed long, body string")
    assert flatten_json(df, "feed", "body", list(SPECS), block_bytes=size).count() == 400


def test_any_number_of_wrappings_and_escaped_names():
    text = '{"es": [{"id": 5}]}'
    for _ in range(8):
        text = json.dumps(text)
    assert links(text) == [("e", None, 5, 0)]
    assert links(r'{"\u0065s": [{"\u0069d": 5, "p\u0073": {"p\u0069d": 6}}]}') == [("e", None, 5, 0), ("p", 5, 6, 0)]
    assert links('{"es": [{"id": 1, "id": 2}]}') == [("e", None, 2, 0)]  # the last of repeated names, as JSON readers do


def test_ids_that_do_not_fit_skip_their_record_only(spark):
    bodies = ['{"es": [{"id": 99999999999999999999}, {"id": "1_0"}, {"id": -3}, {"id": 9223372036854775807}]}', '{"es": [{"id": "\\ud800"}, {"id": 4, "t": "\\udfff"}]}', '"\\ud800"']
    df = spark.createDataFrame(list(enumerate(bodies)), "feed long, body string")
    got = sorted((r.row_id, r.child_id) for r in flatten_json(df, "feed", "body", list(SPECS), with_record=True).collect())
    assert got == [(0, -3), (0, 9223372036854775807), (1, 4)]


def test_the_three_readers_of_whole_numbers_agree(spark):
    from pyspark.sql import functions as F

    from pitchloom.operators.nested import whole_number_column

    texts = ["7", " 07 ", "7.0", "7.", "-3", "+4", "-0", "7.5", "x", "", "1_0", "1e3", "1.5e1", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "99999999999999999999", "0" * 30 + "12", None]
    want = [None if t is None else whole_number(t) for t in texts]
    df = spark.createDataFrame([(k, [(t,)]) for k, t in enumerate(texts)], "id long, home array<struct<jerseyNum:string>>")
    listed = {r.parent_id: r.child_id for r in flatten_lists(df, "id", {"home": "home"}, "jerseyNum").collect()}
    column = {r.id: r.n for r in df.select("id", whole_number_column(F.col("home")[0]["jerseyNum"]).alias("n")).collect()}
    assert [listed.get(k) for k in range(len(texts))] == want
    assert [column[k] for k in range(len(texts))] == want


def test_a_payload_does_not_vouch_for_the_one_before_it():
    texts = ["null", "[false,]", "}null", "[1]"]
    assert StructuralIndex([t.encode() for t in texts]).valid.tolist() == [True, False, False, True]
