import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from barkeel.operators.csv_fsm import _CLASS, _NEXT, chunk_maps, compose, parse_records, piece_map, states_before, tokenize

GOOD = "2025-01-01T00:00:00Z,1,2,0.5,1.5,10,A,"


def brute(record):
    """Reason of a record by one plain loop."""
    fields, state, cur = [], "start", ""
    for ch in record:
        if state == "start":
            if ch == '"':
                state = "quoted"
            elif ch == ",":
                fields.append("")
            else:
                state, cur = "plain", ch
        elif state == "plain":
            if ch == '"':
                return "quoting"
            if ch == ",":
                fields.append(cur)
                state, cur = "start", ""
            else:
                cur += ch
        elif state == "quoted":
            if ch == '"':
                state = "closed"
            else:
                cur += ch
        else:
            if ch == '"':
                state, cur = "quoted", cur + ch
            elif ch == ",":
                fields.append(cur)
                state, cur = "start", ""
            else:
                return "quoting"
    if state == "quoted":
        return "quoting"
    return [*fields, cur]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='a,"\n é', max_size=20), max_size=8))
def test_tokenizer_equals_loop(records):
    tok = tokenize(pa.array(records, pa.string()))
    for i, r in enumerate(records):
        want = brute(r)
        assert (tok["fault"][i] >= 0) == (want == "quoting")
        if want != "quoting":
            assert tok["count"][i] == len(want)
    for k, i in enumerate(tok["rows"]):
        assert [t[k].as_py() for t in tok["texts"]] == brute(records[i])


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet='a,"', min_size=1, max_size=60), st.integers(1, 59), st.integers(1, 9))
def test_maps_compose(text, at, chunk):
    s = _CLASS[np.frombuffer(text.encode(), dtype=np.uint8)]
    at = min(at, len(s) - 1) or 1
    if at < len(s):
        assert (compose(piece_map(s[:at]), piece_map(s[at:])) == chunk_maps(s[None, :])[0]).all()
    state, want = 0, []
    for c in s:
        want.append(state)
        state = _NEXT[c, state]
    assert states_before(s, chunk).tolist() == want


def test_reasons(spark):
    rows = [
        (1, 1, "Timestamp,Open"), (2, 2, GOOD), (3, 3, GOOD + '"a, ""b""\nc"'), (4, 4, GOOD + '"a'), (5, 5, GOOD + 'a"b"'), (6, 6, GOOD + '"a" '), (7, 7, GOOD + ",x"), (8, 8, "a,b"),
        (9, 9, None), (10, 10, ""), (11, 11, GOOD.replace("10", "1e1")), (12, 12, GOOD.replace(",10,", ", +010.0 ,")), (13, 13, GOOD.replace(",10,", ",1_0,")), (14, 14, GOOD.replace(",10,", ",inf,")),
        (15, 15, GOOD.replace(",10,", ",-1,")), (16, 16, GOOD.replace(",2,", ",0.4,")), (17, 17, GOOD.replace("0.5", "1.2")), (18, None, GOOD), (19, 19, GOOD + "x" * 100_000), (20, 20, GOOD.replace(",10,", ",1e999,")),
    ]
    df = spark.createDataFrame([(*r, 7) for r in rows], "line_id long, line_no int, raw_line string, reason int")
    out = {r.line_id: r for r in parse_records(df).collect()}
    reasons = {k: r.reason for k, r in out.items()}
    assert reasons == {2: None, 3: None, 4: "quoting", 5: "quoting", 6: "quoting", 7: "column_count", 8: "column_count", 9: "column_count", 10: "column_count", 11: None, 12: None, 13: "value", 14: "value", 15: "value", 16: "value", 17: "value", 18: None, 19: None, 20: "value"}
    assert out[3].ignored == 'a, "b"\nc' and out[12].volume == 10.0 and out[2].reason_given == 7
    assert out[5].offset == len(GOOD) + 1 and out[8].offset == 3
    assert parse_records(df.limit(0)).count() == 0
