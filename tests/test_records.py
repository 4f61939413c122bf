import csv
import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tallyspring.operators import records

D = datetime.date(2024, 5, 27)


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ("2024-05-27,a,b,1.5,1", None),
        ("2024-05-27,a,b,1.5,\r", None),
        ('2024-05-27,"Permits ""new build""",b,,1', None),
        (' "2024-05-27" , "a" , "b" , "1" ,  ', None),
        ('2024-05-27,"a"" ,b",c,1,', None),
        ("2024-05-27,a,b,+.5e-3,76.", None),
        ('2024-05-27,"a long', "quoting"),
        ('2024-05-27,"a"x,b,1,', "quoting"),
        ('2024-05-27,a "b" c,b,1,', "quoting"),
        ('2024-05-27,"a",b,1,2,"x', "quoting"),
        ("", "columns"),
        (None, "columns"),
        ("   ", "columns"),
        ("2024-05-27,a,b,1", "columns"),
        ("2024-05-27,a,b,1,2,3", "columns"),
        ("2024-05-27,,b,1,2", "name"),
        ('2024-05-27,"  ",b,1,2', "name"),
        ("2024-05-27,\ta,b,1,2", "name"),
        ("2024-05-27,a�,b,1,2", "name"),
        ("2024-05-27,a\nb,b,1,2", "name"),
        ("2023-02-29,a,b,1,2", "date"),
        ("1900-02-29,a,b,1,2", "date"),
        ("2024-5-27,a,b,1,2", "date"),
        ("٢٠٢٤-٠٥-٢٧,a,b,1,2", "date"),
        ("2024-05-27,a,b,NaN,2", "value"),
        ("2024-05-27,a,b,1,inf", "value"),
        ("2024-05-27,a,b,1_000,2", "value"),
        ("2024-05-27,a,b,1,٣", "value"),
        ("2024-05-27,a,b,1,2\r\r", "value"),
    ],
)
def test_reasons(line, reason):
    assert records.parse(line, ",")[0] == reason


def test_values_and_separator():
    assert records.parse('2024-05-27;"a;b";k;"1,5";', ";")[0] == "value"
    assert records.parse('2024-05-27;"a;b";k;-1.5E2;', ";") == (None, D, "a;b", "k", -150.0, None)
    assert records.parse(' 2024-05-27 , a b , k , 1 , 2 ', ",") == (None, D, "a b", "k", 1.0, 2.0)


def brute_sound(line: str, sep: str) -> bool:
    """The grammar, character by character."""
    i, n = 0, len(line)
    while True:
        j = i
        while j < n and line[j] == " ":
            j += 1
        if j < n and line[j] == '"':
            j += 1
            while True:
                if j >= n:
                    return False
                if line[j] == '"':
                    if j + 1 < n and line[j + 1] == '"':
                        j += 2
                        continue
                    j += 1
                    break
                j += 1
            while j < n and line[j] == " ":
                j += 1
            if j < n and line[j] != sep:
                return False
        else:
            while j < n and line[j] != sep:
                if line[j] == '"':
                    return False
                j += 1
        if j >= n:
            return True
        i = j + 1


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet='ab", ;', max_size=14))
def test_quoting_against_brute_force(line):
    for sep in ",;":
        try:
            records.split_record(line, sep)
            ok = True
        except csv.Error:
            ok = False
        assert ok == brute_sound(line, sep), (line, sep)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='ab",; x', max_size=6), min_size=1, max_size=6))
def test_round_trip(fields):
    line = ",".join('"' + f.replace('"', '""') + '"' for f in fields)
    assert records.split_record(line, ",") == fields


def test_table(spark):
    rows = [(1, "f", 1, "date;driver_unique_name;driver_classification;driver_value;denorm"), (2, "f", 2, "2024-05-27;a;b;1;2"), (3, "f", 3, "2024-05-27,a,b,1,2"), (4, "g", 2, "2024-05-27,a,b,1,2"),
            (5, "f", 2, "2024-05-27;a;b;1;2"), (6, None, None, "2024-05-27,a,b,1,2"), (7, "g", 3, None), (8, "g", 4, "x" * 300_000)]
    df = spark.createDataFrame(rows, "line_id long, file_name string, line_no int, raw_line string").selectExpr("*", "1 AS _sep", "2 AS reason")
    got = {r.line_id: r.reason for r in records.parse_lines(df, ["line_id"]).collect()}
    assert got == {2: None, 3: "columns", 4: None, 5: None, 6: None, 7: "columns", 8: "columns"}
    assert {r.line_id for r in records.rejected(df, ["line_id"]).collect()} == {3, 7, 8}
    assert records.accepted(df, ["line_id"]).count() == 4
    assert records.parse_lines(df.limit(0), ["line_id"]).count() == 0


def test_line_breaks_beside_characters_of_private_use():
    line = '2024-05-27,a,"x\ue00a\ue00d\n\ue000\r\n",1,2'
    assert records.parse(line, ",") == (None, D, "a", "x\ue00a\ue00d\n\ue000\r\n", 1.0, 2.0)
