"""Event XML of shapes that real logs have."""

import pytest

from emberlog.functions.event_xml import event_parts
from emberlog.operators.normalize import map_fields, parse_event_xml


def properties(inner):
    found = event_parts(f"<Event xmlns='http://n'>{inner}</Event>")
    return found and dict(found["main"])


@pytest.mark.parametrize(
    "inner, want",
    [
        ("<UserData><A><B k='v'><![CDATA[a<b]]></B><C>num &#65; x</C></A></UserData>", {"b": "a<b", "c": "num A x"}),
        ("<EventData><Data Name='a'>1</Data><Param1>nested</Param1></EventData>", {"a": "1", "param1": "nested"}),
        ("<UserData><A><B><C>x</C><D><E>y</E></D></B></A></UserData>", {"b.c": "x", "b.d.e": "y", "c": "x", "d.e": "y", "e": "y"}),
        ("<EventData><Data>x</Data><Data/><Data>z</Data></EventData>", {"data0": "x", "data2": "z"}),
        ("<EventData><Data Name='K'>1</Data><Data Name='k'>2</Data></EventData><UserData><u><k>3</k><l>4</l></u></UserData>", {"k": "2", "l": "4"}),
        ("<EventData><Data Name='n'> keeps spaces </Data><Data Name='w'>  \n </Data></EventData>", {"n": " keeps spaces "}),
        ("<EventData><Data Name='m'>a<b>c</b>d</Data><Binary>AAEC</Binary></EventData>", {"m": "acd", "b": "c"}),
        ("<EventData><Data Name='c'>bell &#7; \x01</Data></EventData>", {"c": "bell � �"}),
        ("<System/>", {}),
    ],
)
def test_properties(inner, want):
    assert properties(inner) == want


@pytest.mark.parametrize("text", [None, "", "  ", "plain", "<Event>", "<!DOCTYPE a [<!ENTITY b 'c'>]><Event>&b;</Event>", "<Event>&nothing;</Event>"])
def test_texts_that_are_no_event(text):
    assert event_parts(text) is None


def test_rows_keep_what_the_parts_say(spark):
    deep = "<x>" * 500 + "y" + "</x>" * 500
    texts = [
        "<?xml version='1.0' encoding='utf-16'?><E><System><Provider Name=' p '/><EventID Qualifiers='7'>4688</EventID><EventRecordID> 12 </EventRecordID><Level>4</Level><Computer>h</Computer>"
        "<Security UserID='S-1'/></System><EventData><Data Name='NewProcessName'>C:\\a\\b.exe</Data><Data Name='SecurityUserId'>other</Data></EventData></E>",
        "broken", None, f"<E><UserData>{deep}</UserData></E>",
    ]
    d = parse_event_xml(spark.createDataFrame([(t, 1) for t in texts], "raw_xml string, properties int")).drop("time_created_utc")
    rows = d.orderBy("event_id").collect()
    assert [(r.event_id, r.event_record_id, r.level, r.computer_name, r.provider_name) for r in rows] == [(0, None, "Unknown", None, None), (4688, 12, "Information", "h", "p")]
    assert rows[1].properties == {"securityuserid": "S-1", "eventidqualifiers": "7", "newprocessname": "C:\\a\\b.exe"}
    mapped = map_fields(d.where("event_id = 4688"), {"CommandLine": ("NewProcessName",)}).first()
    assert (mapped.process_name, mapped.process_path, mapped.command_line) == ("b.exe", "C:\\a\\b.exe", "C:\\a\\b.exe")


def test_plain_documents_take_the_builtin_builder(monkeypatch):
    from emberlog.functions import event_xml as E

    plain = "<Event xmlns='x'><System><EventID Qualifiers='7'>5</EventID><Level> </Level></System><EventData><Data Name='A'>b</Data><Data/><Data> c </Data></EventData></Event>"
    want = (None, None, "5", "7", None, None, "", None, None, [("a", "b"), ("data1", " c ")])
    assert E._parts(plain) == want
    typed = "<!DOCTYPE Event [<!ENTITY e 'x'>]>" + plain
    assert E.event_parts(typed) is None
    assert E._parts(plain.replace(">b<", "><![CDATA[<!DOCTYPE x>]]><")) == (*want[:-1], [("a", "<!DOCTYPE x>"), ("data1", " c ")])

    def slow(*_):
        raise AssertionError("a builder of its own")

    monkeypatch.setattr(E, "_Builder", slow)
    assert E._parts(plain) == want
