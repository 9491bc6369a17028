import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamcontract.functions import ecma, formats, idn, pointer, punycode

FORMATS = {
    "email": (["joe@example.com", "te~st@x.org", '"a b"@x.com', "a@[127.0.0.1]"], ["2962", ".a@x.com", "a..b@x.com", "a@[1.1.1.300]"]),
    "idn-email": (["실례@실례.테스트"], ["a@b@c.de", "x"]),
    "hostname": (["www.example.com", "xn--4gbwdl.xn--wgbh1c"], ["-a.com", "a" * 64, "a_b", "", "xn--X"]),
    "idn-hostname": (["실례.테스트", "bücher.example"], ["〮실례", "-a"]),
    "ipv4": (["1.2.3.4"], ["1.2.3", "256.1.1.1", "01.1.1.1", "1.1.1.1 "]),
    "ipv6": (["::1", "::", "1::d6:192.168.0.1"], ["12345::", "::1%eth0", "1:2:3:4:5:6:7:8:9", ":2:3:4:5:6:7:8"]),
    "uri": (["http://a.b/c?d=e#f", "urn:x:y", "http://[::1]/"], ["//a", "a b", "http://a/ b", "\\\\x"]),
    "uri-reference": (["/a", "#f", "//h"], ["\\\\x", "#a\\b"]),
    "iri": (["http://ƒøø.ßår/"], ["/abc", "http://x/ y"]),
    "uuid": (["2EB8AA08-aa98-11ea-b4aa-73b441d16380"], ["2eb8aa08aa9811eab4aa73b441d16380"]),
    "date": (["2020-02-29", "0000-01-01"], ["2021-02-29", "1963-6-19", "2020-01-32"]),
    "time": (["12:00:00Z", "23:59:60Z", "01:29:60+01:30", "12:00:00.5+05:00"], ["12:00:00", "22:59:60Z", "24:00:00Z", "12:00:00+24:00"]),
    "date-time": (["1963-06-19T08:30:06.28Z", "1998-12-31T23:59:60Z"], ["1963-06-19 08:30:06Z", "1990-02-31T15:59:59Z"]),
    "duration": (["P4DT12H30M5S", "P2W", "PT1M"], ["P", "PT", "P1D2H", "P2Y1W"]),
    "json-pointer": (["", "/a~0b", "/"], ["a", "/a~", "/~2"]),
    "relative-json-pointer": (["0", "1/a", "0#"], ["01", "/a", "-1", "0##"]),
    "regex": (["^a+$", "\\p{L}"], ["(", "\\Z", "a{2,1}"]),
    "uri-template": (["/a/{b}", "{?x,y*}"], ["/a/{b", "/a b"]),
    "who-knows": (["x"], []),
}


@pytest.mark.parametrize("name", FORMATS)
def test_formats(spark, name):
    good, bad = FORMATS[name]
    assert [formats.check(name, s) for s in good + bad] == [True] * len(good) + [False] * len(bad)
    if formats.column(name, F.lit("")) is not None:
        got = spark.range(1).select(*[formats.column(name, F.lit(s)).alias(f"c{i}") for i, s in enumerate(good + bad)]).first()
        assert list(got) == [True] * len(good) + [False] * len(bad)


# pattern, flags, text, matches
REGEX = [
    ("a$", "", "a\n", False), ("a$", "m", "a\n", True), ("^b", "m", "a\nb", True), ("a.b", "", "a\u0085b", True), ("a.b", "", "a b", False), ("a.b", "s", "a\nb", True),
    ("^\\s$", "", " ", True), ("^\\s$", "", "﻿", True), ("\\bé", "", "é", False), ("^[a&&b]$", "", "&", True), ("\\d", "", "٣", False), ("^\\u{1F432}$", "u", "🐲", True),
    ("^.$", "", "🐲", True), ("(?<=a)b", "", "ab", True), ("(?<x>a)\\k<x>", "", "aa", True), ("^\\cA$", "", "\x01", True), ("^[^]$", "", "\n", True), ("[]", "", "a", False), ("\\/", "", "/", True), ("\\p{Letter}", "u", "é", True), ("A", "i", "a", True), ("^\\W$", "", "é", True), ("[\\d-x]", "", "-", True),
]


def test_regex_hosts_agree(spark):
    columns = []
    for i, (p, f, t, want) in enumerate(REGEX):
        assert ecma.compile_regex(p, f).test(t) is want, p
        columns.append(ecma.test_column(F.lit(t), p, f).alias(f"c{i}"))
    assert list(spark.range(1).select(*columns).first()) == [w for *_, w in REGEX]


@pytest.mark.parametrize("pattern", ["a++a", "a*+", "(", ")", "[b-a]", "\\Z", "\\R", "(?P<x>a)", "a{2,1}", "\\k<x>", "*a", "(?>a)", "\\"])
def test_other_syntax_is_refused(pattern):
    with pytest.raises(ecma.RegexError):
        ecma.compile_regex(pattern, "u")


def test_unset_group_is_empty():
    assert ecma.compile_regex("^(a)?b\\1$").test("b")
    with pytest.raises(ecma.NotTranslatable):
        ecma.translate("^(a)?b\\1$")


def test_matches(spark):
    r = ecma.compile_regex("(a)(x)?", "g")
    assert r.match("ba") == {"start": 1, "end": 2, "text": "a", "captures": [{"start": 1, "end": 2, "text": "a"}, {"start": -1, "end": -1, "text": None}]}
    assert [m["text"] for m in r.match_all("abaxa")] == ["a", "ax", "a"]
    assert [m["start"] for m in ecma.compile_regex("x*").match_all("ab")] == [0, 1]
    assert ecma.compile_regex("x*").match_all("") == []
    assert r.capture_count == 3
    df = spark.createDataFrame([("a1b22",), ("",), (None,)], "t string")
    got = ecma.with_match_all(ecma.with_match(df, "t", "\\d+"), "t", "\\d+").collect()
    assert got[0].match.start == 1
    assert [m.text for m in got[0].matches] == ["1", "22"]
    assert got[1].match is None
    assert got[1].matches == []
    assert got[2].match is None


@given(st.lists(st.text()))
def test_pointer_round_trip(segments):
    assert pointer.parse_pointer(pointer.render_pointer([s.replace("%", "") for s in segments])) == tuple(s.replace("%", "") for s in segments)


def test_pointer():
    assert pointer.render_pointer(("a/b", "m~n", "")) == "/a~1b/m~0n/"
    assert pointer.parse_pointer("#/a%20b") == ("a b",)
    assert pointer.resolve({"a": [1, {"b": 2}]}, "/a/1/b") == 2
    for bad in ("/a/9", "/a/01", "/x"):
        with pytest.raises(KeyError):
            pointer.resolve({"a": [1, 2]}, bad)
    with pytest.raises(ValueError, match="pointer"):
        pointer.parse_pointer("a")


@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=30))
def test_punycode_round_trip(text):
    p = punycode.encode(text)
    assert punycode.decode(p) == text
    assert p == text.encode("punycode").decode()


def test_punycode_vectors():
    assert punycode.encode("münchen") == "mnchen-3ya"
    assert punycode.encode("example") == "example-"
    assert punycode.encode("") == ""
    assert punycode.decode("test-") == "test"
    for bad in ("a-b-c-!", "é", "a-9999999999"):
        with pytest.raises(punycode.PunycodeError):
            punycode.decode(bad)


def test_idn(spark):
    assert idn.to_ascii("München.Example") == "xn--mnchen-3ya.example"
    assert idn.to_unicode("xn--mnchen-3ya.example") == "münchen.example"
    assert idn.to_ascii("a。b") == "a.b"
    kinds = {"": "EmptyLabel", "a..b": "EmptyLabel", "-a": "InvalidHyphen", "ab--c": "InvalidHyphen", "a" * 64: "LabelTooLong", "́a": "LeadingCombiningMark", "a·b": "ContextRule", "ـa": "DisallowedCodePoint", "אa": "BidiRule", "xn--99999999": "InvalidPunycode", "xn--abc-": "InvalidPunycode", ".".join(["a" * 63] * 4): "DomainTooLong"}
    for text, kind in kinds.items():
        with pytest.raises(idn.IdnError) as e:
            idn.to_ascii(text)
        assert e.value.kind == kind, text
    for good in ("l·l", "͵α", "א׳", "ア・", "क्‍", "אב", "ب1"):
        assert idn.validate_label(good) == good
    df = spark.createDataFrame([("bücher.de",), ("-",), (None,), ("bücher.de",)], "d string")
    got = [(r.d, r.ascii.value, r.ascii.error) for r in idn.with_ascii(df, "d").collect()]
    assert sorted(got, key=str) == [("-", None, "InvalidHyphen"), ("bücher.de", "xn--bcher-kva.de", None), ("bücher.de", "xn--bcher-kva.de", None), (None, None, None)]
