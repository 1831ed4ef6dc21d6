import pytest

from spanloom.functions import scalar
from spanloom.operators.matchers import Matcher, java_regex
from spanloom.plans import language as L

ROUND_TRIP = [
    'prometheus{}', '{req.status="500"}', '{}', 'prometheus{a="b",c!="d"}', '{a=~"x.*",b!~"y|z"}', 'prometheus{}[5m]', '{a="b"}[1h30m]', 'rate(prometheus{}[5m])',
    'histogram_quantile(0.95, {a="b"})', 'heatmap(prometheus{})', 'sum by (a,b) (rate({}[5m]))', 'count without (pod) ({})', '{a="q\\"uote\\\\"}', '0.95',
]


@pytest.mark.parametrize("text", ROUND_TRIP)
def test_round_trip(text):
    node = L.parse(text)
    assert L.parse(str(node)) == node
    assert L.parse(node.pretty()) == node


@pytest.mark.parametrize("text", ["", "!", 'prometheus{"x', "heatmap(prometheus{}[5m])", "sum(", "{a=}", "rate(x[5m]", "{a='b'}", "x[5ms]", "x[1.5h]", "heatmap(rate(x[5m]))", "heatmap(sum(x))", "sum by a (x)", "{sum=\"1\"}", "x y"])
def test_refused(text):
    with pytest.raises(L.LanguageError):
        L.parse(text)


@pytest.mark.parametrize("text", ["rate(prometheus{})", "histogram_quantile({}, {})"])
def test_invalid(text):
    with pytest.raises(L.LanguageError):
        L.validate(L.parse(text))


@pytest.mark.parametrize("text", ["sum(rate({}[5m]))", "sum by (h) (rate({}[5m]))", "avg(rate({}[5m]))", "sum(heatmap({}))"])
def test_nested(text):
    L.validate(L.parse(text))
    assert L.result_type(L.parse(text)) == "matrix"


@pytest.mark.parametrize("text,kind", [("5s", "duration"), ("1h30m", "duration"), ("42", "number"), ("0.95", "number"), ("1e-1", "number"), ("2.5e2", "number"), ("a.b", "ident"), ("rate", "word")])
def test_tokens(text, kind):
    assert [t[0] for t in L.tokens(text + " # comment")] == [kind]


def test_normal_form():
    assert str(L.normalize(L.parse('sum by (b,a) ({z="1",a!="2",a="2"})'))) == 'sum by (a,b) ({a!="2",a="2",z="1"})'


def test_group_is_by_and_selector_parts():
    assert L.parse("sum group (a) ({})") == L.parse("sum by (a) ({})")
    s, length, heat = L.bare_selector(L.parse("sum(rate(x{a=\"b\"}[5m]))"))
    assert (str(s), length, heat) == ('x{a="b"}', "5m", False)
    assert L.bare_selector(L.parse("heatmap({})"))[2]
    seen = []
    L.walk(L.parse("sum(rate({}[5m]))"), lambda n: seen.append(type(n).__name__))
    assert seen == ["Aggregation", "Call", "Range", "Selector"]


def test_texts_at_the_edge():
    assert scalar.parse_duration("1h30m") == 5400 * scalar.SECOND and scalar.parse_duration("1d12h") == 129600 * scalar.SECOND
    for bad in ("", "5", "5ms", "1.5h"):
        with pytest.raises(ValueError):
            scalar.parse_duration(bad)
    assert scalar.parse_time("1700000000") == scalar.parse_time("2023-11-14T22:13:20Z") == scalar.parse_time(1700000000 * scalar.SECOND)
    assert scalar.parse_time("2023-11-14T23:13:20.5+01:00") == 1700000000 * scalar.SECOND + 500_000_000
    assert [scalar.default_step(m * 60 * scalar.SECOND) // scalar.SECOND for m in (5, 30, 120, 360, 1440, 10080, 20000)] == [5, 15, 30, 60, 300, 900, 3600]
    assert scalar.default_rate_step(1800 * scalar.SECOND, 300 * scalar.SECOND) == 75 * scalar.SECOND


@pytest.mark.parametrize("bad", ["a(?=b)", "(?<!x)a", r"(a)\1", "a(", "[z"])
def test_regexes_refused(bad):
    with pytest.raises(ValueError):
        Matcher("a", "=~", bad)


def test_regex_dialect():
    assert java_regex("(?P<n>a)") == r"(?d)\A(?:(?<n>a))\z"


ACCEPTED = {
    r"[[:alpha:]]+": (["abc"], ["a1", "[:a"]), r"[[:^digit:]x]": (["a", "x"], ["1"]), r"[a&&b]+": (["a&b"], ["c"]), r"\pL\p{Lu}\PN": (["aBc"], ["ab1", "1Ab"]), r"\p{Greek}+": (["αβ"], ["ab"]), r"\p{^L}": (["1"], ["a"]),
    r"\Qa.b\E+": (["a.b", "a.bb"], ["axb"]), r"a\z": (["a"], ["a\n"]), r"a$": (["a"], ["a\n"]), r"(?m)a$\nb": (["a\nb"], ["ab"]), r"x{,2}": (["x{,2}"], ["xx"]), r"[]a]+": (["]a"], ["b"]), r"[^]a]": (["b"], ["]"]),
    r"[a-]+": (["a-"], ["b"]), r"(?i)É": (["é", "É"], ["e"]), r"(?U)a+": (["aa"], [""]), r"(?s).": (["\n"], [""]), r".": (["\r"], ["\n"]), r"a|b|": (["", "a"], ["c"]), r"\x41\x{1F600}\101": (["A\U0001F600A"], ["A"]),
    r"\v": (["\x0b"], ["\n"]), r"\s": ([" "], ["\x0b"]), r"[\S]": (["\x0b"], [" "]), r"[[]": (["["], ["a"]), r"(?P<a_b>x)y": (["xy"], ["x"]), r"\bé\b": ([], ["é"]), r"[\d-]+": (["1-2"], ["a"]), r"\-\_": (["-_"], ["-"]), r"(?i:a)b": (["Ab"], ["AB"]),
}


def test_regexes_mean_what_they_say(spark):
    rows = [(p, t, want) for p, (yes, no) in ACCEPTED.items() for want, texts in ((True, yes), (False, no)) for t in texts]
    from pyspark.sql import functions as F

    for p, t, want in rows:
        got = spark.range(1).select(F.lit(t).rlike(java_regex(p))).first()[0]
        assert got == want, (p, t)


@pytest.mark.parametrize("bad", ["a++", "a**", "a{2}{3}", "*a", "(*a)", "a|*", r"\Z", r"\e", r"[a-\d]", "[z-a]", "(?x)a", "a)", "\\", "a{1001}", "[[:foo:]]", "(?P<a>x)(?P<a>y)", "(?>a)", "(?)"])
def test_more_regexes_refused(bad):
    with pytest.raises(ValueError):
        java_regex(bad)


def test_strings_and_extensions():
    assert L.tokens(r'"\a\x41\101\u00e9\U0001F600\"\\"') == [("string", '\aAA\u00e9\U0001F600"\\')]
    for bad in (r'"\q"', r'"\x4"', r'"\ud800"', r'"\8"', "\"\\'\""):
        with pytest.raises(L.LanguageError):
            L.tokens(bad)
    with pytest.raises(ValueError):
        L.register("rate", None)
    L.register("everything", lambda planner, args: planner.plan(args[0]), "vector")
    try:
        node = L.parse("sum(everything({}))")
        assert node.arg == L.Call("everything", (L.Selector(),)) and L.result_type(node) == "vector" and L.parse("everything{}").metric == "everything"
    finally:
        del L.EXTENSIONS["everything"]
