"""Operators on small tables, against goldens and plain loops."""
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from maskweave.functions import labels as L
from maskweave.functions import spans as S
from maskweave.functions import text as T
from maskweave.operators import fragments, profiles, ranks, report, rules, session, sse, stateless
from maskweave.operators.chunks import owned_chunks
from maskweave.sources import settings, traffic, vault
from maskweave.streaming import holdback


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def spans(spark, *items):
    return F.array(*[F.struct(F.lit("t").alias("type"), F.lit("").alias("text"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).cast("float").alias("confidence")) for a, b, c in items])


@pytest.mark.parametrize("items, merged, confident", [
    ([(0, 4, .95), (2, 9, .5), (8, 12, .99)], [(2, 9)], []),
    ([(0, 5, 1), (0, 3, 1)], [(0, 5)], [(0, 5)]),
    ([(0, 3, 1), (3, 6, 1)], [(0, 3), (3, 6)], [(0, 3), (3, 6)]),
    ([(0, 4, 1), (2, 6, 1)], [(0, 4)], [(0, 4)]),
])
def test_merge_overlaps(spark, items, merged, confident):
    m = S.merge_overlaps(spans(spark, *items))
    row = spark.range(1).select(m.alias("m"), S.confident(m, 0.9).alias("c")).first()
    assert [(s.start, s.end) for s in row.m] == merged and [(s.start, s.end) for s in row.c] == confident


def test_merge_against_a_loop(spark):
    rnd = random.Random(1)
    rows = [([{"type": "t", "text": "", "start": (a := rnd.randint(0, 12)), "end": a + rnd.randint(1, 6), "confidence": 1.0} for _ in range(rnd.randint(0, 6))],) for _ in range(200)]
    got = values(spark, S.merge_overlaps(F.col("s")), rows, f"s {S.SPANS}")
    for (items,), out in zip(rows, got):
        kept = []
        for s in sorted(items, key=lambda s: (s["start"], -s["end"])):
            hit = next((i for i, k in enumerate(kept) if s["start"] < k["end"] and s["end"] > k["start"]), None)
            if hit is None:
                kept.append(s)
            elif s["end"] - s["start"] > kept[hit]["end"] - kept[hit]["start"]:
                kept[hit] = s
        assert [(s["start"], s["end"]) for s in kept] == [(s.start, s.end) for s in out]


def test_pattern_spans_places(spark):
    rows = [("ab12c345",), ("",), ("12",), ("x",), ("é12😀3",), (None,)]
    got = values(spark, S.pattern_spans(F.col("t"), "[0-9]+", "n", 0.5), rows, "t string")
    for (t,), out in zip(rows, got):
        assert [(s.text, s.start, s.end) for s in out] == [(m[0], *m.span()) for m in re.finditer("[0-9]+", t or "")]


def test_placeholder_and_summary(spark):
    row = spark.createDataFrame([("mail a@b.de or c@d.fr",)], "t string").withColumn("s", rules.detect(F.col("t"))).select(S.redact_placeholders(F.col("t"), F.col("s")), S.summary(F.col("s")), S.describe(F.col("s"))).first()
    assert row[0] == "mail [REDACTED PRIVATE EMAIL] or [REDACTED PRIVATE EMAIL]" and row[1] == "2 items redacted" and row[2] == ["private_email: a@b.de", "private_email: c@d.fr"]


def test_detect_filters_types_then_merges_then_threshold(spark):
    rows = [("call 555-1234",), ("date 2024-01-02",)]
    assert [len(x) for x in values(spark, rules.detect(F.col("t")), rows, "t string")] == [0, 1]
    assert [len(x) for x in values(spark, rules.detect(F.col("t"), ("private_phone",), 0.5), rows, "t string")] == [1, 0]
    assert [len(x) for x in values(spark, rules.detect(F.col("t"), ()), rows, "t string")] == [0, 0]


def test_regex_redaction(spark):
    patterns = stateless.usable_patterns(spark, [stateless.Pattern(r"\bPN-\d{5}\b"), stateless.Pattern("(", True), stateless.Pattern("  "), stateless.Pattern("x", False)])
    assert patterns == [r"\bPN-\d{5}\b"]
    rows = [("The part number is pn-12345.",), ("none",), (None,)]
    got = values(spark, stateless.redact_patterns(F.col("t"), patterns)["text"], rows, "t string")
    assert got == ["The part number is <<REDACTED_REGEX_0>>.", "none", None]
    spread = values(spark, stateless.redact_patterns(F.col("t"), [r"\bfoo\b"])["text"], [("foo foobar",)], "t string")
    assert spread == ["<<REDACTED_REGEX_0>> <<REDACTED_REGEX_0>>bar"]
    assert values(spark, stateless.redact_patterns(F.col("t"), ["a*"])["text"], [("bab",)], "t string") == ["b<<REDACTED_REGEX_0>>b"]


def test_labels_are_protected(spark):
    text = "<<REDACTED_PII_0>> 0 red"
    row = spark.createDataFrame([(text,)], "t string").select(stateless.redact_patterns(F.col("t"), [r"\d+", "red"])["text"], stateless.redact_patterns(F.col("t"), [r"\d+"], protect=False)["text"]).first()
    assert row[0] == "<<REDACTED_PII_0>> <<REDACTED_REGEX_1>> <<REDACTED_REGEX_0>>"
    assert row[1] == "<<REDACTED_PII_<<REDACTED_REGEX_0>>>> <<REDACTED_REGEX_0>> red"
    esc = spark.createDataFrame([(text,)], "t string").select(L.escape_labels(F.col("t")), L.unescape_labels(L.escape_labels(F.col("t")))).first()
    assert not re.search(r"<<REDACTED_PII_\d", esc[0]) and esc[1] == text


def test_keywords(spark):
    words = stateless.usable_keywords([stateless.Keyword("Chimera"), stateless.Keyword(" Project Chimera "), stateless.Keyword("x", enabled=False), stateless.Keyword("  ")])
    assert words == [("Project Chimera", False), ("Chimera", False)]
    got = values(spark, stateless.redact_keywords(F.col("t"), words), [("Project Chimera and Chimera",), ("project chimera",), (None,)], "t string")
    assert got == ["<<REDACTED_KEYWORD_0>> and <<REDACTED_KEYWORD_1>>", "project chimera", None]
    ci = stateless.usable_keywords([stateless.Keyword("a.b$\\E"), stateless.Keyword("a.b$\\E", case_sensitive=False)])
    assert ci == [("a.b$\\E", True)]
    got = values(spark, stateless.redact_keywords(F.col("t"), ci), [("A.B$\\e axb",)], "t string")
    assert got == ["<<REDACTED_KEYWORD_0>> axb"]
    pairs = stateless.keyword_pairs([("Project Chimera", True)])
    back = values(spark, L.unredact(stateless.redact_keywords(F.col("t"), [("Project Chimera", True)]), pairs), [("The plan is project chimera.",)], "t string")
    assert back == ["The plan is Project Chimera."]  # as configured


def _simulate(rows, patterns, email):
    """The session pipeline as a plain loop over fragments."""
    out = {}
    state = {}
    for s, q, t in sorted(rows, key=lambda r: (r[0], r[1])):
        st = state.setdefault(s, {"pii": {}, "regex": {}, "cache": {}})
        if t in st["cache"]:
            out[s, q] = st["cache"][t]
            continue
        body = t
        for m in reversed(list(re.finditer(email, t))):
            lab = st["pii"].setdefault(m[0], f"<<REDACTED_PII_{len(st['pii'])}>>")
            body = body[: m.start()] + lab + body[m.end():]

        def gaps(x, f):
            parts = re.split(r"(<<REDACTED_(?:PII|REGEX|KEYWORD)_\d+>>)", x)
            return "".join(p if i % 2 else f(p) for i, p in enumerate(parts))

        found = set()
        gaps(body, lambda g: [found.add(m[0]) for p in patterns for m in re.finditer("(?i)" + p, g) if m[0]] and "" or "")
        for o in sorted(found, key=lambda o: (-len(o), o)):
            lab = st["regex"].setdefault(o, f"<<REDACTED_REGEX_{len(st['regex'])}>>")
            body = gaps(body, lambda g: g.replace(o, lab))
        known = {**{o: x for o, x in st["regex"].items()}, **st["pii"]}
        for o in sorted(known, key=lambda o: (-len(o), o)):
            body = gaps(body, lambda g: g.replace(o, known[o]))
        st["cache"][t] = out[s, q] = body
    return out


@pytest.mark.parametrize(("originals", "slice_bytes"), [(session.ORIGINALS, session.SLICE_BYTES), (3, 60), (1, 1)])
def test_sessions_against_a_loop(spark, monkeypatch, originals, slice_bytes):
    monkeypatch.setattr(session, "ORIGINALS", originals)
    monkeypatch.setattr(session, "SLICE_BYTES", slice_bytes)
    rnd = random.Random(7)
    pieces = ["a1", "b22", "x@y.de", "zz@q.fr", "cat", "CAT", "dog", "a", "22", " ", "1"]
    rows = [(f"s{i % 5}", i, " ".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 8)))) for i in range(60)]
    rows += [("s0", 100 + i, rows[i][2]) for i in range(10)]
    email, patterns = r"[a-z]+@[a-z]+\.[a-z]{2}", [r"[ab]\d+", "cat", r"\d+"]
    df = spark.createDataFrame(rows, "session string, seq long, text string")
    got, dictionary = session.redact_sessions(df, S.pattern_spans(F.col("text"), email, "private_email", 1.0), patterns)
    got.cache()
    expected = _simulate(rows, patterns, email)
    assert {(r.session, r.seq): r.redacted_text for r in got.collect()} == expected
    back = session.restore_sessions(got, dictionary)
    assert {(r.session, r.seq): r.restored_text for r in back.collect()} == {(s, q): t for s, q, t in rows}
    n = {(r.session, r.seq, r.kind): r.n_labels for r in session.request_counts(got, ["session", "seq"]).collect()}
    for (s, q), t in expected.items():
        for kind in ("PII", "REGEX"):
            assert n.get((s, q, kind), 0) == len(set(re.findall(rf"<<REDACTED_{kind}_\d+>>", t)))


def test_pii_numbers_run_from_the_right(spark):
    df = spark.createDataFrame([("s", 1, "a@b.de to c@d.de"), ("s", 2, "c@d.de e@f.de")], "session string, seq long, text string")
    got, _ = session.redact_sessions(df, rules.candidates(F.col("text"), ("private_email",)))
    assert sorted(r.redacted_text for r in got.collect()) == ["<<REDACTED_PII_0>> <<REDACTED_PII_2>>", "<<REDACTED_PII_1>> to <<REDACTED_PII_0>>"]


def test_empty_sessions(spark):
    df = spark.createDataFrame([], "session string, seq long, text string")
    got, d = session.redact_sessions(df, rules.detect(F.col("text")), ["x"], [("k", False)])
    assert got.count() == 0 and d.count() == 0


def test_epochs(spark):
    df = spark.createDataFrame([("p", i, h) for i, h in enumerate("aabba")], "p string, n int, h string")
    assert [r.epoch for r in session.session_epochs(df, "p", "n", "h").orderBy("n").collect()] == [0, 0, 1, 1, 2]


BODY = {"model": "m", "system": "kept", "messages": [{"role": "u", "content": "A"}, {"content": [{"type": "image"}, {"type": "text", "text": "B"}, {"type": "tool_result", "text": "no"}]}, {"content": None, "tool_calls": [{"function": {"name": "f", "arguments": "{}"}}]}]}


def test_fragments(spark):
    df = spark.createDataFrame([(1, json.dumps(BODY)), (2, '{"input":"x"}'), (3, "no json"), (4, '{"messages":[]}'), (5, '{"messages":[{"content":"[1]"}],"stream":true}')], "id long, body string")
    rows = fragments.exploded(df).orderBy("id", "frag_seq").collect()
    assert [(r.id, r.text) for r in rows] == [(1, "A"), (1, "B"), (1, "{}"), (1, "f"), (2, '{"input":"x"}'), (3, "no json"), (5, "[1]")]
    changed = fragments.exploded(df).withColumn("text", F.concat(F.lit("<"), "text", F.lit(">")))
    back = {r.id: r.body for r in fragments.reassembled(changed, ["id"]).collect()}
    one = json.loads(back[1])
    assert one["messages"][0]["content"] == "<A>" and one["messages"][1]["content"][1]["text"] == "<B>" and one["messages"][2]["tool_calls"][0]["function"] == {"arguments": "<{}>", "name": "<f>"}
    assert back[2] == '<{"input":"x"}>' and back[1].index('"messages"') < back[1].index('"model"')
    assert values(spark, fragments.wants_stream(F.col("b")), [('{"stream":true}',), ("{}",), ("x",)], "b string") == [True, False, False]


def test_redistributed_is_the_plain_one(spark):
    from maskweave.functions.events import redistribute

    rnd = random.Random(3)
    rows = [("abcdefghijklmnopq"[: rnd.randint(0, 17)], [rnd.randint(0, 5) for _ in range(rnd.randint(1, 6))]) for _ in range(200)]
    got = values(spark, sse.redistributed(F.col("t"), F.col("n")), rows, "t string, n array<bigint>")
    assert got == [redistribute(t, n) for t, n in rows]


def test_chunks(spark):
    rows = [(10,), (11,), (25,), (0,), (None,)]
    got = values(spark, owned_chunks(F.col("n"), 10, 2), rows, "n long")
    assert [[(c.start_at, c.end_at, c.owned_end) for c in x] for x in got] == [[(0, 10, 10)], [(0, 10, 8), (8, 11, 11)], [(0, 10, 8), (8, 18, 16), (16, 25, 25)], [], []]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.trim_ws(F.lit(" \t\f\u000bx y\r\n "))) == "x y"
    assert one(T.split_on(F.lit("a,b,"), ",")) == ["a", "b"] and one(T.split_on(F.lit(""), ",")) == [] and one(T.split_on(F.lit(",a"), ",")) == ["", "a"]
    assert one(T.replace_ignoring_case(F.lit("aAb"), F.lit("A"), F.lit("$1"))) == "$1$1b" and one(T.replace_ignoring_case(F.lit("x"), F.lit(""), F.lit("y"))) == "x"
    assert one(T.format_size(F.lit(1536))) == "1.5 KB" and one(T.format_size(F.lit(5 * 1024**4))) == "5120.0 GB"
    assert one(T.is_rtl(F.lit("ar-EG"))) and not one(T.is_rtl(F.lit("arx")))
    assert one(T.language_matches(F.lit("de-DE"), F.lit("de"))) and not one(T.language_matches(F.lit("des"), F.lit("de")))
    assert one(T.endpoint(F.lit("/api/V1/Messages?x"))) == "/v1/messages" and one(T.endpoint(F.lit("/Foo"))) == "/foo"
    assert one(T.preview(F.lit("abcdef"), 3)) == "abc...[truncated]" and one(T.strip_leading_blank(F.lit(" \r\n{"))) == "{"
    assert one(T.route_params(F.lit("/updates/win/x"), "/updates/:channel/:file?")) == {"channel": "win", "file": "x"}
    assert one(T.route_params(F.lit("/updates/win"), "/updates/:channel/:file?")) == {"channel": "win"} and one(T.route_params(F.lit("/u/win"), "/updates/:channel")) is None


def test_reports(spark):
    df = spark.createDataFrame([("p" if i % 2 else "q", i) for i in range(20)], "alias string, n int")
    assert sorted(r.n for r in report.last_per_key(df, "alias", "n", 3).collect()) == [14, 15, 16, 17, 18, 19]
    assert [r.n for r in report.recent(df, "n", 4).orderBy("place").collect()] == [16, 17, 18, 19]
    assert [r.n for r in report.of_alias(df, "q", "n", 9, ring=5).orderBy("place").collect()] == [16, 18]


def test_profiles(spark):
    requests = spark.createDataFrame([(1, 80), (2, 81)], "id long, port int")
    p = spark.createDataFrame([("x", 80, 1, False), ("y", 80, 2, True), ("z", 80, 3, True)], "alias string, port int, place int, enabled boolean")
    assert [(r.id, r.alias) for r in profiles.bind(requests, p).orderBy("id").collect()] == [(1, "y"), (2, None)]


def test_vault(spark):
    salt, wrapped = vault.wrap(spark, b"d" * 32, "pw")
    assert vault.unwrap(spark, wrapped, "pw", salt) == b"d" * 32 and vault.unwrap(spark, wrapped, "no", salt) is None
    sealed = vault.sealed(spark.createDataFrame([(1, "é"), (2, None), (3, "")], "id long, s string"), ["s"], b"d" * 32)
    assert [r[0] for r in sealed.orderBy("id").select(vault.opened(F.col("s"), F.lit(b"d" * 32))).collect()] == ["é", None, ""]
    assert {r.s._mode for r in sealed.collect() if r.s} == {vault.MODE}


def test_keys_stay_out_of_plans(spark):
    key = b"PlainKeyBytesThatNoPlanMayShow!!"
    rows = spark.createDataFrame([(1, "é")], "id long, s string")
    packed = rows.select(F.aes_encrypt(F.col("s").cast("binary"), vault.key_column(spark, key), F.lit("GCM")).alias("p"))
    shut = vault.sealed(rows, ["s"], key)
    back = shut.select(vault.opened(F.col("s"), vault.key_column(spark, key)).alias("s"))
    assert back.first().s == "é" and packed.count() == 1
    for df in (packed, shut, back):
        plan = df._jdf.queryExecution()
        text = plan.toString()
        assert not any(shown in text for shown in (key.decode(), key.hex(), key.hex().upper(), str(list(key))[1:-1]))


def test_settings_are_sealed_on_save(spark, tmp_path):
    docs = [
        {"profiles": [{"id": "a", "api_key": "sk-1é", "keywords": [{"text": "x"}], "regex_patterns": []}, {"id": "b", "api_key": ""}, "odd"], "app_language": "de"},
        {"profiles": []}, {}, {"profiles": [{"keywords": "no list", "api_key": 5}]},
    ]
    rows = spark.createDataFrame([(json.dumps(d),) for d in docs] + [("{broken",)], "value string")
    settings.write(rows, str(tmp_path / "s"), key=b"k" * 32)
    text = "".join(p.read_text() for p in (tmp_path / "s").glob("part-*"))
    assert "sk-1" not in text and text.count(vault.MODE) == 4 and "{broken" in text
    back = [r.value for r in settings.read_lines(spark, str(tmp_path / "s"), b"k" * 32).collect()]
    assert sorted(json.dumps(json.loads(v), sort_keys=True) for v in back if v != "{broken") == sorted(json.dumps(d, sort_keys=True) for d in docs)
    shut = [json.loads(r.value) for r in settings.read_lines(spark, str(tmp_path / "s"), b"z" * 32).collect() if "sk" not in r.value and "app_language" in r.value]
    assert set(shut[0]["profiles"][0]["api_key"]) == {"_enc", "_mode", "_iv", "_tag"}
    settings.write(rows.limit(1), str(tmp_path / "one"), key=b"k" * 32)
    (read,) = settings.read(spark, str(tmp_path / "one" / "part-*"), False, b"k" * 32).collect()
    assert json.loads(read.value)["profiles"] == docs[0]["profiles"] and not read.corrupt


def test_settings_quarantine(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"verbose_logging": true}')
    (tmp_path / "b.json").write_text('{"start')
    rows = {r.path.rsplit("/", 1)[1]: (r.corrupt, json.loads(r.value)) for r in settings.read(spark, str(tmp_path / "*.json")).collect()}
    assert rows["a.json"] == (False, {"app_language": "", "logging_enabled": True, "settings_version": 2, "start_on_boot": True})
    assert rows["b.json"] == (True, {"app_language": "", "logging_enabled": False, "settings_version": 2, "start_on_boot": True})
    assert [p.read_text() for p in tmp_path.glob("b.json.corrupt-*.bak")] == ['{"start']


def test_requests(spark):
    raw = ["GET / HTTP/1.1\r\nA:  1\r\nA: 2\r\nno colon\r\n\r\nbody", "broken", "POST /x HTTP/1.0\r\nContent-Length: 2\r\n\r\nabcd"]
    got = values(spark, traffic.parsed_request(F.col("r")), [(r,) for r in raw], "r string")
    assert (got[0].method, got[0].path, got[0].headers, got[0].body) == ("GET", "/", {"A": "2"}, "") and got[1] is None and got[2].body == "ab"


def test_logs_and_messages(spark, tmp_path):
    logs = spark.createDataFrame([("UserToProxy", "abc"), ("ProxyToLLM", "abc")], "direction string, details string")
    traffic.append_log(logs, str(tmp_path / "log"), "s1")
    assert {(r.direction, r.details, r.session) for r in spark.read.json(str(tmp_path / "log")).collect()} == {("UserToProxy", "3 bytes (body omitted)", "s1"), ("ProxyToLLM", "abc", "s1")}
    (tmp_path / "m.xml").write_text('<root><data name="k"><value>Hello {0}</value></data><data name="l"><value>x</value></data></root>')
    assert {(r.lang, r.key, r.value) for r in traffic.messages(spark, str(tmp_path / "m.xml"), "en").collect()} == {("en", "k", "Hello {0}"), ("en", "l", "x")}


def test_stream_restores_split_labels(spark):
    turns = spark.createDataFrame([(1, 0, "secretword in a longer text with secretword"), (1, 1, "ab"), (2, 0, "another turn")], "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn): r.content for r in holdback.run_once(spark, turns).collect()}
    assert got == {(r.conv_id, r.turn): r.text for r in turns.collect()}


def test_plans_have_no_python_on_the_pattern_path(spark):
    import __spark_entry__

    q = __spark_entry__.queries()
    for name in ("regex_redact_email", "keyword_redact_ci", "rule_detect_all", "sse_parse", "fragment_explode"):
        plan = q[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_every_sql_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_numbers_of_other_languages(spark):
    from maskweave.functions import text as T

    df = spark.createDataFrame([("1.234,5",), ("-2.5 kg",), ("x",), (None,), (" 7",)], "s string")
    assert [r[0] for r in df.select(T.parse_float(F.col("s"))).collect()] == [1.234, -2.5, 0.0, 0.0, 7.0]
    assert [r[0] for r in df.select(T.parse_float(F.replace("s", F.lit("."), F.lit(",")), comma=True)).collect()] == [1.234, -2.5, 0.0, 0.0, 7.0]
    assert df.select(T.format_float(F.lit(2.345), 1, comma=True)).first()[0] == "2,3"


def test_logging_switches_and_templates(spark):
    from maskweave.functions import spans as S
    from maskweave.operators import report

    logs = spark.createDataFrame([("UserToProxy", "secret"), ("ProxyToLLM", "x")], "direction string, details string")
    assert report.logged(logs, False, True).count() == 0
    assert [r.details for r in report.logged(logs, True, True).collect()] == ["secret", "x"]
    assert [r.details for r in report.logged(logs, True, False).collect()] == ["6 bytes (body omitted)", "x"]
    spans = F.array(F.struct(F.lit("secret").alias("type"), F.lit("b").alias("text"), F.lit(2).alias("start"), F.lit(3).alias("end"), F.lit(1.0).cast("float").alias("confidence")))
    t = spark.createDataFrame([("a b c",)], "t string")
    assert t.select(S.redact_placeholders(F.col("t"), spans), S.redact_placeholders(F.col("t"), spans, "***")).first()[:] == ("a [REDACTED SECRET] c", "a *** c")
    seen, metrics = report.observed(t, "step", "t")
    assert seen.count() == 1 and metrics.get == {"n_rows": 1, "n_bytes": 5}


def test_a_profile_switches_stages(spark):
    from maskweave.operators import session

    rows = spark.createDataFrame([("s", 1, "mail a@b.de PN-12345 Chimera"), ("s", 2, "PN-12345")], "session string, seq long, text string")
    profile = {"use_openai_model": True, "enabled_pii_types": ["private_email"], "regex_patterns": [{"pattern": r"PN-\d{5}"}, {"pattern": "(", "enabled": True}, {"pattern": "mail", "enabled": False}], "keywords": [{"text": "chimera", "case_sensitive": False}]}
    redacted = lambda p: sorted(r.redacted_text for r in session.redact_for_profile(rows, p)[0].collect())
    assert redacted(profile) == ["<<REDACTED_REGEX_0>>", "mail <<REDACTED_PII_0>> <<REDACTED_REGEX_0>> <<REDACTED_KEYWORD_0>>"]
    assert redacted(profile | {"use_openai_model": False}) == ["<<REDACTED_REGEX_0>>", "mail a@b.de <<REDACTED_REGEX_0>> <<REDACTED_KEYWORD_0>>"]
    assert redacted({"use_openai_model": False}) == sorted(r.text for r in rows.collect())


def test_jobs_can_be_cancelled(spark):
    import threading
    import time

    from maskweave.operators import model

    failed = []

    def slow():
        with model.cancellable(spark, "slow-scores"):
            try:
                spark.range(4, numPartitions=4).select(F.udf(lambda i: time.sleep(20) or i, "long")("id")).collect()
            except Exception as e:
                failed.append(e)

    thread = threading.Thread(target=slow)
    thread.start()
    began = time.time()
    while not failed and time.time() - began < 15:
        time.sleep(0.5)
        model.cancel(spark, "slow-scores")
    thread.join(15)
    assert failed and time.time() - began < 18


def test_ranks_within_one_large_group(spark):
    from pyspark.sql import Window as W

    rows = spark.range(3000).select(F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 3 == 0, "b").otherwise("a").alias("g"), F.xxhash64("id").alias("o"), F.col("id") % 7)
    kept = ranks.dealt(rows, ["g"], ["o"])
    spread = {r.g: r.n for r in kept.groupBy("g").agg(F.countDistinct(ranks.RANGE).alias("n")).collect()}
    assert spread["a"] >= 2 and sum(spread.values()) <= 4 + len(spread)  # the largest group uses the tasks that there are
    want = {(r.g, r.o): r.n for r in rows.withColumn("n", F.row_number().over(W.partitionBy("g").orderBy("o")) - 1).collect()}
    got = ranks.numbered(rows, ["g"], ["o"], "n")
    assert {(r.g, r.o): r.n for r in got.collect()} == want and len(want) == 3000
    assert got.columns == rows.columns + ["n"]
    seen = ranks.previous(kept, ["g"], ["o"], "o", "before").collect()
    by = {}
    for r in sorted(seen, key=lambda r: (r.g or "", r.o)):
        assert (None if r.before is None else r.before.o) == by.get(r.g)
        by[r.g] = r.o
    assert ranks.numbered(rows.where("false"), ["g"], ["o"], "n").collect() == []


def test_labels_of_one_session_that_holds_nearly_all(spark):
    texts = spark.createDataFrame([("big", i, [f"o{(i * 7 + k) % 400}" for k in range(5)]) for i in range(200)] + [("small", 0, ["x", "y"])], "session string, first_seq long, matches array<string>")
    got = {(r.session, r.original): r.n for r in session.regex_dictionary(texts).collect()}
    first = {}
    for i in range(200):
        for o in {f"o{(i * 7 + k) % 400}" for k in range(5)}:
            first.setdefault(o, (i, -len(o), o))
    want = {("big", o): n for n, o in enumerate(sorted(first, key=first.get))}
    assert got == want | {("small", "x"): 0, ("small", "y"): 1}


def test_stages_are_timed(spark):
    took = {}
    rows = spark.createDataFrame([("s", 1, "a@b.de x"), ("s", 2, "a@b.de")], "session string, seq long, text string")
    out, _ = session.redact_sessions(rows, rules.candidates(F.col("text"), ("private_email",)), ["x"], [("k", False)], took)
    assert list(took) == ["spans", "patterns", "keywords", "forward propagation"] and all(v > 0 for v in took.values())
    assert sorted(r.redacted_text for r in out.collect()) == ["<<REDACTED_PII_0>>", "<<REDACTED_PII_0>> <<REDACTED_REGEX_0>>"]


def test_the_last_value_written_wins(spark):
    rows = [("g", "k", "a", 1), ("g", "k", None, 3), ("g", "k", "b", 2), ("g", "l", "c", 1), (None, "k", "d", 1)]
    got = report.last_written(spark.createDataFrame(rows, "g string, k string, v string, n long"), ["g"], "k", "v", ["n"]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("g", "k", None), ("g", "l", "c"), (None, "k", "d")], key=repr)


def test_scopes_of_threads_are_apart(spark):
    from concurrent.futures import ThreadPoolExecutor

    from maskweave import storage

    def run(name):
        with storage.collected() as outer:
            storage.stage(spark.range(3), f"{name}-a")
            with storage.collected() as inner:
                storage.stage(spark.range(3), f"{name}-b")
            storage.handed_on(inner)
        return outer

    with ThreadPoolExecutor(3) as pool:
        for name, paths in zip("xyz", pool.map(run, "xyz")):
            assert [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in paths] == [f"{name}-a", f"{name}-b"]


def test_sizes_and_floats_round_as_printf_does(spark):
    n = [1280, 1792, 877824, -5, 0, 1023, 742652928, 5 * 1024**4]
    got = [r.s for r in spark.createDataFrame([(i, x) for i, x in enumerate(n)], "i int, n long").orderBy("i").select(T.format_size(F.col("n")).alias("s")).collect()]
    assert got == ["1.2 KB", "1.8 KB", "857.2 KB", "-5.0 B", "0.0 B", "1023.0 B", "708.2 MB", "5120.0 GB"]
    x = [0.25, 0.35, 1.005, 2.675, 0.125, -0.04, 9.95, 1e15, 2.0**60 + 4096, -(2.0**55)]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", *[T.format_float(F.col("x"), d).alias(f"d{d}") for d in (1, 2, 3)]).collect()
    assert all(r[d] == f"{r.x:.{d}f}" for r in rows for d in (1, 2, 3))


def test_labels_and_counts_do_not_redact_again(spark, tmp_path, monkeypatch):
    from maskweave.plans import sessions

    rows = [(1, "a", "thinging a@b.de thble"), (2, "a", "a@b.de thinging"), (3, "b", "none"), (4, "b", "none")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    staged, stage = [], session.stage
    monkeypatch.setattr(session, "stage", lambda df, name: staged.append((name, df.columns)) or stage(df, name))
    labels = {(r.session, r.kind, r.original): r.label for r in sessions.session_dictionary(spark, str(tmp_path)).collect()}
    assert labels["a", "PII", "a@b.de"] == "<<REDACTED_PII_0>>" and ("b", "KEYWORD", "thble") in labels
    assert "session-bodies" not in [name for name, _ in staged]
    counts = sessions.profile_stats(spark, str(tmp_path))
    assert "FlatMapCoGroups" not in counts._jdf.queryExecution().toString()
    assert {tuple(r) for r in counts.collect()} == {("a", 2, 2), ("b", 2, 0)}
    assert all("text" not in columns for name, columns in staged if name in ("session-matches", "session-bodies"))


def test_stored_texts_are_not_shuffled_again(spark, tmp_path, monkeypatch):
    from maskweave import storage
    from maskweave.plans import sessions

    monkeypatch.setattr(storage, "BUCKET_BYTES", 0)
    monkeypatch.setattr(storage, "BROADCAST_BYTES", -1)
    rows = [(i, "ab"[i % 2], f"thinging u{i % 9}@b.de thble {i % 30} tail") for i in range(80)] + [(90, "b", "thinging"), (91, "b", ""), (92, "a", "none")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = {t.name for t in spark.catalog.listTables()}
    out = sessions.unredact_roundtrip(spark, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == {(i, t) for i, _, t in rows}
    assert {t.name for t in spark.catalog.listTables()} == before
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted").split("\n\n")
    moved = [x for x in plan if ") Exchange" in x or ") ShuffleQueryStage" in x]
    assert moved and not any(re.search(r"\b(text|body|redacted_text)#", x) for x in moved)
    assert any("Bucketed: true" in x and "text#" in x for x in plan)


def test_several_automata_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(session, "ORIGINALS", 2)
    monkeypatch.setattr(session, "AUTOMATA", 2)
    words = [f"w{i}x" for i in range(9)]
    texts = spark.createDataFrame([("s", "t", 5, " ".join(words)), ("s", "u", 3, "w1x w7x"), ("s", "v", 9, "none")], "session string, _id string, first_seq long, body string")
    known = spark.createDataFrame([("s", w, f"<{i}>", i) for i, w in enumerate(words)], "session string, original string, label string, first_seq long")
    got = {r._id: {k.original for k in r.known} for r in session.known_originals(texts, known, "body", "_id").collect()}
    assert got == {"t": set(words[:6]), "u": {"w1x"}}


def test_streams_are_rebuilt_a_slice_at_a_time(spark, monkeypatch):
    body = lambda i: "".join(f'data: {{"choices":[{{"delta":{{"content":"{p}"}}}}]}}\n\n' for p in (f"{i} <<REDA", "CTED_PII_0>> é"))
    monkeypatch.setattr(sse, "AT_A_TIME", 3)
    rows = spark.createDataFrame([(i, body(i), {"<<REDACTED_PII_0>>": f"n{i}"}) for i in range(10)], "id int, body string, pairs map<string,string>").coalesce(1)
    out = sse.rebuilt_streams(rows, ["id"])
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    seen = out.collect()
    text = lambda b: "".join(json.loads(line[6:])["choices"][0]["delta"]["content"] for line in b.split("\n") if line)
    assert {r.id: text(r.body) for r in seen} == {i: f"{i} n{i} é" for i in range(10)}
