"""Names, matching, arbitration and synthesis on small tables, against folds in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as t
from plumbline.operators import arbitrate, match, synthesize, triage

ROWS = "source_id string, seq long, model_name string, vendor_hint string, fields map<string,string>, synthesized_from string, entity string"
REGISTRY = "entity string, ord int, vendor string, display string, aliases array<string>"
PAIRS = "pair_idx long, target string, donor string"


def of(spark, expression, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normal_names(spark):
    assert of(spark, t.normalize_name, "z.ai/glm", "foo.bar", "gpt-5.5", "A&amp;B  (C)", "Moonshot AI k2", "quiz ai") == ["zai glm", "foo bar", "gpt 5.5", "a b c", "moonshot k2", "quizai"]
    assert of(spark, t.compact_key, "Claude Opus 4.7") == ["claudeopus47"]


def test_cells_end_without_blanks_of_any_script(spark):
    assert of(spark, t.cell_text, "<b>a</b> \n b&#x3000;", "\u00a0 \u2003a\u3000b \u2028", "a\x0bb", " &nbsp; ", None) == ["a b", "a\u3000b \u2028", "a\x0bb", "", None]


def test_efforts_are_read_once_a_row(spark):
    """No condition of a join or filter repeats what reads the texts, and the classes stay."""
    rows = spark.createDataFrame([("A", k, name, None, {"q": "1", "t": text}, None, "e") for k, (name, text) in enumerate([("m &amp; High", "1e5"), ("m", "thinking"), ("m max", "Infinity"), ("m", None)])], ROWS)
    cells = arbitrate.eligible_cells(rows.repartition(2), spark.createDataFrame([("e", 1, "v", "E", [])], REGISTRY))
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("moonshot ai") == 1
    assert sorted((r.seq, r.metric, r.effort) for r in cells.collect()) == [(1, "q", 2), (3, "q", 0)]


@pytest.mark.parametrize("mark", [" ", "-", "_"])
def test_suffixes(spark, mark):
    names = [f"alpha{mark}{s.replace(' ', mark)}" for s in t.SUFFIXES]
    assert all("alpha" in forms for forms in of(spark, lambda x: t.stripped_forms(t.normalize_name(x)), *names))
    got = of(spark, lambda x: t.stripped_forms(t.normalize_name(x)), f"a{mark}non-reasoning", f"a{mark}thinking{mark}high", "non-reasoning", "high")
    assert got == [["a"], ["a thinking", "a"], [], []]


def test_texts_of_sources(spark):
    assert of(spark, t.extract_model, "Agent + Model X (2025-01-31)", "Model (old)", "A + B + C") == ["Model X", "Model (old)", "C"]
    assert of(spark, t.parse_accuracy, "82.0% ± 2.2", "n/a", " 7 % ") == [82.0, None, 7.0]
    assert of(spark, t.unescape_once, r'\"a\\\"') == [r'"a\"']
    overlap = lambda a, b: spark.range(1).select(t.token_overlap(F.lit(a), F.lit(b)).alias("o")).first().o
    assert overlap("a b c", "a b c") == 1 and 0.6 <= overlap("a b c", "a b") < 1 and overlap("a", "b") == 0 and overlap("", "") == 1


@pytest.fixture
def registry(spark):
    return spark.createDataFrame(
        [("acme/rocket-9", 0, "acme", "rocket-9", ["Rocket Nine"]), ("acme/glider", 1, "acme", "glider", []), ("zeta/rocket-9", 2, "zeta", "rocket-9", []), ("zeta/submarine-deluxe", 3, "zeta", "submarine-deluxe", [])], REGISTRY
    )


def test_names_find_entities(spark, registry):
    asked = [
        ("Rocket-9", None, "acme/rocket-9"), ("Rocket-9 (high)", "zeta", "acme/rocket-9"), ("zeta rocket 9", None, "zeta/rocket-9"), ("ROCKET NINE thinking", None, "acme/rocket-9"),
        ("the submarine deluxe edition", "zeta", "zeta/submarine-deluxe"), ("sub", "acme", None), ("", None, None), (None, None, None),
    ]
    rows = spark.createDataFrame([("s", i, n, h) for i, (n, h, _) in enumerate(asked)], "source_id string, seq long, model_name string, vendor_hint string")
    got = {r.seq: r.entity for r in match.resolve(rows, registry).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(asked)}


def test_arbitration_against_a_fold(spark, registry):
    r = random.Random(4)
    marks = {"x": 0, "x medium": 1, "x thinking": 2, "x high": 5}
    rows = []
    for i in range(300):
        entity, name, synth = r.choice(["acme/rocket-9", "acme/glider", "zeta/rocket-9"]), r.choice(list(marks)), r.random() < 0.3
        fields = {m: str(r.randint(0, 99)) for m in r.sample(["m1", "m2", "m3", "m4"], 2)}
        rows.append((r.choice(["a", "b", "overrides", "z"]), i, name, None, fields, "d" if synth else None, entity))
    rows = [x for x in rows if x[0] in "az" or x[5] is None or r.random() < 0.5]
    want: dict = {}
    for source in sorted({x[0] for x in rows}):
        chosen: dict = {}
        for x in sorted((x for x in rows if x[0] == source and x[5] is None), key=lambda x: x[1]):
            if marks[x[2]] > 2:
                continue
            for m, v in x[4].items():
                if (x[6], m) not in chosen or marks[x[2]] <= chosen[x[6], m]:
                    chosen[x[6], m] = marks[x[2]]
                    want[x[6], m] = (float(v), False, source == "overrides")
        for x in sorted((x for x in rows if x[0] == source and x[5]), key=lambda x: x[1]):
            if marks[x[2]] <= 2:
                for m, v in x[4].items():
                    want.setdefault((x[6], m), (float(v), True, False))
    df = spark.createDataFrame(rows, ROWS)
    got = {(c.entity, c.metric): (c.raw, c.is_synth, c.is_override) for c in arbitrate.arbitrate(arbitrate.eligible_cells(df, registry)).collect()}
    assert got == want
    assert {s for x in arbitrate.sources_of(df).collect() for s in x.sources} == {x[0] for x in rows if x[5] is None}


@pytest.mark.parametrize("cap", [0.1, 0.4, 1.0])
@pytest.mark.parametrize("chained", [False, True])
def test_synthesis_against_a_loop(spark, cap, chained):
    r = random.Random(int(cap * 10) + chained)
    names = [f"v/{c}" for c in "abcdefgh"]
    registry = spark.createDataFrame([(e, i, "v", e[2:].upper(), []) for i, e in enumerate(names)], REGISTRY)
    rows = [(s, i, f"n{i}", "v", {"x": str(i)}, None, r.choice(names[:4])) for s in ("p", "q") for i in range(5)]
    pairs = [(i, *r.sample(names if chained else names[4:], 1), r.choice(names if chained else names[:4])) for i in range(12)]
    pairs = [p for p in pairs if p[1] != p[2]]
    want = []
    for s in ("p", "q"):
        held, emitted, real = [(x[6], x[2]) for x in rows if x[0] == s], 0, 5
        for _, target, donor in pairs:
            if emitted and emitted / (real + emitted) > cap:
                break
            given = [(e, n) for e, n in held if e == donor]
            emitted += bool(given)
            held += [(target, target[2:].upper()) for _ in given]
            want += [(s, target, donor, n) for _, n in given]
    run = synthesize.synthesize_chained if chained else synthesize.synthesize
    done = run(spark.createDataFrame(rows, ROWS), spark.createDataFrame(pairs, PAIRS), registry, cap)
    new = [x for x in done.collect() if x.synthesized_from]
    assert sorted((x.source_id, x.entity, x.synthesized_from, x.fields[synthesize.MARK]) for x in new) == sorted(want)
    assert all(x.model_name == x.entity[2:].upper() for x in new)


def test_triage(spark, registry):
    rows = spark.createDataFrame(
        [("s", 0, "Rocket-9", "acme", {"b": "1", "a": "2"}, None, "acme/rocket-9"), ("s", 1, "What?", None, {"b": "1", "a": "2", "d": "x", "c": "y"}, None, None), ("s", 2, "what", None, {}, None, None), ("u", 0, "g", None, {}, None, "acme/glider")], ROWS
    )
    (g,) = triage.unmatched_groups(rows, 2).collect()
    assert (g.source_id, g.name_norm, g["count"], g.example_name, g.sample_fields) == ("s", "what", 2, "What?", ["a=2", "b=1", "c=y"])
    gaps = {(x.entity, x.source_id) for x in triage.coverage_gaps(rows, registry).collect()}
    assert gaps == {("acme/rocket-9", "u"), ("acme/glider", "s"), ("zeta/rocket-9", "s"), ("zeta/rocket-9", "u"), ("zeta/submarine-deluxe", "s"), ("zeta/submarine-deluxe", "u")}


def test_synth_chain_reads_all_sources(spark):
    from plumbline.plans import base, queries

    sf = "/root/testdata/sf0.001"
    listed = {x.source_id for x in base.line_rows(spark, sf).filter("entity is not null").select("source_id").distinct().collect()}
    assert len(listed) > 1 and {x.source_id for x in queries.synth_chain(spark, sf).select("source_id").distinct().collect()} == listed
