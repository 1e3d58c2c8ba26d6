"""Edge rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.functions import coding, numbers, scoring, text
from riskloom.operators import prompts


def values(spark, rows, column):
    """Results of a column over one-column text rows, in order."""
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, x string")
    return [r[0] for r in frame.orderBy("i").select(column).collect()]


WHITE = "a b\x1cc\x85d e　f​g\x0bh i"


def test_words_split_like_python(spark):
    rows = [None, "", "  ", "one", " two\twords\n", WHITE]
    assert values(spark, rows, text.word_count(F.col("x"))) == [0, 0, 0, 1, 2, len(WHITE.split())]
    assert values(spark, [WHITE], text.words(F.col("x"))) == [WHITE.split()]


def test_unique_ratio(spark):
    assert values(spark, [None, "", "a b a"], text.unique_word_ratio(F.col("x"))) == [0.0, 0.0, 0.5]


def test_delimiter_count(spark):
    assert values(spark, [None, "", "a;b;c", ";"], text.delimiter_count(F.col("x"), ";")) == [1, 1, 3, 2]
    assert values(spark, ["a | b | c"], text.delimiter_count(F.col("x"), " | ")) == [3]


def test_keyword_flag(spark):
    rows = [None, "", "A Randomised trial", "randomize"]
    assert values(spark, rows, text.keyword_flag(F.col("x"), C.RANDOMIZED_WORDS)) == [0, 0, 1, 0]


def test_status_and_phase(spark):
    rows = [None, "completed", "Terminated", "WITHDRAWN", "suspended", "other"]
    assert values(spark, rows, coding.status_label(F.col("x"))) == [0, 0, 1, 1, 1, 0]
    rows = [None, "phase1", "PHASE 2", "Early_Phase3", "PHASE4", "N/A", "PHASE1/PHASE2"]
    assert values(spark, rows, coding.phase_encode(F.array("x"))) == [0, 1, 2, 3, 4, 0, 1]
    empty = spark.createDataFrame([([],), (None,)], "p array<string>")
    assert [r[0] for r in empty.select(coding.phase_encode(F.col("p"))).collect()] == [0, 0]


def test_phase_parse_modes(spark):
    rows = [None, "Phase 1/2", "2.0", "nothing", "3 and 1"]
    last = values(spark, rows, coding.phase_parse(F.col("x"), "last"))
    first = values(spark, rows, coding.phase_parse(F.col("x"), "first"))
    assert last == ["Phase 2", "Phase 2", "Phase 2", "Phase 2", "Phase 3"]
    assert first == ["Phase 2", "Phase 1", "Phase 2", "Phase 2", "Phase 1"]


def test_parse_number(spark):
    rows = ["1,234", "12.9", "-3.7", "many", "", None, "nan", "1e3"]
    assert values(spark, rows, numbers.parse_number(F.col("x"), 100)) == [1234, 12, -3, 100, 100, 100, 100, 1000]


def test_expected_size_of_unseen_phase(spark):
    frame = spark.createDataFrame([(1.0, 15), (4.0, 500), (9.0, 300), (None, 75)], "p double, n int")
    ratios = [r[0] for r in frame.select(coding.enrollment_ratio(F.col("n"), F.col("p"))).collect()]
    assert ratios == [0.5, 0.5, 2.0, 0.5]
    deficits = [r[0] for r in frame.select(coding.enrollment_deficit(F.col("n"), F.col("p"))).collect()]
    assert deficits == [15.0, 500.0, 0.0, 75.0]


@pytest.mark.parametrize(
    "p, additive, proportional",
    [(0.56, "HIGH RISK", "HIGH RISK"), (0.55, "HIGH RISK", "MEDIUM RISK"), (0.26, "MEDIUM RISK", "MEDIUM RISK"),
     (0.25, "MEDIUM RISK", "LOW RISK"), (0.1, "LOW RISK", "LOW RISK")],
)
def test_tiers(spark, p, additive, proportional):
    row = spark.range(1).select(
        scoring.risk_tier(F.lit(p), 0.4).alias("a"), scoring.risk_tier(F.lit(p), 0.4, "proportional").alias("b")
    ).first()
    assert (row["a"], row["b"]) == (additive, proportional)


def test_unknown_tier_mode():
    with pytest.raises(ValueError):
        scoring.risk_tier(F.lit(0.5), 0.4, "other")


@pytest.mark.parametrize(
    "size, shift", [(22, 0.20), (30, 0.13), (100, 0.06), (150, 0.0), (225, 0.0), (450, -0.08), (451, -0.14)]
)
def test_size_bands(spark, size, shift):
    assert spark.range(1).select(scoring.size_shift(F.lit(size), F.lit(2.0))).first()[0] == shift


def test_adjusted_probability_is_clipped(spark):
    row = spark.range(1).select(
        scoring.enrollment_adjust(F.lit(0.95), F.lit(1), F.lit(3.0)),
        scoring.enrollment_adjust(F.lit(0.02), F.lit(9000), F.lit(3.0)),
    ).first()
    assert tuple(row) == (0.99, 0.01)


def test_flag_or_text(spark):
    frame = spark.createDataFrame(
        [(None, "multi-center"), (False, "multi-center"), (False, "multicenter"), (True, ""), (None, "single")],
        "f boolean, x string",
    )
    flag = coding.flag_or_text(F.col("f"), F.col("x"), ["multicenter", "multi-center"], ["multicenter"])
    assert [r[0] for r in frame.select(flag).collect()] == [True, False, True, True, False]


def test_sections(spark):
    body = "intro\n--- STUDY DESIGN ---\nopen label\nrandomized\n--- Follow-up NOTES ---\nend"
    rows = [body, "no header", None, ""]
    names = values(spark, rows, text.list_sections(F.col("x")))
    assert names[0] == ["Study Design", "Follow-Up Notes"]
    assert names[1:] == [C.DEFAULT_SECTIONS] * 3
    picked = values(spark, rows, text.extract_section(F.col("x"), F.lit("Study Design")))
    assert picked == ["--- STUDY DESIGN ---\nopen label\nrandomized", "no header", "", ""]
    # Titles are looked up in capitals, so a mixed-case one is not found.
    assert values(spark, [body], text.extract_section(F.col("x"), F.lit("Follow-Up Notes"))) == [body]
    assert values(spark, [body], text.extract_section(F.col("x"), F.lit("(Full Protocol)"))) == [body]


def test_section_marker_window(spark):
    body = "x" * 100 + "Eligible people" + "y" * 3000
    found = values(spark, [body], text.extract_section(F.col("x"), F.lit("Eligibility criteria")))[0]
    assert found == body[70:2100]


def test_replies(spark):
    rows = [
        '```json\n{"rewrites": [" a ", "", "b"]}\n```',
        '{"rewrites": ["only"]}',
        "Intro\n1. one\n2) two\n3: three\n4. four",
        "free text",
        "   ",
        None,
        '{"rewrites": []}',
    ]
    assert values(spark, rows, text.replies_to_list(F.col("x"))) == [
        ["a", "b"],
        ["only"],
        ["Intro", "one", "two"],
        ["free text"],
        [C.NO_SUGGESTIONS],
        [C.NO_SUGGESTIONS],
        ['{"rewrites": []}'],
    ]


def test_apply_suggestion(spark):
    rows = ["1. first\n2. second. more", "nothing numbered", ""]
    chosen = values(spark, rows, text.apply_suggestion(F.col("x"), F.lit("body"), F.lit(1)))
    assert chosen == [f"body\n\n{C.REVISION_MARK}: second. more", "body", "body"]


def test_choice_label_round_trip(spark):
    frame = spark.createDataFrame([("NCT1", "T" * 50, "", "HIGH RISK", 0.815)], "k string, t string, c string, r string, p double")
    label = prompts.choice_label(F.col("k"), F.col("t"), F.col("c"), F.col("r"), F.col("p"))
    row = frame.select(label.alias("l")).select("l", prompts.choice_key(F.col("l")).alias("k")).first()
    assert row["l"] == "[HIGH] NCT1 — " + "T" * 45 + "… (82%)"
    assert row["k"] == "NCT1"
    assert values(spark, ["broken", None], prompts.choice_key(F.col("x"))) == [None, None]


def test_describe_changes(spark):
    row = spark.sql("select map('a', '1', 'b', '2', 'n', null) x, map('a', '1', 'b', '3', 'c', '4', 'n', null) y")
    changed = row.select(scoring.describe_changes(F.col("x"), F.col("y"))).first()[0]
    assert {k: tuple(v) for k, v in changed.items()} == {"b": ("2", "3"), "c": (None, "4")}


def test_fixed_decimals(spark):
    values = [0.125, 0.375, -0.1, 0.0, -0.0004, 12.0, 0.0625, 0.00005, -0.00005, 0.00015, 0.005, 1.005, 2.675]
    values += [k / 2000 for k in range(-40, 41)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (2, 3, 4):
        text = numbers.fixed(F.col("v"), places, signed=True)
        got = frame.select(text, numbers.half_even(F.col("v"), places)).collect()
        assert [tuple(r) for r in got] == [(f"{v:+.{places}f}", round(v, places)) for v in values]
    shares = [0.125, 0.135, 0.005, 0.015, 0.995, 1.0, 0.0]
    frame = spark.createDataFrame([(v,) for v in shares], "v double")
    got = frame.select(numbers.whole_percent(F.col("v")), numbers.percent(F.col("v"), 1)).collect()
    assert [tuple(r) for r in got] == [(round(v * 100), f"{v * 100:.1f}%") for v in shares]
