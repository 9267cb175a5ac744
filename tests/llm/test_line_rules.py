from pyspark.sql import functions as F

from passagedex.llm import line_quality as L

WORDS = " ".join(f"word{i}" for i in range(30))

LINES = [
    "",
    " \t\x0b\x0c\r",
    "Click here",
    "please CLICK HERE now",
    "clickhere",
    "click  here",
    " here",
    "All Rights Reserved",
    "small rights reserved",
    "privacy policy",
    "the policy of privacy",
    "terms of service and terms of use",
    "terms of user",
    "share this page",
    "follow us on",
    f"click here {WORDS}",
    WORDS,
    f"{WORDS}.",
    f"{WORDS}…",
    f"{WORDS}。",
    f"{WORDS}؟",
    f"{WORDS}།",
    "a | b | c",
    "a > b » c",
    "###",
    "#abcdefghi",
    "#abcdefghijkl",
    "a & b",
    "no!! no!! no!!",
    "é ü ñ",
    "\U0001f600 smile",
]


def plain(line):
    """The rules as they are written down, with every count taken."""
    letters, blanks = L._letters(line), L._count(line, L.BLANKS)
    marks = sum((L._pairs(line, m) for m in (" | ", " > ", " » ", " · ")), start=F.lit(0))
    shouts = L._pairs(line, "!!")
    return (letters > 0) & (
        (marks >= 2)
        | (L._count(line, L.SYMBOLS) * 100 >= letters * 10)
        | ((shouts >= 3) & (shouts * 100 >= (blanks + 1) * 20))
        | ((blanks + 1 >= 25) & (L._count(line, L.SENTENCE_ENDS) == 0))
        | ((blanks + 1 < 25) & F.lower(line).rlike(L.BOILERPLATE))
    )


def test_cheap_conditions_judge_lines_as_the_rules_do(spark):
    rows = spark.createDataFrame([(line,) for line in LINES], "line string")
    line = F.col("line")
    for row in rows.select(
        "line", plain(line).alias("want"), L.line_fails(line, L.LineRules()).alias("got")
    ).collect():
        assert row["got"] == row["want"], row["line"]
    for phrase in L.BOILERPLATE.split("|"):
        cases = spark.createDataFrame([(phrase,), (phrase[1:],), (phrase[:-1],)], "line string")
        fits = [r[0] for r in cases.select(line.rlike(L._FURNITURE)).collect()]
        assert fits == [True, False, False], phrase


def test_a_limit_of_no_symbols_fails_every_line(spark):
    rows = spark.createDataFrame([("plain words.",)], "line string")
    rules = L.LineRules(max_symbol_percent=0)
    assert rows.select(L.line_fails(F.col("line"), rules)).first()[0]


def test_characters_are_counted_only_where_a_look_does_not_settle(spark):
    docs = spark.createDataFrame([("a b.",)], "text string")
    plan = L.measure_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    # Words are there already, so their characters need no second pass over the text.
    assert "array_join" in plan
    rule = L.line_fails(F.col("line"), L.LineRules())
    text = spark.createDataFrame([("x",)], "line string").select(rule.alias("fails"))
    shown = text._jdf.queryExecution().analyzed().toString()
    assert shown.index("RLIKE") < shown.index("translate")


def test_measures_of_texts_with_and_without_failing_lines(spark):
    text = "\n".join([f"{WORDS}.", "a # b", "Click here", "é ü"])
    rows = spark.createDataFrame([(text,), ("a b\n\na b",), (None,)], "text string")
    found = [r["quality"] for r in L.measure_lines(rows.coalesce(1)).collect()]
    size = sum(len(w) for w in text.split())
    assert [q["word_chars"] for q in found] == [size, 4, 0]
    assert [q["n_symbols"] for q in found] == [1, 0, 0]
    assert [q["n_dup_lines"] for q in found] == [0, 1, 0]
    assert [q["clean_chars"] for q in found] == [size - 12, 4, 0]
