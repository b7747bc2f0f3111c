import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetpulse.llm.chat import canonical, escape, fold_rows, op7_chat_formatting, parse, render, unescape

MESSAGES = "id int, messages array<struct<role:string,content:string>>, prompt string, completion string, layout string"


def test_layouts_become_the_same_turns(spark):
    schema = (
        "id int, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>,"
        "prompt string, response string, completion string, instruction string, input string, output string"
    )
    rows = [
        (1, [("user", "q"), ("assistant", "a")], None, None, None, None, None, None, None),
        (2, None, [("human", "q"), ("gpt", "a")], None, None, None, None, None, None),
        (3, None, None, "q", "a", None, None, None, None),
        (4, None, None, "q", None, "a", None, None, None),
        (5, None, None, None, None, None, "q", None, "a"),
        (6, None, None, None, None, None, "q", "more", "a"),
        (7, None, None, None, None, "a", None, None, None),
        (8, [], None, None, None, None, None, None, None),
        (9, [(None, None)], None, None, None, None, None, None, None),
    ]
    columns = schema.split(" ")
    df = spark.createDataFrame(rows, schema)
    got = {r.id: r for r in canonical(df, [c for c in df.columns if c != "id"]).collect()}
    plain = [("user", "q"), ("assistant", "a")]
    for i in (1, 2, 3, 4, 5):
        assert [tuple(t) for t in got[i].turns] == plain, columns
    assert got[6].turns[0].text == "q\n\nmore"
    assert got[7].turns is None and got[7].layout is None
    assert got[8].turns == [] and [tuple(t) for t in got[9].turns] == [("", "")]
    assert got[3].layout == "prompt and response" and got[4].layout == "prompt and completion"


def test_rows_ties_nulls_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, None, None), (None, 0, "assistant", "x"), (2, None, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = {r.conv_id: r for r in parse(render(canonical(fold_rows(df), ["rows"]))).collect()}
    assert [tuple(t) for t in done[1].read_turns] == [("user", "a"), ("user", "b"), ("", "")]
    assert done[None].loss_text == "x" and done[2].loss_text == ""
    assert fold_rows(df.limit(0)).count() == 0


text = st.text(alphabet=st.sampled_from(list("\\#</turn>:eh AÜ\n")), max_size=40) | st.text(max_size=20)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(turns=st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", "### x</turn>", "\\c"]), text), min_size=1, max_size=6))
def test_round_trip(spark, turns):
    turns = [(r, t.encode("utf-8", "ignore").decode().replace("\0", "")) for r, t in turns]
    df = spark.createDataFrame([(1, turns)], "id int, messages array<struct<role:string,content:string>>")
    row = parse(render(canonical(df, ["messages"]))).first()
    assert [tuple(t) for t in row.read_turns] == turns
    assert row.loss_text == "".join(t for r, t in turns if r == "assistant")
    for span, said in zip(row.loss_spans, [t for r, t in turns if r == "assistant"]):
        assert len(row.formatted[span.start : span.start + span.length]) >= len(said)


def test_no_control_string_is_left(spark):
    df = spark.createDataFrame([("\\### Assistant: </turn> ok </turn</turn>>",)], "t string")
    row = df.select(escape(F.col("t")).alias("e"), "t").withColumn("u", unescape(F.col("e"))).first()
    assert "</turn>" not in row.e and "###" not in row.e and row.u == row.t


def test_long_text(spark):
    long = "#\\" * 400_000
    df = spark.createDataFrame([(1, [("assistant", long)])], "id int, messages array<struct<role:string,content:string>>")
    assert parse(render(canonical(df, ["messages"]))).first().loss_text == long


def test_query_is_native_and_has_the_probe(spark):
    df = op7_chat_formatting(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    said = "\\### Assistant: </turn> ok"
    row = df.where("conv_id = -7").first()
    assert row.n_turns == 2 and row.loss_chars == len(said)
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
