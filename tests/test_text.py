import json
import uuid

from pyspark.sql import functions as F

from routeloom.functions import text as tx


def one(spark, values, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string")
    return [r[0] for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").select("v").collect()]


def test_first_object_that_decodes(spark):
    inner = json.dumps({"t": "``` {x ```"})
    asked = {
        '{"a":1} and {"b":2}': '{"a":1}',
        '{"a":1} done }': '{"a":1}',
        'use {x} -> {"a":1}': '{"a":1}',
        "```JSON\n" + inner + "\n```": inner,
        '{"a": {"b": 1}': '{"b": 1}',
        "none": None,
        "": None,
    }
    assert one(spark, [*asked, None], tx.first_json_object) == [*asked.values(), None]


def test_reply_parts(spark):
    body = lambda c: json.dumps({"choices": [{"message": {"content": c}}]})
    listed = [{"type": "reasoning", "text": "no"}, {"type": "text", "text": " a"}, "stray", {"type": "output_text", "text": "b "}, {"type": "text"}]
    got = one(spark, [body("\u00a0 hi\n"), body(listed), body([]), body(5), "{}", "no json", None], tx.reply_text)
    assert got == ["hi", "a\nb", "", None, None, None, None]


def test_identifier_is_the_name_based_one(spark):
    got = one(spark, ["k", "é", ""], lambda x: tx.stable_id(F.lit("v1"), x))
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"v1:{k}")) for k in ("k", "é", "")]


def test_slug_of_nothing(spark):
    assert one(spark, ["..", " a b "], tx.safe_slug) == ["skill", "a_b"]


def test_first_object_forms(spark):
    deep = '{"a":' * 30 + "1" + "}" * 30
    asked = {
        'He said "hi {"a":"}{"} there': '{"a":"}{"}',
        '{bad {"b":2.0} }': '{"b":2.0}',
        '{"t":"a \\"quoted} \\\\"}}': '{"t":"a \\"quoted} \\\\"}',
        f"x {deep}}}": deep,
        '```JSON {"k":"é"}\n``` ': '{"k":"é"}',
        "{" * 50: None,
        '{"a":1,"a":2}': None,
        "": None,
    }
    assert one(spark, [*asked, None], tx.first_json_object) == [*asked.values(), None]
