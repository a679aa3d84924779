"""Final payloads: texts are searched and parsed once."""

from corpusmill.operators import payload


def test_texts_are_searched_and_parsed_once(spark):
    rows = [(1, "```final\n[1]\n```\nthen\n```final\n{\"selection\": []}\n```"), (2, "none"), (3, None), (4, "```final\n{\n```"), (5, "```final\n\n```")]
    found = payload.final_payloads(spark.createDataFrame(rows, "conv_id long, text string"))
    said = {r.conv_id: (r.error, None if r.payload is None else r.payload.selection) for r in found.collect()}
    assert said == {1: (None, []), 2: ("missing block", None), 3: ("must be an object", None), 4: ("must be an object", None), 5: ("must be an object", None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
