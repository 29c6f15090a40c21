from __future__ import annotations

import json
import random

from plumbline.operators import redaction


def scrub(value):
    if isinstance(value, dict):
        return {k: "<redacted>" if any(t in k.lower() for t in ("key", "token", "secret", "password")) else scrub(v) for k, v in value.items()}
    return [scrub(v) for v in value] if isinstance(value, list) else value


def made(rng, depth):
    kind = rng.random()
    if depth and kind < 0.45:
        names = ["a", "apiKey", "PASSWORD hint", 'quo"ted', "tok\\en", "access_Token", "é\n", "", "plain", "monkeys", "b/c"]
        return {n: made(rng, depth - 1) for n in rng.sample(names, rng.randrange(5))}
    if depth and kind < 0.7:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, 0, -17, 10**12, 1.5, "", "text", 'a "quoted" \\ one', "line\nbreak", "é😀", '{"key": 1}'])


def test_any_depth_equals_brute_force(spark):
    rng = random.Random(7)
    values = [made(rng, 7) for _ in range(150)] + [{}, [], {"a": {}}, [[], [[]]], {"key": {"deep": [1]}, "x": [{"y": {"z": [{"secret": 1, "w": 2}]}}]}]
    rows = [(k, json.dumps(v, ensure_ascii=bool(k % 2))) for k, v in enumerate(values)]
    out = {r.id: json.loads(r.body) for r in redaction.redact(spark.createDataFrame(rows, "id int, body string"), "id", "body").collect()}
    assert out == {k: scrub(v) for k, v in enumerate(values)}
    assert sum("<redacted>" in json.dumps(v) for v in out.values()) > 20


def test_texts_that_are_no_json_stay(spark):
    rows = [(1, None), (2, ""), (3, "not json {"), (4, "5"), (5, '"token"'), (6, "null"), (7, '{"a": 1'), (8, "[" * 40 + '{"token": 2}' + "]" * 40)]
    out = {r.id: r.body for r in redaction.redact(spark.createDataFrame(rows, "id int, body string"), "id", "body").collect()}
    assert out[1] is None and {k: out[k] for k in (2, 3, 5, 6, 7)} == {2: "", 3: "not json {", 5: '"token"', 6: "null", 7: '{"a": 1'} and out[4] == "5"
    assert out[8] == "[" * 40 + '{"token":"<redacted>"}' + "]" * 40


def test_other_words_and_an_empty_table(spark):
    frame = spark.createDataFrame([(1, '{"Pin": 4, "token": 5}')], "id int, body string")
    assert redaction.redact(frame, "id", "body", ("pin",)).first().body == '{"Pin":"<redacted>","token":5}'
    assert redaction.redact(frame.limit(0), "id", "body").count() == 0


def test_shallow_texts_are_redacted_in_their_rows(spark, monkeypatch):
    """Texts of up to six levels are never taken apart; one that is deeper doesn't change how the others are read."""
    shallow = [(1, '{"b":[{"Key":{"x":[1]}},[],{}],"a":null}'), (2, "no json"), (3, None), (4, '[[[[[{"z":"\\u0000","token":[[1]]}]]]]]'), (5, "3")]
    written, tags = redaction.materialise, []
    monkeypatch.setattr(redaction, "materialise", lambda df, tag, **k: tags.append(tag) or written(df, tag, **k))
    want = {1: '{"a":null,"b":[{"Key":"<redacted>"},[],{}]}', 2: "no json", 3: None, 4: '[[[[[{"token":"<redacted>","z":"\\u0000"}]]]]]', 5: "3"}
    out = redaction.redact(spark.createDataFrame(shallow, "id int, body string"), "id", "body")
    assert {r.id: r.body for r in out.collect()} == want and tags == ["json-texts"]
    deep = [(6, '[[[[[[[[{"a":{"secret":1},"b":2}]]]]]]]]')]
    out = redaction.redact(spark.createDataFrame(shallow + deep, "id int, body string"), "id", "body")
    assert {r.id: r.body for r in out.collect()} == want | {6: '[[[[[[[[{"a":{"secret":"<redacted>"},"b":2}]]]]]]]]'} and "json-level" in tags
