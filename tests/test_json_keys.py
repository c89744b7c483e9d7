"""Keys of JSON text as a table, and the limit on those that become columns."""

import pytest

from gridwash.operators import nested

DOCS = ['{"a": 1, "b": {"c": "x", "d.e": {"f": null}}}', '{"a": "1", "b": {"c": [1, {"z": 1}]}, "text": "{\\"not\\": 1}"}', '{"b": 2.5}', '[{"q": 1}]',
        "no json", "{}", None, '{"": {"A": true, "a": 1}}']


def test_every_key_is_listed(spark):
    docs = spark.createDataFrame([(d, 1) for d in DOCS], "doc string, path long").repartition(3)
    got = {(tuple(r.path), r.kind): r.rows for r in nested.json_keys(docs, "doc").collect()}
    assert got == {(("a",), "BIGINT"): 1, (("a",), "STRING"): 1, (("b",), "OBJECT"): 2, (("b",), "DECIMAL"): 1, (("b", "c"), "STRING"): 1,
                   (("b", "c"), "ARRAY"): 1, (("b", "d.e"), "OBJECT"): 1, (("b", "d.e", "f"), "VOID"): 1, (("text",), "STRING"): 1,
                   (("",), "OBJECT"): 1, (("", "A"), "BOOLEAN"): 1, (("", "a"), "BIGINT"): 1}
    assert nested.json_keys(docs.limit(0), "doc").collect() == []


def test_data_in_the_place_of_keys_is_refused(spark):
    users = spark.range(300).selectExpr("""concat('{"n": 1, "of": {"user', id, '": 1}}') AS doc""")
    assert len(nested.flatten_json_text(users, "doc", most_keys=302).columns) == 301
    with pytest.raises(ValueError, match="more than 301 keys"):
        nested.flatten_json_text(users, "doc", most_keys=301)
