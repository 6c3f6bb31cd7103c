import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.text import distinct_tokens, field_tokens, key_id, log_positive, normalize, passage_prompt, query_prompt, tokenize
from tessera.functions.vectors import dot, l2_normalize, mean_pool

LETTERS = st.text(alphabet=st.sampled_from("aZ09_ ёЁéñß.,-\t\n\xa0 　\x1c\x85é") | st.characters(max_codepoint=0x52F, exclude_categories=("Cs",)), max_size=40)


def py_normalize(t):
    words, word = [], ""
    for c in (t or "").lower() + " ":
        if not c.isspace():
            word += "е" if c == "ё" else c
        elif word:
            words.append(word)
            word = ""
    return " ".join(words)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LETTERS.filter(lambda t: not set(t) & set("Σİΐΰẞ")), min_size=20, max_size=60))
def test_normalize_and_tokens_follow_python(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.n, list(r.k)) for r in rows.select("i", normalize("t").alias("n"), tokenize("t").alias("k")).collect()}
    for i, t in enumerate(texts):
        n = py_normalize(t)
        if n != n.lower():
            continue
        assert got[i][0] == n
        if all(not re.match(r"[^\W_]", c) or c.isalnum() for c in n):
            assert got[i][1] == re.findall(r"[^\W_]+", n)


def test_text_edges(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    assert one(normalize(F.lit(None).cast("string"))) == ""
    assert one(tokenize(F.lit("éx a_b Ёлка 😀 12"))) == ["e", "x", "a", "b", "елка", "12"]
    assert one(field_tokens(F.lit("abc  defg"), 6)) == ["abc", "de"]
    assert one(distinct_tokens(F.lit("a b A"))) == ["a", "b"]
    assert one(passage_prompt(F.lit("T"), F.lit(None).cast("string"))) == "passage: T. "
    assert one(query_prompt(F.lit("q"), F.lit("f" * 300))) == "query: q. " + "f" * 200
    assert one(log_positive(F.lit(-3))) == 0.0
    assert one(log_positive(F.lit(None).cast("double"))) is None
    assert abs(one(dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))) - 11) < 1e-9
    assert one(l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(mean_pool(F.array(F.array(F.lit(1.0)), F.array(F.lit(3.0)), F.array(F.lit(9.0))), F.array(F.lit(1), F.lit(1), F.lit(0)))) == [2.0]


def test_key_id_equals_json_digest(spark):
    keys = [("a\"b\\é", 5, None), (None, None, "x"), ("плита", 0, "ё")]
    written = [r'["a\"b\\é",5,null]', '[null,null,"x"]', '["плита",0,"ё"]']
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "i int, a string, b long, c string")
    for r in rows.select("i", key_id("a", "b", "c").alias("k")).collect():
        assert r.k == hashlib.sha256(written[r.i].encode()).hexdigest()
