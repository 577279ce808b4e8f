"""Scalar functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import parsing as P
from corpusmill.functions import text as X
from corpusmill.functions import vectors as V
from corpusmill.operators import retrieve as R


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("raw", "plain"),
    [
        (r"$$6520.92 \times 2 = \mathbf{13,041.84元}$$", "6520.92 × 2 = 13,041.84元"),
        (r"a \div b \approx c \leq d \geq e", "a ÷ b ≈ c ≤ d ≥ e"),
        (r"x \neq y \equiv z \pm 1", "x ≠ y ≡ z ± 1"),
        (r"a \cdot b", "a · b"),
        (r"$$a = b\\nc = d$$", "a = b\nnc = d"),
    ],
)
def test_plain_math(spark, raw, plain):
    assert one(spark, X.plain_math(F.col("t")), t=raw) == plain


def test_tokens(spark):
    got = one(spark, X.tokens(F.col("t")), t="养老中心有哪些 The API api")
    assert "养老" in got and "中心" in got and "哪些" not in got and got.count("api") == 1 and "the" not in got


@pytest.mark.parametrize(
    ("query", "kind"),
    [("智能终端怎么安装", "fuzzy"), ("白杨街道怎么走", "fuzzy"), ("白杨街道晨光社区居家养老服务照料中心", "precise"), ("浙民事〔2025〕84号", "precise"), ("骨灰寄存", "normal"), ("PDCA循环", "normal")],
)
def test_query_class(spark, query, kind):
    assert one(spark, R.query_class(F.col("q")), q=query) == kind


def test_citations(spark):
    t = F.col("t")
    assert one(spark, X.citations(t), t="[1] [3] [2]") == [1, 3, 2]
    assert one(spark, X.citations(t), t="[2] [1] [2] [文字]") == [2, 1]
    assert one(spark, X.valid_citations(t, F.lit(3)), t="[1] [9] [3]") == [1, 3]
    assert one(spark, X.invalid_citations(t, F.lit(5)), t="[1] [9] [0]") == [9, 0]
    assert one(spark, X.drop_citations(t, X.invalid_citations(t, F.lit(5))), t="a [1] b [9]") == "a [1] b "
    for text, want in [("", False), ("，。！？", False), ("[1] [2] [3]", False), ("短", False), ("This sentence says something of substance.", True)]:
        assert one(spark, X.substantive(t), t=text) is want


def test_compress(spark):
    assert one(spark, X.compress(F.col("t"), 100), t="A" * 200) == "A" * 50 + "\n...\n" + "A" * 50
    assert one(spark, X.compress(F.col("t"), 100), t="A" * 100) == "A" * 100
    assert one(spark, X.compress(F.col("t"), 0), t="A" * 200) == "A" * 200


def test_simhash(spark):
    def distance(a, b):
        return one(spark, V.hamming(V.simhash(F.col("a")), V.simhash(F.col("b"))), a=a, b=b)

    assert distance("骨灰安置是指将骨灰安放在骨灰堂的过程", "骨灰安置是指将骨灰安放在骨灰堂中的过程") <= 5
    assert distance("骨灰安置政策条例", " JavaScript编程入门教程") > 10
    assert tuple(one(spark, V.simhash(F.col("t")), t="")) == (0, 0)


def test_clean_and_join_lines(spark):
    assert one(spark, X.clean_symbols(F.col("t")), t="中 中 中■ a    b") == "中中中 a b"
    assert one(spark, X.join_lines(F.col("t")), t="This line is broken for the\neye alone, it goes on.\n\nNext") == "This line is broken for the eye alone, it goes on.\n\nNext"
    assert one(spark, X.join_lines(F.col("t")), t="这是一行被折断的中文文本它还没有结束而且\n继续写下去这里才是结尾。\n下一句另起一行。") == "这是一行被折断的中文文本它还没有结束而且继续写下去这里才是结尾。\n下一句另起一行。"


def test_parsing(spark):
    raw = F.col("r")
    schema = "score int, ok string"
    for text in ('{"score": 5, "ok": "true"}', 'x\n```json\n{"score": 5, "ok": "true"}\n```', 'so {"score": 5, "ok": "true"} it is'):
        assert one(spark, P.lenient_json(raw, schema), r=text)["score"] == 5
    assert one(spark, P.lenient_json(raw, schema), r="no json") is None
    assert len(one(spark, P.lenient_json(raw, f"array<struct<{schema.replace(' ', ':', 1).replace('ok string', 'ok:string')}>>", array=True), r='[{"score": 1, "ok": "a"}, {"score": 2, "ok": "b"}, {"sco')) == 2
    assert one(spark, P.tag_list(raw), r='["a", " b ", ""]') == ["a", "b"]
    assert one(spark, P.tag_list(raw), r="a，b、c d") == ["a", "b", "c", "d"]
    assert one(spark, P.sub_queries(raw), r="1. first\n2. second") == ["first", "second"]
    assert one(spark, P.sub_queries(raw), r="What is it?\nWhere is it?") == ["What is it?", "Where is it?"]
    assert one(spark, P.sub_queries(raw), r="one plain line") == []


def test_inject_title_is_idempotent(spark):
    first = one(spark, X.inject_title(F.col("c"), F.lit("T$1")), c="[s] a=1")
    assert first == "[s] doc=T$1 | a=1"
    assert one(spark, X.inject_title(F.col("c"), F.lit("T$1")), c=first) == first


def test_sql_functions(spark):
    from corpusmill.functions.register import register

    register(spark)
    row = spark.sql("SELECT hamming64(5, 6) h, cosine(array(1D, 0D), array(1D, 0D)) c, cosine(array(0D), array(1D)) z, citation_indices('a [2] [1] [2]') i, clean_text('a■    b') t, length(content_id('x')) n").first()
    assert (row.h, row.c, row.z, row.i, row.t, row.n) == (2, 1.0, 0.0, [2, 1], "a b", 32)
    parts = spark.sql(r"SELECT * FROM split_chunks('one two.\nthree four five', 12, 2)").collect()
    assert parts[0]["start_char"] == 0 and parts[-1]["end_char"] == 24


def test_nfkc_in_tokens(spark):
    """Ligatures, half-width kana, circled digits and composed accents meet their plain forms; other texts stay in built-in functions."""
    for raw, plain in (("ﬁnd ﬁle", "find file"), ("ｶﾞｲﾄﾞ", "ガイド"), ("Café", "Café"), ("③ items", "3 items"), ("ＡＢＣ　x", "abc x")):
        assert one(spark, X.tokens(F.col("t")), t=raw) == one(spark, X.tokens(F.col("t")), t=plain)
    assert one(spark, X.tokens(F.col("t")), t="") == [] and spark.range(1).select(X.tokens(F.lit(None).cast("string")).alias("x")).first()[0] is None


def test_join_lines(spark):
    cases = {
        "第一行\n第二行文字比较长一些用来测试合并的情况如何": "第一行第二行文字比较长一些用来测试合并的情况如何",
        "这一句已经结束了。\n下一段": "这一句已经结束了。\n下一段",
        "An English line that goes on\nhere and ends.\nA new one": "An English line that goes on here and ends.\nA new one",
        "some words that are long enough to be prose\n1. item\n（2）item": "some words that are long enough to be prose\n1. item\n（2）item",
        "some words that are long enough to be prose\nTITLE LINE\r\n\r\n\r\nmore": "some words that are long enough to be prose\nTITLE LINE\n\nmore",
        "标题\n短行": "标题\n短行",
        "甲乙丙丁戊己庚辛壬癸甲乙丙丁戊己庚辛壬癸\n，子丑": "甲乙丙丁戊己庚辛壬癸甲乙丙丁戊己庚辛壬癸，子丑",
        "": "",
    }
    for raw, want in cases.items():
        assert one(spark, X.join_lines(F.col("t")), t=raw) == want


def test_simhash_equals_brute_force(spark):
    import hashlib
    import re

    for text in ("", "The API api 12 骨灰安置 x", "a a b", "word " * 300 + "other " * 299):
        votes = [0] * 64
        for w in re.findall("[一-鿿]|[a-z]+|[0-9]+", text.lower()):
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[8:], "big")
            votes = [v + (1 if h >> k & 1 else -1) for k, v in enumerate(votes)]
        want = sum(1 << k for k, v in enumerate(votes) if v > 0)
        got = one(spark, V.simhash(F.col("t")), t=text)
        assert got["hi"] << 32 | got["lo"] == want
