"""The bound of the language stage comes from all labelled texts."""
from reeltide.llm import language


def test_every_labelled_text_counts_whole(spark, monkeypatch):
    text = "the cat sat on the mat and the dog sat on the cat "
    docs = spark.range(600).selectExpr("id AS doc_id", f"repeat('{text}', 1 + id % 40) AS text", "if(id % 6 = 5, null, 'en') AS lang")
    asked, real = [], language.identify
    monkeypatch.setattr(language, "identify", lambda d, *a: asked.append(d) or real(d, *a))
    bits = language.usual_bits(docs, (("en", text * 20),))
    assert 0 < bits < 5
    assert asked[0].count() == 500
    assert asked[0].agg({"_t": "max"}).count() == 1 and asked[0].selectExpr("max(length(_t))").first()[0] == 40 * len(text)
