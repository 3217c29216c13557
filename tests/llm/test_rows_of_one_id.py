"""Rows of one id with different texts are documents of their own."""
import corpus_pipeline as P


def test_a_unique_text_stays_beside_a_copy(llm):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(3, texts[0]), (5, texts[1]), (5, texts[0]), (7, texts[2]), (7, texts[2])]
    for order in (rows, rows[::-1]):
        docs = llm.createDataFrame(order, "doc_id long, text string").repartition(3)
        assert sorted(map(tuple, P.near_dedup(llm, docs, "").collect())) == sorted(set(rows) - {(5, texts[0])})
