"""Near copies against all pairs by brute force."""
import random

import corpus_pipeline as P
from conftest import SF
from reeltide.llm import copies


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / max(1, len(a | b))


def changed_texts():
    """60 texts of 150 words with a copy of one or two other words, 60 without, and 40 of one template that are just not alike."""
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(3000)]
    texts = {i: [rng.choice(vocabulary) for _ in range(150)] for i in range(120)}
    for i in range(60):
        changed = list(texts[i])
        for k in rng.sample(range(150), 1 + i % 2):
            changed[k] = rng.choice(vocabulary)
        texts[1000 + i] = changed
    template = [rng.choice(vocabulary) for _ in range(150)]
    for i in range(40):
        texts[2000 + i] = template[:110] + [rng.choice(vocabulary) for _ in range(40)]
    return {i: " ".join(t) for i, t in texts.items()}


def test_changed_words_go(llm, monkeypatch):
    texts = changed_texts()
    alike = [(a, b) for a in texts for b in texts if a < b and similarity(texts[a], texts[b]) >= 0.8]
    assert len(alike) >= 60 and all(b == a + 1000 for a, b in alike)
    frame = llm.createDataFrame(list(texts.items()), "doc_id long, text string")
    for size in (512, 16):  # one block, and block pair by block pair
        monkeypatch.setattr(copies, "BLOCK_TEXTS", size)
        left = {r["doc_id"] for r in P.near_dedup(llm, frame, SF).collect()}
        assert left == set(texts) - {b for _, b in alike}


def test_near_copies_odd(odd, empty):
    wide = {r["node"]["doc_id"]: r["component"]["doc_id"] for r in copies.near_copies(odd).collect()}
    assert None not in wide and wide[0] == 0 and set(wide) >= {0, 3, 5, 7} and copies.near_copies(empty).count() == 0


def test_stage_on_documents(llm, documents):
    """Every class of op8's bits and of similar texts leaves its smallest id, by brute force."""
    from test_queries import smallest_of_classes
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    assert {r["doc_id"] for r in P.near_dedup(llm, docs, SF).collect()} == smallest_of_classes({i: t or "" for i, t, _ in documents})


def test_language_stage(llm, documents):
    """Random letters, an unlearned script and a text without a letter go; short texts of the learned languages stay, with all columns."""
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(6)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(600))
    short = [" ".join((t or "").split()[:4]) for _, t, lang in documents if lang and t][:20]
    short = [t for t in short if t.isascii() and all(w.isalpha() for w in t.split())]
    more = {-1: noise, -2: "Это русский текст о доме и саде и о людях, которые в нём живут", -3: "12 34 -- 56", -4: None}
    more |= {-100 - k: t for k, t in enumerate(short)}
    rows = docs.unionByName(llm.createDataFrame([(i, t) for i, t in more.items()], "doc_id long, text string"), allowMissingColumns=True)
    told = P.language_id(llm, rows, SF)
    left = {r["doc_id"] for r in told.collect()}
    assert told.columns == docs.columns and short
    assert {i for i in more if i in left} == {i for i in more if i <= -100}
    assert {i for i, t, lang in documents if lang and len(t or "") > 200} <= left
