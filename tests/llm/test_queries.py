"""The registered queries on the small tables against brute force."""
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import SF
from oracle_check import compare
from tokenizers import Tokenizer

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def rows(llm, name):
    return [r.asDict() for r in QUERIES[name](llm, SF).collect()]


def base(text):
    words = text.encode().split()
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    n = len(words)
    return {"n_words": n, "word_chars": sum(len(w.decode()) for w in words), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(covered), "base_failed": n < 20 or 100 * len(covered) > 30 * n}


def test_names():
    assert [n for n in QUERIES if n.startswith("op")] == sorted([n for n in QUERIES if n.startswith("op")], key=lambda n: int(n[2:].split("_")[0]))
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op") and n[2].isdigit()} == set(range(1, 14)) and "pipeline" in QUERIES


def test_quality(llm, documents):
    labels = {r["doc_id"]: r["quality"] for r in llm.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in rows(llm, "op1_quality_rules")}
    assert len(got) == len(documents)
    for i, text, _ in documents:
        want = base(text)
        assert {k: got[i][k] for k in want} == want
        assert not (got[i]["base_failed"] and got[i]["kept"])
    judged = [(labels[i], got[i]["kept"]) for i in got if i in labels and not got[i]["base_failed"]]
    assert sum(bool(a) == b for a, b in judged) / len(judged) > 0.95


def test_toxicity(llm, documents):
    got = {r["doc_id"]: r for r in rows(llm, "op2_toxicity")}
    for i, _, _ in documents:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.5)


def test_toxicity_accuracy(llm):
    sf = SF.replace("0.001", "0.1")
    labels = {r["doc_id"]: r["toxic"] for r in llm.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[r["doc_id"]], r["predicted"]) for r in QUERIES["op2_toxicity"](llm, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    caught = [p for t, p in held if t]
    wrong = [p for t, p in held if not t]
    assert sum(caught) / len(caught) > 0.8 and sum(wrong) / len(wrong) < 0.02


def test_language(llm, documents):
    got = {r["doc_id"]: r for r in rows(llm, "op3_language_id")}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i]["score"] <= 1 for i, _, _ in documents)
    held = [got[i]["lang_pred"] == lang for i, _, lang in documents if got[i]["held_out"]]
    assert sum(held) / len(held) > 0.97


def cut(documents, window=20):
    seen, out = set(), {}
    for i, text, _ in sorted(documents):
        words = text.encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s:s + window])
            if w in seen:
                gone[s:s + window] = [True] * window
            seen.add(w)
        left = [w for w, g in zip(words, gone) if not g]
        out[i] = (len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


def test_substrings(llm, documents):
    want = cut(documents)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(llm, "op4_substring_dedup")} == want
    assert sum(w[1] for w in want.values()) > 0


@pytest.mark.parametrize("name", sorted(ORACLE.keys() & {n for n in QUERIES if n.startswith("op")}))
def test_sql(llm, name):
    verdict, _, note = compare(llm, SF, name, QUERIES[name], ORACLE[name])
    assert verdict == "ok", note


def check_pieces(pieces, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = tokenizer.encode(texts[i], add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"]:at], "<u4").tobytes())
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 4096
        padding += 4096 - at if at & (at - 1) else 0
    assert padding == 0


def test_packing(llm, documents):
    check_pieces(rows(llm, "op6_packing"), {i: t for i, t, _ in documents})


def test_fingerprints(llm, documents):
    got = {r["doc_id"]: r for r in rows(llm, "op7_fingerprints")}
    order = sorted(documents, reverse=True)
    by_print, by_text = {}, {}
    near_edited, near_next = [], []
    for k, (i, text, _) in enumerate(order):
        follow = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + follow[:half]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        by_print.setdefault(r["fingerprint"], set()).add(tuple(sorted(x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r"))))
        by_text.setdefault(text, set()).add(r["fingerprint"])
        near_edited.append(r["near_edited"])
        near_next.append(r["near_next"])
    assert all(len(v) == 1 for v in by_print.values()) and all(len(v) == 1 for v in by_text.values())
    assert 0.4 < np.mean(near_edited) < 0.6 and np.mean(near_next) < 0.15


def simhash(text):
    words = text.encode().lower().split()
    runs = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in runs]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def classes(prints, bits=3):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(llm, documents):
    prints = {i: simhash(t) for i, t, _ in documents}
    want = classes(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(llm, "op8_simhash")}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_bpe(llm, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    got = {r["doc_id"]: r for r in rows(llm, "op9_bpe")}
    for i, text, _ in documents:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_shards(got, sources, shards=40):
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    total = Counter(sources.values())
    for s, n in counts.items():  # the mixture: no source is off its share by more than one row at each end
        own = Counter(sources[r["doc_id"]] for r in got if r["shard"] == s)
        assert all(abs(own[k] - total[k] * n / len(got)) <= 2 for k in total)


def test_sharding(llm, documents):
    got = rows(llm, "op10_sharding")
    texts = {i: t for i, t, _ in documents}
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
    check_shards(got, {r["doc_id"]: r["source"] for r in got})


def smallest_of_classes(texts):
    """The smallest id of every class of op8's bits and of texts alike to 0.8 or more, by all pairs."""
    from test_copies import shingles
    prints, sets = {i: simhash(t) for i, t in texts.items()}, {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    links = [(a, b) for a in texts for b in texts if a < b and (bin(prints[a] ^ prints[b]).count("1") <= 3 or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) > 0)]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return set(label.values())


def test_pipeline(llm, documents):
    """Stage by stage: every stage's result follows from its own input."""
    import corpus_pipeline as P
    assert [n for n, _ in P.STAGES][3:] == ["substring dedup", "packing"] and len(P.STAGES) == 5
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = P.quality_rules(llm, docs, SF)
    assert kept.columns == columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    good = {r["doc_id"] for r in rows(llm, "op1_quality_rules") if r["kept"]}
    assert set(texts) == good
    told = P.language_id(llm, kept, SF)
    assert told.columns == columns and {r["doc_id"] for r in told.collect()} == good
    single = P.near_dedup(llm, told, SF)
    left = {r["doc_id"]: r["text"] for r in single.collect()}
    assert single.columns == columns and set(left) == smallest_of_classes(texts)
    clean = P.substring_dedup(llm, single, SF)
    expected = cut([(i, t, None) for i, t in left.items()])
    after = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == columns and set(after) == set(left)
    for i, r in after.items():
        assert r["n_chars"] == len(r["text"]) and hashlib.sha256(b" ".join(r["text"].encode().split())).hexdigest() == expected[i][2]
    pieces = [r.asDict() for r in QUERIES["pipeline"](llm, SF).collect()]
    check_pieces(pieces, {i: r["text"] for i, r in after.items()})
