"""Language ID by cross-parsing: the language whose labelled text parses a document into the fewest phrases wins."""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, table, whole

#: The bounded sample of labelled text: per language at most so many documents, and characters of each, and in all.
SAMPLE_DOCS = 256
SAMPLE_DOC_CHARS = 600
REFERENCE_CHARS = 30_000
#: A text is parsed in stretches of so many letters side by side; a stretch goes on with the phrase that the one before it left.
STRETCH = 128
#: Lanes that are walked letter by letter instead of side by side.
FEW_LANES = 64
UNKNOWN = "und"
_SLICE_CHARS = 1 << 20
#: How sharply the share of bits a letter turns into a score.
SHARPNESS = 6.0


def plain(text: str) -> str:
    """Lower case, everything that is no letter a blank, runs of blanks one."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class SuffixAutomaton:
    """All substrings of a text of letter codes below width.

    A state is a number; its edge for code c, if it has one, stands in the slot state + c of one table that all states share: owner
    holds the state, ahead the next one. So the table grows with the edges, whatever the number of letters.
    """

    def __init__(self, codes: list[int], width: int):
        edges, link, length = [{}], [-1], [0]
        last = 0
        for c in codes:
            cur = len(edges)
            edges.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = cur
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(edges)
                    edges.append(dict(edges[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.size = len(codes)
        self._pack(edges, width)

    def _pack(self, edges: list[dict[int, int]], width: int) -> None:
        """Give every state a number of its own whose slots are free; three of four slots stay free.

        States with many edges go first. All states of about one number of edges try random places at once; those whose slots are taken,
        or wanted by another one too, try again.
        """
        degree = np.array([len(e) for e in edges])
        first = np.cumsum(degree) - degree
        code = np.fromiter((c for e in edges for c in e), np.int64, degree.sum())
        target = np.fromiter((t for e in edges for t in e.values()), np.int64, degree.sum())
        rng = np.random.default_rng(5)
        room = 4 * (len(code) + len(edges))
        owner, used, claim = np.full(room + width, -1, np.int64), np.zeros(room, bool), np.full(room + width, -1, np.int64)
        state = np.zeros(len(edges), np.int64)
        size_class = np.ceil(np.log2(degree + 1))
        for k in np.unique(size_class)[::-1]:
            left = np.flatnonzero(size_class == k)
            while len(left):
                at, n = rng.integers(0, room, len(left)), degree[left]
                which = np.repeat(np.arange(len(left)), n)
                slots = at[which] + code[first[left][which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                claim[slots] = which
                bad = np.bincount(which, (owner[slots] >= 0) | (claim[slots] != which), minlength=len(left)) > 0
                claim[at] = np.arange(len(left))
                fits = ~bad & ~used[at] & (claim[at] == np.arange(len(left)))
                state[left[fits]] = at[fits]
                used[at[fits]] = True
                owner[slots[fits[which]]] = at[which][fits[which]]
                left = left[~fits]
        # behind a letter that no edge knows, and before a text, every letter begins a phrase: a number without slots
        self.start = int(np.flatnonzero(~used)[0])
        slots = np.repeat(state, degree) + code
        self.owner, self.ahead, self.first = owner, np.zeros(room + width, np.int64), np.full(width, self.start, np.int64)
        self.ahead[slots] = state[target]
        for c, t in edges[0].items():
            self.first[c] = state[t]


@lru_cache(maxsize=1)
def lower_letters() -> np.ndarray:
    """The lower-case code point of every letter; 0x110000 for what is no letter. A letter whose lower case is longer stands for itself."""
    out = np.full(0x110000, 0x110000, np.int32)
    for i in range(0x110000):
        if chr(i).isalpha():
            low = chr(i).lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


class CrossParser:
    """One automaton a language over the letters of all references. Code 0 pads, 1 is a letter that no reference has, 2 the blank."""

    def __init__(self, references: tuple[tuple[str, str], ...]):
        self.languages = [name for name, _ in references]
        letters = sorted({c for _, text in references for c in text} - {" "})
        codes = {" ": 2, **{c: 3 + i for i, c in enumerate(letters)}}
        own = np.ones(0x110000 + 1, np.int32)
        own[-1] = 2
        for c, code in codes.items():
            own[ord(c)] = code
        self.code = own[lower_letters()]
        automata = [SuffixAutomaton([codes[c] for c in text], 3 + len(letters)) for _, text in references]
        # one table for all languages: the numbers of an automaton begin where those of the one before it end
        base = np.cumsum([0, *[len(a.owner) for a in automata]])
        self.edge = np.concatenate([np.where(a.owner >= 0, (a.owner + at << 32) + a.ahead + at, -1) for a, at in zip(automata, base)])
        self.first = np.stack([a.first + at for a, at in zip(automata, base)])
        self.start = np.array([a.start + at for a, at in zip(automata, base)])
        self.size = np.array([a.size for a in automata])

    def step(self, language, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after one more letter, whether that letter begins a phrase)."""
        found = self.edge[state + code] ^ (state << 32)
        begins = found >> 32 != 0
        return np.where(begins, self.first[language, code], found), begins

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of every text in every language, and the number of its letters and single blanks."""
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) + 1 for t in texts])
        row = np.repeat(np.arange(len(texts)), lengths)
        code = self.code[points]
        keep = np.ones(len(code), bool)  # a text begins without blanks
        keep[:1] = code[:1] != 2
        keep[1:] = (code[1:] != 2) | (code[:-1] != 2)
        keep[np.cumsum(lengths) - 1] = False
        code, row = code[keep], row[keep]
        n = np.bincount(row, minlength=len(texts))
        lanes = -(-n // STRETCH)
        lane_row = np.repeat(np.arange(len(texts)), lanes)
        within = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
        lane = (np.cumsum(lanes) - lanes)[row] + within // STRETCH
        filled = np.bincount(lane, minlength=len(lane_row))
        order = np.argsort(-filled, kind="stable")  # long lanes first
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        grid = np.zeros((STRETCH, len(order)), np.int32)
        grid[within % STRETCH, place[lane]] = code
        filled, lane_row = filled[order], lane_row[order]
        before = np.where(np.concatenate([[False], np.diff(np.repeat(np.arange(len(texts)), lanes)) == 0])[:len(order)][order], place[order - 1], -1)
        begun = self._begun(grid, filled, before)
        return np.stack([np.bincount(lane_row, own, minlength=len(texts)) for own in begun], axis=1), n

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised phrases: bits a letter when each phrase is a pointer into the language's text; and the number of letters."""
        found, n = self.phrases(texts)
        return found * np.log2(np.maximum(2, self.size)) / np.maximum(n, 1)[:, None], n

    def _begun(self, grid: np.ndarray, filled: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Phrases that begin inside every lane, for every language. A lane is a column of grid, filled from the top, long ones first; before is
        the lane it follows, or -1.

        All lanes first begin a phrase. Then each lane whose predecessor left another state is walked again from that, beside its old
        walk, until both agree, as they soon do; this is repeated until no lane is left with a wrong beginning. Once only few lanes are left,
        as in long texts of one repeated passage, each is followed letter by letter through the lanes behind it.
        """
        after = np.full(len(filled), -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        every = np.arange(len(self.languages))[:, None]
        start = self.start[:, None]
        state = np.repeat(start, len(filled), axis=1)
        count = np.zeros(state.shape, np.int64)
        for t in range(STRETCH):
            m = int(np.searchsorted(-filled, -t, side="left"))
            if not m:
                break
            state[:, :m], begins = self.step(every, state[:, :m], grid[t, :m])
            count[:, :m] += begins
        entry = np.repeat(start, len(filled), axis=1)
        while True:
            wanted = np.where(before >= 0, state[:, before], start)
            k, lane = np.nonzero(wanted != entry)
            if not len(k):
                return count
            if len(k) <= FEW_LANES:
                for i, at in zip(k.tolist(), lane.tolist()):
                    self._follow(i, at, int(state[i, before[at]]), (state[i], entry[i], count[i]), grid, filled, after)
                continue
            old, new = entry[k, lane], wanted[k, lane]
            entry[k, lane] = new
            live = np.arange(len(k))
            for t in range(STRETCH):
                live = live[(old[live] != new[live]) & (t < filled[lane[live]])]
                if not len(live):
                    break
                at, code = k[live], grid[t, lane[live]]
                old[live], gone = self.step(at, old[live], code)
                new[live], come = self.step(at, new[live], code)
                count[at, lane[live]] += come.astype(np.int64) - gone
            live = np.flatnonzero(old != new)
            state[k[live], lane[live]] = new[live]

    def _follow(self, language: int, lane: int, new: int, own: tuple[np.ndarray, np.ndarray, np.ndarray], grid: np.ndarray, filled: np.ndarray, after: np.ndarray) -> None:
        """Walk a lane, and those behind it, that begins in state new, until the walk agrees with the old one. own: states, entries and counts."""
        state, entry, count = own
        edge, first = memoryview(self.edge), self.first[language].tolist()
        while lane >= 0 and entry[lane] != new:
            old, more = int(entry[lane]), 0
            entry[lane] = new
            for c in grid[:filled[lane], lane].tolist():
                if old == new:
                    break
                found = edge[old + c] ^ old << 32
                old, gone = (first[c], 1) if found >> 32 else (found, 0)
                found = edge[new + c] ^ new << 32
                new, come = (first[c], 1) if found >> 32 else (found, 0)
                more += come - gone
            count[lane] += more
            if old == new:
                return
            state[lane] = new
            lane = int(after[lane])


@held
def parser(references: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(references)


def _some(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """_lang, _h, _t (middle) of the document of the smallest hash in each of SAMPLE_DOCS buckets of every language, found on id and language alone."""
    key = F.xxhash64(F.lit("lang"), F.col(id_col))
    some = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = some.select(F.col(lang_col).alias("_lang"), key.alias("_h")).groupBy("_lang", F.pmod("_h", F.lit(SAMPLE_DOCS)).alias("_b")).agg(F.min("_h").alias("_h"))
    middle = F.greatest(F.lit(1), F.expr(f"(length(`{text_col}`) - {SAMPLE_DOC_CHARS}) div 2"))
    texts_of = some.select(F.col(lang_col).alias("_lang"), key.alias("_h"), F.substring(F.col(text_col), middle, F.lit(SAMPLE_DOC_CHARS)).alias("_t"))
    return texts_of.join(chosen.drop("_b"), ["_lang", "_h"], "left_semi").distinct()


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[tuple[str, str], ...]:
    """Reference text of every language: a hash-spread sample of its documents, bounded as stated above."""
    texts: dict[str, list[str]] = {}
    for r in sorted(_some(labelled, id_col, text_col, lang_col).collect(), key=lambda r: (r["_lang"], r["_h"], r["_t"])):
        texts.setdefault(r["_lang"], []).append(plain(r["_t"]))
    return tuple((lang, " ".join(t)[:REFERENCE_CHARS]) for lang, t in sorted(texts.items()))


def usual_bits(labelled: DataFrame, references: tuple[tuple[str, str], ...], quantile: float = 0.9, text_col: str = "text", lang_col: str = "lang") -> float:
    """Bits a letter that this share of the texts of the language with the highest figure does not exceed; infinite without such texts.

    Measured on every whole text of the labelled documents; give those that the references were not taken from.
    """
    texts = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_t"))
    told = identify(texts, references, "_t").filter("row._lang = lang_pred")
    most = told.groupBy("lang_pred").agg(F.percentile_approx("bits", quantile).alias("b")).agg(F.max("b")).first()[0]
    return float("inf") if most is None else most


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(shared.value)
        for b in batches:
            texts = b.column("_t").to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= _SLICE_CHARS):
                    size += len(texts[end])
                    end += 1
                bits, letters = p.bits(texts[at:end])
                best = bits.argmin(1)
                odds = np.exp(-SHARPNESS * (bits - bits.min(1, keepdims=True)))
                part = b.slice(at, end - at)
                yield pa.record_batch([part.column("row"), pa.array([p.languages[k] for k in best], pa.string()), pa.array(1 / odds.sum(1)), pa.array(bits.min(1)), pa.array(letters), part.column("_has")],
                                      names=["row", "lang", "sure", "bits", "letters", "has"])
                at = end
    return run


def identify(docs: DataFrame, references: tuple[tuple[str, str], ...], text_col: str = "text") -> DataFrame:
    """row (all columns of docs), lang_pred, score (0 to 1), bits (a letter, of the best language), letters (with single blanks).

    Ties go to the first language by name. A text without a letter, a null text, and any text if nothing was learned is
    `und` with score 0. Every whole text is parsed.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole(text_col).alias("_t"))
    rows = rows.withColumn("_has", F.col("_t").rlike(r"\p{L}"))
    if not references:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"), F.lit(0).cast("long").alias("letters"))
    shared = docs.sparkSession.sparkContext.broadcast(references)
    told = rows.mapInArrow(_predict(shared), f"row {docs.schema.simpleString()}, lang string, sure double, bits double, letters long, has boolean")
    return told.select("row", F.when(F.col("has"), F.col("lang")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("has"), F.col("sure")).otherwise(0.0).alias("score"), "bits", "letters")


def held_out(id_col: str = "doc_id"):
    """True for ids that nothing is learned from. A null id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    references = learn(docs.filter(~held_out()))
    out = identify(docs.select("doc_id", "text"), references)
    return out.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")
