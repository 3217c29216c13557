"""Fill-in-middle transformation: cuts of every text are located by the code points counted in content-defined chunks."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import let, table, whole

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = 1
#: Of a hundred texts so many are transformed, and of a hundred transformed ones so many put the suffix first.
MIDDLE_PERCENT = 90
SUFFIX_FIRST_PERCENT = 20
#: Bytes under the rolling hash, bits of it that are zero at a chunk's end (1 KB on average), and bounds of a chunk.
WINDOW = 32
END_BITS = 10
LEAST_BYTES = 256
MOST_BYTES = 8_192
#: Bytes of chunks that a task remembers; it starts anew beyond.
MEMORY_BYTES = 64 << 20
_U = np.uint64


def checked(marks: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    """The marks in UTF-8. A text must be told from its marks, so none may be empty, hold or overlap another or itself."""
    p, s, m = raw = tuple(x.encode() for x in marks)
    for a in raw:
        for b in raw:
            if not a or (a is not b and b in a) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a is not b))):
                raise ValueError(f"marks overlap: {marks}")
    return p, s, m


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Chunk ends of every text: where the hash of the last WINDOW bytes ends in zeros, at least and at most so far from the last end."""
    h = scan.mix(scan.rolling(data.astype(_U) + _U(1), WINDOW))
    marks = np.flatnonzero((h & _U((1 << END_BITS) - 1)) == 0) + WINDOW
    out = []
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        ends, last = [], a
        for e in marks[np.searchsorted(marks, a + WINDOW):np.searchsorted(marks, z)].tolist():
            while e - last > MOST_BYTES:
                last += MOST_BYTES
                ends.append(last)
            if e - last >= LEAST_BYTES:
                ends.append(e)
                last = e
        ends += range(last + MOST_BYTES, z, MOST_BYTES)
        out.append(np.array(ends + [z] if z > a else ends, np.int64))
    return out


class ChunkMemory:
    """Summaries of chunks by hash, trusted only where the content is the same: (content, code points that begin, holds a mark, first and last bytes)."""

    def __init__(self, marks: tuple[bytes, ...], limit: int = MEMORY_BYTES):
        self.marks, self.limit, self.held, self.known, self.hits = marks, limit, 0, {}, 0
        self.reach = max(map(len, marks)) - 1

    def marked(self, part: bytes) -> bool:
        return any(m in part for m in self.marks)

    def summary(self, key: int, chunk: bytes) -> tuple:
        got = self.known.get(key)
        if got is not None and got[0] == chunk:
            self.hits += 1
            return got
        begins = np.count_nonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80)
        got = (chunk, begins, self.marked(chunk), chunk[:self.reach], chunk[-self.reach:] if self.reach else b"")
        if self.held + len(chunk) > self.limit:
            self.known, self.held = {}, 0
        if key not in self.known:
            self.known[key] = got
            self.held += len(chunk)
        return got

    def marks_in(self, parts: list[tuple]) -> bool:
        """Whether a mark lies in a chunk or over the border of chunks."""
        seam = b""
        for chunk, _, marked, first, last in parts:
            if marked or self.marked(seam + first):
                return True
            seam = last if len(chunk) >= self.reach else (seam + last)[-self.reach:]
        return False


def cut_at(parts: list[tuple], begins: np.ndarray, unit: int) -> int:
    """Byte at which code point number unit begins (the end of the text for the one after the last)."""
    k = int(np.searchsorted(begins, unit, side="right")) - 1
    before = sum(len(p[0]) for p in parts[:k])
    if k == len(parts):
        return before
    own = np.frombuffer(parts[k][0], np.uint8)
    return before + int(np.flatnonzero((own & 0xC0) != 0x80)[unit - begins[k]])


def transform(texts: pa.Array, draws: np.ndarray, marks: tuple[bytes, bytes, bytes], middle_percent: int, suffix_first_percent: int, memory: ChunkMemory) -> Iterator[tuple]:
    """(n, form, prefix, middle, output) of every text; draws are its four unsigned numbers."""
    p, s, m = marks
    for lo, hi, data, offsets in scan.slices(texts):
        sums = np.zeros(len(data) + 1, _U)
        power, inverse = scan._powers(scan.BASE, len(data) + 1)
        np.cumsum((data.astype(_U) + _U(1)) * power[:len(data)], out=sums[1:])
        raw = data.tobytes()
        for k, ends in enumerate(chunk_ends(data, offsets)):
            starts = np.concatenate([offsets[k:k + 1], ends])[:len(ends)]
            keys = scan.mix((sums[ends] - sums[starts]) * inverse[starts]).tolist()
            parts = [memory.summary(h, raw[a:z]) for h, a, z in zip(keys, starts.tolist(), ends.tolist())]
            begins = np.cumsum([0, *[x[1] for x in parts]])
            n, (h1, h2, h3, h4) = int(begins[-1]), draws[lo + k].tolist()
            text = raw[offsets[k]:offsets[k + 1]]
            if not n or h3 % 100 >= middle_percent or memory.marks_in(parts):
                yield n, "plain", None, None, text
                continue
            first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, z = cut_at(parts, begins, first), cut_at(parts, begins, last)
            prefix, middle, suffix = text[:a], text[a:z], text[z:]
            if h4 % 100 < suffix_first_percent:
                yield n, "spm", first, last - first, b"".join((s, suffix, p, prefix, m, middle))
            else:
                yield n, "psm", first, last - first, b"".join((p, prefix, s, suffix, m, middle))


def _apply(marks: tuple[bytes, bytes, bytes], middle_percent: int, suffix_first_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = ChunkMemory(marks)
        for b in batches:
            draws = np.frombuffer(b"".join(bytes.fromhex(x[:32]) for x in b.column("_h").to_pylist()), ">u4").reshape(-1, 4)
            n, form, first, middle, output = zip(*transform(b.column("_t"), draws, marks, middle_percent, suffix_first_percent, memory)) if b.num_rows else [()] * 5
            yield pa.record_batch([b.column("row"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                                  names=["row", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, middle_percent: int = MIDDLE_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, marks: tuple[str, str, str] = MARKS,
                   id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (struct of the columns in keep, else of all), n (code points), form (plain, psm, spm), prefix_chars, middle_chars, output.

    The two cuts, the form and the order are drawn from the SHA-256 of "seed:id" (a null id is drawn as an empty one), so a row's result depends
    on nothing else and repeated rows are alike. Empty and null texts and texts that hold a mark stay plain, with null counts.
    """
    raw = checked(marks)
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), whole(text_col).alias("_t"), draw.alias("_h"))
    schema = rows.select("row").schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    return rows.mapInArrow(_apply(raw, middle_percent, suffix_first_percent), schema)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of this form was made from."""
    p, s, m = marks

    def parts(first: str, second: str, swap: bool) -> Column:
        def cut(at: Column) -> Column:
            one = F.substr(output, F.lit(len(first) + 1), at["b"] - len(first) - 1)
            two = F.substr(output, at["b"] + len(second), at["c"] - at["b"] - len(second))
            three = F.substr(output, at["c"] + len(m))
            return F.concat(two, three, one) if swap else F.concat(one, three, two)
        return let(F.struct(F.instr(output, second).alias("b"), F.instr(output, m).alias("c")), cut)

    return F.when(form == "plain", output).when(form == "spm", parts(s, p, True)).otherwise(parts(p, s, False))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
numbered AS (
  SELECT *, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (n + 1) AS c2,
    CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM drawn),
formed AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS z,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbered),
cut AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, z - a) AS middle, substr(t, z + 1) AS suffix FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(z - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""
