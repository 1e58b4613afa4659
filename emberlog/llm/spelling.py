"""Spelling variants: words that are one edit apart, grouped below the most frequent spelling.

Words that one insertion, deletion or replacement parts have a common prefix and a common suffix that
together reach the longer length less one. The edit lies in one of a few segments of the longer word,
and what is before and after that segment is equal. So words meet in cells of equal length class, segment
and rest, and each cell is a dense tile: a matrix of padded code points, compared with itself by
common prefix and suffix. A cell with many words is cut into blocks, and each pair of blocks is a tile of its
own, so no cell is one task and no pair of words is ever a row: a tile gives each of its words the
number of near words and the best of them.

Defined cases: a null text has no words and a null doc_id counts as empty text; texts are read whole, long ones
in slices that end between runs; rows that repeat count each; of near words that are as frequent, the
smallest in code-point order is the form; a word without near words is its own root; an empty table
gives an empty result; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, small_or_shuffled, stored
from .simhash import whole_cells

#: What a word is made of: ASCII letters, and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
_ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: Characters of a long text that are searched at once, and distinct words that a task holds.
SLICE, HELD = 1 << 20, 200_000
#: Words of a block, and code points of its matrix.
BLOCK_WORDS, BLOCK_POINTS = 2048, 1 << 22
#: Segments that an edit may lie in: more give smaller tiles and more copies of each word.
SEGMENTS = 3


def runs(text: str, least: int) -> Counter:
    """The maximal runs of at least ``least`` letters, with their counts."""
    find, gap = re.compile(f"[{LETTERS}]{{{least},}}"), re.compile(f"[^{LETTERS}]")
    if len(text) <= SLICE:
        return Counter(find.findall(text))
    found, at = Counter(), 0
    while at < len(text):
        end = gap.search(text, min(at + SLICE, len(text)))
        end = end.start() if end else len(text)
        found.update(find.findall(text, at, end))
        at = end + 1
    return found


def _counted(least_length: int, typo_mod: int | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, int] = {}

        def flush() -> Iterator[pd.DataFrame]:
            words = list(total)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pd.DataFrame({"word": part, "n": np.fromiter((total[w] for w in part), np.int64, len(part))})
            total.clear()

        for pdf in frames:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                if not text:
                    continue
                start = zlib.crc32(f"{doc or ''}:".encode())
                for word, n in runs(text, least_length).items():
                    word = word.lower() if word.isascii() else word.translate(_ASCII_LOWER)
                    if typo_mod:
                        h = zlib.crc32(word.encode(), start)
                        if h % typo_mod == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                    total[word] = total.get(word, 0) + n
                if len(total) > HELD:
                    yield from flush()
        yield from flush()

    return run


def word_counts(docs: DataFrame, least_length: int = 5, least: int = 3, typo_mod: int | None = None) -> DataFrame:
    """(word, n) of the words of at least ``least_length`` code points that occur ``least`` times in all.

    Only A-Z is lower-cased. ``typo_mod`` plants misspellings to measure by: of a run whose unsigned
    crc32 of '<doc_id>:<run>' it divides, the code point at that number modulo the length is left out.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    counted = rows.mapInPandas(_counted(least_length, typo_mod), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _points(words: list[str], width: int, right: bool) -> np.ndarray:
    """One row of code points a word, padded by 0 on the left or right."""
    line = "".join(w.rjust(width, "\0") if right else w.ljust(width, "\0") for w in words)
    try:
        flat = np.frombuffer(line.encode("latin-1"), dtype=np.uint8)
    except UnicodeEncodeError:
        flat = np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32)
    return flat.reshape(len(words), width)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The common prefix lengths of all rows of a (cells, rows, width) with those of b."""
    same = np.ones((a.shape[0], a.shape[1], b.shape[1]), dtype=bool)
    length = np.zeros(same.shape, dtype=np.uint8 if a.shape[2] < 256 else np.int32)
    for t in range(a.shape[2]):
        same &= a[:, :, None, t] == b[:, None, :, t]
        if not same.any():
            break
        length += same
    return length


def tile(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], first: int, end: int) -> np.ndarray:
    """Which rows of each cell's matrix a are one edit from those of b, the longer being as long as the matrix is wide.

    a, b: code points padded on the right, the same padded on the left, and lengths (0: no word).
    The edit follows the common prefix; a pair belongs to the cell whose segment, ``first`` to ``end``, holds it.
    """
    width = a[0].shape[2]
    prefix = _common(a[0], b[0])
    near = (prefix >= first) & (prefix < end) & (prefix < width)
    near &= (a[2][:, :, None] == width) | (b[2][:, None, :] == width)
    near &= (a[2][:, :, None] > 0) & (b[2][:, None, :] > 0)
    return near & (_common(a[1][:, :, ::-1], b[1][:, :, ::-1]).astype(np.int32) + prefix >= width - 1)


def _side(size: int) -> int:
    """The size of tile that a cell is padded to: 2, 3, 4, 6, 8, 12 and so on."""
    top = 1 << (size - 1).bit_length()
    return top * 3 // 4 if top >= 4 and size <= top * 3 // 4 else top


def _tiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each word of each tile: how many near words the tile has, and the best, by frequency and order."""
    keys = ["cell", "i", "j"]
    for pdf in whole_cells(frames, keys):
        # Rows come sorted by cell, then best first, so the first near word of a row is its best.
        key = pdf[keys].to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
        starts, sizes = edge[:-1], np.diff(edge)
        words, n = pdf["word"].to_numpy(dtype=object), pdf["n"].to_numpy()
        width, first, end, block = (pdf[c].to_numpy() for c in ("width", "first", "end", "block"))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, near words, best rows

        def keep(near: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
            count = near.sum(axis=-1)
            cell, row = np.nonzero(count)
            out.append((rows[cell, row], count[cell, row], columns[cell, near[cell, row].argmax(axis=-1)]))

        def matrices(rows: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """rows: (cells, words) of row numbers, -1 where a cell has no more."""
            flat = rows.ravel()
            there = flat >= 0
            text = ["" if r < 0 else words[r] for r in flat.tolist()]
            shape = (*rows.shape, wide)
            return _points(text, wide, False).reshape(shape), _points(text, wide, True).reshape(shape), np.where(there, lengths[flat], 0).reshape(rows.shape)

        alike: dict[tuple[int, int, int, int], list[int]] = {}
        for c in np.flatnonzero(sizes > 1).tolist():
            s, size = int(starts[c]), int(sizes[c])
            shape = int(width[s]), int(first[s]), int(end[s])
            if key[s, 1] == key[s, 2]:
                alike.setdefault((*shape, _side(size)), []).append(c)
                continue
            rows = np.arange(s, s + size)
            left, right = (rows[block[s : s + size] == key[s, k]][None] for k in (1, 2))
            if left.size and right.size:
                near = tile(matrices(left, shape[0]), matrices(right, shape[0]), *shape[1:])
                keep(near, left, right)
                keep(near.transpose(0, 2, 1), right, left)
        for (wide, *segment, side), cells in alike.items():
            at_once = max(1, (1 << 22) // (side * max(side, wide)))
            for k in range(0, len(cells), at_once):
                part, place = np.array(cells[k : k + at_once]), np.arange(side)[None, :]
                rows = np.where(place < sizes[part][:, None], starts[part][:, None] + place, -1)
                m = matrices(rows, wide)
                near = tile(m, m, *segment)
                near[:, np.arange(side), np.arange(side)] = False
                keep(near, rows, rows)
        if out:
            rows, count, best = map(np.concatenate, zip(*out))
            yield pd.DataFrame({"word": words[rows], "near": count.astype(np.int64), "best_n": n[best], "best": words[best]})


def near_words(words: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n; distinct) that have a word one edit away."""
    length = F.char_length("word")
    kinds = [F.struct((length + more).alias("width"), F.lit(k).alias("segment")) for more in (0, 1) for k in range(segments)]
    cells = words.where(length > 0).select("word", "n", F.explode(F.array(*kinds)).alias("k")).select("word", "n", "k.*")
    bound = lambda k: F.floor(F.col("width") * k / segments).cast("int")
    cells = cells.select("word", "n", "width", bound(F.col("segment")).alias("first"), bound(F.col("segment") + 1).alias("end")).where("first < end")
    rest = F.struct(F.substring("word", F.lit(1), F.col("first")), F.expr("right(word, width - end)"))
    cells = cells.withColumn("cell", F.xxhash64("width", "first", rest))
    most = F.greatest(F.lit(2), F.least(F.lit(BLOCK_WORDS), F.floor(F.lit(BLOCK_POINTS) / F.col("width")))).cast("int")
    heavy = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.max(most).alias("most")).where("size > most")
    heavy = stored(heavy.select(F.col("cell").alias("k"), F.ceil(F.col("size") / F.col("most")).cast("int").alias("blocks")), "spelling-heavy")
    cells = cells.join(small_or_shuffled(heavy, heavy.count(), 100_000), F.col("cell") == F.col("k"), "left").drop("k")
    cells = cells.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).cast("int"))
    cells = cells.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("cell", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "width", "first", "end", "word", "n")
    dealt = cells.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", F.col("n").desc(), "word")
    found = dealt.mapInPandas(_tiles, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("fewer"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.fewer")).alias("best_n"), F.col("b.word").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form (word, form): links are followed, twice as far each round.

    A form is at least twice as frequent as its word, so chains end after as many links as counts
    have bits, and rounds are as many as that number has.
    """
    links = stored(forms.select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        ahead = links.select(F.col("word").alias("k"), F.col("root").alias("next"))
        moved = links.join(ahead, F.col("root") == F.col("k"), "left")
        moved = stored(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-links")
        links = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return links


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """One row per word of ``words`` (word, n): word, form, root, n, n_near, form_n.

    A word's form is its most frequent near word, if that is ``ratio`` (over 1) times as frequent at
    least; its root is where the forms end.
    """
    words = stored(words, "spelling-words")
    near = stored(near_words(words), "spelling-near")
    right = F.col("best_n") >= ratio * F.col("n")
    rows = words.join(near.withColumnRenamed("word", "k"), F.col("word") == F.col("k"), "left").select(
        "word", F.when(right, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(right, F.col("best_n")).alias("form_n")
    )
    rows = stored(rows, "spelling-forms")
    roots = with_roots(rows.where("form is not null")).withColumnRenamed("word", "k")
    named = rows.join(roots, F.col("word") == F.col("k"), "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS b))
), runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) GROUP BY 1, 2
), hex AS (
  SELECT r, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS x FROM runs WHERE length(r) >= 5
), hashed AS (
  SELECT r, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h
  FROM hex, crc
), words AS (
  SELECT w AS word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS w, k FROM hashed)
  WHERE length(w) >= 5 GROUP BY 1 HAVING sum(k) >= 3
), less AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS n FROM near GROUP BY 1
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 2 * w.n THEN b.n END AS form_n,
    CASE WHEN b.n >= 2 * w.n THEN (SELECT min(x.other) FROM near x WHERE x.word = w.word AND x.n = b.n) END AS form
  FROM words w LEFT JOIN best b USING (word)
), walk AS (
  SELECT word, word AS at, form AS up FROM formed
  UNION ALL SELECT k.word, k.up, f.form FROM walk k JOIN formed f ON f.word = k.up
)
SELECT f.word, f.form, k.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM formed f JOIN walk k ON k.word = f.word AND k.up IS NULL
"""
