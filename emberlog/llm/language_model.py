"""Language-model scoring by a weighted backoff automaton.

Smoothed n-grams become states with failure arcs: a state is a context, an arc carries the
log-probability of a word after it, and the failure arc carries the context's backoff weight to its
suffix. A text's score adds up the arcs that a left-to-right traversal takes. Each chunk of texts has
the part of the automaton that its own n-grams reach, and walks all its texts side by side.

The model grows with the corpus: every n-gram that occurs ``least`` times in the training rows is
kept, at every size. Texts are encoded in chunks, once. A chunk asks for the counts of its distinct
n-grams, then for the backoff weights of the contexts that it leaves by a failure arc. What is asked
is dealt out by ranges of a hash, so each n-gram is one number a chunk however common it is; the
answers come back in the order asked, without the n-grams. Chunks and answers are bucketed alike, so
each moves once, however many rounds read it.

Words are counted by 80 bits of a digest: any two of 10^9 distinct ones share them with a probability
below one in a million, of 10^10 one in 20 000. Longer n-grams are known by hashes whose width grows with the corpus: one shares
its hash with another with a probability below one in a million (until 2^44 tokens, where 64 bits are
used up), which can touch a score and no count of words.

Defined cases: a null text is an empty one and has one token, the end; rows that repeat count and
score each on its own; a text of any length is one document of one chunk; equal counts need no order,
as nothing is ranked; without training rows every word is unknown; an empty table gives an empty
result; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bucketed, id_remainder, mixed

#: Stands for the end of a text; no word is empty.
END = b""
#: A chunk is closed at so many distinct words or characters of text.
CHUNK_WORDS, CHUNK_BYTES = 200_000, 8_000_000
#: So many asked n-grams of the whole corpus meet in one group, about.
PART_KEYS = 1 << 19
#: A text is walked in pieces of so many tokens, side by side.
PIECE = 256
#: Taken off every count of an n-gram of two words or more, in quarters: sums of these are whole.
QUARTERS = 3
DISCOUNT = QUARTERS / 4
#: Bits that a hash has over those of the number of tokens.
SPARE_BITS = 20


def tokens(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


class _Numbers(dict):
    """Numbers words as they are looked up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


CHUNKS = "chunk long, doc_id array<long>, held_out array<boolean>, n array<long>, words binary, hashes binary, checks binary, tokens long"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk: its documents, their tokens as local word numbers, the words' hashes."""
    numbers, docs, parts, size = _Numbers(), [], [], 0

    def chunk() -> pa.RecordBatch:
        ids, held, n = zip(*docs)
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in numbers), dtype="<u8").reshape(-1, 2)
        words = np.concatenate(parts)
        order = np.argsort(-np.bincount(words, minlength=len(numbers)), kind="stable")  # frequent words get small numbers, which pack well
        rank = np.empty(len(order), dtype=np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        row = [uuid.uuid4().int >> 65, list(ids), list(held), list(n), pack(rank[words], tight=8), digests[order, 0].tobytes(), digests[order, 1].astype("<u2").tobytes(), sum(n)]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=["chunk", "doc_id", "held_out", "n", "words", "hashes", "checks", "tokens"])

    for batch in batches:
        for doc_id, held, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
            words = tokens(text)
            parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
            docs.append((doc_id, held, len(words)))
            size += len(text or "")
            if len(numbers) >= CHUNK_WORDS or size >= CHUNK_BYTES:
                yield chunk()
                numbers, docs, parts, size = _Numbers(), [], [], 0
    if docs:
        yield chunk()


def pack(x: np.ndarray, tight: int = 2) -> bytes:
    """Unsigned numbers in as many bytes each as the greatest takes, first all lowest bytes; the
    ``tight`` highest of them, which vary little, are compressed."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    plain = max(width - tight, 0)
    return bytes([width, plain]) + len(x).to_bytes(6, "little") + planes[:plain].tobytes() + zlib.compress(planes[plain:].tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    width, plain, n = data[0], data[1], int.from_bytes(data[2:8], "little")
    planes = data[8 : 8 + plain * n] + zlib.decompress(data[8 + plain * n :])
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(planes, dtype=np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Sorted numbers, by their differences."""
    return int(keys[0]).to_bytes(8, "little") + pack(np.diff(keys))


def _distinct(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(First place of each distinct pair, by key and check; which one each place has.)"""
    order = np.argsort(keys, kind="stable")
    other = lambda x: x[order[1:]] != x[order[:-1]]
    if (other(checks) & ~other(keys)).any():
        order = np.lexsort((checks, keys))
    new = np.ones(len(order), dtype=bool)
    new[1:] = other(keys) | other(checks)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def _unsteps(data: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], dtype="<u8"), unpack(data[8:])]), dtype=np.uint64)


class Plan:
    """What all chunks of a corpus agree on."""

    def __init__(self, bits: int, parts: int, order: int, least: int, total: int = 0, types: int = 0, discount: float = 0.5):
        self.bits, self.parts, self.order, self.least = bits, parts, order, least
        self.total, self.types, self.discount = total, types, discount

    def part_of(self, keys: np.ndarray, bits: int) -> np.ndarray:
        """Ranges of keys, so sorted keys are dealt out in slices."""
        top = min(bits, 32)
        return ((keys >> np.uint64(bits - top)) * np.uint64(self.parts)) >> np.uint64(top)

    def slices(self, k: int, keys: np.ndarray) -> list[tuple[int, int, int]]:
        """(Part, begin, end) of sorted keys of k words; those of single words have all 64 bits."""
        part = self.part_of(keys, 64 if k == 1 else self.bits)
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(keys) else np.zeros(1, dtype=np.int64)
        return [(int(part[a]), int(a), int(b)) for a, b in zip(edge[:-1], edge[1:])]


class Automaton:
    """A weighted backoff automaton. State 0 is the empty context and has an arc for every word.

    ``arc`` has the sorted numbers state * words + word; ``log_p`` and ``to`` are what an arc adds and
    the state that it leads to, the longest suffix that is a context. A state without an arc for a word
    is left by its failure arc, which adds ``backoff`` and leads to the context less its first word.
    """

    def __init__(self, words: int, state: np.ndarray, word: np.ndarray, log_p: np.ndarray, to: np.ndarray, fail: np.ndarray, backoff: np.ndarray):
        arc = state.astype(np.int64) * words + word
        order = np.argsort(arc)
        self.words, self.fail, self.backoff = words, fail, backoff
        self.arc, self.log_p, self.to = arc[order], log_p[order], to[order].astype(np.int64)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(What reading a word adds, the next state) of walks that stand in ``state``."""
        added, state = np.zeros(len(state)), state.copy()
        on = np.arange(len(state))
        while len(on):
            at, wanted = word[on].astype(np.int64), state[on] * self.words + word[on]
            deep = np.flatnonzero(state[on])  # the empty context's arcs come first, one for each word
            at[deep] = np.minimum(np.searchsorted(self.arc, wanted[deep]), len(self.arc) - 1)
            found = self.arc[at] == wanted
            added[on[found]] += self.log_p[at[found]]
            state[on[found]] = self.to[at[found]]
            on = on[~found]
            added[on] += self.backoff[state[on]]
            state[on] = self.fail[state[on]]
        return added, state

    def walk(self, word: np.ndarray, begin: np.ndarray, length: np.ndarray, memory: int) -> np.ndarray:
        """What each token adds, by one left-to-right traversal of all texts side by side.

        A state remembers at most ``memory`` words. So a text is walked in pieces: one that begins
        inside it first reads so many words before, and stands where a walk of the whole text would.
        """
        pieces = -(-length // PIECE)
        text = np.repeat(np.arange(len(length)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = begin[text] + nth * PIECE
        end = np.minimum(first + PIECE, (begin + length)[text])
        at = np.maximum(np.where(nth > 0, first - memory, first), begin[text])
        longest = np.argsort(at - end, kind="stable")
        first, at, size = first[longest], at[longest], (at - end)[longest]
        state, out = np.zeros(len(at), dtype=np.int64), np.zeros(len(word))
        for t in range(-int(size.min(initial=0))):
            on = np.searchsorted(size, -t)
            here = at[:on] + t
            added, state[:on] = self.step(state[:on], word[here])
            own = here >= first[:on]
            out[here[own]] = added[own]
        return out


class Chunk:
    """Texts of a chunk and what is known of their n-grams.

    ``keys[k]`` has the sorted hashes of the n-grams of k words that are asked for, ``n[k]`` their
    training counts, ``at[k]`` for each token the place of the kept one that ends there, or -1,
    ``kept[k]`` one token that each kept one ends at, ``own[k]`` whether this chunk is to add it to sums,
    and ``weight[k]`` their log10 backoff weights.
    """

    def __init__(self, row: dict, plan: Plan, answers: list[dict]):
        self.plan = plan
        self.lengths = np.array(row["n"], dtype=np.int64)
        words = unpack(row["words"]).astype(np.int32)
        hashes = np.frombuffer(row["hashes"], dtype=np.uint64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(~np.array(row["held_out"], dtype=bool), self.lengths)
        self.inner = np.ones(len(words), dtype=bool)
        self.inner[self.starts] = False  # a token with another before it in its text
        self.word = hashes[words]
        self.shift = np.uint64(64 - plan.bits)
        self.keys, self.n, self.at, self.kept, self.own, self.weight = {}, {}, {}, {}, {}, {}
        checks = np.frombuffer(row["checks"], dtype="<u2")
        first, place = _distinct(hashes, checks)
        self.keys[1], self.checks = hashes[first], checks[first]
        self.place = {1: place.astype(np.int32)[words]}
        self.here = {1: np.arange(len(words), dtype=np.int32)}
        before = np.arange(len(words)) - np.repeat(self.starts, self.lengths)
        last = self.word
        for k in range(2, plan.order + 1):
            self.here[k] = np.flatnonzero(before >= k - 1).astype(np.int32)
            last = mixed(np.roll(last, 1) * np.uint64(0x9E3779B97F4A7C15) + self.word)
            self.keys[k], place = np.unique(last[self.here[k]] >> self.shift, return_inverse=True)
            self.place[k] = place.astype(np.int32)
        by: dict[int, list[dict]] = {}
        for a in answers:
            by.setdefault(a["kind"], []).append(a)
        if by:
            for k in range(1, plan.order + 1):
                self._counts(k, by.get(k, []))
        for k in range(1, plan.order):
            self._weights(k, by.get(-k, []))

    def _counts(self, k: int, answers: list[dict]) -> None:
        answers = sorted(answers, key=lambda a: a["part"])
        sizes = [b - a for _, a, b in self.plan.slices(k, self.keys[k])]
        n = [unpack(a["n"]) for a in answers]
        if [len(x) for x in n] != sizes:
            raise ValueError(f"answers on {k} words do not fit what was asked")
        self.n[k] = np.concatenate([np.zeros(0, np.uint64), *n]).astype(np.int64)
        often = self.n[k] >= self.plan.least
        if k > 1:
            own = [np.unpackbits(np.frombuffer(a["own"], dtype=np.uint8), count=int((x >= self.plan.least).sum())) for a, x in zip(answers, n)]
            self.own[k] = np.zeros(len(often), dtype=bool)
            self.own[k][often] = np.concatenate([np.zeros(0, np.uint8), *own])
        self.at[k] = np.full(len(self.word), -1, dtype=np.int32)
        here, kept = self.here[k], often[self.place[k]]
        if k > 1:  # head and tail occur as often, unless hashes coincide
            kept &= (self.at[k - 1][here] >= 0) & (self.at[k - 1][here - 1] >= 0)
        self.at[k][here] = np.where(kept, self.place[k], -1)
        ends = np.zeros(len(often), dtype=np.int64)
        ends[self.place[k]] = here
        self.kept[k] = ends[self.at[k][ends] >= 0]

    def unigram(self) -> np.ndarray:
        """The probability of each word of the chunk; the unknown word's where it has no count."""
        p, total = self.plan, max(self.plan.total, 1)
        unknown = p.discount * p.types / p.total if p.total else 1.0
        return np.where(self.n[1] > 0, (self.n[1] - p.discount) / total, unknown)

    def lower(self, k: int, ends: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        """Probability of the n-grams of k words that end at ``ends``; all are kept."""
        if k == 1:
            return unigram[self.place[1][ends]]
        return (self.n[k][self.at[k][ends]] - DISCOUNT) / self.n[k - 1][self.at[k - 1][ends - 1]]

    def train_counts(self, k: int) -> np.ndarray:
        """How often the keys of length k occur in the chunk's training rows."""
        mine = self.train[self.here[k]]
        return np.bincount(self.place[k][mine], minlength=len(self.keys[k])).astype(np.uint64)

    def owned(self, k: int) -> np.ndarray:
        """One token that each kept n-gram of k words ends at which this chunk adds to its context's sums."""
        ends = self.kept[k]
        return ends[self.own[k][self.at[k][ends]]]

    def asked_contexts(self, k: int) -> np.ndarray:
        """Places in keys[k] of the contexts to ask for: those that the chunk leaves by the failure arc,
        and those to whose sums it adds."""
        left = np.flatnonzero(self.inner & (self.at[k + 1] < 0)) - 1
        asked = np.zeros(len(self.keys[k]) + 1, dtype=bool)
        asked[self.at[k][left]] = True  # the last one stands for none
        asked[self.at[k][self.owned(k + 1) - 1]] = True
        return np.flatnonzero(asked[:-1])

    def added_to_contexts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """What the chunk adds, for each of keys[k], to the discounted counts of what follows (in
        quarters), and to the probability that the shorter context gives it."""
        ends, unigram = self.owned(k + 1), self.unigram()
        head, size = self.at[k][ends - 1], len(self.keys[k])
        seen = np.bincount(head, weights=4 * self.n[k + 1][self.at[k + 1][ends]] - QUARTERS, minlength=size)
        return seen.astype(np.uint64), np.bincount(head, weights=self.lower(k, ends, unigram), minlength=size)

    def _weights(self, k: int, answers: list[dict]) -> None:
        if not answers:
            return
        places = self.asked_contexts(k)
        answers = sorted(answers, key=lambda a: a["part"])
        weight = [np.frombuffer(zlib.decompress(a["n"]), dtype="<f4") for a in answers]
        if [len(x) for x in weight] != [b - a for _, a, b in self.plan.slices(-k, self.context_keys(k)[places])]:
            raise ValueError(f"answers on contexts of {k} words do not fit what was asked")
        self.weight[k] = np.zeros(len(self.keys[k]))
        self.weight[k][places] = np.concatenate(weight)

    def context_keys(self, k: int) -> np.ndarray:
        """As contexts words need no more bits than n-grams."""
        return self.keys[k] >> self.shift if k == 1 else self.keys[k]

    def automaton(self) -> Automaton:
        """The kept n-grams as states, arcs and failure arcs. The state of a context of k words is its
        place in keys[k], after those of shorter ones."""
        top = self.plan.order - 1
        base = np.cumsum([1, *(len(self.keys[k]) for k in range(1, top + 1))])
        state = lambda k, ends: base[k - 1] + self.at[k][ends]
        fail, backoff = np.zeros(base[-1], dtype=np.int64), np.zeros(base[-1])
        unigram, words = self.unigram(), np.arange(len(self.keys[1]))
        arcs = [(np.zeros_like(words), words, np.log10(unigram), np.where(self.n[1] >= self.plan.least, 1 + words, 0) if top else np.zeros_like(words))]
        for k in range(2, self.plan.order + 1):
            ends = self.kept[k]
            arcs.append((state(k - 1, ends - 1), self.place[1][ends], np.log10(self.lower(k, ends, unigram)), state(min(k, top), ends)))
            if k <= top:
                fail[state(k, ends)] = state(k - 1, ends)
        for k, weight in self.weight.items():
            backoff[base[k - 1] : base[k]] = weight
        return Automaton(len(words), *map(np.concatenate, zip(*arcs)), fail, backoff)

    def log_p(self) -> np.ndarray:
        """The log10 probability of each token."""
        return self.automaton().walk(self.place[1], self.starts, self.lengths, self.plan.order - 1)


ASKED = "chunk long, kind int, part long, keys binary, n binary, checks binary, whole binary, seen binary, below binary"
ANSWERS = "chunk long, kind int, part long, n binary, own binary, total long, types long, once long, twice long"


def _table(rows: list[dict], ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.table({name: pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields})


def _counts_asked(plan: Plan):
    """What chunks ask first: how often their n-grams occur. ``kind`` is the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row, plan, [])
                for k, keys in c.keys.items():
                    n = c.train_counts(k)
                    yield from _table([{"chunk": row["chunk"], "kind": k, "part": p, "keys": _steps(keys[a:b]), "n": pack(n[a:b]), "checks": c.checks[a:b].tobytes() if k == 1 else None} for p, a, b in plan.slices(k, keys)], ASKED).to_batches()

    return run


def _weights_asked(plan: Plan):
    """What chunks ask then: the backoff weights of contexts, with what the chunk adds to their sums
    (``n`` says to which, ``whole`` how often these occur). ``kind`` is the length below zero."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        (row,), rows = chunks.to_pylist(), []
        c = Chunk(row, plan, answers.to_pylist())
        for k in range(1, plan.order):
            places, (seen, below) = c.asked_contexts(k), c.added_to_contexts(k)
            keys, n, seen, below = c.context_keys(k)[places], c.n[k][places].astype(np.uint64), seen[places], below[places].astype("<f4")
            for p, a, b in plan.slices(-k, keys):
                given = np.flatnonzero(seen[a:b])
                sums = {"n": _steps(given.astype(np.uint64)), "whole": pack(n[a:b][given]), "seen": pack(seen[a:b][given]), "below": below[a:b][given].tobytes()} if len(given) else {}
                rows.append({"chunk": row["chunk"], "kind": -k, "part": p, "keys": _steps(keys[a:b])} | sums)
        return _table(rows, ASKED)

    return run


def _answers(least: int):
    """Sums over all chunks that ask, in the order in which each asks."""

    def run(asked: pa.Table) -> pa.Table:
        by: dict[int, list[dict]] = {}
        for r in asked.to_pylist():
            by.setdefault(r["kind"], []).append(r)
        out: list[dict] = []
        for kind, rows in by.items():
            keys = [_unsteps(r["keys"]) for r in rows]
            ends = np.cumsum([len(k) for k in keys])
            if kind == 1:
                first, place = _distinct(np.concatenate(keys), np.concatenate([np.frombuffer(r["checks"], dtype="<u2") for r in rows]))
            else:
                _, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            size = len(first)
            if kind > 0:
                n = np.bincount(place, weights=np.concatenate([unpack(r["n"]) for r in rows]).astype(float), minlength=size).astype(np.uint64)
                told = n if kind == 1 else np.where(n >= least, n, 0).astype(np.uint64)
                own = np.zeros(len(place), dtype=bool)
                own[first] = True
                kept = told[place] >= least
                stats = {"total": int(n.sum()), "types": int((n > 0).sum()), "once": int((n == 1).sum()), "twice": int((n == 2).sum())} if kind == 1 else {}
                for r, a, b in zip(rows, ends - [len(k) for k in keys], ends):
                    out.append({"chunk": r["chunk"], "kind": kind, "part": r["part"], "n": pack(told[place[a:b]]), "own": np.packbits(own[a:b][kept[a:b]]).tobytes() if kind > 1 else None} | stats)
                    stats = {}
            else:
                seen, below, whole = np.zeros(size), np.zeros(size), np.full(size, 0.25)
                for r, a in zip(rows, ends - [len(k) for k in keys]):
                    if r["n"] is not None:
                        given = place[a + _unsteps(r["n"]).astype(np.int64)]
                        seen[given] += unpack(r["seen"])
                        below[given] += np.frombuffer(r["below"], dtype="<f4")
                        whole[given] = unpack(r["whole"])
                weight = np.log10(np.maximum((4 * whole - seen) / (4 * whole), 1e-12) / np.maximum(1 - below, 1e-12)).astype("<f4")
                for r, a, b in zip(rows, ends - [len(k) for k in keys], ends):
                    out.append({"chunk": r["chunk"], "kind": kind, "part": r["part"], "n": zlib.compress(weight[place[a:b]].tobytes(), 1)})
        return _table(out, ANSWERS)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(plan: Plan):
    base_total = math.log10(plan.total + plan.types + 1)

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        (row,) = chunks.to_pylist()
        c = Chunk(row, plan, answers.to_pylist())
        added = lambda x: np.add.reduceat(x, c.starts)
        n = c.n[1][c.place[1]]
        return pa.table({
            "doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()), "n_tokens": c.lengths, "n_known": added((n > 0).astype(np.int64)),
            "train_tokens": np.full(len(c.lengths), plan.total), "base_score": added(np.log10(n + 1.0) - base_total), "score": added(c.log_p()),
        })

    return run


def score_texts(docs: DataFrame, mod: int = 7, fold: int = 2, order: int = 3, least: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Unigrams are absolutely discounted, with the discount from the numbers of words seen once and
    twice; what it frees is the probability of the one unknown word, as in the base. Longer n-grams
    are kept from ``least`` occurrences up, discounted likewise, and back off.
    """
    d = docs.select("doc_id", "text", (id_remainder(F.col("doc_id"), mod) == fold).alias("held_out"))
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts, told = Bucketed(spark, "lm-chunks", "chunk", width), Bucketed(spark, "lm-answers", "chunk", width)
    try:
        chunks = texts.add(d.mapInArrow(_encode, CHUNKS))
        size = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        plan = Plan(min(64, int(size).bit_length() + SPARE_BITS), max(2 * width, -(-order * size // PART_KEYS)), order, least)
        answers = told.add(chunks.mapInArrow(_counts_asked(plan), ASKED).groupBy("part").applyInArrow(_answers(least), ANSWERS), moved=True)
        t = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "types", "once", "twice"))).first()
        plan.total, plan.types = t.total, t.types
        plan.discount = min(max(t.once / (t.once + 2 * t.twice), 0.01), 0.99) if t.once + t.twice else 0.5
        grouped = lambda answers: chunks.groupBy("chunk").cogroup(answers.select("chunk", "kind", "part", "n", "own").groupBy("chunk"))
        if order > 1:
            answers = told.add(grouped(answers).applyInArrow(_weights_asked(plan), ASKED).groupBy("part").applyInArrow(_answers(least), ANSWERS), moved=True)
        return grouped(answers).applyInArrow(_scores(plan), SCORES)
    finally:
        texts.release()
        told.release()
