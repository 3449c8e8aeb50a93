"""Best-fit packing by linear grouping.

Documents become tokens; longer ones than a sequence are cut. Only the lengths matter then, and there are at most CAPACITY
of them, so the packing is computed on the driver over (length, number of pieces): large lengths are dealt into
GROUPS groups of equal cardinality and rounded up to their group's largest, a linear program over configurations of these few sizes
is solved by column generation, and its whole parts become sequences whose places take actual lengths, but for each configuration's smallest
place. What is left (that place's items, leftovers and small lengths) is put best-fit, longest first, into what room remains. That is done
for each of the THRESHOLDS from which a length counts as large, and the plan of the fewest sequences is taken. At the last one, half a sequence, no
configuration holds two large lengths, so a plan is never longer than best fit alone would give. Runs of equal sequences are kept as counts, so the
work doesn't grow with the number of documents. The pieces take their places by their gapless number among those of their length.

Defined cases: a null or empty text is one piece, the end token; rows that repeat a doc_id are packed each by itself; an empty
table gives an empty result; other columns are ignored (`packed_texts` keeps none).
"""

from __future__ import annotations

import bisect
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import stored, table, with_rid
from lattica.llm.ranking import ranked

CAPACITY, END = 2048, 0
TOKENIZER = "word_bpe_49k.json"
#: Groups of large lengths, and the least lengths that count as large, as shares of a sequence.
GROUPS, THRESHOLDS = 128, (0.125, 0.25, 0.5)
#: Bytes that a Python worker remembers of chunks of text and their ids, and what an entry takes besides them.
REMEMBERED, ENTRY = 128 << 20, 200
#: Pieces of one length that a task numbers.
NUMBERED = 100_000
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_characters() -> dict[int, str]:
    """The character by which a byte-level tokenizer writes each byte: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes. The tokenizer splits at white space before it merges, and
    lower-cases, so chunks between ASCII white space are encoded alone and remembered. A word of letters, and a run of marks after
    it, is one unit of merging each, and goes to the tokenizer's merging model directly; other chunks take the whole way."""

    def __init__(self, tokenizer: str = TOKENIZER) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        self.characters = _byte_characters()
        self.bytes_of = [n.to_bytes(4, "little") for n in range(self.tokenizer.get_vocab_size())]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _unit(self, unit: str) -> bytes:
        bytes_of = self.bytes_of
        return b"".join([bytes_of[t.id] for t in self.model.tokenize(unit)])

    def _learn(self, chunks: set[bytes]) -> None:
        known, whole = self.known, []
        for c in chunks:
            word = c.rstrip(_MARKS)
            if word.isalpha():  # ASCII letters
                unit = word.decode()
            else:
                unit = unicodedata.normalize("NFC", word.decode("utf-8"))
                unit = unit.lower() if "Σ" not in unit else "".join([x.lower() for x in unit])  # no final sigma here
                if not unit.isalpha():
                    whole.append(c)
                    continue
                unit = unit.encode("utf-8").decode("latin-1").translate(self.characters)
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self._unit(unit)
            if len(word) < len(c):
                marks = c[len(word) :]
                more = known.get(marks)
                if more is None:
                    more = known[marks] = self._unit(marks.decode())
                known[c] = ids + more
        if whole:
            known.update(zip(whole, self._plain([c.decode("utf-8") for c in whole]), strict=True))

    def __call__(self, text: str | None) -> bytes:
        raw = (text or "").encode("utf-8", "replace")
        if b"<|" in raw:  # a special token may stand there, in its exact case
            return self._plain([text])[0]
        chunks = raw.lower().split()
        if new := set(chunks).difference(self.known):
            if self.held > REMEMBERED:
                self.known.clear()
                self.held, new = 0, set(chunks)
            self._learn(new)
            self.held += sum(len(c) + len(self.known[c]) + ENTRY for c in new)
        return b"".join(map(self.known.__getitem__, chunks))


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """_rid, doc_id, piece, start, length, ids_crc32 (and the ids) of rows with _rid, doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = vars(sys.modules.setdefault("_lattica_worker", types.ModuleType("_lattica_worker")))  # for the worker's life, beyond this task
        if tokenizer not in kept:
            kept[tokenizer] = Encoder(tokenizer)
        encode = kept[tokenizer]
        for b in batches:
            for at in range(0, max(1, b.num_rows), 500):
                part = b.slice(at, 500)
                which, piece, start, length, crc, own = [], [], [], [], [], []
                for i, t in enumerate(part.column("text")):
                    data = encode(t.as_py()) + END.to_bytes(4, "little")
                    n = len(data) // 4
                    for k, s in enumerate(range(0, n, capacity)):
                        cut = data[4 * s : 4 * (s + capacity)]
                        which.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if ids:
                            own.append(cut)
                take = pa.array(which, pa.int64())
                cols = [part.column("_rid").take(take), part.column("doc_id").take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["_rid", "doc_id", "piece", "start", "length", "ids_crc32"]
                if ids:
                    cols, names = [*cols, pa.array(own, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("_rid", "doc_id", "text").mapInArrow(run, f"_rid long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def _knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The most value that fits, any number of each, and how many of each."""
    room = np.arange(capacity + 1)[:, None] - np.array(sizes)[None, :]
    fits, room = room >= 0, np.maximum(room, 0)
    best, took = np.zeros(capacity + 1), []
    for _ in range(capacity // min(sizes)):  # one more item each time
        gain = np.where(fits, best[room] + values, -1.0)
        g = gain.argmax(axis=1)
        new = gain[np.arange(capacity + 1), g]
        better = new > best + 1e-12
        if not better.any():
            break
        took.append(np.where(better, g, -1))
        best = np.where(better, new, best)
    counts, c = [0] * len(sizes), capacity
    for choice in reversed(took):
        if choice[c] >= 0:
            counts[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), counts


def configurations(sizes: list[int], counts: list[int], capacity: int = CAPACITY, most: int = 400) -> list[tuple[list[int], float]]:
    """(how many of each size, how often) of the linear program's optimum, by column generation."""
    k = len(sizes)
    columns = [[0] * g + [capacity // s] + [0] * (k - g - 1) for g, s in enumerate(sizes)]
    basis = np.array(columns, dtype=float).T
    need = np.array(counts, dtype=float)
    x = np.linalg.solve(basis, need)
    for _ in range(most):
        duals = np.linalg.solve(basis.T, np.ones(k))
        value, col = _knapsack(sizes, duals, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, np.array(col, dtype=float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = col
        columns[out] = col
        x = np.maximum(np.linalg.solve(basis, need), 0)
    return [(columns[g], float(x[g])) for g in range(k)]


def plan(lengths: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences), for the number of pieces of each length."""
    return min((grouped(lengths, capacity, groups, int(capacity * t) + 1) for t in THRESHOLDS), key=lambda p: sum(n for _, n in p))


def grouped(lengths: dict[int, int], capacity: int, groups: int, large: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan by linear grouping of lengths from `large` on."""
    done: list[tuple[tuple[int, ...], int]] = []
    if lengths.get(capacity):
        done.append(((capacity,), lengths[capacity]))
    big = [(n, c) for n, c in sorted(lengths.items(), reverse=True) if large <= n < capacity and c]
    rest = {n: c for n, c in lengths.items() if n < large and c}
    # Groups of equal cardinality, longest first; a length may stand in more than one.
    dealt: list[list[tuple[int, int]]] = []
    total = sum(c for _, c in big)
    each = -(-total // groups)
    if len(big) <= groups:  # few lengths need no rounding
        dealt = [[x] for x in big]
    for n, c in big if len(big) > groups else ():
        while c:
            if not dealt or sum(x for _, x in dealt[-1]) >= each:
                dealt.append([])
            take = min(c, each - sum(x for _, x in dealt[-1]))
            dealt[-1].append((n, take))
            c -= take
    by_size: dict[int, list[tuple[int, int]]] = {}  # groups that round to one size are one
    for g in dealt:
        by_size.setdefault(g[0][0], []).extend(g)
    sizes = sorted(by_size, reverse=True)
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room: (lengths, number)

    def put(content: tuple[int, ...], room: int, number: int) -> None:
        if number:
            open_.setdefault(room, []).append((content, number))

    if sizes:
        queue = {s: list(by_size[s]) for s in sizes}
        for col, often in configurations(sizes, [sum(c for _, c in by_size[s]) for s in sizes], capacity):
            slots = [s for s, a in zip(sizes, col, strict=True) for _ in range(a)]
            slots = slots[: max(1, len(slots) - 1)]  # the smallest place is left to best fit, which sees actual lengths
            number = int(often + 1e-9)
            for s in set(slots):
                number = min(number, sum(c for _, c in queue[s]) // slots.count(s))
            if not number or not slots:
                continue
            takes = []
            for s in slots:  # the next `number` actual lengths of the group
                run, want = [], number
                while want:
                    n, c = queue[s][0]
                    t = min(c, want)
                    run.append((n, t))
                    want -= t
                    queue[s][0] = (n, c - t)
                    if c == t:
                        queue[s].pop(0)
                takes.append(run)
            at = [0] * len(slots)
            while number:
                t = min(takes[j][at[j]][1] for j in range(len(slots)))
                content = tuple(takes[j][at[j]][0] for j in range(len(slots)))
                put(content, capacity - sum(content), t)
                number -= t
                for j in range(len(slots)):
                    n, c = takes[j][at[j]]
                    takes[j][at[j]] = (n, c - t)
                    at[j] += c == t
        for q in queue.values():
            for n, c in q:
                rest[n] = rest.get(n, 0) + c
    rooms = sorted(open_)
    for n, c in sorted(rest.items(), reverse=True):
        while c:
            k = bisect.bisect_left(rooms, n)
            if k < len(rooms):
                room = rooms[k]
                content, number = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
                fit = min(c, number)
                if fit < number:
                    if room not in open_:
                        bisect.insort(rooms, room)
                    put(content, room, number - fit)
                new = [((*content, n), room - n, fit)]
                c -= fit
            else:
                f = capacity // n
                new = [((n,) * f, capacity - n * f, c // f)] * (c >= f) + [((n,) * (c % f), capacity - n * (c % f), 1)] * (c % f > 0)
                c = 0
            for content, room, number in new:
                if room not in open_:
                    bisect.insort(rooms, room)
                put(content, room, number)
    return done + [x for v in open_.values() for x in v]


def places(sequences: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs sorted by key = length * 2^40 + first number: the first sequence, and the offset there."""
    cursor: dict[int, int] = {}
    keys, first, offsets, seq = [], [], [], 0
    for content, number in sequences:
        at = 0
        for n in content:
            keys.append((n << 40) + cursor.get(n, 0))
            cursor[n] = cursor.get(n, 0) + number
            first.append(seq)
            offsets.append(at)
            at += n
        seq += number
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    return np.array(keys, dtype=np.int64)[order], np.array(first, dtype=np.int64)[order], np.array(offsets, dtype=np.int64)[order]


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece; with `ids`, the pieces' bytes too."""
    cut = stored(pieces(with_rid(docs.select("doc_id", "text")), tokenizer, capacity, ids), "pack-pieces")
    lengths = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    keys, first, offsets = places(plan(lengths, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = (b.column("length").to_numpy() << 40) + b.column("_rank").to_numpy()
            k = np.searchsorted(keys, key, side="right") - 1
            seq = first[k] + (key - keys[k])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(seq), pa.array(offsets[k])], names=[*kept, "sequence_id", "offset"])

    numbered = ranked(cut, ["length"], F.struct("_rid", "piece"), [F.col("_rid"), F.col("piece")], "_rank", slices=max(64, -(-max(lengths.values(), default=0) // NUMBERED))).drop("_rid")
    kept = [c for c in numbered.columns if c != "_rank"]
    kinds = dict(numbered.dtypes)
    out = numbered.mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", sequence_id long, offset long")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] * ids))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
