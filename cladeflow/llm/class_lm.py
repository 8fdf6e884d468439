"""A Brown class-based bigram model: exchange clustering, class transitions, word emissions.

The corpus is cut into blocks, each a row with its own word list and its texts as numbers
in that list. The words of all blocks are counted in one aggregation, and what is known of
a word comes back to the blocks by a shuffle, so no worker or driver ever holds the
vocabulary; only what is known of the core is sent to all, so no word of that shuffle is in
more than one of FREQUENT tokens.

Clustering starts from the FREQUENT most frequent words, the core: exchange clustering moves
them between classes, one at a time, over the counts of all adjacent units of the training
texts, all other words falling for this start into SPELLINGS units by their last letters. Every
other training word starts in the class k with the greatest sum of log P(b before | k) and
log P(c after | k) over its own neighbours of the core. Then all words of LEAST training tokens
or more, core and others alike, are exchanged in sweeps: Spark gathers how often each class
stands before and after each word, tasks find the class in which the likelihood is greatest for
each word by the counts without it, and moves are made so that the likelihood rises in each
sweep. What is gathered is how often which neighbours stand beside a word, once and by shuffle;
each sweep adds them up by their classes of the moment where they lie. The number of words that take part grows with the corpus up to MOST_WORDS; beyond, the
least count doubles until they are no more. Words of fewer tokens keep the class they start
in, and only words without any core neighbour, and words not seen in training, have the class
of their spelling. For a word w of
class c after class b,

    P(w | b) = P(c | b) P(w | c),

with P(c | b) = (N(b, c) + w p(c)) / (N(b) + w), w being PRIOR and the number of classes seen
after b, for which new ones come in so much the likelier, from counts of the placed classes of
all training tokens; emission counts plus a half, and half a count for all unknown words of a
spelling together as well as each known one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.common import bounded_batches, mix, remainder, scratch_table, texts, worker_store

FREQUENT, SPELLINGS, CLASSES, SWEEPS, PRIOR = 2048, 256, 96, 6, 10.0
#: Words of so many training tokens take part in the exchange, in so many sweeps at most. MOST_WORDS bounds what is sent to all, a byte a word.
LEAST, MOST_WORDS, ROUNDS = 2, 1 << 24, 4
#: Text bytes of a block, but for one longer text.
BLOCK_BYTES = 12_000_000
END = b" "  # no word holds a blank
BLOCK = "block long, doc_ids binary, no_id binary, held binary, sizes binary, low binary, high binary, words array<binary>, counts binary"
SLOTS = 2 * CLASSES  # classes before a word, then classes after it
AROUND = np.dtype([("slot", "u1"), ("n", "<u4")])
CELLS, SLICE, FAN, SMALL = SLOTS + 1, 256, 64, 16  # a word's cells, itself beside itself last; words a row of counts, at least; rows merged at once; counts with a table of differences
#: Neighbours in a stored row, but for a word with more; bits of a neighbour; owners with more rows than that are summed one by one.
ROW_NEAR, NEAR_BITS, LONG = 1 << 17, 26, 64
#: Rows of counts of a block, at most: their number then grows with the blocks alone. A row has up to MOST_WORDS / MOST_SLICES words.
MOST_SLICES = 1024
WORD_ROWS = "block long, place int, word binary, n long"
PACKED = "block long, size int, packed binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


class _Block:
    def __init__(self):
        self.ids, self.held, self.texts, self.bytes = [], [], [], 0

    def add(self, doc_id: int | None, held: bool, text: bytes) -> None:
        self.ids.append(doc_id)
        self.held.append(held)
        self.texts.append(text)
        self.bytes += len(text)

    def coded(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct words, END first; the texts as numbers of words, an end closing each; the sizes of the texts."""
        texts = pa.array(self.texts, pa.binary())
        texts = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers())  # whatever the bytes: ASCII functions leave all others as they are
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words, bounds = split.values, split.offsets.to_numpy().astype(np.int64)
        words = pa.Array.from_buffers(pa.binary(), len(words), words.buffers(), offset=words.offset)
        real = pc.binary_length(words).to_numpy() > 0  # white space at either end leaves an empty word
        bounds = np.append(0, np.cumsum(real))[bounds]
        coded = (words if real.all() else words.filter(pa.array(real))).dictionary_encode()
        sizes = np.diff(bounds) + 1
        codes = np.zeros(int(sizes.sum()), dtype=np.uint32)
        own = np.ones(len(codes), dtype=bool)
        own[np.cumsum(sizes) - 1] = False
        codes[own] = coded.indices.to_numpy() + 1
        return pa.concat_arrays([pa.array([END], pa.binary()), coded.dictionary]), codes, sizes

    def row(self, block: int) -> dict:
        words, codes, sizes = self.coded()
        held = np.array(self.held, dtype=bool)
        uses = np.bincount(codes, minlength=len(words))
        order = np.argsort(-uses, kind="stable")  # frequent words get small numbers, which compress
        place = np.empty(len(order), dtype=np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        codes = place[codes]
        counts = np.bincount(codes[~np.repeat(held, sizes)], minlength=len(order))
        no_id = np.array([i is None for i in self.ids])
        return {
            "block": block, "doc_ids": np.array([i or 0 for i in self.ids], dtype="<i8").tobytes(), "no_id": no_id.tobytes(), "held": held.tobytes(), "sizes": sizes.astype("<i8").tobytes(),
            "low": codes.astype("<u2").tobytes(), "high": (codes >> 16).astype("<u2").tobytes(), "words": words.take(pa.array(order)), "counts": counts.astype("<i8").tobytes(),
        }


_KINDS = [pa.int64(), *[pa.binary()] * 6, pa.list_(pa.binary()), pa.binary()]


def _emit(row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) if pa.types.is_list(t) else pa.array([v], t) for v, t in zip(row.values(), _KINDS)], list(row))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_store("class_lm")
    number, now = TaskContext.get().partitionId() << 32, _Block()
    for batch in batches:
        for doc_id, held, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            now.add(doc_id, held, text)
            if now.bytes >= BLOCK_BYTES:
                yield _emit(now.row(number))
                number, now = number + 1, _Block()
    if now.ids:
        yield _emit(now.row(number))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, words, counts in zip(*(batch.column(i) for i in range(3))):
            words, counts = words.values, np.frombuffer(counts.as_py(), dtype="<i8")
            n = len(counts)
            for at in range(0, n, 20_000):
                to = min(n, at + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(to - at, block.as_py())), pa.array(np.arange(at, to, dtype=np.int32)), words[at:to], pa.array(counts[at:to])], ["block", "place", "word", "n"])


#: The spelling of words of one letter, then of those that end in each two.
_SPELLED = np.array([zlib.crc32(bytes([i])) % SPELLINGS for i in range(256)] + [zlib.crc32(bytes([i >> 8, i & 255])) % SPELLINGS for i in range(1 << 16)])


def _number(words: pa.Array, core: dict[bytes, int]) -> np.ndarray:
    """The numbers of words in the core, which has them in order; -1 for all others."""
    return pc.index_in(words, value_set=pa.array(list(core), pa.binary())).fill_null(-1).to_numpy().astype(np.int64)


def units(words: list[bytes] | pa.Array, core: dict[bytes, int]) -> np.ndarray:
    """The unit of each word: its own number, or that of its spelling."""
    words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
    out = _number(words, core)
    rest = np.flatnonzero(out < 0)
    data, bounds = _bytes_of(words)
    ends, sizes = bounds[1:][rest], np.diff(bounds)[rest]
    last = data[ends - 1].astype(np.int64)
    out[rest] = len(core) + _SPELLED[np.where(sizes > 1, 256 + (data[ends - 2].astype(np.int64) << 8) + last, last)]
    return out


def _codes(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, dtype="<u2").astype(np.uint32) | (np.frombuffer(high, dtype="<u2").astype(np.uint32) << 16)


def _around(model: ClassModel):
    """The rows of ``_word_rows`` that are not of core words, with a list of AROUND: how often core words of each class stand beside the word in training texts."""
    first, end = len(model.core), model.of[model.core[END]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, held, sizes, low, high, counts = (batch.column(k)[i].as_py() for k in (0, 1, 2, 3, 4, 6))
                words = batch.column(5)[i].values
                u = units(words, model.core)
                k_of = np.where(u < first, model.of[u], -1)
                codes = _codes(low, high)
                k = k_of[codes]
                # An end closes each text and is in the core, so a word's neighbours are of its own text.
                learn = ~np.repeat(np.frombuffer(held, dtype=bool), np.frombuffer(sizes, dtype="<i8")) & (k < 0)
                before, after = np.concatenate([[end], k[:-1]]), np.concatenate([k[1:], [-1]])
                left, right = learn & (before >= 0), learn & (after >= 0)
                at = codes.astype(np.int64) * SLOTS
                keys, n = np.unique(np.concatenate([at[left] + before[left], at[right] + CLASSES + after[right]]), return_counts=True)
                entries = np.empty(len(keys), dtype=AROUND)
                entries["slot"], entries["n"] = keys % SLOTS, n
                counts, rest = np.frombuffer(counts, dtype="<i8"), np.flatnonzero(k_of < 0).astype(np.int32)
                # Core words have no entries, so those of the rest lie side by side.
                bounds = np.append(np.searchsorted(keys // SLOTS, rest), len(keys))
                for at in range(0, len(rest), 20_000):
                    to = min(len(rest), at + 20_000)
                    own_bounds = ((bounds[at : to + 1] - bounds[at]) * AROUND.itemsize).astype("<i4")
                    own_entries = entries[bounds[at] : bounds[to]].tobytes()
                    around = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(own_bounds.tobytes()), pa.py_buffer(own_entries)])
                    part = rest[at:to]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(to - at, block)), pa.array(part), words.take(pa.array(part)), pa.array(counts[part]), around], ["block", "place", "word", "n", "around"]
                    )

    return run


def _core_rows(model: ClassModel):
    """block, place, n, mark and number of the core words of each block; their counts and classes are known to all, so their rows need not meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                u = _number(words.values, model.core)
                at = np.flatnonzero(u >= 0)
                u = u[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32)), pa.array(model.core_n[u]), pa.array((2 * model.of[u]).astype(np.int32)), pa.array(u.astype(np.int32))], ["block", "place", "n", "mark", "id"]
                )

    return run


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column in a row, and the bounds of its values."""
    bounds = np.frombuffer(column.buffers()[1], dtype="<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return data, bounds - bounds[0]


def row_sums(table: np.ndarray, index: np.ndarray, starts: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """For each owner the sum of the rows of a table at index[starts[i]:starts[i + 1]], weighted if weights are given.

    The first rows of all owners are added at once, then the second ones, and so on.
    """
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    falling, first = sizes[order], starts[:-1][order]
    out = np.zeros((len(sizes), table.shape[1]))
    long = int(np.searchsorted(-falling, -LONG))
    for i, (a, n) in enumerate(zip(first[:long].tolist(), falling[:long].tolist())):
        rows = table[index[a : a + n]]
        out[i] = rows.sum(0) if weights is None else weights[a : a + n] @ rows
    falling, first, rest = falling[long:], first[long:], out[long:]
    for i in range(int(falling[0]) if len(falling) else 0):
        at = first[: np.searchsorted(-falling, -i)] + i
        rest[: len(at)] += table[index[at]] if weights is None else table[index[at]] * weights[at, None]
    back = np.empty_like(out)
    back[order] = out
    return back


def place(word: np.ndarray, slot: np.ndarray, n: np.ndarray, default: np.ndarray, log_beside: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """The class of each word from entries (word, slot, n), of any order; default where a word has none.

    log_beside has a row for each slot: the log probability of such a neighbour by the word's class.
    """
    keys, at = np.unique(word * SLOTS + slot, return_inverse=True)
    n = np.bincount(at, weights=n, minlength=len(keys))
    word, slot = keys // SLOTS, keys % SLOTS
    out = default.copy()
    owners, starts = np.unique(word, return_index=True)
    starts, a = np.append(starts, len(word)), 0
    while a < len(owners):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + step, side="right")) - 1)
        part = slice(starts[a], starts[b])
        out[owners[a:b]] = row_sums(log_beside, slot[part], starts[a : b + 1] - starts[a], n[part]).argmax(1)
        a = b
    return out


def _placed(model: ClassModel, numbered: Numbered | None = None, part: int = 0):
    """block, place, n, mark and id of all rows of a word that is not of the core: its count, twice its class, plus one in the first row of a training word, and its number or -1."""
    log_beside = model.beside()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        coded = rows["word"].combine_chunks().dictionary_encode()
        word, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        n = np.bincount(word, weights=rows["n"].to_numpy(), minlength=len(words)).astype(np.int64)
        data, bounds = _bytes_of(rows["around"].combine_chunks())
        entries = data.view(AROUND)
        u = units(coded.dictionary, model.core)
        owner = np.repeat(word.astype(np.int64), np.diff(bounds) // AROUND.itemsize)
        k = place(owner, entries["slot"].astype(np.int64), entries["n"], model.of[u], log_beside)
        mark = 2 * k[word]
        # The first row is that of the least block, and numbers go by the words, so a task that runs again gives the same.
        order = np.lexsort((rows["block"].to_numpy(), word))
        mark[order[np.unique(word[order], return_index=True)[1]]] += n > 0
        ids = np.full(len(words), -1, dtype=np.int32)
        if numbered is not None:
            often = sorted(np.flatnonzero(n >= numbered.least).tolist(), key=words.__getitem__)
            if len(often) != numbered.starts[part + 1] - numbered.starts[part]:
                raise ValueError("the shuffle by word and the vocabulary disagree")
            ids[often] = numbered.starts[part] + np.arange(len(often))
        out = pa.table({"block": rows["block"], "place": rows["place"], "n": pa.array(n[word]), "mark": pa.array(mark.astype(np.int32)), "id": pa.array(ids[word])})
        yield from out.combine_chunks().to_batches(50_000)

    return run


def _planes(x: np.ndarray, kind: str) -> bytes:
    """First the low bytes of all numbers, then the next ones: the high ones, mostly zero, compress to nothing."""
    x = np.ascontiguousarray(x.astype(kind))
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(planes: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel().astype(np.int64)


def _squeeze(*fields: bytes) -> tuple[int, bytes]:
    plain = b"".join([np.array([len(f) for f in fields], dtype="<u8").tobytes(), *fields])
    return len(plain), pa.compress(plain, codec="zstd", asbytes=True)


def _fields(size: int, packed: bytes, n: int) -> list[bytes]:
    plain = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True)
    ends = 8 * n + np.cumsum(np.frombuffer(plain, dtype="<u8", count=n)).astype(np.int64)
    return [plain[a:b] for a, b in zip([8 * n, *ends[:-1].tolist()], ends.tolist())]


def _steps(place: np.ndarray) -> bytes:
    return _planes(np.diff(place, prepend=0), "<u4")


def _squeezed_known(place: np.ndarray, n: np.ndarray, mark: np.ndarray, ids: np.ndarray) -> tuple[int, bytes]:
    return _squeeze(_steps(place), _planes(n, "<u8"), _planes(mark, "<u2"), _planes(ids + 1, "<u4"))


def _known(size: int, packed: bytes) -> tuple[np.ndarray, ...]:
    """place, n, mark and number of words of a block."""
    place, n, mark, ids = _fields(size, packed, 4)
    return np.cumsum(_numbers(place, "<u4")), _numbers(n, "<u8"), _numbers(mark, "<u2"), _numbers(ids, "<u4") - 1


def _parted(model: ClassModel, parts: int):
    """The rows of ``_around``, those of a block whose words fall into one part as one packed row."""
    around = _around(model)

    def rows(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        words = t["word"].to_pylist()
        part = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % parts
        place, n = t["place"].to_numpy(), t["n"].to_numpy()
        data, bounds = _bytes_of(t["around"].combine_chunks())
        entries, bounds = data.view(AROUND), bounds // AROUND.itemsize
        order = np.argsort(part, kind="stable")
        at = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            mine = order[a:b]
            sizes = bounds[mine + 1] - bounds[mine]
            own = entries[np.repeat(bounds[mine] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            fields = _steps(place[mine]), b" ".join([words[i] for i in mine.tolist()]), _planes(n[mine], "<u4"), _planes(sizes, "<u2"), own["slot"].tobytes(), _planes(own["n"], "<u4")
            out.append((int(part[mine[0]]), batches[0].column(0)[0].as_py(), *_squeeze(*fields)))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["part", "block", "size", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in around(batches):
            if held and held[0].column(0)[0] != batch.column(0)[0]:
                yield rows(held)
                held = []
            if batch.num_rows:
                held.append(batch)
        if held:
            yield rows(held)

    return run


def _placed_part(model: ClassModel, numbered: Numbered):
    """``_placed`` over the packed rows of a part: a packed row a block."""

    def run(group: pa.Table) -> pa.Table:
        tables = []
        for block, size, packed in zip(*(group[f].to_pylist() for f in ("block", "size", "packed"))):
            place, words, n, sizes, slots, counts = _fields(size, packed, 6)
            place, sizes = np.cumsum(_numbers(place, "<u4")), _numbers(sizes, "<u2")
            entries = np.empty(len(slots), dtype=AROUND)
            entries["slot"], entries["n"] = np.frombuffer(slots, dtype=np.uint8), _numbers(counts, "<u4")
            ends = np.append(0, np.cumsum(sizes) * AROUND.itemsize).astype("<i4")
            around = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(entries.tobytes())])
            tables.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(place), block)), pa.array(place), pa.array(words.split(b" "), pa.binary()), pa.array(_numbers(n, "<u4")), around], ["block", "place", "word", "n", "around"]))
        got = pa.Table.from_batches(_placed(model, numbered, group["part"][0].as_py())(iter(tables)))
        place, n, mark, ids = (got[f].to_numpy() for f in ("place", "n", "mark", "id"))
        ends = np.cumsum([t.num_rows for t in tables]).tolist()
        rows = [_squeezed_known(place[a:b], n[a:b], mark[a:b], ids[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
        return pa.table([group["block"].combine_chunks(), pa.array([x for x, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["block", "size", "packed"])

    return run


def _core_packed(model: ClassModel):
    """The rows of ``_core_rows``, packed: one row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _core_rows(model)(batches):
            size, packed = _squeezed_known(*(batch.column(i).to_numpy() for i in range(1, 5)))
            yield pa.RecordBatch.from_arrays([batch.column(0)[:1], pa.array([size], pa.int32()), pa.array([packed], pa.binary())], ["block", "size", "packed"])

    return run


def _pairs(core: dict[bytes, int]):
    """Counts of adjacent units in the training texts; a text follows an end."""
    n_units = len(core) + SPELLINGS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, sizes, low, high, words in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                u = units(words.values, core)[_codes(low, high)]
                learn = ~np.repeat(np.frombuffer(held, dtype=bool), np.frombuffer(sizes, dtype="<i8"))
                before = np.concatenate([[core[END]], u[:-1]])
                keys, n = np.unique((before * n_units + u)[learn], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["pair", "n"])

    return run


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(left: np.ndarray, right: np.ndarray, n: np.ndarray, n_units: int, n_classes: int = CLASSES, sweeps: int = SWEEPS, fixed: int | None = None) -> np.ndarray:
    """Classes of units by the exchange algorithm, from counts n of pairs (left, right).

    The likelihood is, but for a constant, the sum of N(b, c) log N(b, c) less twice that of
    N(c) log N(c). Units are visited by falling count, each time moving to the best class,
    until a sweep moves none. The fixed unit keeps the last class to itself.
    """
    free = n_classes - (fixed is not None)
    total = np.bincount(right, weights=n, minlength=n_units)
    order = np.argsort(-total, kind="stable")
    if fixed is not None:
        order = order[order != fixed]
    of = np.empty(n_units, dtype=np.int64)
    of[order] = np.minimum(np.arange(len(order)), free - 1) if len(order) <= free else np.arange(len(order)) % free
    if fixed is not None:
        of[fixed] = n_classes - 1
    from_left, from_right = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    at_left = np.searchsorted(left[from_left], np.arange(n_units + 1))
    at_right = np.searchsorted(right[from_right], np.arange(n_units + 1))
    cc = np.zeros((n_classes, n_classes))
    np.add.at(cc, (of[left], of[right]), n)
    c = np.bincount(of, weights=total, minlength=n_classes)
    for _ in range(sweeps):
        moved = 0
        for u in order.tolist():
            if not total[u]:
                continue
            after, ahead = from_left[at_left[u] : at_left[u + 1]], from_right[at_right[u] : at_right[u + 1]]
            self_n = n[after][right[after] == u].sum()
            after, ahead = after[right[after] != u], ahead[left[ahead] != u]
            r = np.bincount(of[right[after]], weights=n[after], minlength=n_classes)
            l = np.bincount(of[left[ahead]], weights=n[ahead], minlength=n_classes)
            g = of[u]
            cc[g, :] -= r
            cc[:, g] -= l
            cc[g, g] -= self_n
            c[g] -= total[u]
            rows = _f(cc + r[None, :]) - _f(cc)
            cols = _f(cc + l[:, None]) - _f(cc)
            d = np.diagonal(cc)
            gain = rows.sum(1) - np.diagonal(rows) + cols.sum(0) - np.diagonal(cols) + _f(d + r + l + self_n) - _f(d) - 2 * (_f(c + total[u]) - _f(c))
            k = int(np.argmax(gain[:free]))
            if gain[k] <= gain[g] + 1e-9:
                k = g
            cc[k, :] += r
            cc[:, k] += l
            cc[k, k] += self_n
            c[k] += total[u]
            if k != g:
                of[u] = k
                moved += 1
        if not moved:
            break
    return of


@dataclass
class ClassModel:
    """What exchange clustering of the core gives.

    core: units of frequent words; core_n: their training counts; of: class of each unit; transition: log10 P(c | b); emission: log10 P(u | class of u).

    spelling_total holds log10 of what a spelling unit's word counts are divided by; beside_n
    has the counts of pairs of core words by class.
    """

    core: dict[bytes, int]
    core_n: np.ndarray
    of: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    spelling_total: np.ndarray
    beside_n: np.ndarray

    def beside(self) -> np.ndarray:
        """log P(b before | k) for each class b, then log P(c after | k) for each c, by k; a class with no core word but the end's is never chosen."""
        out = []
        for n in (self.beside_n, self.beside_n.T):  # [neighbour, k]
            prior = (n.sum(1, keepdims=True) + 0.5) / (n.sum() + 0.5 * CLASSES)
            out.append(np.log((n + PRIOR * prior) / (n.sum(0, keepdims=True) + PRIOR)))
        got = np.concatenate(out)
        closed = np.ones(CLASSES, dtype=bool)
        closed[np.delete(self.of[: len(self.core)], self.core[END])] = False
        if not closed.all():
            got[:, closed] = -np.inf
        return got


def transitions(cc: np.ndarray) -> np.ndarray:
    """log10 P(c | b) from the counts of class pairs."""
    class_n = cc.sum(0)
    prior = (class_n + 0.5) / (class_n.sum() + 0.5 * CLASSES)
    weight = PRIOR + (cc > 0).sum(1, keepdims=True)
    return np.log10((cc + weight * prior[None, :]) / (cc.sum(1, keepdims=True) + weight))


def fit(blocks: DataFrame, vocabulary: DataFrame) -> ClassModel:
    """blocks as stored by ``cut``; vocabulary has word and n, its training count, zero if there is none."""
    seen = vocabulary.filter("n > 0")
    spelled = F.crc32(F.substring("word", -2, 2)) % SPELLINGS
    ends = seen.filter(F.col("word") == F.lit(END))
    often = [(bytes(r["word"]), r["n"]) for r in seen.orderBy(F.desc("n"), "word").limit(FREQUENT).unionByName(ends).distinct().collect()]
    core = {w: i for i, w in enumerate([END, *sorted(w for w, _ in often if w != END)])}
    n_units = len(core) + SPELLINGS
    spelled_n = seen.filter(F.col("word") != F.lit(END)).groupBy(spelled.alias("s")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    total = np.full(SPELLINGS, 0.5)
    for r in spelled_n:
        total[r["s"]] = r["n"] + 0.5 * (r["v"] + 1)
    for w, k in often:
        total[zlib.crc32(w[-2:]) % SPELLINGS] -= (k + 0.5) * (w != END)
    counted = blocks.select("held", "sizes", "low", "high", "words").mapInArrow(_pairs(core), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # at most (FREQUENT + SPELLINGS + 1) squared rows
    pair, n = got["pair"].to_numpy(), got["n"].to_numpy().astype(float)
    sort = np.argsort(pair)
    pair, n = pair[sort], n[sort]
    left, right = pair // n_units, pair % n_units
    of = exchange(left, right, n, n_units, fixed=core[END])
    cc = np.zeros((CLASSES, CLASSES))
    np.add.at(cc, (of[left], of[right]), n)
    unit_n = np.bincount(right, weights=n, minlength=n_units)
    class_n = np.bincount(of, weights=unit_n, minlength=CLASSES)
    members = np.bincount(of, minlength=CLASSES)
    emission = np.log10((unit_n + 0.5) / (class_n + 0.5 * members)[of])
    beside_n, both = np.zeros((CLASSES, CLASSES)), (left < len(core)) & (right < len(core))
    np.add.at(beside_n, (of[left[both]], of[right[both]]), n[both])
    core_n = np.zeros(len(core), dtype=np.int64)
    for w, k in often:
        core_n[core[w]] = k
    return ClassModel(core, core_n, of, transitions(cc), emission, np.log10(total), beside_n)


@dataclass
class Numbered:
    """Which words have numbers: those of the core first, then those counted least times or more, by part of the shuffle by word; starts has a start for each part and the end."""

    least: int
    starts: np.ndarray

    @classmethod
    def of(cls, vocabulary: DataFrame, model: ClassModel, parts: int) -> Numbered:
        """The least count is LEAST, or the first doubling of it that leaves MOST_WORDS words or fewer."""
        doubled = [LEAST << i for i in range(50)]
        met = vocabulary.agg(*(F.count(F.when(F.col("n") >= x, 1)).alias(str(x)) for x in doubled)).first()
        least = next(x for x in doubled if met[str(x)] <= MOST_WORDS)
        core = vocabulary.sparkSession.createDataFrame([(w,) for w in model.core], "word binary")
        rest = vocabulary.filter(F.col("n") >= least).join(F.broadcast(core), "word", "left_anti")
        n = np.zeros(parts + 1, dtype=np.int64)
        for r in rest.groupBy((F.crc32("word") % parts).alias("part")).count().collect():  # one row for each part
            n[r["part"] + 1] = r["count"]
        return cls(least, len(model.core) + np.cumsum(n))


def _joined(block: pa.Table, words: pa.Table) -> pa.Table:
    """A block with what is known of its words by place: numbers, classes; new are the numbers first met here, types the other training words first met here by class."""
    if not block.num_rows:
        return _JOINED.empty_table()
    row = block.to_pylist()[0]
    at, n_of, mark_of, ids_of = (np.concatenate(x) for x in zip(*(_known(size.as_py(), packed.as_py()) for size, packed in zip(words["size"], words["packed"]))))
    n, mark, ids = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64), np.full(len(at), -1, dtype=np.int32)
    n[at], mark[at], ids[at] = n_of, mark_of, ids_of
    codes = _codes(row["low"], row["high"])
    sizes = np.frombuffer(row["sizes"], dtype="<i8")
    starts = np.cumsum(sizes) - sizes
    own, first = (mark >> 1).astype(np.uint8), mark % 2 == 1
    new = first & (ids >= 0)
    known = np.add.reduceat((n > 0).astype(np.int64)[codes], starts)
    logs = np.add.reduceat(np.log10(n + 0.5)[codes], starts)
    types = np.bincount(own[first & (ids < 0)], minlength=CLASSES)
    put = {
        **{k: row[k] for k in ("block", "doc_ids", "no_id", "held", "sizes", "low", "high")}, "known": known.astype("<i8").tobytes(), "logs": logs.astype("<f8").tobytes(),
        "ids": ids.astype("<i4").tobytes(), "own": own.tobytes(), "new": ids[new].astype("<i4").tobytes(), "new_own": own[new].tobytes(), "types": types.astype("<i8").tobytes(),
    }
    return pa.table([pa.array([v], t.type) for v, t in zip(put.values(), _JOINED)], schema=_JOINED)


_JOINED = pa.schema([("block", pa.int64()), *((k, pa.binary()) for k in ("doc_ids", "no_id", "held", "sizes", "low", "high", "known", "logs", "ids", "own", "new", "new_own", "types"))])
JOINED = ", ".join(f"{f.name} {'long' if f.name == 'block' else 'binary'}" for f in _JOINED)
TOKENS = ["block", "held", "sizes", "low", "high", "ids", "own"]


@dataclass
class _Tokens:
    """The tokens of a block: places in its word list, and for each whether it is learned from; starts of its texts."""

    codes: np.ndarray
    learn: np.ndarray
    starts: np.ndarray
    ids: np.ndarray
    own: np.ndarray

    @classmethod
    def each(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, _Tokens]]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {f: batch.column(k)[i].as_py() for k, f in enumerate(batch.schema.names)}
                sizes = np.frombuffer(row["sizes"], dtype="<i8")
                learn = ~np.repeat(np.frombuffer(row["held"], dtype=bool), sizes)
                yield row, cls(_codes(row["low"], row["high"]), learn, np.cumsum(sizes) - sizes, np.frombuffer(row["ids"], dtype="<i4"), np.frombuffer(row["own"], dtype=np.uint8))

    def classes(self, of: np.ndarray) -> np.ndarray:
        """Classes of the tokens where numbered words have those of a map."""
        return np.where(self.ids >= 0, of[self.ids], self.own)[self.codes] if len(of) else self.own[self.codes]

    def before(self, now: np.ndarray, end: int) -> np.ndarray:
        """What stands before each token; a text follows an end."""
        out = np.empty_like(now)
        out[1:] = now[:-1]
        out[self.starts] = end
        return out


def _class_pairs(of: np.ndarray, end: int):
    """Counts of class pairs of the training tokens under a map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for _, t in _Tokens.each(batches):
            k = t.classes(of).astype(np.int64)
            n += np.bincount((t.before(k, end) * CLASSES + k)[t.learn], minlength=CLASSES * CLASSES)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["cell", "n"])

    return run


def count_pairs(rows: DataFrame, count, n_maps: int) -> np.ndarray:
    """N(b, c) under each map, as tasks count it."""
    n = np.zeros(n_maps * CLASSES * CLASSES)
    for r in rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # class pairs
        n[r["cell"]] = r["n"]
    return n.reshape(n_maps, CLASSES, CLASSES)


def likelihood(cc: np.ndarray) -> float:
    """The likelihood of training texts by class pairs, but for a constant."""
    return float(_f(cc).sum() - 2 * _f(cc.sum(0)).sum())


def n_slices(words: int) -> int:
    """Into how many slices numbered words are dealt: word w to slice w modulo that, at place w // that."""
    return max(1, min(MOST_SLICES, -(-words // SLICE)))


def _packed_near(place: np.ndarray, near: np.ndarray, n: np.ndarray) -> bytes:
    """Neighbours of words in order: the places of the words, how many each has, and these with their counts."""
    at = np.flatnonzero(np.diff(place, prepend=-1))
    size, packed = _squeeze(_steps(place[at]), _planes(np.diff(at, append=len(place)), "<u4"), _planes(near, "<u4"), _planes(n, "<u8"))
    return size.to_bytes(8, "little") + packed


def _near_of(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of the words of a row, the starts of their neighbours and their end, the neighbours, their counts."""
    place, sizes, near, n = _fields(int.from_bytes(packed[:8], "little"), packed[8:], 4)
    return np.cumsum(_numbers(place, "<u4")), np.append(0, np.cumsum(_numbers(sizes, "<u4"))), _numbers(near, "<u4"), _numbers(n, "<u8")


def _word_counts(of: np.ndarray, end: int):
    """For each slice of a block, how often each neighbour stands before and after each word of the numbers of a map, the end aside.

    A neighbour is its number plus CLASSES, or the class of a word that never moves: one
    without number, or the end. It is doubled, with one added for those after the word.
    A word beside itself stands before it alone.
    """
    dealt, width = n_slices(len(of)), -(-len(of) // n_slices(len(of)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, t in _Tokens.each(batches):
            code = np.where(t.ids > 0, t.ids.astype(np.int64) + CLASSES, t.own)[t.codes]
            pairs, n = np.unique(((t.before(code, end) << 32) | code)[t.learn], return_counts=True)
            left, right = pairs >> 32, pairs & 0xFFFFFFFF
            l, r = right >= CLASSES, (left >= CLASSES) & (left != right)
            word = np.concatenate([right[l], left[r]]) - CLASSES
            keys, n = ((word % dealt) * width + word // dealt) << NEAR_BITS | np.concatenate([2 * left[l], 2 * right[r] + 1]), np.concatenate([n[l], n[r]])
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            word, near = keys >> NEAR_BITS, keys & ((1 << NEAR_BITS) - 1)
            slices = word // width
            at = np.append(np.flatnonzero(np.diff(slices, prepend=-1)), len(keys))
            rows = [(int(slices[a]), row["block"], _packed_near(word[a:b] - slices[a] * width, near[a:b], n[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["slice", "block", "counts"])

    return run


def _added(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Counts of equal keys added up, keys in order."""
    keys, n = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    return [keys[at]], [np.add.reduceat(n, at)]


def _merged(fan: int, row_near: int):
    """The neighbours of a slice, rows of all blocks merged fan at a time; in rows of row_near neighbours, each word in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, first = [], [], None
        for batch in batches:
            for slice_, packed in zip(batch.column(0), batch.column(1)):
                place, starts, near, more = _near_of(packed.as_py())
                first = slice_ if first is None else first
                keys.append(np.repeat(place, np.diff(starts)) << NEAR_BITS | near)
                n.append(more)
                if len(keys) > fan:
                    keys, n = _added(keys, n)
        (keys,), (n,) = _added(keys, n)
        word, near = keys >> NEAR_BITS, keys & ((1 << NEAR_BITS) - 1)
        starts, a = np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(word)), 0
        while a < len(starts) - 1:
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + row_near, side="right")) - 1)
            part = slice(starts[a], starts[b])
            yield pa.RecordBatch.from_arrays([pa.array([first.as_py()], pa.int32()), pa.array([_packed_near(word[part], near[part], n[part])], pa.binary())], ["slice", "counts"])
            a = b

    return run


def neighbours(joined: DataFrame, of: np.ndarray, end: int, n_blocks: int) -> DataFrame:
    """How often which neighbours stand beside each numbered word in training texts, stored: classes change in the exchange, these do not, so they travel once."""
    rows = joined.select(*TOKENS).mapInArrow(_word_counts(of, end), "slice int, block long, counts binary").select("slice", "counts")
    return scratch_table(rows.repartition(n_blocks, "slice").groupBy("slice").applyInArrow(_merged(FAN, ROW_NEAR), "slice int, counts binary"), "neighbours")


def _now(of: np.ndarray) -> np.ndarray:
    """The classes of neighbours under a map."""
    return np.concatenate([np.arange(CLASSES, dtype=np.uint8), of])


def _near_pairs(maps: list[np.ndarray]):
    """Counts of the class pairs that a numbered word is in under each of several maps, in cells one map after the other."""
    dealt, classes = n_slices(len(maps[0])), [_now(of) for of in maps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(classes), CLASSES * CLASSES))
        for batch in batches:
            for slice_, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                place, starts, near, n = _near_of(packed.as_py())
                sizes, after = np.diff(starts), (near & 1).astype(bool)
                word, code = np.repeat(slice_ + place * dealt + CLASSES, sizes), near >> 1
                # A pair of two numbered words is counted where it stands before the second.
                fixed = after & (code < CLASSES)
                l, r = (word[~after], code[~after], n[~after]), (word[fixed], code[fixed], n[fixed])
                for i, k in enumerate(classes):
                    out[i] += np.bincount(k[l[1]].astype(np.int64) * CLASSES + k[l[0]], weights=l[2], minlength=CLASSES * CLASSES)
                    out[i] += np.bincount(k[r[0]].astype(np.int64) * CLASSES + r[1], weights=r[2], minlength=CLASSES * CLASSES)
        out = out.ravel()
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at].astype(np.int64))], ["cell", "n"])

    return run


def differences(cc: np.ndarray) -> list[np.ndarray]:
    """For the neighbours after and before a word: f(N + m) - f(N) by m from 1 to SMALL, neighbour class and class, zero where both are one."""
    out = []
    for table in (cc.T, cc):
        d = np.stack([_f(table + m) - _f(table) for m in range(1, SMALL + 1)])
        d[:, np.arange(len(cc)), np.arange(len(cc))] = 0.0
        out.append(d)
    return out


def gains(counts: np.ndarray, of: np.ndarray, cc: np.ndarray, small: list[np.ndarray]) -> np.ndarray:
    """What each word (a row: its neighbours by class before and after, and itself) gains in each class, by what the likelihood would be without it.

    Taking a word out of class g changes row and column g of N(b, c) alone: what a neighbour
    class other than g brings to a class other than g is the same for all words and comes from
    small, the result of ``differences``, where it stands there SMALL times or less. Most words
    have few neighbours, so only classes that stand beside a word are looked at.
    """
    left, right, own = counts[:, :CLASSES].astype(float), counts[:, CLASSES:SLOTS].astype(float), counts[:, SLOTS].astype(float)
    total, words = left.sum(1) + own, np.arange(len(of))
    out = np.zeros(left.shape)
    for beside, other, table, d in ((right, left, cc.T, small[0]), (left, right, cc, small[1])):  # table[j, k]: pairs of neighbour class j and class k
        rest = beside.copy()
        rest[words, of] = 0.0
        w, j = np.nonzero(rest)
        n = rest[w, j]
        few = n <= SMALL
        at = (n[few].astype(np.int64) - 1) * CLASSES + j[few]
        part = row_sums(d.reshape(-1, CLASSES), at, np.append(0, np.cumsum(np.bincount(w[few], minlength=len(of)))))
        if not few.all():
            much_w, much_j, much = w[~few], j[~few], n[~few, None]
            more = _f(table[much_j] + much) - _f(table[much_j])
            more[np.arange(len(much_j)), much_j] = 0.0
            part += row_sums(more, np.arange(len(more)), np.append(0, np.cumsum(np.bincount(much_w, minlength=len(of)))))
        with_own = np.flatnonzero(beside[words, of])
        without = table[of[with_own]] - other[with_own]  # neighbours of the word's own class
        part[with_own] += _f(without + beside[with_own, of[with_own]][:, None]) - _f(without)
        stay = table[j, of[w]]  # the word's own class
        part[words, of] = np.bincount(w, weights=_f(stay) - _f(stay - n), minlength=len(of))
        out += part
    both, diagonal, size = left + right + own[:, None], np.diagonal(cc), cc.sum(0)
    w, k = np.nonzero(both)
    met = both[w, k]
    corner = diagonal[k] - np.where(of[w] == k, met, 0.0)
    out[w, k] += _f(corner + met) - _f(corner)
    totals, at = np.unique(total, return_inverse=True)
    grown = (_f(size + totals[:, None]) - _f(size))[at]
    grown[words, of] = _f(size[of]) - _f(size[of] - total)
    return out - 2 * grown


def _moves(of: np.ndarray, cc: np.ndarray, end: int):
    """The words of a slice that gain in another class, and that class."""
    small, dealt, classes = differences(cc), n_slices(len(of)), _now(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                place, starts, near, n = _near_of(packed.as_py())
                word = slice_ + place * dealt
                own = classes[word + CLASSES].astype(np.int64)
                to = own.copy()
                for a in range(0, len(word), 512):
                    b = min(len(word), a + 512)
                    at, code = np.repeat(np.arange(b - a), np.diff(starts[a : b + 1])), near[starts[a] : starts[b]]
                    cell = np.where(code >> 1 == word[a:b][at] + CLASSES, SLOTS, classes[code >> 1] + CLASSES * (code & 1))
                    counts = np.bincount(at * CELLS + cell, weights=n[starts[a] : starts[b]], minlength=(b - a) * CELLS).reshape(b - a, CELLS)
                    got, rows = gains(counts, own[a:b], cc, small), np.arange(b - a)
                    got[:, end] = -np.inf
                    best = got.argmax(1)
                    to[a:b] = np.where(got[rows, best] > got[rows, own[a:b]] + 1e-9, best, own[a:b])
                moved = np.flatnonzero(to != own)
                yield pa.RecordBatch.from_arrays([pa.array([word[moved].astype("<i4").tobytes()], pa.binary()), pa.array([to[moved].astype(np.uint8).tobytes()], pa.binary())], ["ids", "to"])

    return run


def sweep(joined: DataFrame, of: np.ndarray, cc: np.ndarray, end: int, n_blocks: int, near: DataFrame | None = None) -> np.ndarray:
    """The best class of each numbered word, all others staying where they are; near is what ``neighbours`` gives, if it is there already."""
    near = neighbours(joined, of, end, n_blocks) if near is None else near
    to = of.copy()
    for r in near.mapInArrow(_moves(of, cc, end), "ids binary, to binary").collect():  # five bytes for each of MOST_WORDS words at most
        to[np.frombuffer(r["ids"], dtype="<i4")] = np.frombuffer(r["to"], dtype=np.uint8)
    return to


def refine(joined: DataFrame, model: ClassModel, words: int, n_blocks: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Exchange over all numbered words: their classes, N(b, c), and the likelihood at first and after each sweep.

    The moves of a sweep are found for all words at once, each exact if it were the only one.
    All of them, or a half, a quarter or an eighth of them by number, are made: what gives the
    greatest likelihood. It rises in each sweep; the exchange ends when it can't or after ROUNDS.
    """
    end, core = int(model.of[model.core[END]]), len(model.core)
    of = np.zeros(words, dtype=np.uint8)
    of[:core] = model.of[:core]
    for r in joined.select("new", "new_own").collect():  # each number once
        of[np.frombuffer(r["new"], dtype="<i4")] = np.frombuffer(r["new_own"], dtype=np.uint8)
    cc = count_pairs(joined.select(*TOKENS), _class_pairs(of, end), 1)[0]
    values = [likelihood(cc)]
    if not ROUNDS:
        return of, cc, values
    near = neighbours(joined, of, end, n_blocks)
    fixed = cc - count_pairs(near, _near_pairs([of]), 1)[0]  # pairs without a numbered word are the same under all maps
    share = mix(np.arange(words, dtype=np.uint64)) >> np.uint64(61)
    for _ in range(ROUNDS):
        to = sweep(joined, of, cc, end, n_blocks, near)
        if (to == of).all():
            break
        maps = [np.where(share < k, to, of) for k in (8, 4, 2, 1)]
        counted = fixed + count_pairs(near, _near_pairs(maps), len(maps))
        reached = [likelihood(x) for x in counted]
        best = int(np.argmax(reached))
        if reached[best] <= values[-1]:
            break
        of, cc = maps[best], counted[best]
        values.append(reached[best])
    return of, cc, values


@dataclass
class Scorer:
    """The whole model: classes of numbered words; transition, log10 P(c | b); total, log10 of what the word counts of each class are divided by; tokens and types of training."""

    end: int
    of: np.ndarray
    transition: np.ndarray
    total: np.ndarray
    tokens: int
    types: int

    @classmethod
    def fit(cls, joined: DataFrame, model: ClassModel, of: np.ndarray, cc: np.ndarray) -> Scorer:
        end, core = int(model.of[model.core[END]]), len(model.core)
        types = np.bincount(of[:core][model.core_n > 0], minlength=CLASSES) + np.bincount(of[core:], minlength=CLASSES)
        rest = joined.select("types").mapInArrow(_type_sums, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        for r in rest.collect():  # classes
            types[r["cell"]] += r["n"]
        spellings = np.bincount(model.of[core:], minlength=CLASSES)
        total = np.log10(np.maximum(cc.sum(0) + 0.5 * (types + spellings), 0.5))
        return cls(end, of, transitions(cc), total, int(cc.sum()), int(types.sum()))

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_total = np.log10(self.tokens + 0.5 * (self.types + 1))
        for row, t in _Tokens.each(batches):
            now = t.classes(self.of).astype(np.int64)
            sizes, logs = np.frombuffer(row["sizes"], dtype="<i8"), np.frombuffer(row["logs"], dtype="<f8")
            score = logs + np.add.reduceat(self.transition[t.before(now, self.end), now] - self.total[now], t.starts)
            ids = pa.array(np.frombuffer(row["doc_ids"], dtype="<i8"), mask=np.frombuffer(row["no_id"], dtype=bool))
            columns = [ids, pa.array(np.frombuffer(row["held"], dtype=bool)), pa.array(sizes), pa.array(np.frombuffer(row["known"], dtype="<i8")), pa.array(logs - sizes * base_total), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCORES.split(", ")])


def _type_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(CLASSES, dtype=np.int64)
    for batch in batches:
        for types in batch.column(0).to_pylist():
            n += np.frombuffer(types, dtype="<i8")
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n)], ["cell", "n"])


def cut(docs: DataFrame) -> DataFrame:
    """Blocks of docs, stored; texts with crc32(doc_id) mod 5 = 1 are held out."""
    bounded_batches(docs.sparkSession)
    t = texts(docs).select("doc_id", (remainder(F.col("doc_id"), 5) == 1).alias("held"), F.col("text").cast("binary").alias("text"))
    return scratch_table(t.mapInArrow(_blocks, BLOCK), "word-blocks")


def class_lm(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Defined cases: a null text is empty and scores its end alone; a null doc_id counts as
    the empty text in the split; with no training text all counts are zero; rows that repeat
    a doc_id are scored each; an empty table gives an empty result; other columns are ignored.
    """
    joined, model, of, cc, _ = learn(docs)
    scorer = Scorer.fit(joined, model, of, cc)
    scored = joined.select("doc_ids", "no_id", "known", "logs", *TOKENS).mapInArrow(scorer.run, SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(scorer.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def learn(docs: DataFrame) -> tuple[DataFrame, ClassModel, np.ndarray, np.ndarray, list[float]]:
    """The blocks with their words' numbers, stored; the model of the core; classes of numbered words, N(b, c), and the likelihood by sweep."""
    blocks = cut(docs)
    rows = blocks.select("block", "words", "counts").mapInArrow(_word_rows, WORD_ROWS)
    vocabulary = scratch_table(rows.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    model = fit(blocks, vocabulary)
    n_blocks = max(1, blocks.count())  # tasks that grow with the corpus: about one block each
    numbered = Numbered.of(vocabulary, model, n_blocks)
    whole = blocks.select("block", "doc_ids", "no_id", "held", "sizes", "low", "high").repartition(n_blocks, "block")
    near = blocks.select("block", "held", "sizes", "low", "high", "words", "counts").mapInArrow(_parted(model, n_blocks), "part int, " + PACKED)
    placed = near.repartition(n_blocks, "part").groupBy("part").applyInArrow(_placed_part(model, numbered), PACKED)
    every = placed.unionByName(blocks.select("block", "words").mapInArrow(_core_packed(model), PACKED)).repartition(n_blocks, "block")
    joined = scratch_table(whole.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(_joined, JOINED), "numbered-blocks")
    return joined, model, *refine(joined, model, int(numbered.starts[-1]), n_blocks)
