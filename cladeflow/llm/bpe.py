"""Byte-pair encoding as a deterministic automaton over token arcs, and decoding by arc labels.

The automaton is compiled by successive merge gadgets. It starts with one state and an arc
for each byte; the gadget of a merge (x, y) -> xy, taken in order of rank, gives the state
that an x arc enters no y arc any more, and an xy arc runs to a copy of the state where y
led. A merge whose y arc is already gone from the state of x never applies: its gadget does
nothing. After all gadgets exactly one path spells any word, and its arcs are the word's tokens.

Which arcs a state has depends on the arc that enters it alone, so the states are the tokens,
and the table of a vocabulary of 50 000 has 2.5e9 cells. ``compiled`` stores what the gadgets
take away instead. An arc whose token begins with a later merge of y is never added where y
is gone already; so with tokens ordered such that those which begin with y, the latest merged
first, follow y, a gadget takes away a range of arcs, and a copied state has the ranges of
its original up to that gadget. The table is the sorted list of all states' ranges, a million
numbers, and a transition is one search in it. ``full_table`` builds every state with all its
arcs one gadget after another, as tests of small vocabularies do.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.common import bounded_batches, texts, worker_store
from cladeflow.llm.tokens import vocabulary_path

#: Words that a worker keeps; beyond it the store starts anew.
CACHE_WORDS = 300_000
CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Unicode's White_Space characters.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pieces of text, worked out when first asked for."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, piece: str) -> bytes:
        got = self[piece] = self.automaton.piece(piece)
        return got


class Automaton:
    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[bytes, int] | None = None):
        """labels: bytes of each token; merges: (left, right, token) by rank; special: tokens found before all else."""
        self.labels, self.special = labels, special or {}
        made = {t for *_, t in merges}
        self.table = compiled([t for t in labels if len(labels[t]) == 1 and t not in made], merges)
        self.arcs = self._trie()
        self.known = _Pieces(self)
        self.words: dict[bytes, bytes] = {}

    def _trie(self) -> dict:
        """Nested tables from a byte to (place of a token or -1, table)."""
        root: dict = {}
        for token, place in self.table.place.items():
            node, label = root, self.labels[token]
            for b in label[:-1]:
                node = node.setdefault(b, [-1, {}])[1]
            node.setdefault(label[-1], [-1, {}])[0] = place
        return root

    def path(self, word: bytes) -> list[int]:
        """The tokens of the one path that spells the word.

        Longer arcs are tried first. Each start of the word has one path only, so a place
        from which no arc leads on is never entered again.
        """
        n, root = len(word), self.arcs
        bounds, first, last = self.table.bounds, self.table.first, self.table.last
        i, out, dead, stack, lo, hi = 0, [], set(), [], 0, 0
        while i < n:
            node, j, arcs = root, i, []
            while j < n:
                step = node.get(word[j])
                if step is None:
                    break
                token, node = step
                j += 1
                if token >= 0:
                    arcs.append((token, j))
            while True:
                while arcs:
                    token, j = arcs.pop()
                    if j in dead:
                        continue
                    k = bisect_right(first, token, lo, hi) - 1
                    if k < lo or token >= last[k]:
                        break
                else:
                    dead.add(i)
                    out.pop()
                    i, arcs, lo, hi = stack.pop()
                    continue
                break
            stack.append((i, arcs, lo, hi))
            out.append(token)
            i, lo, hi = j, bounds[token], bounds[token + 1]
        tokens = self.table.tokens
        return [tokens[p] for p in out]

    def piece(self, piece: str) -> bytes:
        """The ids of the pre-split words of a piece that holds white space at its start alone."""
        body = piece[1:] if piece[0] == " " else piece
        if body.isalpha():  # as \p{L}+ matches it
            split = (piece,)
        elif body[:-1].isalpha() and body[-1] in ".,;:!?":
            split = (piece[:-1], body[-1])
        else:
            import regex

            split = regex.findall(PATTERN, piece)
        got = []
        for word in split:
            word = word.encode()
            ids = self.words.get(word)
            if ids is None:
                ids = b"".join(t.to_bytes(4, "little") for t in self.path(word))
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                self.words[word] = ids
            got.append(ids)
        return b"".join(got)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if self.special:
            out, known = [], self.special
            for part in re.split("(" + "|".join(re.escape(s.decode()) for s in known) + ")", text):
                token = known.get(part.encode())
                out.append(self._plain(part) if token is None else token.to_bytes(4, "little"))
            return b"".join(out)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        known = self.known
        got = b"".join(map(known.__getitem__, PIECES.findall(text)))
        if len(known) > CACHE_WORDS:
            known.clear()
        return got

    def decode(self, ids: list[int]) -> bytes:
        """The labels of the arcs, in a row."""
        labels = self.labels
        return b"".join([labels[i] for i in ids])


@dataclass
class Table:
    """The compiled automaton: the arcs that each state lacks.

    place: a number for each token that a path can have, and tokens the reverse. The state that
    token b enters has the ranges k from bounds[place[b]] to bounds[place[b] + 1] - 1, in order
    and apart; it lacks the arc of token t if place[t] is from first[k] to last[k] - 1 for one
    of them. The start has all arcs.
    """

    place: dict[int, int]
    tokens: list[int]
    bounds: list[int]
    first: list[int]
    last: list[int]

    def has(self, before: int, token: int) -> bool:
        b, t = self.place[before], self.place[token]
        k = bisect_right(self.first, t, self.bounds[b], self.bounds[b + 1]) - 1
        return k < self.bounds[b] or t >= self.last[k]


def compiled(letters: list[int], merges: list[tuple[int, int, int]]) -> Table:
    """Apply the gadget of each merge (left, right, token) in order of rank to the automaton of the letters."""
    never = len(merges)
    right: dict[int, list[tuple[int, int]]] = {t: [(t, never)] for t in letters}  # the parts on a token's right edge, each with the gadget at which it went up
    left: dict[int, list[tuple[int, int]]] = {t: [(t, never)] for t in letters}
    begins: dict[int, list[tuple[int, int]]] = {}  # of a token, the merges that it begins, by rank
    taken: dict[int, list[tuple[int, int]]] = {}  # of a state, (rank, token whose arc a gadget takes away)
    gone: set[tuple[int, int]] = set()
    rank_of: dict[tuple[int, int], int] = {}
    for rank, (x, y, xy) in enumerate(merges):
        if x not in right or y not in right or xy in right:
            continue
        # A state has the ranges of the right edge's parts up to when each was copied.
        if any((a, b) in gone and rank_of[a, b] < a_until and rank_of[a, b] <= b_until for a, a_until in right[x] for b, b_until in left[y]):
            continue
        gone.add((x, y))
        rank_of[x, y] = rank
        taken.setdefault(x, []).append((rank, y))
        begins.setdefault(x, []).append((rank, xy))
        right[xy] = [(xy, never), (y, rank), *((part, min(until, rank)) for part, until in right[y][1:])]
        left[xy] = [(xy, never), (x, rank), *left[x][1:]]
    # Number the tokens so that those which begin with y follow it, the latest merged first.
    place, end, stack = {}, {}, [(t, False) for t in reversed(letters)]
    while stack:
        t, done = stack.pop()
        if done:
            end[t] = len(place)
            continue
        place[t] = len(place)
        stack.append((t, True))
        stack.extend((z, False) for _, z in begins.get(t, ()))  # by rank, so the latest comes off first
    ranges = {}
    for x, lost in taken.items():
        los, his = [], []
        for rank, y in lost:
            later = begins.get(y, ())
            at = bisect_left(later, (rank, -1))
            los.append(place[y])
            his.append(end[later[at][1]] if at < len(later) else place[y] + 1)
        ranges[x] = [r for r, _ in lost], np.array(los, dtype=np.int64), np.array(his, dtype=np.int64)
    width, firsts, lasts = len(place), [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for t, k in place.items():
        for part, until in right[t]:
            if part in ranges:
                ranks, los, his = ranges[part]
                n = bisect_left(ranks, until)
                firsts.append(los[:n] + k * width)
                lasts.append(his[:n] + k * width)
    first, last = np.concatenate(firsts), np.concatenate(lasts)
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order]) if len(order) else last
    state = first // max(width, 1)
    new = np.append(True, (first[1:] > last[:-1]) | (state[1:] > state[:-1])) if len(first) else np.empty(0, dtype=bool)
    starts = np.flatnonzero(new)
    state, first, last = state[starts], first[starts], np.maximum.reduceat(last, starts) if len(starts) else last
    bounds = np.searchsorted(state, np.arange(width + 1))
    return Table(place, list(place), bounds.tolist(), (first - state * width).tolist(), (last - state * width).tolist())


#: How byte-level vocabularies split text into words before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Larger pieces that are split alike: white space, or what is between, with the blank before it.
PIECES = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def full_table(alphabet: list[bytes], merges: list[tuple[int, int, int]]) -> tuple[list[dict[int, int]], int]:
    """Apply every gadget in turn; returns each state's arcs and the start. For small vocabularies."""
    states: list[dict[int, int]] = [{t: 0 for t in range(len(alphabet))}]
    for x, y, xy in merges:
        split: dict[int, int] = {}
        for s in range(len(states)):
            entered = states[s].get(x)
            if entered is None or y not in states[entered]:
                continue
            if entered not in split:
                split[entered] = len(states)
                states.append({k: v for k, v in states[entered].items() if k != y})
        size = len(states)
        before = [dict(s) for s in states]
        for s in range(size):
            entered = before[s].get(x)
            if entered in split:
                states[s][x] = split[entered]
                states[s][xy] = before[entered][y]
        if x == y:
            # In a run of x the merges take pairs from the left, so after x comes no arc xy either.
            for new in split.values():
                states[new].pop(xy, None)
    return states, 0


def load(path: str) -> Automaton:
    """Compile the merges of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    labels = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if all(c in letters for c in s)}
    special = {}
    for x in spec.get("added_tokens", []):
        labels[x["id"]] = x["content"].encode()
        special[x["content"].encode()] = x["id"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = set(special.values())
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    return Automaton({k: v for k, v in labels.items()}, [m for m in merges if m[2] not in made], special)


def automaton(path: str) -> Automaton:
    """One automaton for each worker process and path."""
    loaded = worker_store("automaton")
    if path not in loaded:
        loaded[path] = load(path)
    return loaded[path]


def _code(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for batch in batches:
            sizes, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                data = a.encode(text)
                sizes.append(len(data) // 4)
                ids_sha.append(hashlib.sha256(data).hexdigest())
                decoded = a.decode(memoryview(data).cast("I").tolist()).decode("utf-8", "replace")
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for batch in batches:
            ids = [memoryview(a.encode(t)).cast("I").tolist() for t in batch.column(1).to_pylist()]
            back = [a.decode(i).decode("utf-8", "replace") for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs.

    Defined cases: a null text is empty and has no ids; special tokens in a text are found
    first and become their id; rows that repeat a doc_id are coded each; other columns are
    ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    return texts(docs).mapInArrow(_code(path or vocabulary_path("byte_bpe_50k.json")), CODED)


def bpe_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and decoded text of every row of docs."""
    bounded_batches(docs.sparkSession)
    return texts(docs).select("doc_id", F.col("text")).mapInArrow(_ids(path or vocabulary_path("byte_bpe_50k.json")), "doc_id long, ids array<int>, decoded string")
