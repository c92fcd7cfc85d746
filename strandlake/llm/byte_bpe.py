"""Byte-level BPE encoding and decoding (operator 9).

Pre-tokenisation needs no regex. Every character becomes a symbol of a small alphabet (its class, and for apostrophes and
white space what follows), every symbol stands for a transition function between the states of a nine-state machine, and
the functions form a finite monoid whose composition table is computed once. An inclusive scan over monoid elements, by
doubling, gives the state before each character; a table of (symbol, state) says where a token begins. Nearly all
compositions are constant after two doublings, so the scan ends early. Each document begins in its own start state,
however many documents are scanned at once.

The slices between boundaries go through pair merging: those not met lately together, a row for each and a step at a time,
long ones by a heap over a linked list, n log n in the length. A bounded number of slices is kept with their ids. Offsets of every token are kept, and decoding copies the bytes of every id to its offset.

Nulls and empty texts have no tokens; very long texts, and slices without a boundary in them, are encoded whole; repeated rows give
equal results; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import sys
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from strandlake.llm.common import map_arrow

# The characters with the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The endings that the pattern keeps with an apostrophe that begins a token.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")

# States: what has been read last. START: nothing; GAP: white space but a blank; BLANK: U+0020; C2, C1: inside an ending
# with that many letters to come; DONE: an ending has just been read.
START, GAP, BLANK, LETTER, NUMBER, OTHER, C2, C1, DONE = range(9)
# Symbols. A space is LAST if it ends its run and something follows; FIRST_* is the first character of a document.
SPACE, SPACE_LAST, WHITE, WHITE_LAST, ALPHA, DIGIT, ELSE, SHORT, LONG = range(9)
N_SYMBOLS = 9
CHUNK = 1 << 18  # characters scanned at once
DECODE = 1 << 16  # ids decoded at once
KEPT = 100_000  # slices of a generation
WIDE, TOGETHER = 64, 1 << 14  # bytes of the longest slice that is merged in a row, and rows merged at once
NONE = np.iinfo(np.int32).max  # no token


def _step(symbol: int, state: int) -> int:
    if symbol in (SPACE, SPACE_LAST):
        return BLANK
    if symbol in (WHITE, WHITE_LAST):
        return GAP
    if symbol == ALPHA:
        return {C2: C1, C1: DONE}.get(state, LETTER)
    if symbol == DIGIT:
        return NUMBER
    if symbol == ELSE or state in (BLANK, OTHER):
        return OTHER
    return C1 if symbol == SHORT else C2


def _begins(symbol: int, state: int) -> bool:
    if symbol in (SPACE_LAST, WHITE_LAST):
        return True
    if symbol in (SPACE, WHITE):
        return state not in (GAP, BLANK)
    if symbol == ALPHA:
        return state not in (BLANK, LETTER, C1, C2)
    if symbol == DIGIT:
        return state not in (BLANK, NUMBER)
    return state not in (BLANK, OTHER)


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each symbol (after N_SYMBOLS: as first of a document), composition table, whether an element is
    constant, and its value from START."""
    maps = [tuple(_step(s, q) for q in range(9)) for s in range(N_SYMBOLS)]
    maps += [(m[START],) * 9 for m in maps]
    known = list(dict.fromkeys(maps))
    at = {m: i for i, m in enumerate(known)}
    done = 0
    while done < len(known):  # close under composition
        done = len(known)
        for a in known[:done]:
            for b in known[:done]:
                c = tuple(b[q] for q in a)
                if c not in at:
                    at[c] = len(known)
                    known.append(c)
    table = np.array([[at[tuple(b[q] for q in a)] for b in known] for a in known], np.uint8)
    return np.array([at[m] for m in maps], np.uint8), table, np.array([len(set(m)) == 1 for m in known]), np.array([m[START] for m in known], np.uint8)


@cache
def _classes() -> np.ndarray:
    """The symbol of every code point, apart from what follows it."""
    out = np.full(0x110000, ELSE, np.uint8)
    # Which Unicode version counts is the library's affair: it keeps what matches, so these two probes (over single bytes,
    # once in a process) tell its letters and numbers. No text is split this way.
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    for kind, k in ((r"\p{L}", ALPHA), (r"\p{N}", DIGIT)):
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=single, special_tokens={})
        out[[ord(c) for c in bytes(probe.encode_ordinary(every)).decode("utf-8")]] = k
    out[WHITE_SPACE] = WHITE
    out[0x20] = SPACE
    return out


@cache
def _begin_table() -> np.ndarray:
    return np.array([[_begins(s, q) for q in range(9)] for s in range(N_SYMBOLS)])


def token_starts(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions at which pre-tokens begin. codes: code points of documents laid end to end; firsts: where documents begin."""
    n = len(codes)
    if not n:
        return np.empty(0, np.int64)
    sym = _classes()[codes]
    is_first = np.zeros(n + 1, bool)
    is_first[firsts] = True
    is_first[n] = True
    white = sym <= WHITE_LAST
    # a run of white space is followed by something in the same document
    ends_run = white[:-1] & ~white[1:] & ~is_first[1:n]
    sym[:-1][ends_run] += 1
    marks = np.flatnonzero(codes == 0x27)
    if len(marks):
        pad = np.concatenate([codes, [0, 0]])
        same1, same2 = ~is_first[np.minimum(marks + 1, n)], ~is_first[np.minimum(marks + 1, n)] & ~is_first[np.minimum(marks + 2, n)]
        one, two = pad[marks + 1], pad[marks + 2]
        sym[marks[same1 & np.isin(one, [ord(c) for c in SHORT_ENDINGS])]] = SHORT
        for a, b in LONG_ENDINGS:
            sym[marks[same2 & (one == ord(a)) & (two == ord(b))]] = LONG
    element, table, constant, from_start = _monoid()
    own = element[sym + N_SYMBOLS * is_first[:n]]
    scan, d = own, 1
    while d < n and not constant[scan].all():
        scan = np.concatenate([scan[:d], table[scan[:-d], scan[d:]]])
        d *= 2
    before = np.empty(n, np.uint8)
    before[0] = START
    before[1:] = from_start[scan[:-1]]
    before[is_first[:n]] = START
    return np.flatnonzero(_begin_table()[sym, before] | is_first[:n])


class Ranks:
    """Ranks of a byte-level vocabulary, with the ids of slices met lately. Those are kept in two generations: when the young one
    holds KEPT slices it becomes the old one, so what a worker keeps between tasks is bounded."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = dict(zip(self.ranks.values(), self.ranks.keys()))
        self.most = max(self.bytes_of) + 1
        self.lengths = np.zeros(self.most, np.int64)
        for i, t in self.bytes_of.items():
            self.lengths[i] = len(t)
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(self.most)), np.uint8)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.decimal = list(map(str, range(self.most)))
        self.single = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        # two tokens side by side, as one number, and the token they give; the greatest number stands behind the last
        get = self.ranks.get
        pairs = sorted((x * (self.most + 1) + y, i) for t, i in self.ranks.items() for k in range(1, len(t)) if (x := get(t[:k])) is not None and (y := get(t[k:])) is not None)
        self.pairs = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.gives = np.array([i for _, i in pairs] + [NONE], np.int32)
        self.young, self.old = {}, {}

    def plain(self, piece: bytes) -> list[bytes]:
        """Merges the adjacent pair of lowest rank, leftmost first, until none is in the vocabulary."""
        get, none = self.ranks.get, len(self.ranks) + 1
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts

    def encoded(self, group: list[list[bytes]]) -> Iterator[np.ndarray]:
        """Ids of each list of slices; slices that are not kept are merged together."""
        if len(self.young) >= KEPT:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        flat = list(chain.from_iterable(group))
        found = list(map(young.get, flat))
        at = [i for i, x in enumerate(found) if x is None]
        missing = set(map(flat.__getitem__, at))
        young.update([(x, old[x]) for x in missing if x in old])
        new = [x for x in missing if x not in old]
        young.update(zip(new, self.merged_all(new)))
        for i in at:
            found[i] = young[flat[i]]
        for x in new:
            if len(x) > WIDE:
                del young[x]
        i = 0
        for slices in group:
            yield np.frombuffer(b"".join(found[i : i + len(slices)]), np.int32)
            i += len(slices)

    def merged(self, piece: bytes) -> list[int]:
        return np.frombuffer(self.merged_all([piece])[0], np.int32).tolist()

    def merged_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as the bytes of 32-bit numbers: whole tokens as they are, pieces of up to WIDE bytes many at a time
        beside those of about their length, longer ones by a heap."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, x in enumerate(pieces):
            if (r := self.ranks.get(x)) is not None:
                out[i] = r.to_bytes(4, sys.byteorder)
            elif len(x) <= WIDE:
                by_width.setdefault(-(-len(x) // 4), []).append(i)
            else:
                out[i] = np.array(self.merged_long(x), np.int32).tobytes()
        for at in by_width.values():
            for k in range(0, len(at), TOGETHER):
                for i, x in zip(at[k : k + TOGETHER], self.merged_rows([pieces[i] for i in at[k : k + TOGETHER]])):
                    out[i] = x
        return out

    def given(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each two tokens side by side give, or NONE."""
        key = left * np.int64(self.most + 1) + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.gives[at], NONE)

    def merged_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Merges the adjacent pair of lowest rank, leftmost first, in a row for each piece, all rows a step at a time until they are
        done. A token stands where its first byte does; `most`, which pairs with nothing, stands after the last one, and so before
        the next row's first."""
        size = np.array(list(map(len, pieces)))
        rows, width = len(pieces), int(size.max()) + 1
        there = (np.arange(width) < size[:, None]).ravel()
        token = np.full(rows * width, self.most, np.int64)
        token[there] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        if token.min() < 0:
            raise KeyError("a byte is not in the vocabulary")
        after, before = np.arange(1, rows * width + 1), np.arange(-1, rows * width - 1)
        rank = np.full((rows, width), NONE, np.int32)
        low = rank.ravel()
        heads = np.flatnonzero(there)
        low[heads] = self.given(token[heads], token[heads + 1])
        live = np.arange(rows)
        while True:
            at = live * width + rank[live].argmin(1)
            go = low[at] < NONE
            live, at = live[go], at[go]
            if not len(at):
                break
            gone = after[at]
            right, left = after[gone], before[at]
            token[at] = best = low[at].astype(np.int64)
            there[gone], low[gone] = False, NONE
            after[at], before[right] = right, at
            low[at], low[left] = self.given(best, token[right]), self.given(token[left], best)
        flat = token[there].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(there.reshape(rows, width).sum(1))).tolist()
        return [flat[x:y] for x, y in zip([0, *ends], ends)]

    def merged_long(self, piece: bytes) -> list[int]:
        """The same by a heap over linked parts, n log n in the length."""
        ranks = self.ranks
        n = len(piece)
        end = list(range(1, n + 1))  # the part that begins at i ends at end[i]; 0: merged away
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two parts has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where the bytes of each id begin, and the end."""
        out = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.lengths[ids], out=out[1:])
        return out

    def decode(self, ids, offsets: np.ndarray | None = None) -> bytes:
        """Bytes of ids, each at its offset; an id outside the vocabulary raises KeyError."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise KeyError("an id is not in the vocabulary")
        offsets, out = self.offsets(ids) if offsets is None else offsets, []
        for k in range(0, len(ids), DECODE):
            part, at = ids[k : k + DECODE], offsets[k : k + DECODE + 1]
            out.append(self.flat[np.repeat(self.begin[part] - at[:-1], np.diff(at)) + np.arange(at[0], at[-1])].tobytes())
        return b"".join(out)


@cache
def ranks_at(path: str) -> Ranks:
    return Ranks(path)


def resolve(name: str) -> str:
    """Path of a vocabulary file on the machine that runs this: a path as it is, a bare name from the installed package."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_tokens(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """The slices of each text, in order, by groups of texts that are scanned together, up to CHUNK characters."""
    i = 0
    while i < len(texts):
        group, size = [], 0
        while i < len(texts) and (not group or size + len(texts[i] or "") <= CHUNK):
            group.append(texts[i] or "")
            size += len(group[-1])
            i += 1
        joined = "".join(group)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(x) for x in group])
        begin = np.cumsum(lengths) - lengths
        starts = token_starts(codes, begin[lengths > 0])
        at_byte = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800).astype(np.int8) + (codes >= 0x10000), out=at_byte[1:])
        raw = joined.encode("utf-8")
        cuts = at_byte[starts].tolist() + [len(raw)]
        bounds = np.searchsorted(starts, np.append(begin, len(codes))).tolist()
        yield [[raw[x:y] for x, y in zip(cuts[a:b], cuts[a + 1 : b + 1])] for a, b in zip(bounds, bounds[1:])]


def encode_texts(texts: list[str | None], vocabulary: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and byte offsets (one more than ids) of each text."""
    r = ranks_at(vocabulary)
    for group in pre_tokens(texts):
        for ids in r.encoded(group):
            yield ids, r.offsets(ids)


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int>, offsets array<long> (byte offsets of tokens and the end) per row of df."""

    def run(batches):
        path = resolve(vocabulary)
        for b in batches:
            for k in range(0, b.num_rows, 512):  # ids of a few hundred texts at a time
                part = b.slice(k, 512)
                found = list(encode_texts(part.column(1).to_pylist(), path))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.int64()))], ["id", "ids", "offsets"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"id {kind}, ids array<int>, offsets array<bigint>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and decoded binary; null ids decode to nothing."""

    def run(batches):
        r = ranks_at(resolve(vocabulary))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], ["id", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, ids_col), run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def round_trip_digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, then decodes each text where it is, and returns id_col, n_tokens, ids_sha256 and decoded_sha256: ids and offsets
    never leave the worker, so nothing but digests is moved."""

    def run(batches):
        r = ranks_at(resolve(vocabulary))
        for b in batches:
            n, by_ids, by_bytes = [], [], []
            for k in range(0, b.num_rows, 512):
                for group in pre_tokens(b.column(1).slice(k, 512).to_pylist()):
                    for ids in r.encoded(group):
                        n.append(len(ids))
                        by_ids.append(hashlib.sha256(",".join(map(r.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                        by_bytes.append(hashlib.sha256(r.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_bytes, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
