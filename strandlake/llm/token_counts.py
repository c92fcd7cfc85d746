"""Token counts by a finite-state tokenizer (operator 10).

The piece vocabulary is compiled into a deterministic transducer over characters. What a state stands for is all that
decides the future of a greedy pair-merging tokenizer: for each position from which a piece may still be growing, the node of the
piece trie that the characters since then lead to, the piece that the tokenisation up to there ends with, and its token count
against that of the text so far; and the last piece. Reading a character moves every node; just one of the pieces that end
there is compatible with the piece before it (two pieces are compatible if the merging of their joined text gives just these two).
A transition is annotated with the tokens it emits, the difference of the two counts. States are numbered and transitions kept in
their tables as texts ask for them, as in a lazily built automaton: written out beforehand, the machine has over half a
million states for 20 MB of text. Once there are `MOST_STATES`, what leads to further ones is stepped through and not kept.

No piece spans two characters that never stand side by side inside a piece, so such places lead back to the start state. What a
segment between them emits is kept in a bounded cache. Every text is cut into chunks. A chunk acts on states as (what precedes its
first reset, tokens between, what follows its last reset); these chunk maps compose associatively, and a tree of compositions
gives the count of a text.

Characters that no piece holds count one token for each UTF-8 byte. Texts that are null or empty have no tokens; very long
texts are more chunks. Repeated rows give equal results; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandlake.llm.byte_bpe import resolve
from strandlake.llm.common import Recent, map_arrow

MARK = "▁"
CHUNK = 1 << 20  # characters
MOST_STATES = 50_000  # that are kept


class Transducer:
    """Counting transducer of a piece vocabulary. scores: of every piece that merging may make."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.trie: dict = {}  # characters lead to nodes; "" leads to the piece that ends here
        for p in scores:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.pairs = Recent(self.compatible)
        self.segments = Recent(self.walk)
        self.begin_tables()
        pairs = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        chars = sorted({c for p in pairs for c in p})
        self.number = np.zeros(0x110000, np.int16)  # class of a character; 0: it never merges
        for i, c in enumerate(chars):
            self.number[ord(c)] = i + 1
        self.joins = np.zeros((len(chars) + 1,) * 2, bool)
        for a, b in pairs:
            self.joins[self.number[ord(a)], self.number[ord(b)]] = True
        code = np.arange(0x110000)
        self.alone = (1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)).astype(np.uint8)  # tokens of a character by itself
        self.alone[[ord(p) for p in scores if len(p) == 1]] = 1

    def compatible(self, pair: tuple[str, str]) -> bool:
        return self.merge(pair[0] + pair[1]) == [*pair]

    def merge(self, text: str) -> list[str]:
        """Plain merging of a short text: the highest score first, then the leftmost."""
        get, none = self.scores.get, float("-inf")
        parts = list(text)
        pairs = [get(text[i : i + 2], none) for i in range(len(text) - 1)]
        while pairs and (best := max(pairs)) > none:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts

    def number_of(self, growing: tuple, last: str | None) -> int:
        """The number of a state, which is given one if it is new. growing: (node, piece before, tokens against those so far)."""
        key = (tuple((id(n), p, k) for n, p, k in growing), last)
        q = self.numbers.get(key)
        if q is None:
            q = self.numbers[key] = len(self.moves)
            self.meaning.append((growing, last))
            self.moves.append({})
        return q

    def begin_tables(self) -> None:
        self.numbers, self.meaning, self.moves = {}, [], []
        self.number_of((), None)  # the start state is 0

    def step(self, growing: tuple, before: str | None, c: str) -> tuple[tuple, str, int]:
        """What reading a character makes of (growing, last piece), and the tokens it emits."""
        still, last, emitted = [], None, 0
        for node, piece, k in (*growing, (self.trie, before, 0)):
            if (node := node.get(c)) is not None:
                if last is None and (ends := node.get("")) is not None and (piece is None or self.pairs[piece, ends]):
                    last, emitted = ends, k + 1
                still.append((node, piece, k))
        if last is None:  # a character that is no piece: it is spelt in bytes
            last, emitted = c, int(self.alone[ord(c)])
        return tuple([(n, p, k - emitted) for n, p, k in still]), last, emitted

    def compile(self, state: int, c: str) -> tuple[int, int]:
        """The transition of a state by a character: (next state, tokens emitted); kept in the state's table."""
        growing, last, emitted = self.step(*self.meaning[state], c)
        move = self.moves[state][c] = self.number_of(growing, last), emitted
        return move

    def unkept(self, state: int, rest: str) -> int:
        """Tokens for the rest of a segment, by steps that are not kept."""
        (growing, last), total = self.meaning[state], 0
        for c in rest:
            growing, last, emitted = self.step(growing, last, c)
            total += emitted
        return total

    def walk(self, segment: str) -> int:
        """Tokens that the machine emits for a segment, from the start state."""
        if len(segment) == 1:
            return int(self.alone[ord(segment)])
        state, total = 0, 0
        for i, c in enumerate(segment):
            move = self.moves[state].get(c)
            if move is None:
                if len(self.moves) >= MOST_STATES:
                    return total + self.unkept(state, segment[i:])
                move = self.compile(state, c)
            state, total = move[0], total + move[1]
        return total

    def segment_counts(self, text: str, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where segments begin, and the tokens of each. text: texts laid end to end; firsts: where they begin."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        k = self.number[codes]
        begins = np.ones(len(codes), bool)
        begins[1:] = ~self.joins[k[:-1], k[1:]]
        begins[firsts] = True
        begin = np.flatnonzero(begins)
        count = self.alone[codes[begin]].astype(np.int64)
        end = np.append(begin[1:], len(codes))
        more = end > begin + 1
        parts = [text[a:b] for a, b in zip(begin[more].tolist(), end[more].tolist())]
        count[more] = np.fromiter(map(self.segments.__getitem__, parts), np.int64, len(parts))
        return begin, count

    def count(self, segment: str) -> int:
        """Tokens of one segment."""
        return self.segments[segment] if segment else 0

    def joined(self, a: str, b: str) -> bool:
        """Whether a piece may span the end of a and the beginning of b."""
        return bool(self.joins[self.number[ord(a[-1])], self.number[ord(b[0])]])

    def compose(self, x: tuple[bool, str, int, str], y: tuple[bool, str, int, str]) -> tuple[bool, str, int, str]:
        """First x, then y; associative."""
        left, right = x[3] if x[0] else x[1], y[1]
        if not right and not y[0]:
            return x
        if not left and not x[0]:
            return y
        if left and right and not self.joined(left, right):  # a reset between them
            n = (x[2] + self.count(left) if x[0] else 0) + (self.count(right) + y[2] if y[0] else 0)
            return True, x[1] if x[0] else left, n, y[3] if y[0] else right
        middle = left + right
        if x[0] and y[0]:
            return True, x[1], x[2] + self.count(middle) + y[2], y[3]
        if x[0]:
            return True, x[1], x[2], middle
        if y[0]:
            return True, middle, y[2], y[3]
        return False, middle, 0, ""

    def maps(self, chunks: list[str]) -> list[tuple[bool, str, int, str]]:
        """How each chunk acts: (has a reset, text before the first reset, tokens between, text after the last). The chunks are laid
        end to end and scanned together."""
        text, lengths = "".join(chunks), np.array([len(x) for x in chunks])
        firsts = np.cumsum(lengths) - lengths
        if not text:
            return [(False, "", 0, "")] * len(chunks)
        begin, count = self.segment_counts(text, firsts[lengths > 0])
        total, cuts = np.concatenate([[0], np.cumsum(count)]), np.append(begin, len(text)).tolist()
        out = []
        for lo, hi in zip(np.searchsorted(begin, firsts).tolist(), np.searchsorted(begin, firsts + lengths).tolist()):
            if hi - lo < 2:
                out.append((False, text[cuts[lo] : cuts[hi]], 0, ""))
            else:
                out.append((True, text[cuts[lo] : cuts[lo + 1]], int(total[hi - 1] - total[lo + 1]), text[cuts[hi - 1] : cuts[hi]]))
        return out

    def tokens(self, texts: list[str]) -> list[int]:
        """Tokens of texts that have been marked already."""
        chunks, owner = [], []
        for i, x in enumerate(texts):
            for k in range(0, len(x), CHUNK):
                chunks.append(x[k : k + CHUNK])
                owner.append(i)
        by_text: list[list] = [[] for _ in texts]
        at = 0
        while at < len(chunks):
            end, size = at, 0
            while end < len(chunks) and (end == at or size + len(chunks[end]) <= CHUNK):
                size += len(chunks[end])
                end += 1
            for i, m in zip(owner[at:end], self.maps(chunks[at:end])):
                by_text[i].append(m)
            at = end
        out = []
        for maps in by_text:
            while len(maps) > 1:  # a tree of compositions
                maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
            cut, head, n, tail = maps[0] if maps else (False, "", 0, "")
            out.append(self.count(head) + n + (self.count(tail) if cut else 0))
        return out


def from_sentencepiece(path: str) -> Transducer:
    """Transducer of a sentencepiece BPE model with the identity normaliser and byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
    return Transducer({sp.id_to_piece(i): sp.get_score(i) for i in range(sp.vocab_size()) if not special(i)})


@cache
def transducer_at(path: str) -> Transducer:
    return from_sentencepiece(path)


def count_texts(t: Transducer, texts: list[str | None]) -> list[int]:
    """Tokens of raw texts: a mark goes before each, and blanks are marks."""
    return t.tokens([MARK + x.replace(" ", MARK) if x else "" for x in texts])


def token_counts(df: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens and over_limit per row of df."""

    def run(batches):
        t = transducer_at(resolve(model))
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                texts = part.column(1).to_pylist()
                n = count_texts(t, texts)
                size = [len(x.encode("utf-8")) if x else 0 for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
