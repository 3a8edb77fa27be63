"""Token counts of a byte-level BPE tokenizer, by finite-state transduction.

The tokenizer is compiled into a deterministic transducer over bytes. After a prefix of
a pre-token, a state knows the longest suffix that begins some vocabulary entry (a node of the
vocabulary's Aho-Corasick automaton) and, for each place where an entry could still begin,
the last token of the encoding up to there and its number of tokens relative to now. That
is all that the encoding of any continuation depends on: the last token of the longer
prefix is the one entry that ends there and may follow the last token before it, and two tokens may follow
each other if the merges turn their joint bytes into just these two. A transition carries
the change in the number of emitted tokens; over a pre-token these add up to its exact token count.
Tokens that the same entries may follow stand in for each other, which keeps the
states few. Transitions are compiled when first needed and kept in one table.

Text runs through the tables in chunks that lie side by side as numpy lanes. The first
pass gives each chunk's state map: where it holds the start of a pre-token, which resets the state, its map is
constant; elsewhere it depends on the state before it. A scan composes the maps from left to right, and
the bytes before each chunk's first reset are run from the state that it finds.

Pre-tokens are those of the usual byte-level pattern (contractions, letters, numbers,
other signs, each with one leading space, and white space), found by local rules on
character classes.

Defined results: null and empty texts have 0 tokens; special tokens' strings are ordinary
text; rows, repeated or without doc_id, are counted one by one; a text of any length is cut into chunks and counted whole; nothing is
ranked, so there are no ties; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import unicodedata
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from termforge.llm.common import identified, slices, table

#: The vocabulary: a line for each token, its bytes in base 64 and its rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Compiled states at which a worker drops its tables and starts anew, and bytes in a chunk.
MOST_STATES, CHUNK = 150_000, 512
#: Entries beyond a node up to which last tokens are told apart only by those they allow.
FEW = 200
_UNKNOWN, _START = 0, 1
_LETTER, _NUMBER, _SPACE = 1, 2, 3


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Transducer:
    """The compiled tokenizer. ``cells[state << 8 | byte]`` is ``next state << 8 | emitted + 128``, or -1."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        self.ranks, self.most_states = ranks, most_states
        self.words = {rank: token for token, rank in ranks.items()}
        self.goto: list[dict[int, int]] = [{}]
        self.depth, self.token = [0], [-1]
        for word, rank in ranks.items():
            at = 0
            for byte in word:
                if byte not in self.goto[at]:
                    self.goto[at][byte] = len(self.goto)
                    self.goto.append({})
                    self.depth.append(self.depth[at] + 1)
                    self.token.append(-1)
                at = self.goto[at][byte]
            self.token[at] = rank
        self.fail, self.ends = [0] * len(self.goto), [0] * len(self.goto)
        queue = deque(self.goto[0].values())
        while queue:
            at = queue.popleft()
            for byte, child in self.goto[at].items():
                back = self.fail[at]
                while back and byte not in self.goto[back]:
                    back = self.fail[back]
                self.fail[child] = self.goto[back].get(byte, 0)
                queue.append(child)
            back = self.fail[at]
            self.ends[at] = back if self.token[back] >= 0 else self.ends[back]
        self.below: dict[int, tuple[int, ...]] = {}
        for at in sorted(range(1, len(self.goto)), key=lambda n: -self.depth[n]):
            found: list[int] = []
            for child in self.goto[at].values():
                found += (self.token[child],) * (self.token[child] >= 0) + self.below.get(child, (-1,) * (FEW + 1))
            if len(found) <= FEW:
                self.below[at] = tuple(found)
        self.alike: dict[tuple[int, int], int | None] = {}
        self.same: dict[tuple[int, tuple[bool, ...]], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all compiled states."""
        self.names: dict[tuple, int] = {}
        self.states: list[tuple] = [(), ()]
        self.cells = np.full(1024 << 8, -1, dtype=np.int32)
        self.cells[:256] = _UNKNOWN << 8 | 128
        self.states[_START] = (0, ((0, -1, 0),))
        self.names[self.states[_START]] = _START

    def merge(self, data: bytes, below: int = 1 << 60) -> list[bytes]:
        """The encoding of ``data`` by merges of least rank, leftmost first, of ranks under ``below``."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.ranks.get(parts[k] + parts[k + 1], 1 << 60))
            if self.ranks.get(parts[best] + parts[best + 1], below) >= below:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens that ``token`` was last merged from; itself twice if it is one byte."""
        found = self.parts.get(token)
        if found is None:
            word = self.words[token]
            parts = self.merge(word, token) if len(word) > 1 else [word, word]
            found = self.parts[token] = (self.ranks[parts[0]], self.ranks[parts[-1]])
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the merges turn the joint bytes of both tokens into just these two.

        Undoes their merges from the latest on; at no time may the two tokens that
        touch have a merge of their own that would have come first.
        """
        if left < 0:
            return True
        limit = 1 << 60
        while True:
            if self.ranks.get(self.words[left] + self.words[right], limit) < limit:
                return False
            if left > right and len(self.words[left]) > 1 or len(self.words[right]) == 1:
                if len(self.words[left]) == 1:
                    return True
                limit, left = left, self.halves(left)[1]
            else:
                limit, right = right + 1, self.halves(right)[0]

    def stand_in(self, node: int, last: int) -> int | None:
        """A token that the entries beyond ``node`` may follow just when they may follow ``last``; None if none may."""
        if node not in self.below:
            return last
        if (node, last) not in self.alike:
            if len(self.alike) > 4_000_000:
                self.alike.clear()
            may = tuple(self.may_follow(last, t) for t in self.below[node])
            self.alike[node, last] = self.same.setdefault((node, may), last) if any(may) else None
        return self.alike[node, last]

    def compile(self, state: int, byte: int) -> None:
        """Fill one cell of the tables, adding the state it leads to if that is new."""
        node, before = self.states[state]
        while node and byte not in self.goto[node]:
            node = self.fail[node]
        node = self.goto[node].get(byte, 0)
        held = {k: (last, n) for k, last, n in before}
        at = node if self.token[node] >= 0 else self.ends[node]
        while True:
            if not at:
                raise ValueError(f"byte {byte} is missing in the vocabulary")
            last, n = held.get(self.depth[at] - 1, (None, 0))
            if last is not None and self.may_follow(last, self.token[at]):
                break
            at = self.ends[at]
        token, emitted = self.token[at], n + 1
        chain, back = [], node
        while back:
            last, n = held.get(self.depth[back] - 1, (None, 0))
            last = None if last is None else self.stand_in(back, last)
            if last is not None:
                chain.append((self.depth[back], last, n - emitted))
            back = self.fail[back]
        name = (node, (*chain, (0, token, 0)))
        to = self.names.get(name)
        if to is None:
            to = self.names[name] = len(self.states)
            self.states.append(name)
            if to << 8 >= len(self.cells):
                self.cells = np.concatenate([self.cells, np.full_like(self.cells, -1)])
        self.cells[state << 8 | byte] = to << 8 | emitted + 128

    def advance(self, cell: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Where all lanes go from their last cells (state and emission) with the next bytes."""
        at = cell & ~255 | byte
        to = self.cells.take(at)
        if to.min(initial=0) < 0:
            for c in np.unique(at[to < 0]).tolist():
                self.compile(c >> 8, c & 255)
            to = self.cells.take(at)
        return to

    def emissions(self, data: np.ndarray, resets: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Tokens emitted at each byte of ``data``; a pre-token starts where ``resets``."""
        if len(self.states) > self.most_states:
            self.reset()
        lanes = -(-len(data) // chunk)
        text = np.zeros((lanes, chunk), dtype=np.uint8)
        text.ravel()[: len(data)] = data
        anew = np.zeros((lanes, chunk), dtype=bool)
        anew.ravel()[: len(data)] = resets
        anew.ravel()[len(data) :] = True
        text, anew = np.ascontiguousarray(text.T), np.ascontiguousarray(anew.T)
        out = np.zeros((chunk, lanes), dtype=np.uint8)
        cell = np.full(lanes, _UNKNOWN << 8, dtype=np.int32)
        for t in range(chunk):  # every chunk's map, where it is constant
            np.putmask(cell, anew[t], _START << 8)
            cell = self.advance(cell, text[t])
            out[t] = cell.astype(np.uint8)
        constant = cell >> 8 != _UNKNOWN
        head = np.where(constant, anew.argmax(axis=0), chunk)
        known = np.append(True, constant[:-1])
        before = np.append(_START << 8, cell[:-1]).astype(np.int32)
        todo = np.arange(lanes)
        while len(todo):  # compose: chunks whose map is not constant hand on what they are given
            now = todo[known[todo]]
            todo = todo[~known[todo]]
            s = before[now]
            for t in range(int(head[now].max(initial=0))):
                on = head[now] > t
                s[on] = self.advance(s[on], text[t, now[on]])
                out[t, now[on]] = s[on].astype(np.uint8)
            passed = ~constant[now] & (now + 1 < lanes)
            after = now[passed] + 1
            before[after], known[after] = s[passed], True
        return out.T.ravel()[: len(data)].astype(np.int16) - 128


@cache
def _classes() -> np.ndarray:
    kinds = np.zeros(0x110000, dtype=np.int8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            kinds[c] = _LETTER
        elif kind == "N":
            kinds[c] = _NUMBER
    kinds[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return kinds


def pretoken_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start among the characters ``codes``; ``first`` marks each text's first one."""
    kind = _classes()[codes]
    last = np.append(first[1:], True)
    before = np.where(first, -1, np.append(-1, kind[:-1]))
    blank_before = ~first & (np.append(0, codes[:-1]) == 32)
    after_is_sign = ~last & (np.append(kind[1:], _SPACE) != _SPACE)
    space = kind == _SPACE
    start = np.where(space, (before != _SPACE) | after_is_sign, (before != kind) & ~blank_before)
    start |= first
    marks = np.flatnonzero((codes == 39) & ~blank_before & (before != 0))
    text = np.cumsum(first)
    padded, inside = np.append(codes, [0, 0]), np.append(text, [-1, -1])
    one, two = padded[marks + 1], padded[marks + 2]
    in_one, in_two = inside[marks + 1] == text[marks], inside[marks + 2] == text[marks]
    long = in_two & np.isin(one << 8 | two, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])
    short = in_one & ~long & np.isin(one, [ord(c) for c in "stmd"])
    for found, size in ((marks[short], 2), (marks[long], 3)):
        for k in range(1, size):
            start[found + k] = False
        end = found + size
        start[end[end < len(codes)]] = True
    return start


def count_tokens(texts: list[str | None], machine: Transducer) -> np.ndarray:
    """The number of tokens of each text."""
    out, texts = [], [t or "" for t in texts]
    for part in slices(texts, 4 << 20):
        some = texts[part]
        joined = "".join(some)
        ends = np.cumsum([len(t) for t in some])
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
        if not len(codes):
            out.append(np.zeros(len(some), dtype=np.int64))
            continue
        first = np.zeros(len(codes), dtype=bool)
        begins = np.append(0, ends[:-1])
        first[begins[begins < ends]] = True
        size = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        place = np.append(0, np.cumsum(size))
        data = np.frombuffer(joined.encode("utf-8", "replace"), dtype=np.uint8)
        resets = np.zeros(len(data), dtype=bool)
        resets[place[:-1][pretoken_starts(codes, first)]] = True
        total = np.append(0, np.cumsum(machine.emissions(data, resets), dtype=np.int64))
        out.append(total[place[ends]] - total[place[begins]])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


_MACHINES: dict[int, Transducer] = {}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) for every row of ``docs``."""
    with open(vocabulary, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = hash(held.value)
        if key not in _MACHINES:  # stays for this worker's later tasks
            _MACHINES.clear()
            _MACHINES[key] = Transducer(read_ranks(held.value))
        for pdf in batches:
            texts = pdf["text"].where(pdf["text"].notna(), None).tolist()
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": count_tokens(texts, _MACHINES[key])})

    return identified(docs).mapInPandas(count, "doc_id bigint, tokens bigint")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(table(spark, sf_dir, "documents"))
