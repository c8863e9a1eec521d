"""Problems 2, 6 and 7 share this: byte-pair encoding by an automaton compiled from the merge list, without a tokenizer.

The automaton reads tokens; its state is the last token read. It starts with one state and an arc for each byte. The
gadget of each merge (u, v) -> w, in the order of the merges, adds a state w that is entered wherever u was and left
wherever v is, and takes the arc v away behind u and behind all later tokens that end in this u. What is left after all
gadgets is, for any bytes, exactly one path: their encoding. The labels of its arcs are the ids, and `decode` emits them.

Number the states so that a token's right half comes before it and all tokens grown from that half follow, the youngest
first, and the arcs likewise by their left halves. Then a gadget takes away the arcs of one run of numbers behind the
states of one run of numbers, and the whole table is a few runs of missing arcs per state. It is compiled once a worker
and not changed after. A word is read by steps of the table, the longest arc first: every prefix of it has
one last token, the state behind it, so that each prefix is entered at most once, whatever other arcs lead there.

Words are cut further where no token of the vocabulary holds both neighbours: no merge reaches across such a place.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import compress
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bunko.session import spread, table

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that splits text into words before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Distinct words a worker keeps.
KEPT_WORDS = 400_000
# Characters of texts whose words are read together; bytes of a word, and number of words, beyond or below which each is read alone.
READ_CHARS, LONG_WORD, FEW_WORDS = 500_000, 200, 24


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Kept(dict):
    """Values of f, kept."""

    def __init__(self, f: Callable[[str], bool]):
        super().__init__()
        self.f = f

    def __missing__(self, key: str) -> bool:
        found = self[key] = self.f(key)
        return found


class MergeAutomaton(dict):
    """A mapping of words to their ids as int32 bytes, filled on demand."""

    def __init__(self, path: str):
        super().__init__()
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        letter = _byte_letters()
        raw = lambda t: bytes([letter[c] for c in t])
        vocab = {t: i for t, i in model["vocab"].items() if all(c in letter for c in t)}
        self.label = {raw(t): i for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for k, merge in enumerate(model["merges"]):
            u, v = merge.split(" ") if isinstance(merge, str) else merge
            a, b = vocab[u], vocab[v]
            self.rank[a, b] = k
            self.halves.setdefault(vocab[u + v], (a, b, k))
        for t, i in list(self.label.items()):
            if len(t) > 1 and i not in self.halves:
                del self.label[t]
        self.bytes_of = {i: t for t, i in self.label.items()}
        self.size = {i: len(t) for i, t in self.bytes_of.items()}
        self.reach: dict[bytes, int] = {}
        self.inside: set[tuple[bytes, bytes]] = set()
        for t in self.label:
            head = t[:3]
            self.reach[head] = max(self.reach.get(head, 0), len(t))
            for i in range(1, len(t)):
                if t[i] & 0xC0 != 0x80:
                    start = i - 1
                    while start > 0 and t[start] & 0xC0 == 0x80:
                        start -= 1
                    end = i + 1
                    while end < len(t) and t[end] & 0xC0 == 0x80:
                        end += 1
                    self.inside.add((t[start:i], t[i:end]))
        self.compile()
        self._spell()
        self.cut = Kept(lambda two: self._apart(two[0], two[1]))
        self.parts: dict[str, bytes] = {}
        self.words = regex.compile(PATTERN).findall

    @staticmethod
    def _numbers(half: dict[int, tuple[int, int]], states: list[int]) -> tuple[dict[int, int], dict[int, tuple[list[int], list[int]]]]:
        """Numbers of the tokens, each followed by those grown from it (half: token -> its half, rank), youngest first;
        per token the ranks (falling, so negated) of those grown from it and where each one's run ends."""
        grown: dict[int, list[int]] = {}
        for token in sorted(half, key=lambda t: -half[t][1]):
            grown.setdefault(half[token][0], []).append(token)
        at: dict[int, int] = {}
        end: dict[int, int] = {}
        stack = [(t, False) for t in reversed(states) if t not in half]
        while stack:
            token, left = stack.pop()
            if left:
                end[token] = len(at)
                continue
            at[token] = len(at)
            stack.append((token, True))
            stack += [(c, False) for c in reversed(grown.get(token, []))]
        return at, {t: ([-half[c][1] for c in of], [end[c] for c in of]) for t, of in grown.items()}

    def compile(self) -> None:
        """Apply the gadgets: `starts` and `stops` are the runs of missing arcs, the arc's number plus the state's times a row's width."""
        states = sorted(self.label.values())
        state, behind = self._numbers({t: (b, k) for t, (_, b, k) in self.halves.items()}, states)
        self.arcs, ahead = self._numbers({t: (a, k) for t, (a, _, k) in self.halves.items()}, states)
        width = len(states) + 1
        self.row = {t: n * width for t, n in state.items()}
        none: tuple[list[int], list[int]] = ([], [])
        rows, first, last = [], [], []
        for (u, v), k in self.rank.items():
            ranks, ends = behind.get(u, none)
            n = bisect_left(ranks, -k)
            top, below = state[u], ends[n - 1] if n else state[u] + 1
            ranks, ends = ahead.get(v, none)
            n = bisect_right(ranks, -k)
            rows.append((top, below))
            first.append(self.arcs[v])
            last.append(ends[n - 1] if n else self.arcs[v] + 1)
        top, below = np.array(rows, dtype=np.int64).reshape(-1, 2).T
        n = below - top
        row = np.repeat(top - np.cumsum(n) + n, n) + np.arange(n.sum())
        start, stop = row * width + np.repeat(first, n), row * width + np.repeat(last, n)
        order = np.argsort(start, kind="stable")
        start, stop = start[order], np.maximum.accumulate(stop[order])
        new = np.concatenate([[True], start[1:] > stop[:-1]])[: len(start)]
        # keys of runs that touch are one run
        self.starts = array("q", start[new].tobytes())
        self.stops = array("q", stop[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(stop) - 1]])].tobytes() if len(stop) else b"")

    def arc(self, last: int, token: int) -> bool:
        """Is there an arc `token` behind `last`?"""
        key = self.row[last] + self.arcs[token]
        i = bisect_right(self.starts, key) - 1
        return i < 0 or key >= self.stops[i]

    def path(self, word: bytes) -> list[int]:
        """Steps of the table, from the state reached last, by the longest arc that fits; a prefix has one last token, so that
        one that was reached is not entered again."""
        label, reach, starts, stops, arcs, row = self.label, self.reach, self.starts, self.stops, self.arcs, self.row
        if word in label:
            return [label[word]]
        n = len(word)
        last = [-1] * (n + 1)
        left: list[tuple[int, int]] = []
        at, keys, end = 0, 0, min(reach.get(word[:3], 2), n)
        while at < n:
            while end > at:
                if last[end] < 0:
                    token = label.get(word[at:end])
                    if token is not None:
                        i = bisect_right(starts, keys + arcs[token]) if at else 0
                        if i == 0 or keys + arcs[token] >= stops[i - 1]:
                            last[end] = token
                            left.append((at, end - 1))
                            break
                end -= 1
            else:
                at, end = left.pop()
                keys = row[last[at]] if at else 0
                continue
            at, keys = end, row[token]
            end = min(at + reach.get(word[at : at + 3], 2), n)
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= self.size[last[at]]
        ids.reverse()
        return ids

    def _spell(self) -> None:
        """The tokens' spellings as a tree of bytes (edges are the parent's number times 256 plus the byte), and arrays by id."""
        nodes: dict[bytes, int] = {b"": 0}
        edges: list[int] = []
        for t in self.label:
            for i in range(1, len(t) + 1):
                if t[:i] not in nodes:
                    nodes[t[:i]] = len(nodes)
                    edges.append(nodes[t[: i - 1]] << 8 | t[i - 1])
        order = np.argsort(np.array(edges, dtype=np.int64))
        self.edges, self.below = np.array(edges, dtype=np.int64)[order], (order + 1).astype(np.int32)
        self.spelled = np.full(len(nodes), -1, dtype=np.int32)
        n = max(self.bytes_of, default=-1) + 1
        self.sizes, self.shorter = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int32)
        self.rows_of, self.arcs_of = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for t, i in self.label.items():
            self.spelled[nodes[t]] = i
            self.sizes[i], self.rows_of[i], self.arcs_of[i] = len(t), self.row[i], self.arcs[i]
            self.shorter[i] = next((self.label[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.label), -1)

    def paths(self, parts: list[bytes]) -> list[bytes]:
        """`path` of many words at once, as int32 bytes: each step of the table is taken for all words together; the last few,
        which take longest, and long ones take their steps alone."""
        alone = lambda part: np.array(self.path(part), dtype=np.int32).tobytes()
        ids: list[bytes | None] = [None if 0 < len(part) <= LONG_WORD else alone(part) for part in parts]
        which = [k for k, found in enumerate(ids) if found is None]
        if len(which) < FEW_WORDS:
            return [alone(part) if found is None else found for part, found in zip(parts, ids)]
        text = np.frombuffer(b"".join([parts[k] for k in which]), dtype=np.uint8)
        size = np.array([len(parts[k]) for k in which], dtype=np.int64)
        stop = np.cumsum(size)
        start = stop - size
        # the longest token at each place; one byte further for all places that are still within the tree
        longest, place, node, end = np.full(len(text) + 1, -1, dtype=np.int32), np.arange(len(text)), np.zeros(len(text), dtype=np.int64), np.repeat(stop, size)
        depth = 0
        while len(place):
            edge = node << 8 | text[place + depth]
            at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            within = np.flatnonzero(self.edges[at] == edge)
            place, node, end = place[within], self.below[at[within]].astype(np.int64), end[within]
            token = self.spelled[node]
            longest[place[token >= 0]] = token[token >= 0]
            depth += 1
            more = np.flatnonzero(place + depth < end)
            place, node, end = place[more], node[more], end[more]
        starts, stops = np.frombuffer(self.starts, dtype=np.int64), np.frombuffer(self.stops, dtype=np.int64)
        # the token that ends before each place of a word, once that prefix is reached; words lie one place apart
        first = start + np.arange(len(size))
        last, shift = np.full(len(text) + len(size), -1, dtype=np.int32), np.arange(len(size))
        word, at, token = np.arange(len(size)), first.copy(), longest[start]
        while len(word) >= FEW_WORDS:
            # nothing fits: back to the prefix before, and on with the next shorter token there
            back = np.flatnonzero(token < 0)
            if len(back):
                if (at[back] == first[word[back]]).any():
                    break
                taken = last[at[back]]
                at[back] -= self.sizes[taken]
                token[back] = self.shorter[taken]
            tried = np.flatnonzero(token >= 0)
            own, here, t = word[tried], at[tried], token[tried]
            to = here + self.sizes[t]
            key = self.rows_of[last[here]] + self.arcs_of[t]
            run = np.searchsorted(starts, key, side="right") - 1
            there = (run < 0) | (key >= stops[run]) if len(stops) else np.ones(len(key), dtype=bool)
            fits = (last[to] < 0) & (there | (here == first[own]))
            token[tried[~fits]] = self.shorter[t[~fits]]
            yes, to, own = tried[fits], to[fits], own[fits]
            last[to] = t[fits]
            at[yes] = to
            token[yes] = longest[to - shift[own]]
            ended = at == first[word] + size[word]
            if ended.any():
                word, at, token = word[~ended], at[~ended], token[~ended]
        ready = np.ones(len(size), dtype=bool)
        ready[word] = False
        # back from the ends of the words along their tokens
        on, back, from_ = np.zeros(len(last), dtype=bool), (first + size)[ready], first[ready]
        while len(back):
            on[back] = True
            back = back - self.sizes[last[back]]
            more = back > from_
            back, from_ = back[more], from_[more]
        found, ends = last[on].tobytes(), (np.cumsum(on)[first + size] * 4).tolist()
        for k, done, a, b in zip(which, ready.tolist(), [0, *ends], ends):
            ids[k] = found[a:b] if done else alone(parts[k])
        return ids

    def _cuts(self, word: str) -> list[str]:
        """The word cut where no token holds both neighbours."""
        at = [0, *compress(range(1, len(word)), map(self.cut.__getitem__, map(add, word, word[1:]))), len(word)]
        return [word[i:j] for i, j in zip(at, at[1:])]

    def learn(self, words: set[str]) -> None:
        """Read all words at once that were not read yet."""
        plain: list[str] = []
        mixed: list[str] = []
        for word in words.difference(self):
            (plain if word.isascii() else mixed).append(word)
        cuts = list(map(self._cuts, mixed))
        new = list(set().union(*cuts).difference(self.parts))
        found = self.paths([*map(str.encode, plain), *(p.encode("utf-8", "surrogatepass") for p in new)])
        self.update(zip(plain, found))
        self.parts.update(zip(new, found[len(plain) :]))
        self.update(zip(mixed, (b"".join(map(self.parts.__getitem__, cut)) for cut in cuts)))

    def _apart(self, a: str, b: str) -> bool:
        """No token holds an end of a and a beginning of b."""
        x, y = a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass")
        return not any((x[i:], y[:j]) in self.inside for i in range(len(x)) for j in range(1, len(y) + 1))

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = self.parts[part] = np.array(self.path(part.encode("utf-8", "surrogatepass")), dtype=np.int32).tobytes()
        return found

    def __missing__(self, word: str) -> bytes:
        found = np.array(self.path(word.encode()), dtype=np.int32).tobytes() if word.isascii() else b"".join(map(self._part, self._cuts(word)))
        self[word] = found
        return found

    def trim(self) -> None:
        """Keep memory bounded: between blocks of texts, drop what was kept if it has grown too large."""
        for kept in (self, self.parts, self.cut):
            if len(kept) > KEPT_WORDS:
                kept.clear()

    def encode(self, text: str | None) -> bytes:
        """Ids as int32 bytes; none for null and for the empty text."""
        return b"".join(map(self.__getitem__, self.words(text))) if text else b""

    def in_words(self, texts: list[str | None]) -> Iterator[list[str]]:
        """The words of each text, read in blocks of texts, so that `self` has them all."""
        at = 0
        while at < len(texts):
            words, chars, read = [], 0, at
            while read < len(texts) and chars < READ_CHARS:
                words.append(self.words(texts[read]) if texts[read] else [])
                chars += len(texts[read] or "")
                read += 1
            self.trim()
            self.learn(set().union(*words))
            yield from words
            at = read

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def automaton(path: str) -> MergeAutomaton:
    return MergeAutomaton(path)


def vocabulary(tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> str:
    return f"{tokenizers}/{name}.json"


def encoded(batches: Iterator[pa.RecordBatch], path: str, text: int) -> Iterator[pa.RecordBatch]:
    """Replace the text column by its ids; batches are cut so that a block's ids stay small."""
    a = automaton(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            ids = [b"".join(map(a.__getitem__, words)) for words in a.in_words(part.column(text).to_pylist())]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns[:text], column], names=[*part.schema.names[:text], "ids"])


def counted(batches: Iterator[pa.RecordBatch], path: str, text: int) -> Iterator[pa.RecordBatch]:
    """Replace the text column by the number of its tokens."""
    a = automaton(path)
    for batch in batches:
        n = pa.array([sum(map(len, map(a.__getitem__, words))) // 4 for words in a.in_words(batch.column(text).to_pylist())], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:text], n], names=[*batch.schema.names[:text], "n_tokens"])


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): ids by the vocabulary, no special tokens; marker strings in a text are ordinary text.

    Null and empty texts have the empty list. Every row comes out, repeated rows too; other columns are ignored.
    """
    path = path or vocabulary()
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(lambda it: encoded(it, path, 1), "doc_id bigint, ids array<int>")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def decode_documents(encoded_docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text): the text of the ids, the arcs' labels one after the other; null and empty lists give the empty text. Bytes that are no text come out as U+FFFD."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for batch in batches:
            texts = [a.decode([i for i in ids or () if i is not None]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded_docs.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id bigint, text string")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_documents(p6_ids(spark, sf_dir))


QUERIES = {"p6_ids": p6_ids, "p6_decoded": p6_decoded}
ORACLES = {"p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
