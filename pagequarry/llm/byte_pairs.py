"""Byte-level BPE: texts to token ids with offsets, and back.

Where words begin is found without a regular expression. Every character gets a class, every class is a transition of a
small automaton, and an associative scan over the compositions of these transitions gives the state before every
character of a whole batch at once; the state and the class say whether a word begins there. Each word is merged by
ranks once and then remembered.

Null and empty texts have no tokens. Texts of any length are encoded whole, equal texts alike. Bytes that are not UTF-8
count as symbols and come back unchanged. Columns of the input that bear the name of an output are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
import zlib
from array import array
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from pagequarry.llm.common import per_row

LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE = range(6)
#: The code points that count as white space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and numbers that Unicode 16 added; Python's table may be older.
LATER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
LATER_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
#: What may follow an apostrophe as a word of its own, by length.
SHORT_ENDINGS, LONG_ENDINGS = ("s", "t", "m", "d"), ("re", "ve", "ll")
#: Bytes of a vocabulary file that is sent to tasks, at most.
MOST_VOCABULARY = 64 << 20
#: Merged words are remembered up to so many words or bytes, then all are forgotten.
REMEMBERED_WORDS, REMEMBERED_BYTES = 1 << 18, 16 << 20
SLICE = 4 << 20

# States after a character: within letters, numbers or symbols, within white space, after a blank that the next word
# takes, one or two letters before the end of a short ending, and after a word that can't go on.
IN_LETTERS, IN_NUMBERS, IN_SYMBOLS, IN_SPACE, JOINING, ONE_LEFT, TWO_LEFT, ENDED = range(8)
STATES = 8
# Symbols that the automaton reads.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_SPACE, S_JOIN, S_ALONE = range(8)


def class_table() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for ranges, kind in ((LATER_LETTERS, LETTER), (LATER_NUMBERS, NUMBER)):
        for first, last in ranges:
            table[first:last + 1] = kind
    table[list(WHITE_SPACE)] = SPACE
    table[0x20], table[0x27] = BLANK, QUOTE
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a word begins with it."""
    if symbol == S_LETTER:
        if state == TWO_LEFT:
            return ONE_LEFT, False
        if state == ONE_LEFT:
            return ENDED, False
        return IN_LETTERS, state not in (IN_LETTERS, JOINING)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, JOINING)
    if symbol in (S_OTHER, S_SHORT, S_LONG):
        if state in (IN_SYMBOLS, JOINING):
            return IN_SYMBOLS, False
        return {S_OTHER: IN_SYMBOLS, S_SHORT: ONE_LEFT, S_LONG: TWO_LEFT}[symbol], True
    if symbol == S_SPACE:
        return IN_SPACE, state != IN_SPACE
    return (JOINING if symbol == S_JOIN else ENDED), True


class Transitions:
    """The functions from state to state that symbols and their sequences make, as numbers with a table of compositions.

    The first numbers are the constant functions: number s always ends in state s.
    """

    def __init__(self) -> None:
        of_symbol = [tuple(_step(s, symbol)[0] for s in range(STATES)) for symbol in range(8)]
        known = {(s,) * STATES: s for s in range(STATES)}
        for f in of_symbol:
            known.setdefault(f, len(known))
        todo = list(known)
        while todo:
            f = todo.pop()
            for g in of_symbol:
                h = tuple(g[x] for x in f)
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
        functions = list(known)
        self.of_symbol = np.array([known[f] for f in of_symbol], np.uint8)
        self.then = np.array([[known[tuple(g[x] for x in f)] for g in functions] for f in functions], np.uint8)
        self.begins = np.array([[_step(s, symbol)[1] for symbol in range(8)] for s in range(STATES)], bool).ravel()
        self.first = np.array([_step(ENDED, symbol)[0] for symbol in range(8)], np.uint8)

    def states(self, symbols: np.ndarray, starts: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """The state after each symbol; ``starts`` are where texts begin, ``plain`` marks letters that no short ending can reach.

        Composition is associative, so spans double each round: number i stands for the last 1, 2, 4, ... symbols up to
        i. Constant functions need no more, and nearly all are constant from the start.
        """
        f = self.of_symbol[symbols]
        f[plain] = IN_LETTERS
        f[starts] = self.first[symbols[starts]]
        open_, span = np.flatnonzero(f >= STATES), 1
        while open_.size:
            f[open_] = self.then[f[open_ - span], f[open_]]
            open_, span = open_[f[open_] >= STATES], span * 2
        return f


def code_points(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and the byte at which each begins with the length at the end."""
    text = joined.decode("utf-8", "surrogateescape")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) == len(joined):
        return points, np.arange(len(joined) + 1)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    width[(points >= 0xD800) & (points < 0xE000)] = 1  # a byte that is no UTF-8
    return points, np.concatenate([[0], np.cumsum(width)])


def symbols_of(points: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the automaton reads for each code point, and which letters no short ending can reach."""
    n = len(points)
    kind = classes[points]
    white = (kind == BLANK) | (kind == SPACE)
    ends = np.append(starts[1:], n) - 1
    before_word = np.zeros(n, bool)
    before_word[:-1] = ~white[1:]
    before_word[ends] = False
    symbols = np.array([S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_SPACE, S_OTHER], np.uint8)[kind]
    last_white = np.flatnonzero(white & before_word)
    symbols[last_white] = np.where(kind[last_white] == BLANK, S_JOIN, S_ALONE)
    plain = kind == LETTER
    quotes = np.flatnonzero(kind == QUOTE)
    if quotes.size:
        end_of = ends[np.searchsorted(starts, quotes, "right") - 1]
        one = np.where(quotes + 1 <= end_of, points[np.minimum(quotes + 1, n - 1)], 0)
        two = np.where(quotes + 2 <= end_of, points[np.minimum(quotes + 2, n - 1)], 0)
        short = np.isin(one, [ord(x) for x in SHORT_ENDINGS])
        long = np.zeros(len(quotes), bool)
        for a, b in LONG_ENDINGS:
            long |= (one == ord(a)) & (two == ord(b))
        symbols[quotes[short]], symbols[quotes[long]] = S_SHORT, S_LONG
        plain[quotes[short | long] + 1] = False
        plain[quotes[long] + 2] = False
    return symbols, plain


class Lists:
    """Byte strings or numbers in one array, fetched for many numbers at once."""

    def __init__(self, items: list[bytes]) -> None:
        self.length = np.array([len(x) for x in items], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(items), np.uint8)

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the given items in order, and where each item's begin (and end)."""
        return gathered(self.flat, self.start[numbers], self.length[numbers])


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` with these starts and lengths one after another, and where each begins there (and the end)."""
    edges = np.concatenate([[0], np.cumsum(length)])
    return flat[np.repeat(start - edges[:-1], length) + np.arange(edges[-1])], edges


class Codec:
    """Encodes and decodes by the ranks of a vocabulary file (lines of base64 token and rank)."""

    def __init__(self, vocabulary: bytes, packed_classes: bytes) -> None:
        lines = [line.split() for line in vocabulary.splitlines() if line]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens, self.decimals = Lists(tokens), Lists([b"%d," % rank for rank in range(len(tokens))])
        self.classes = np.frombuffer(zlib.decompress(packed_classes), np.uint8)
        self.transitions = Transitions()
        self._forget()

    def _forget(self) -> None:
        """Words seen, by number; the ids of word number i are ``ids[start[i]:start[i] + count[i]]``."""
        self.known: dict[bytes, int] = {}
        self.known_bytes = 0
        self.ids, self.start, self.count = array("q"), array("q"), array("q")

    def boundaries(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All texts in one, the byte at which each word begins, and the number of the first word of each text (and of the end)."""
        joined = b"".join(texts)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not joined:
            return joined, np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        points, byte = code_points(joined)
        starts = np.unique(np.searchsorted(byte, at[:-1][np.diff(at) > 0]))
        symbols, plain = symbols_of(points, starts, self.classes)
        before = np.empty(len(points), np.uint8)
        before[1:] = self.transitions.states(symbols, starts, plain)[:-1]
        before[starts] = ENDED
        words = byte[np.flatnonzero(self.transitions.begins[before * 8 + symbols])]
        return joined, words, np.searchsorted(words, at)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of all texts, the byte of its text at which each token begins, and where each text's tokens begin (and end)."""
        if len(self.known) > REMEMBERED_WORDS or self.known_bytes > REMEMBERED_BYTES:
            self._forget()
        joined, words, first = self.boundaries(texts)
        edges = words.tolist()
        known, number = self.known.get, self._number
        found = [
            n if (n := known(w := joined[a:b])) is not None else number(w)
            for a, b in zip(edges, chain(edges[1:], [len(joined)]), strict=bool(edges))
        ]
        numbers = np.array(found, np.int64)
        start, count = np.array(self.start, np.int64), np.array(self.count, np.int64)
        ids, begin = gathered(np.array(self.ids, np.int64), start[numbers], count[numbers])
        places = begin[first]
        lengths = self.tokens.length[ids]
        offsets = np.cumsum(lengths) - lengths
        return ids, offsets - np.repeat(np.append(offsets, 0)[places[:-1]], np.diff(places)), places

    def decode(self, ids: np.ndarray) -> bytes:
        return self.tokens.joined(np.asarray(ids, np.int64))[0].tobytes()

    def decode_span(self, ids: np.ndarray, offsets: np.ndarray, first: int, last: int) -> bytes:
        """Bytes first to last (exclusive) of a text, from the tokens alone that reach into them."""
        a, b = max(0, int(np.searchsorted(offsets, first, "right")) - 1), int(np.searchsorted(offsets, last))
        return self.decode(ids[a:b])[first - offsets[a]:last - offsets[a]] if b > a else b""

    def _number(self, word: bytes) -> int:
        ids = (self.ranks[word],) if word in self.ranks else [self.ranks[p] for p in merge(word, self.ranks)]
        self.start.append(len(self.ids))
        self.count.append(len(ids))
        self.ids.extend(ids)
        self.known[word] = len(self.known)
        self.known_bytes += len(word)
        return len(self.known) - 1


def merge(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts of a word after all merges: again and again the pair of lowest rank, the leftmost of equals.

    A heap of pairs and links between parts: a word of n bytes takes n log n steps.
    """
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a byte
    heap: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        if a >= 0 and end[a] < n:
            rank = ranks.get(word[a:end[end[a]]])
            if rank is not None:
                heapq.heappush(heap, (rank, a, end[end[a]]))

    for i in range(n - 1):
        offer(i)
    gone = bytearray(n)
    while heap:
        _, a, to = heapq.heappop(heap)
        if gone[a] or end[a] >= n or gone[end[a]] or end[end[a]] != to:
            continue  # one of the two has been merged since
        gone[end[a]] = 1
        end[a] = to
        if to < n:
            before[to] = a
        offer(a)
        offer(before[a])
    return [word[a:end[a]] for a in range(n) if not gone[a]]


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        found = file.read(MOST_VOCABULARY + 1)
    if len(found) > MOST_VOCABULARY:
        raise ValueError(f"{path} has over {MOST_VOCABULARY} bytes; no vocabulary of that size is sent to tasks")
    return found


def _shipped(path: str) -> tuple[bytes, bytes]:
    """What tasks need; the driver alone reads the file."""
    return _read(path), zlib.compress(class_table().tobytes())


def encoded(docs: DataFrame, vocabulary: str, body: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``ids`` (array of token ids) and ``offsets`` (the byte at which each token begins)."""
    parts = _shipped(vocabulary)
    codec: list[Codec] = []

    def compute(columns: list[list]) -> list[list]:
        codec or codec.append(Codec(*parts))
        ids, offsets, places = codec[0].encode([t or b"" for t in columns[0]])
        spans = list(zip(places[:-1].tolist(), places[1:].tolist(), strict=True))
        return [[ids[a:b] for a, b in spans], [offsets[a:b] for a, b in spans]]

    return per_row(docs, [body], "ids array<bigint>, offsets array<bigint>", compute, SLICE)


def decoded(tokens: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """All columns of ``tokens`` with ``decoded`` (the bytes that the ids stand for; null ids: none)."""
    parts = _shipped(vocabulary)
    codec: list[Codec] = []

    def compute(columns: list[list]) -> list[list]:
        codec or codec.append(Codec(*parts))
        return [[codec[0].decode(x or []) for x in columns[0]]]

    return per_row(tokens, [ids], "decoded binary", compute, SLICE)


def tokens_query(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to, for every row."""
    parts = _shipped(vocabulary)
    codec: list[Codec] = []

    def compute(columns: list[list]) -> list[list]:
        codec or codec.append(Codec(*parts))
        ids, _, places = codec[0].encode([t or b"" for t in columns[0]])
        listed, after = codec[0].decimals.joined(ids)
        back, end = codec[0].tokens.joined(ids)
        return [
            np.diff(places).tolist(),
            _digests(listed, after[places[:-1]], np.maximum(after[places[1:]] - 1, after[places[:-1]])),  # without the last comma
            _digests(back, end[places[:-1]], end[places[1:]]),
        ]

    plain = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    return per_row(plain, ["text"], "n_tokens bigint, ids_sha256 string, decoded_sha256 string", compute, SLICE).drop("text")


def _digests(flat: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[str]:
    return [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(first.tolist(), last.tolist(), strict=True)]


def public_vocabulary(spark: SparkSession, name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """The place of a public vocabulary file: the folder in ``pagequarry.vocabularies``, else the installed files."""
    folder = spark.conf.get("pagequarry.vocabularies", None)
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
