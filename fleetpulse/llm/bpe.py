"""BPE encoding and decoding by a tokenization automaton.

The automaton has a state for each token (the token read last) and an arc for
each token that may follow. It starts with free arcs between all base symbols.
The gadget of merge k, (a, b) -> c, takes the arc b out of state a, adds the arc c
wherever the arc a is at that moment, and gives the new state c the arcs that
state b has at that moment. Arcs are not copied: a state refers to the moment it
was made, so the automaton is as large as the merge list, and an arc that has been
resolved once is kept in a transition table. A sequence of tokens is accepted if
and only if BPE would produce it, so the one accepted path that spells a word is
its encoding, its arc labels being the ids.

Words are read from left to right by tables: one leads from the longest beginning of
a token that ends here to the next one, and gives the tokens that end here, longest
first; exactly one of them may follow the path before it. New words of many texts are
read side by side, a symbol of all of them at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm.common import release_memory, table, worker_cache

VOCABULARY = "word_bpe_49k.json"
#: Words remembered by a Python worker. A full table of words becomes the old one, out of
#: which words that come up again are taken over.
WORDS_KEPT = 50_000
#: Places of the table of resolved arcs: a power of two. An arc takes the place of an older one.
ARC_BITS = 20
#: Bytes of words that are read side by side; longer words are read alone.
SIDE_BY_SIDE = 64
#: Characters of texts that are split into words at once.
CHUNK = 1 << 20
#: White space as the tokenizer file's patterns understand it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

# Ranges of letters and digits that are newer than Unicode 16, the version the tokenizer files are read with.
LATE = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed public tokenizer files keep ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    at = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [at[b] for b in range(256)]


class Automaton:
    """Compiled merges: vocabulary, moments at which states were made, resolved arcs, and the tables by which symbols are read.

    ``goto`` leads from one beginning of tokens to the next; ``back`` is the longest
    other beginning that one ends in, ``longest`` the longest token that it ends in,
    and ``shorter`` the next shorter token that a token ends in.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str, symbols: list[str]):
        self.labels = [""] * (max(vocab.values(), default=-1) + 1)
        for label, i in vocab.items():
            self.labels[i] = label
        n = len(self.labels)
        self.made = [-1] * n  # moment of the gadget that made the state; base symbols have been there before
        self.left, self.right = [-1] * n, [-1] * n
        self.cut: dict[int, int] = {}  # moment at which an arc was taken out
        self.arc_keys = np.full(1 << ARC_BITS, -1, np.int64)
        self.arc_found = np.zeros(1 << ARC_BITS, bool)
        unusable: set[int] = set()
        for moment, (a, b) in enumerate(merges):
            if not self._gadget(moment, vocab[a], vocab[b], vocab[a + b]):
                unusable.add(vocab[a + b])
        self._table(vocab, suffix, symbols, unusable)

    def _table(self, vocab: dict[str, int], suffix: str, symbols: list[str], unusable: set[int]) -> None:
        """Transitions by symbol: 0 to 255 within a word, 256 more at its end."""
        number = {c: i for i, c in enumerate(symbols)}
        self.goto: dict[int, int] = {}
        self.size = [0] * len(self.labels)
        token = [-1]  # token that a beginning is
        children: list[list[tuple[int, int]]] = [[]]
        for label, i in vocab.items():
            last = label.endswith(suffix) and label != suffix
            spelled = [number.get(c, -1) for c in (label.removesuffix(suffix) if last else label)]
            if not spelled or min(spelled) < 0 or i in unusable:
                continue
            if last:
                spelled[-1] += 256
            at = 0
            for c in spelled:
                to = self.goto.get(at << 9 | c)
                if to is None:
                    to = self.goto[at << 9 | c] = len(token)
                    children[at].append((c, to))
                    children.append([])
                    token.append(-1)
                at = to
            token[at], self.size[i] = i, len(spelled)
        self.shorter = [-1] * len(self.labels)
        self.longest = [-1] * len(token)
        self.back = [0] * len(token)
        queue = [0]
        for at in queue:
            for c, to in children[at]:
                back = self.back[to] = self.beginning(self.back[at], c) if at else 0
                own = token[to]
                if own >= 0:
                    self.shorter[own] = self.longest[back]
                self.longest[to] = own if own >= 0 else self.longest[back]
                queue.append(to)
        self.back, self.longest, self.shorter, self.size = (np.array(x, np.int64) for x in (self.back, self.longest, self.shorter, self.size))
        self._hash()

    def _hash(self) -> None:
        """``goto`` as an open hash table in two arrays, at most a quarter full."""
        self.bits = max(4, (4 * len(self.goto)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        keys = np.fromiter(self.goto, np.int64, len(self.goto))
        for place, (key, to) in zip(self._place(keys, self.bits).tolist(), self.goto.items()):
            while self.keys[place] >= 0:
                place = (place + 1) % len(self.keys)
            self.keys[place], self.to[place] = key, to

    @staticmethod
    def _place(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    def beginning(self, at: int, symbol: int) -> int:
        """The longest beginning after one more symbol, through shorter ones where it cannot be continued."""
        to = self.goto.get(at << 9 | symbol)
        while to is None and at:
            at = self.back[at]
            to = self.goto.get(at << 9 | symbol)
        return to or 0

    def _gadget(self, moment: int, a: int, b: int, c: int) -> bool:
        """Whether token c can be reached."""
        reachable = self.arc(a, b, moment)
        self.cut.setdefault(a << 20 | b, moment)
        if reachable and self.left[c] < 0:  # or the same string was made by an earlier merge
            self.made[c], self.left[c], self.right[c] = moment, a, b
        return reachable or self.left[c] >= 0

    def arc(self, state: int, token: int, moment: int) -> bool:
        """Whether the arc was there just before ``moment``.

        The younger of the two took its arcs over when it was made: a state from
        its right half, an arc from where its left half led.
        """
        while True:
            if self.cut.get(state << 20 | token, moment) < moment:
                return False
            born_state, born_arc = self.made[state], self.made[token]
            if born_state < 0 and born_arc < 0:
                return True
            if born_state > born_arc:
                moment, state = born_state, self.right[state]
            else:
                # the gadget takes arcs out before it adds the new one
                moment, token = born_arc + 1, self.left[token]

    def beginnings(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """``beginning`` for aligned arrays."""
        out = np.zeros(len(at), np.int64)
        rest = np.arange(len(at))
        while len(rest):
            key = at << 9 | symbol
            place = self._place(key, self.bits)
            probe = np.flatnonzero((self.keys[place] != key) & (self.keys[place] >= 0))
            while len(probe):
                place[probe] = (place[probe] + 1) % len(self.keys)
                held = self.keys[place[probe]]
                probe = probe[(held != key[probe]) & (held >= 0)]
            to = self.to[place]
            found = to >= 0
            out[rest[found]] = to[found]
            left = ~found & (at > 0)
            rest, at, symbol = rest[left], self.back[at[left]], symbol[left]
        return out

    def follow(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether arcs are there after the last merge, for aligned arrays."""
        key = state << 20 | token
        place = self._place(key, ARC_BITS)
        found = self.arc_found[place]
        new = np.flatnonzero(self.arc_keys[place] != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            made = np.array([self.arc(k >> 20, k & 0xFFFFF, 1 << 60) for k in keys.tolist()])
            found[new] = made[back]
            at = self._place(keys, ARC_BITS)
            _, one = np.unique(at, return_index=True)
            self.arc_keys[at[one]], self.arc_found[at[one]] = keys[one], made[one]
        return found

    def read(self, words: list[bytes]) -> list[bytes]:
        """Ids of words as little-endian unsigned 32-bit integers; no word is empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        lengths, n, width = lengths[order], len(words), int(lengths.max(initial=0))
        symbols = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in order.tolist()]), np.uint8)
        symbols = symbols.reshape(n, width).T.astype(np.int64)
        symbols[lengths - 1, np.arange(n)] += 256
        # the last token of the path of each word, at each place
        last = np.full((width + 1, n), -1, np.int32)
        at = np.zeros(n, np.int64)
        for end in range(1, width + 1):
            some = int(np.searchsorted(-lengths, -end, "right"))
            at = self.beginnings(at[:some], symbols[end - 1, :some])
            token, word = self.longest[at], np.arange(some)
            while len(word):
                before = last[end - self.size[token], word].astype(np.int64)
                right = before < 0
                inner = np.flatnonzero(~right)
                right[inner] = self.follow(before[inner], token[inner])
                last[end, word[right]] = token[right]
                word, token = word[~right], self.shorter[token[~right]]
        ids, count, end, word = np.zeros((n, width), "<u4"), np.zeros(n, np.int64), lengths.copy(), np.arange(n)
        while len(word):
            token = last[end[word], word]
            count[word] += 1
            ids[word, width - count[word]] = token
            end[word] -= self.size[token]
            word = word[end[word] > 0]
        data, out = ids.tobytes(), [b""] * n
        for row, (i, k) in enumerate(zip(order.tolist(), count.tolist()), 1):
            out[i] = data[4 * (row * width - k) : 4 * row * width]
        return out

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word."""
        return np.frombuffer(self.read([word])[0], "<u4").tolist() if word else []


class Codec:
    """Text to ids and back, as a word-level BPE tokenizer file describes it."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        model = described["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"], byte_symbols())
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.labels = dict(enumerate(self.automaton.labels)) | {i: s for s, i in self.special.items()}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        short = "'s|'t|'re|'ve|'m|'ll|'d"
        self.split = regex.compile(rf"{short}|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.split_ascii = re.compile(rf"{short}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        late = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in LATE)
        self.beyond = re.compile(f"[{chr(LATE[0][0])}-\U0010ffff]")
        self.late = regex.compile(f"[{late}]")
        self.split_late = regex.compile(
            rf"(?V1){short}|[\p{{L}}--[{late}]]+|[\p{{N}}--[{late}]]|[[^{SPACE}\p{{L}}\p{{N}}]||[{late}]]+"
        )
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def learn(self, words: set[str]) -> None:
        """Read words that are not in the table, and keep them there."""
        if len(self.words) >= WORDS_KEPT:
            self.words, self.old_words = {}, self.words
        new = []
        for word in words:
            found = self.old_words.get(word)
            if found is None:
                new.append(word)
            else:
                self.words[word] = found
        coded = [w.encode("utf-8", "replace") for w in new]
        short = [i for i, c in enumerate(coded) if len(c) <= SIDE_BY_SIDE]
        self.words.update(zip([new[i] for i in short], self.automaton.read([coded[i] for i in short])))

    def split_words(self, text: str) -> list[str]:
        if text.isascii():
            return self.split_ascii.findall(text.lower())
        # lower case is taken letter by letter: no final form of the Greek sigma
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        split = self.split_late if self.beyond.search(text) and self.late.search(text) else self.split
        return split.findall(text.lower())

    def parts(self, text: str | None) -> list[list[str] | bytes]:
        """Words of a text between special tokens, and the ids of these."""
        if not text:
            return []
        if "<|" not in text:
            return [self.split_words(text)]
        found = self.marks.split(text)
        return [self.special[p].to_bytes(4, "little") if i % 2 else self.split_words(p) for i, p in enumerate(found)]

    def ids(self, words: list[str]) -> bytes:
        known = self.words
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            return b"".join([known.get(w) or self.alone(w) for w in words])

    def alone(self, word: str) -> bytes:
        """Ids of a word that is too long to be kept."""
        return self.automaton.read([word.encode("utf-8", "replace")])[0]

    def encode_some(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; strings of special tokens in the text are those tokens.

        Texts are split CHUNK characters at a time, but each as a whole, and their new words are read side by side.
        """
        at = 0
        while at < len(texts):
            start, held = at, 0
            while at < len(texts) and (at == start or held + len(texts[at] or "") <= CHUNK):
                held += len(texts[at] or "")
                at += 1
            split = [self.parts(t) for t in texts[start:at]]
            words = {w for parts in split for p in parts if not isinstance(p, bytes) for w in p}
            missing = words.difference(self.words)
            if len(self.words) >= WORDS_KEPT:
                missing = words
            self.learn(missing)
            for parts in split:
                yield b"".join([p if isinstance(p, bytes) else self.ids(p) for p in parts])

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_some([text]))

    def decode(self, ids: bytes) -> str:
        """The labels of the path, a blank between them."""
        return " ".join(map(self.labels.__getitem__, memoryview(ids).cast("I").tolist()))


def codec(path: str) -> Codec:
    """The compiled codec of a worker; compiled once, kept across tasks."""
    kept = worker_cache("bpe")
    if ("bpe", path) not in kept:
        kept["bpe", path] = Codec(path)
    return kept["bpe", path]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int). A null text is empty and has no ids; other columns pass through."""

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for texts in parts:
            yield pd.Series([np.frombuffer(ids, "<i4") for ids in own.encode_some(list(texts))], dtype=object)
        release_memory()

    return docs.withColumn("ids", ids(F.col(text)))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text that the ids stand for (null ids: empty)."""

    @F.pandas_udf("string")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for rows in parts:
            yield pd.Series([own.decode(np.asarray(r if r is not None else [], "<u4").tobytes()) for r in rows], dtype=object)

    return encoded.withColumn("decoded", texts(F.col(ids)))


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded, in one pass.

    Works for empty tables, repeated rows and null keys; only key and text are read.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for part in parts:
            out = []
            for ids in own.encode_some(list(part["text"])):
                decoded = own.decode(ids).encode("utf-8")
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            made = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            made.insert(0, "key", part["key"].array)
            yield made

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents: a null or empty text has no tokens, a very long one is read whole, repeated rows stay."""
    return digests(table(spark, sf_dir, "documents"), vocabulary_path())
