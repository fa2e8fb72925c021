"""BPE encoding and decoding through a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens. It starts with one state
in which every base symbol loops. The gadget of a merge ``a b -> c`` splits the state that ``a`` leads
to: the copy loses the transition ``b`` and all that later grow out of it, and ``c`` leads where ``b``
led. So every token leads to one state, a state differs from the one it was split from by one transition,
and a sequence of tokens is the encoding of its text exactly when the automaton has a path for it.

The transition table is sparse. States are numbered so that those split from one another, directly or
not, stand together; then the states that have lost a token are runs of numbers, at most one for each
merge, and everywhere else the default holds: the transition is there. The table is these runs, in arrays
sorted by token and state, compiled once on the driver and broadcast. A token that has grown out of others
is there if none of those was lost before it grew, so a look-up takes a step for each merge on its left edge.

Words come from the tokenizer's own pre-splitting. The distinct words of a slice run through the automaton
together, symbol by symbol: a trie of the reversed tokens gives the arcs that can end at a symbol, and the
one arc is taken for which the state at its beginning has a transition. Decoding emits the arcs' labels.

Nulls and empty texts have no tokens and decode to an empty text. Rows are independent: repeated rows,
ties and further columns don't matter, a very long text is a slice of its own, and an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, slices, small_batches

NEVER = 1 << 60
#: Bytes of text, and of distinct words, that are worked on at a time; entries of a worker's table of words.
SLICE, WORD_BYTES, WORDS = 1 << 19, 1 << 19, 100_000


class Automaton:
    """The deterministic automaton of a merge list; see the module's text. ``vocab`` maps tokens, in byte characters, to ids."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        size = max(vocab.values(), default=0) + 1
        #: By token: the state it leads to, its left half and the merge that made it.
        self.state = np.zeros(size, np.int64)
        self.head = np.full(size, -1, np.int64)
        self.made = np.full(size, -1, np.int64)
        tail = np.full(size, -1, np.int64)
        # By state: the transition it lost, and the state it was split from. A merge makes the state of its number and one.
        lost, before = [-1], [-1]
        for rank, (x, y) in enumerate(merges):
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            reached = self.state[b]
            lost.append(b)
            before.append(int(self.state[a]))
            self.state[a] = len(lost) - 1
            if self.made[c] < 0:
                self.state[c], self.head[c], tail[c], self.made[c] = reached, a, b, rank
        self._number(lost, before)
        base = np.zeros(size, bool)
        for t, i in vocab.items():
            base[i] = len(t.removesuffix(suffix) if suffix else t) == 1
        self._reach(base, tail)
        self._trie(vocab, suffix)

    def _number(self, lost: list[int], before: list[int]) -> None:
        """Numbers states depth first and keeps, by token, the runs of states that have lost it."""
        n = len(lost)
        below = [1] * n
        for s in range(n - 1, 0, -1):
            below[before[s]] += below[s]
        at, free = [0] * n, [1] * n
        for s in range(1, n):
            parent = before[s]
            at[s] = free[parent]
            free[parent] += below[s]
            free[s] = at[s] + 1
        self.state = np.array(at)[self.state]
        # A run inside another adds nothing: the outer state was split earlier.
        runs, end = [], (-1, -1)
        for token, first, s in sorted((lost[s], at[s], s) for s in range(1, n)):
            if token != end[0] or first > end[1]:
                end = (token, first + below[s] - 1)
                runs.append((token << 32 | first, end[1], s - 1))
        runs = np.array(runs, np.int64).reshape(-1, 3)
        self.runs, self.ends, self.when = (np.ascontiguousarray(runs[:, k]) for k in range(3))

    def lacks(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The merge with which the states lost the tokens, or NEVER."""
        if not len(self.runs):
            return np.full(len(state), NEVER)
        k = np.searchsorted(self.runs, token << 32 | state, "right") - 1
        there = (k >= 0) & (self.runs[k] >> 32 == token) & (state <= self.ends[k])
        return np.where(there, self.when[k], NEVER)

    def allowed(self, last: np.ndarray, token: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
        """Whether the states after ``last`` have transitions ``token``: none of the tokens they grew out of was lost before they grew; ``by``: at that merge."""
        out = np.ones(len(token), bool)
        active = np.arange(len(token))
        state, at = self.state[last], token
        until = np.full(len(token), NEVER)
        limit = until if by is None else by
        while len(active):
            gone = self.lacks(state, at)
            bad = (gone <= until) & (gone < limit)  # equal in a merge of a token with itself: the left pair merges
            out[active[bad]] = False
            until, at = self.made[at], self.head[at]
            go = ~bad & (at >= 0)
            active, state, at, until, limit = active[go], state[go], at[go], until[go], limit[go]
        return out

    def _reach(self, base: np.ndarray, tail: np.ndarray) -> None:
        """Which tokens the merges ever make: those whose halves are made and could follow each other when their merge came."""
        grown = np.flatnonzero(self.made >= 0)
        grown = grown[np.argsort(self.made[grown])]
        able = self.allowed(self.head[grown], tail[grown], self.made[grown])
        self.reached = base & (self.made < 0)
        for token, ok, a, b in zip(grown.tolist(), able.tolist(), self.head[grown].tolist(), tail[grown].tolist(), strict=True):
            self.reached[token] = ok and self.reached[a] and self.reached[b]

    def _trie(self, vocab: dict[str, int], suffix: str) -> None:
        """A trie of the reversed tokens that are reached; by node the token that ends inside a word and the one that ends it."""
        step: dict[int, int] = {}
        inside, final = [-1], [-1]
        for text, token in vocab.items():
            if not self.reached[token]:
                continue
            last = bool(suffix) and text.endswith(suffix)
            node = 0
            for c in reversed(text.removesuffix(suffix) if last else text):
                key = node << 8 | CHAR_BYTE[c]
                node = step.get(key, 0)
                if not node:
                    node = step[key] = len(inside)
                    inside.append(-1)
                    final.append(-1)
            if not last:
                inside[node] = token
            if last or not suffix:
                final[node] = token
        keys = np.array(sorted(step), np.int64)
        self.steps, self.to = keys, np.array([step[k] for k in keys.tolist()], np.int64)
        self.inside, self.final = np.array(inside, np.int64), np.array(final, np.int64)

    def arcs(self, data: np.ndarray, first: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, length, token) of all arcs that can end at a symbol. ``first`` is where each symbol's word begins, ``final`` tells its last symbol."""
        at, node, out, size = np.arange(len(data)), np.zeros(len(data), np.int64), [], 0
        while len(at):
            size += 1
            key = node << 8 | data[at - size + 1]
            k = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            ok = self.steps[k] == key
            at, node = at[ok], self.to[k[ok]]
            token = np.where(final[at], self.final[node], self.inside[node])
            hit = token >= 0
            out.append((at[hit], np.full(int(hit.sum()), size), token[hit]))
            more = at - size >= first[at]
            at, node = at[more], node[more]
        return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))

    def run(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' tokens one after the other, and their number by word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        first = np.repeat(ends - sizes, sizes)
        final = np.zeros(len(data), bool)
        final[ends[sizes > 0] - 1] = True
        symbol, length, token = self.arcs(data, first, final)
        depth = symbol - first[symbol]
        order = np.lexsort((length, depth))
        symbol, length, token = symbol[order], length[order], token[order]
        bounds = np.searchsorted(depth[order], np.arange(int(sizes.max(initial=0)) + 1))
        last, back = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64)
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            s, n, t = symbol[low:high], length[low:high], token[low:high]
            begin = s - n  # the symbol before the arc
            ok = begin < first[s]
            inner = np.flatnonzero(~ok)
            before = last[begin[inner]]
            able = before >= 0
            inner, before = inner[able], before[able]
            ok[inner] = self.allowed(before, t[inner])
            last[s[ok]], back[s[ok]] = t[ok], n[ok]
        taken = np.zeros(len(data), bool)
        at = (ends - 1)[sizes > 0]
        while len(at):
            at = at[last[at] >= 0]
            taken[at] = True
            start = first[at]
            at = at - back[at]
            at = at[at >= start]
        where = np.flatnonzero(taken)
        return last[where], np.bincount(np.searchsorted(ends, where, "right"), minlength=len(words))

    def path(self, symbols: str) -> list[int]:
        """The token sequence of a word in byte characters."""
        return self.run([bytes(map(CHAR_BYTE.__getitem__, symbols))])[0].tolist() if symbols else []


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


BYTE_CHAR = byte_chars()
CHAR_BYTE = {c: b for b, c in enumerate(BYTE_CHAR)}


class Tokenizer:
    """What a tokenizer file of the word-end BPE kind says: NFC, blanks, lower case, pre-splitting, byte symbols, merges, special tokens."""

    def __init__(self, spec: str) -> None:
        d = json.loads(spec)
        model, splits = d["model"], d["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in d["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"] or d["decoder"] is not None or splits[0]["behavior"] != "Removed" or not splits[0]["invert"]:
            raise ValueError("the tokenizer file is of another kind")
        merges = [tuple(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
        self.special = {x["content"]: x["id"] for x in d["added_tokens"]}
        self.pattern = splits[0]["pattern"]["Regex"]
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.automaton = Automaton(vocab, merges, model["end_of_word_suffix"] or "")
        self.label = [""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            self.label[i] = t
        self._ready()

    def _ready(self) -> None:
        import unicodedata

        self.nfc = unicodedata.normalize
        self.find = regex.compile(self.pattern, regex.V0).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: By word, or special token: ids as bytes, and the decoded text.
        self.words: dict[str, tuple[bytes, str]] = {}
        self.rest()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("nfc", "find", "cut", "words")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def rest(self) -> None:
        """Between tasks only the automaton is kept."""
        self.words.clear()

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            text = self.nfc("NFC", text).replace("Σ", "σ")  # the final form of sigma is not chosen by context
        return self.find(text.lower())

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens stand for themselves, behind a zero character, which no word has with others."""
        if self.cut is None or "<|" not in text and not self.cut.search(text):
            return self._split(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += ["\0" + part] if part in self.special else self._split(part)
        return out

    def learn(self, words: set[str]) -> None:
        """Runs words through the automaton, and keeps what comes out."""
        todo = []
        for w in words:
            token = self.special.get(w[1:]) if w[:1] == "\0" else None
            if token is None:
                todo.append(w)
            else:
                self.words[w] = (np.array([token], "<u4").tobytes(), w[1:])
        raw = [w.encode() for w in todo]
        size = np.cumsum([0, *map(len, raw)])
        at = 0
        while at < len(raw):
            end = max(at + 1, int(np.searchsorted(size, size[at] + WORD_BYTES)))
            tokens, counts = self.automaton.run(raw[at:end])
            labels = list(map(self.label.__getitem__, tokens.tolist()))
            data = tokens.astype("<u4").tobytes()
            place = 0
            for w, n in zip(todo[at:end], counts.tolist(), strict=True):
                self.words[w] = (data[4 * place : 4 * (place + n)], labels[place] if n == 1 else " ".join(labels[place : place + n]))
                place += n
            at = end

    def encode_all(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """The ids of each text as little-endian unsigned 32-bit integers, and the decoded text."""
        if len(self.words) > WORDS:
            self.words.clear()
        parts = [self.split(t) for t in texts]
        self.learn(set().union(*parts).difference(self.words))
        for words in parts:
            found = list(map(self.words.__getitem__, words))
            yield b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[1]])

    def encode(self, text: str) -> tuple[bytes, str]:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.label.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and those of ``ids`` and ``decoded`` that ``keep`` names.

    The compiled automaton has a fixed size and goes to the executors as a broadcast value. Nothing is shuffled.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        compiled = docs.sparkSession.sparkContext.broadcast(Tokenizer(f.read()))
    schema = T.StructType([docs.schema[id_col], *(T.StructField(*x) for x in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())))])
    if "ids" in keep:
        schema = schema.add("ids", T.ArrayType(T.IntegerType(), False))
    if "decoded" in keep:
        schema = schema.add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = compiled.value
        for batch in slices(batches, "text", SLICE):
            n, a, b, ids, texts = [], [], [], [], []
            for raw, text in tok.encode_all([x or "" for x in batch.column("text").to_pylist()]):
                n.append(len(raw) // 4)
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(text.encode()).hexdigest())
                if "ids" in keep:
                    ids.append(np.frombuffer(raw, "<i4"))
                if "decoded" in keep:
                    texts.append(text)
            out = [batch.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if "ids" in keep:
                out.append(pa.array(ids, pa.list_(pa.int32())))
            if "decoded" in keep:
                out.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)
        tok.rest()
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)
