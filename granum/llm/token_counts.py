"""Token counts from a finite-state transducer compiled from a BPE tokenizer.

The greedy merges of BPE are turned into a deterministic left-to-right machine. It rests on two facts: the tokens of
a text up to a token's end are the tokens of that prefix, and two neighbours t, u are right if and only if BPE of
their joined symbols gives t, u back. So the last token of every prefix is settled when the prefix is read, and a
state need only hold what the future can ask for: the starts from which a vocabulary entry may still grow, each with
its last token and its count relative to now. Each transition carries the change in the number of tokens. States are
made when first reached and kept.

White space is a synchronizing symbol: it leads from any state to the first one. A chunk of text is therefore a map
from states to (state, count) which three things fix: what it runs on with from the state at entry (its piece before
the first white space), the count in between, and what leads from the first state to the one at exit (its piece after
the last white space). Such maps compose associatively. Every text is cut into chunks, whose maps are reduced pairwise
in a tree; as only the whole text's map is asked for, no other prefixes are made.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granum.llm.common import ship

FINAL = 256
MOST_STATES = 300_000
MOST_SEGMENTS = 400_000
MOST_FITS = 1_000_000
CHUNK = 1 << 16


def byte_chars() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Grammar(NamedTuple):
    """What the transducer needs of a tokenizer: ranked merges of symbol strings, special strings, the word pattern."""

    merges: list[tuple[tuple[int, ...], tuple[int, ...]]]
    special: list[str]
    pattern: str


def grammar(path: str) -> Grammar:
    """Read a tokenizer file of word-end BPE: NFC, white space to blanks, lower case, one removing split pattern."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, chars = spec["model"], byte_chars()
    end = model["end_of_word_suffix"]
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
    if model["type"] != "BPE" or not end or kinds != ["NFC", "Replace", "Lowercase"] or len(splits) != 1:
        raise ValueError(f"{path}: not a word-end BPE of the form this compiler knows")

    def symbols(piece: str) -> tuple[int, ...]:
        body = piece.removesuffix(end)
        out = [chars[c] for c in body]
        if body != piece:
            out[-1] += FINAL
        return tuple(out)

    return Grammar([(symbols(a), symbols(b)) for a, b in model["merges"]], [t["content"] for t in spec["added_tokens"]], splits[0]["pattern"]["Regex"])


class Transducer:
    """The compiled machine. `count(word bytes)` runs it; states and transitions are made on demand."""

    def __init__(self, g: Grammar):
        self.rank = {pair: i for i, pair in enumerate(g.merges)}
        tokens = {(b,) for b in range(2 * FINAL)} | {a + b for a, b in g.merges}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[tuple[int, ...] | None] = [None]
        for t in tokens:
            node = 0
            for s in t:
                if s not in self.trie[node]:
                    self.trie[node][s] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(None)
                node = self.trie[node][s]
            self.token_at[node] = t
        self.fits: dict[tuple, bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, None, 0),)
        self.ids, self.contexts, self.next = {start: 0}, [start], [{}]

    def bpe(self, symbols: tuple[int, ...]) -> list[tuple[int, ...]]:
        """Plain merging, lowest rank first; used to compile, not to count."""
        parts = [(s,) for s in symbols]
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: self.rank.get(p, 1 << 30))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def fit(self, last: tuple[int, ...] | None, token: tuple[int, ...]) -> bool:
        key = (last, token)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) >= MOST_FITS:
                self.fits.clear()
            known = self.fits[key] = self.bpe((last or ()) + token) == ([last, token] if last else [token])
        return known

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        grown, token, count = [], None, 0
        for node, last, rel in self.contexts[state]:
            child = self.trie[node].get(symbol)
            if child is None:
                continue
            grown.append((child, last, rel))
            t = self.token_at[child]
            if token is None and t is not None and self.fit(last, t):
                token, count = t, rel + 1
        if token is None:
            raise ValueError(f"no token ends at symbol {symbol}")
        if symbol >= FINAL:
            out = (0, count)
        else:
            context = tuple((c, last, rel - count) for c, last, rel in grown if self.trie[c]) + ((0, token, 0),)
            to = self.ids.get(context)
            if to is None:
                to = self.ids[context] = len(self.contexts)
                self.contexts.append(context)
                self.next.append({})
            out = (to, count)
        self.next[state][symbol] = out
        return out

    def count(self, word: bytes) -> int:
        state, total, nexts = 0, 0, self.next
        try:
            for b in word[:-1]:
                state, n = nexts[state][b]
                total += n
            return total + nexts[state][word[-1] + FINAL][1]
        except KeyError:
            return self.count_anew(word)

    def count_anew(self, word: bytes) -> int:
        """As count, making the transitions that are missing."""
        if len(self.contexts) > MOST_STATES:
            self.reset()
        state = total = 0
        for b in (*word[:-1], word[-1] + FINAL):
            state, n = self.next[state].get(b) or self.compile(state, b)
            total += n
        return total


class Chunk(NamedTuple):
    """The state map of a chunk: `head` runs on from the state at entry; `tail` is None where no white space occurs."""

    head: str
    count: int
    tail: str | None


class Counter(dict):
    """Counts by segment, a run without white space; filled by the transducer and emptied when too large."""

    def __init__(self, g: Grammar):
        super().__init__()
        self.machine = Transducer(g)
        self.words = regex.compile(g.pattern)
        self.special = regex.compile("|".join(map(regex.escape, sorted(g.special, key=len, reverse=True)))) if g.special else None
        self.odd_space = regex.compile(r"[\x1c-\x1f]")
        self.runs = regex.compile(r"\P{White_Space}+")

    def __missing__(self, segment: str) -> int:
        if len(self) >= MOST_SEGMENTS:
            self.clear()
        body = segment[:-1] if segment[-1] in ".,;:!?" else segment
        if body.isascii() and body.isalpha():  # most segments: one word, perhaps with a mark behind it
            n = self.machine.count(body.lower().encode()) + (self.machine.count(segment[-1:].encode()) if body is not segment else 0)
            self[segment] = n
            return n
        parts, n = [segment], 0
        if self.special and "<" in segment:
            parts = self.special.split(segment)
            n = len(parts) - 1
        for p in parts:
            p = unicodedata.normalize("NFC", p)
            p = "".join(map(str.lower, p)) if "Σ" in p else p.lower()
            for w in self.words.findall(p):
                n += self.machine.count(w.encode())
        if len(segment) < 64:  # longer ones hardly recur
            self[segment] = n
        return n

    def segments(self, text: str) -> list[str]:
        return self.runs.findall(text) if self.odd_space.search(text) else text.split()

    def chunk(self, text: str) -> Chunk:
        parts = self.segments(text)
        if len(parts) == 1 and len(parts[0]) == len(text) or not parts:
            return Chunk(parts[0], 0, None) if parts else Chunk("", 0, "" if text else None)
        head = parts.pop(0) if text.startswith(parts[0]) else ""
        tail = parts.pop() if parts and text.endswith(parts[-1]) else ""
        return Chunk(head, sum(map(self.__getitem__, parts)), tail)

    def compose(self, a: Chunk, b: Chunk) -> Chunk:
        if a.tail is None:
            return Chunk(a.head + b.head, b.count, b.tail)
        if b.tail is None:
            return Chunk(a.head, a.count, a.tail + b.head)
        middle = a.tail + b.head
        return Chunk(a.head, a.count + b.count + (self[middle] if middle else 0), b.tail)

    def reduce(self, chunks: list[Chunk]) -> Chunk:
        """The map of all chunks in a row: neighbours are composed, then neighbours of these, until one is left."""
        while len(chunks) > 1:
            chunks = [self.compose(*chunks[i : i + 2]) if i + 1 < len(chunks) else chunks[i] for i in range(0, len(chunks), 2)]
        return chunks[0]

    def count(self, text: str, size: int = CHUNK) -> int:
        """The map of the text from the first state to the end of input."""
        whole = self.reduce([self.chunk(text[i : i + size]) for i in range(0, max(len(text), 1), size)])
        return whole.count + sum(self[x] for x in (whole.head, whole.tail) if x)


def token_counts(docs: DataFrame, path: str, most_tokens: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > most_tokens).

    `path` names the tokenizer's file; it is read by the driver and sent to the tasks, whose size it bounds. A null
    or empty text has no bytes and no tokens. Repeated rows give repeated results, a null id stays null, an empty
    table gives an empty result, and columns beside id and text are ignored. No shuffle: each text is read once.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar(path))  # tens of thousands of merges, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or worker_counter(shared)
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([ids, pa.array([counter.count(t) if t else 0 for t in texts], pa.int64()), batch.column(2)], names=[id_col, "n_tokens", "n_bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, f"{id_col} bigint, n_tokens bigint, n_bytes bigint")
    return out.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > most_tokens).alias("over_limit"))


_counters: dict[int, Counter] = {}


def worker_counter(shared) -> Counter:
    """One machine for each tokenizer in a Python worker; it outlives the task."""
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else id(shared)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(shared.value)
    return _counters[key]
