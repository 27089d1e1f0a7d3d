"""SentencePiece encoding by unigram Viterbi over a double-array trie of pieces, and decoding.

Pieces are the model file's own. So are their log scores in a unigram file. A BPE file has merge ranks instead, which
are no log scores but order the pieces by how often they were met when the file was made; a piece of rank r gets the
log probability that Zipf and Mandelbrot's law gives the r-th most frequent. So a text's ids depend on the file alone,
nothing is trained, and the ids are not those of merging, which takes other paths. A blank is written as the
marker U+2581 and a text gets one marker in front, as the file's normalizer asks. A character that no piece covers
becomes its UTF-8 bytes by the byte pieces. Among segmentations the one of highest score sum is taken.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granum.llm.common import ship

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Segments that a worker keeps, of up to BATCHED bytes each; longer ones are computed whenever they occur.
MOST_SEGMENTS = 200_000
BATCHED = 64
#: Texts that a worker has in hand at once.
ROWS = 200
#: The offset in Zipf and Mandelbrot's law, 1 / (rank + offset), as commonly given for words of prose.
OFFSET = 2.7
#: Letters, and numerals other than decimal digits, as a class of Python's re.
LETTER = r"[^\W\d_]"


class Pieces(NamedTuple):
    """A model's pieces by id: text, log score, and kind: normal, byte, control, unknown."""

    text: list[str]
    score: list[float]
    kind: list[str]


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[key & 7] if key & 7 != 2 else varint()
        yield key >> 3, data[at : at + size]
        at += size


def is_unigram(model: bytes) -> bool:
    """Whether the file's trainer_spec (field 2) has model_type (field 3) 1, unigram, which is also the default."""
    return dict(fields(dict(fields(model)).get(2, b""))).get(3, 1) == 1


def pieces(path: str) -> Pieces:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(p.get_piece_size())
    kind = ["unknown" if p.is_unknown(i) else "control" if p.is_control(i) or p.is_unused(i) else "byte" if p.is_byte(i) else "normal" for i in ids]
    score = [p.get_score(i) for i in ids]
    return Pieces([p.id_to_piece(i) for i in ids], score if is_unigram(p.serialized_model_proto()) else log_scores(score, kind), kind)


def log_scores(score: list[float], kind: list[str]) -> list[float]:
    """Log probabilities for the normal pieces of a BPE file, whose scores are minus their merge ranks; 0 for others.

    Pieces that no merge makes, which such files score far below, come last.
    """
    normal = np.array([k == "normal" for k in kind])
    weight = np.where(normal, 1 / (np.clip(-np.array(score), 1, max(normal.sum(), 1)) + OFFSET), 0.0)
    return np.where(normal, np.log(np.where(normal, weight, 1.0) / max(weight.sum(), 1e-300)), 0.0).tolist()


class DoubleArray:
    """A trie over UTF-8 bytes in two arrays: the child of node s by byte c is t = base[s] + c if check[t] == s.

    value[t] is the id of the piece that ends at t, or -1.
    """

    def __init__(self, words: dict[bytes, int]):
        trie: list[dict[int, int]] = [{}]
        ends = {}
        for w, v in words.items():
            node = 0
            for c in w:
                if c not in trie[node]:
                    trie[node][c] = len(trie)
                    trie.append({})
                node = trie[node][c]
            ends[node] = v
        size = 2 * len(trie) + 512
        base, check, value = array("i", [0]) * size, array("i", [-1]) * size, array("i", [-1]) * size
        used = bytearray(size)
        used[0] = 1
        holes, dense, todo = 1, 1, [(0, 0)]
        while todo:
            node, at = todo.pop()
            children = trie[node]
            if not children:
                continue
            if len(children) == 1:  # fills the first hole; the larger families look on behind what is dense
                (c,) = children
                holes = used.index(0, max(holes, c + 1))
                b = holes - c
            else:
                b, tries = dense, 0
                while b + 256 < size and any(used[b + c] for c in children):
                    b += 1
                    tries += 1
                if tries > 32:
                    dense = b
            if b + 600 > size:
                base.extend([0] * size), check.extend([-1] * size), value.extend([-1] * size), used.extend(bytes(size))
                size *= 2
            base[at] = b
            for c, child in children.items():
                used[b + c] = 1
                check[b + c] = at
                value[b + c] = ends.get(child, -1)
                todo.append((child, b + c))
        self.base, self.check, self.value = base.tolist(), check.tolist(), value.tolist()
        self.arrays = tuple(np.array(x, np.int32) for x in (base, check, value))


class Codec(dict):
    """Ids by segment as the bytes of int32; a segment is a run of markers with the text up to the next run.

    No piece crosses from other characters to a marker, so segments are independent; texts whose pieces do would
    be refused when the codec is made. A newline that stands in no piece cuts segments too, and so does a mark
    behind letters if no piece has it there: all of these only save work, as no path could cross them.
    """

    def __init__(self, p: Pieces):
        super().__init__()
        normal = [i for i, k in enumerate(p.kind) if k == "normal" and p.text[i]]
        if any(MARK in p.text[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece holds a marker behind other characters")
        self.trie = DoubleArray({p.text[i].encode(): i for i in normal})
        self.score, self.scores = p.score, np.array(p.score, np.float64)
        self.unknown_score = min(p.score[i] for i in normal) - UNKNOWN_PENALTY
        self.byte_id = {int(p.text[i][3:5], 16): i for i, k in enumerate(p.kind) if k == "byte"}
        self.unknown_id = p.kind.index("unknown")
        pairs = {(a, b) for i in normal for a, b in zip(p.text[i], p.text[i][1:])}
        after_letters = {b for a, b in pairs if re.match(LETTER, a)}
        inside = {c for pair in pairs for c in pair}
        newline = "" if "\n" in inside else "\n"
        stops = re.escape("".join(c for c in ".,;:!?#*%&|$'-()\"" if c not in after_letters))
        body = f"{MARK}*[^{MARK}{newline}]+|{MARK}+" + ("|\n" if newline else "")
        self.cut = re.compile((f"{MARK}*{LETTER}+(?=[{stops}])|" if stops else "") + body)
        self.decoder = Decoder(p)
        self.lengths = np.array([len(t.encode()) for t in p.text], np.int32)
        self.is_byte = np.array([k == "byte" for k in p.kind])

    def segments(self, text: str | None) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def viterbi(self, text: str) -> list[int]:
        """Best path over the UTF-8 bytes of text; every character starts where the one before it ended."""
        data = text.encode()
        base, check, value, score, n = self.trie.base, self.trie.check, self.trie.value, self.score, len(data)
        size = len(base)
        none = float("-inf")
        best, back, piece = array("d", [none]) * (n + 1), array("i", [0]) * (n + 1), array("i", [0]) * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            lead = data[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, node, j, single = best[i], 0, i, False
            while j < n:
                t = base[node] + data[j]
                if t >= size or check[t] != node:
                    break
                node = t
                j += 1
                if (v := value[t]) >= 0:
                    s = here + score[v]
                    if s > best[j]:
                        best[j], back[j], piece[j] = s, i, v
                    single = single or j == i + width
            if not single:
                j, s = i + width, here + self.unknown_score
                if s > best[j]:
                    best[j], back[j], piece[j] = s, i, -1
            i += width
        out, j = [], n
        while j:
            i = back[j]
            if piece[j] >= 0:
                out.append(piece[j])
            else:
                out += [self.byte_id.get(b, self.unknown_id) for b in reversed(data[i:j])]
            j = i
        return out[::-1]

    def viterbi_many(self, segments: list[bytes]) -> list[bytes | None]:
        """The same path for many short segments of about one length at a time, a column of bytes at once.

        None for a segment with a character that no piece covers; viterbi() takes those.
        """
        base, check, value = self.trie.arrays
        m, lens = len(segments), np.array([len(x) for x in segments])
        most = int(lens.max())
        data = np.frombuffer(b"".join(x.ljust(most, b"\0") for x in segments), np.uint8).reshape(m, most)
        best = np.full((m, most + 1), -np.inf)
        piece = np.full((m, most + 1), -1, np.int32)
        best[:, 0] = 0.0
        for i in range(most):
            rows = np.flatnonzero((i < lens) & (best[:, i] > -np.inf))
            node, here = np.zeros(len(rows), np.int32), best[rows, i]
            for j in range(i, most):
                to = base[node] + data[rows, j]
                on = (check[to] == node) & (j < lens[rows])
                rows, node, here = rows[on], to[on], here[on]
                if not rows.size:
                    break
                v = value[node]
                ends = np.flatnonzero(v >= 0)
                at, v = rows[ends], v[ends]
                s = here[ends] + self.scores[v]
                better = s > best[at, j + 1]
                best[at[better], j + 1], piece[at[better], j + 1] = s[better], v[better]
        at, found = lens.copy(), []
        while (rows := np.flatnonzero(at > 0)).size:
            v = piece[rows, at[rows]]
            column = np.full(m, -1, np.int32)
            column[rows] = v
            found.append(column)
            at[rows] = np.where(v >= 0, at[rows] - self.lengths[v], 0)
        ids = np.stack(found[::-1], 1)
        covered = best[np.arange(m), lens] > -np.inf
        return [row[row >= 0].tobytes() if ok else None for row, ok in zip(ids, covered)]

    def learn(self, segments: set[str]) -> dict[str, bytes]:
        """Put the ids of segments that aren't known yet; those of long ones are returned instead."""
        new = sorted((x for x in segments if x not in self), key=len)
        if len(self) + len(new) > MOST_SEGMENTS:
            self.clear()
            new = sorted(segments, key=len)
        long: dict[str, bytes] = {}
        coded = [x.encode() for x in new]
        for a in range(0, len(new), 2048):
            part = coded[a : a + 2048]
            done = self.viterbi_many(part) if max(map(len, part)) <= BATCHED else [None] * len(part)
            for x, data, ids in zip(new[a : a + 2048], part, done):
                (self if len(data) <= BATCHED else long)[x] = array("i", self.viterbi(x)).tobytes() if ids is None else ids
        return long

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids as the bytes of int32."""
        cut = [self.segments(t) for t in texts]
        long = self.learn(set().union(*cut))
        if long:
            return [b"".join([self.get(s) or long[s] for s in x]) for x in cut]
        return [b"".join(map(self.__getitem__, x)) for x in cut]

    def decode(self, ids: list[int]) -> str:
        return self.decoder.decode_many(pa.array([ids], pa.list_(pa.int32())))[0]


class Decoder:
    """Texts of ids; it needs no trie."""

    def __init__(self, p: Pieces):
        plain = [t.replace(MARK, " ").encode() if k == "normal" else bytes([int(t[3:5], 16)]) if k == "byte" else b" \xe2\x81\x87 " if k == "unknown" else b"" for t, k in zip(p.text, p.kind)]
        self.plain_bytes = pa.array(plain, pa.binary())

    def decode_many(self, ids: pa.ListArray) -> list[str]:
        """Per list of ids its text; "" for null."""
        spans = np.asarray(ids.offsets)
        flat = self.plain_bytes.take(ids.values.slice(spans[0], spans[-1] - spans[0]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(spans - spans[0], pa.int32()), flat), b"").to_pylist()
        known = ids.is_valid().to_pylist()
        return [data.removeprefix(b" ").decode("utf-8", "replace") if ok else "" for data, ok in zip(joined, known)]


_codecs: dict[int, Codec] = {}


def worker_codec(shared) -> Codec:
    """One codec for each model in a Python worker; it outlives the task."""
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else id(shared)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value)
    return _codecs[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """Per document: id, ids (array of int), n_byte_pieces (byte pieces among them); under the name `decoded`, if given, what `decode` makes of the ids.

    `path` names the model's file, read by the driver and sent to the tasks. A null or empty text gives an empty
    array. Repeated rows give repeated results, a null id stays null, an empty table gives an empty result, columns
    beside id and text are ignored. A literal U+2581 is read as a blank. Each text is read once, without a shuffle.
    Decoding here spares the Python workers that `decode` would need beside these.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces(path))  # as large as the vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or worker_codec(shared)
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                coded = codec.encode_many(part.column(1).to_pylist())
                ends = np.cumsum([0] + [len(c) // 4 for c in coded])
                flat = np.frombuffer(b"".join(coded), np.int32)
                byte_sums = np.concatenate(([0], np.cumsum(codec.is_byte[flat])))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                columns = {id_col: part.column(0), "ids": ids, "n_byte_pieces": pa.array(byte_sums[ends[1:]] - byte_sums[ends[:-1]], pa.int64())}
                if decoded:
                    columns[decoded] = pa.array(codec.decoder.decode_many(ids), pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"{id_col} bigint, ids array<int>, n_byte_pieces bigint" + (f", {decoded} string" if decoded else ""))


def decode(coded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """`coded` with a column `decoded`: the text of its ids, "" for null or empty ids. Other columns are kept.

    Blanks come back from markers, the marker in front goes, byte pieces are joined to UTF-8 (broken runs give
    U+FFFD), unknown ids give " ⁇ ", control ids nothing.
    """
    ship(coded.sparkSession)
    shared = coded.sparkSession.sparkContext.broadcast(pieces(path))
    at = coded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for batch in batches:
            decoder = decoder or Decoder(shared.value)
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                texts = decoder.decode_many(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    schema = ", ".join(f"`{n}` {t}" for n, t in [*coded.dtypes, ("decoded", "string")])
    return coded.mapInArrow(run, schema)
