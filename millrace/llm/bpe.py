"""Byte-pair encoding by speculation: propose greedily, verify pairs, merge only what fails.

A word is first cut into the longest vocabulary entries from the left. That
proposal is the true encoding exactly if every pair of neighbours is stable, that
is, if no merge across their border would have fired while the two tokens were
being built. The check runs over all distinct pairs of a batch at once in numpy.
Words with an unstable pair, and only those, go through the merges one by one.

The pair check: a token is built by merges of rising rank. Along the border only
the right edge of the left token and the left edge of the right token matter, and
both edges grow at known ranks. Following the two edges in order of rank visits
each pair of pieces that ever stand next to each other; a merge of such a pair
fires if its rank comes before the next growth of either piece (at equal rank the
pair further left goes first).
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm.arrow import arrow_schema

#: Words are remembered per worker up to this number; then a new memory starts, and what
#: is met again is taken over from the last one.
REMEMBERED_WORDS = 500_000

# Fixed values of the tokenizer format: the end-of-word mark, and the shift that
# gives unprintable bytes a letter.
END = "</w>"
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

_SPACE = regex.compile(r"\p{White_Space}+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_NEVER = np.int64(2**62)


def _byte_letters() -> list[str]:
    shifted = itertools.count(0x100)
    return [chr(b) if b in _PRINTABLE else chr(next(shifted)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file, given as its JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError("a BPE vocabulary with word ends is needed")
        vocabulary: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (1 + max([*vocabulary.values(), *self.added.values()]))
        for name, token in [*vocabulary.items(), *self.added.items()]:
            self.names[token] = name
        self._numbers = list(map(str, range(len(self.names))))
        cut = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pieces = regex.compile(cut.replace(r"\s", r"\p{White_Space}"), regex.V1)
        self._added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self._letters = _byte_letters()
        self._plain = all(self._letters[b] == chr(b) for b in range(0x21, 0x7F))
        self._build(vocabulary, model["merges"])
        # Ids of a word as bytes: idle workers keep them, and tuples of numbers take a multiple.
        self._code = "H" if len(self.names) <= 1 << 16 else "I"
        self._known: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}

    def _build(self, vocabulary: dict[str, int], merges: list[list[str]]) -> None:
        size = len(self.names)
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self._rank = np.full(size, -1, np.int64)  # of the merge that makes a token
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in merges]
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        first = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        second = np.array([vocabulary[b] for _, b in pairs], np.int64)
        left[made], right[made], self._rank[made] = first, second, np.arange(len(pairs))
        keys = (first << 32) | second
        self._key_rank = np.argsort(keys)
        self._keys, self._key_made = keys[self._key_rank], made[self._key_rank]
        # Edges from the outermost byte to the token, one column per step.
        self._right_edge, self._left_edge = self._edges(right), self._edges(left)
        # A token that its own merges would not reach is never proposed.
        made = np.flatnonzero(left >= 0)
        reached = np.ones(size, bool)
        reached[made] = self.stable(left[made], right[made])
        # One character for the end mark, so that a slice of the word is a name.
        self._names = {
            name.removesuffix(END) + "￿" if name.endswith(END) else name: token
            for name, token in vocabulary.items() if reached[token]}
        self._bases = {name: t for name, t in self._names.items() if len(name.rstrip("￿")) == 1}
        self._reach: dict[str, int] = {}  # the longest name that begins with two given characters
        for name in self._names:
            self._reach[name[:2]] = max(self._reach.get(name[:2], 1), len(name))

    def _edges(self, child: np.ndarray) -> np.ndarray:
        steps = [np.arange(len(child))]
        while (inner := np.where(steps[-1] >= 0, child[steps[-1]], -1)).max() >= 0:
            steps.append(inner)
        edges = np.stack(steps, 1)  # from the token inwards, -1 beyond the byte
        depth = (edges >= 0).sum(1)
        at = depth[:, None] - 1 - np.arange(edges.shape[1])[None, :]
        return np.where(at >= 0, np.take_along_axis(edges, np.maximum(at, 0), 1), -1)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens a and b, side by side, stay as they are.

        A merge of the two whole tokens is not looked at: the caller proposes
        longest matches, and it is tested by ``whole``.
        """
        n, last = len(a), self._right_edge.shape[1] - 1
        i, j, ok, live = np.zeros(n, int), np.zeros(n, int), np.ones(n, bool), np.arange(n)
        last_b = self._left_edge.shape[1] - 1
        while len(live):
            x, y = self._right_edge[a[live], i[live]], self._left_edge[b[live], j[live]]
            next_x = np.where(i[live] < last, self._right_edge[a[live], np.minimum(i[live] + 1, last)], -1)
            next_y = np.where(j[live] < last_b, self._left_edge[b[live], np.minimum(j[live] + 1, last_b)], -1)
            grow_x = np.where(next_x >= 0, self._rank[next_x], _NEVER)
            grow_y = np.where(next_y >= 0, self._rank[next_y], _NEVER)
            done = (grow_x == _NEVER) & (grow_y == _NEVER)
            rank = self._pair_rank(x, y)
            fires = ~done & (rank < grow_x) & (rank <= grow_y)
            ok[live[fires]] = False
            first = grow_x <= grow_y
            i[live] += first
            j[live] += ~first
            live = live[~(done | fires)]
        return ok

    def whole(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a merge joins a and b themselves."""
        return self._pair_rank(a, b) < _NEVER

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._find(a, b)[1]

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the merge of a and b stands in the sorted list, and its rank."""
        keys = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return at, np.where(self._keys[at] == keys, self._key_rank[at], _NEVER)

    def _propose(self, word: str) -> list[int]:
        names, reach, end = self._names, self._reach, len(word)
        tokens, at = [], 0
        while at < end:
            stop = min(end, at + reach.get(word[at : at + 2], 1))
            if stop == end - 1:  # the mark never stands alone
                stop -= 1
            while (token := names.get(word[at:stop])) is None:
                stop -= 1
                if stop == end - 1:
                    stop -= 1
            tokens.append(token)
            at = stop
        return tokens

    def _merge(self, words: list[str]) -> list[list[int]]:
        """The merges themselves, one per word and round, all words side by side."""
        bases = [[self._bases[x] for x in (*w[:-2], w[-2:])] for w in words]
        sizes = np.fromiter(map(len, bases), np.int64, len(bases))
        tokens = np.fromiter(itertools.chain.from_iterable(bases), np.int64, int(sizes.sum()))
        word_of, done = np.repeat(np.arange(len(words)), sizes), []
        while len(tokens):
            starts = np.flatnonzero(np.r_[True, word_of[1:] != word_of[:-1]])
            at, rank = self._find(tokens, np.r_[tokens[1:], 0])
            rank[np.r_[starts[1:], len(tokens)] - 1] = _NEVER  # the last token of a word has no right neighbour
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(tokens)])
            lowest = np.repeat(best, sizes)
            ended = lowest == _NEVER
            done.append((word_of[ended], tokens[ended]))
            hit = (rank == lowest) & ~ended
            run = np.flatnonzero(hit[1:] & hit[:-1]) + 1  # x x x: of touching hits every second one waits
            for i in run.tolist():
                if hit[i - 1]:
                    hit[i] = False
            tokens = np.where(hit, self._key_made[at], tokens)
            stay = ~ended & ~np.r_[False, hit[:-1]]
            tokens, word_of = tokens[stay], word_of[stay]
        word_of, tokens = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word_of, kind="stable")
        ends = np.searchsorted(word_of[order], np.arange(len(words)), side="right").tolist()
        flat = tokens[order].tolist()
        return [flat[x:y] for x, y in itertools.pairwise([0, *ends])]

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        """Words as byte letters with the end mark, each encoded."""
        proposals = [self._propose(w) for w in words]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter(itertools.chain.from_iterable(proposals), np.int64, int(sizes.sum()))
        word_of = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(word_of[:-1] == word_of[1:]) if len(flat) else np.zeros(0, int)
        pairs, at = np.unique((flat[inner] << 32) | flat[inner + 1], return_inverse=True)
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        fine = self.stable(a, b) & ~self.whole(a, b)
        failed = np.unique(word_of[inner[~fine[at]]]).tolist()
        if failed:
            for i, tokens in zip(failed, self._merge([words[i] for i in failed]), strict=True):
                proposals[i] = tokens
        return proposals

    def _normalise(self, chunk: str) -> str:
        # Lower case letter by letter: the form of a final sigma is not chosen by place.
        return unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()

    def _cut(self, chunk: str) -> list[str]:
        if chunk.isascii() or not any(unicodedata.category(c) == "Cn" for c in chunk):
            return self._pieces.findall(chunk)
        # Code points not assigned yet are neither letters nor numbers, whatever the pattern library's tables say.
        shadow = "".join("\ue000" if unicodedata.category(c) == "Cn" else c for c in chunk)
        return [chunk[slice(*m.span())] for m in self._pieces.finditer(shadow)]

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks (texts without white space) not seen before."""
        words: dict[str, int] = {}
        of_chunk = []
        for chunk in chunks:
            pieces = self._cut(self._normalise(chunk))
            if self._plain and chunk.isascii() and chunk.isprintable():
                marked = [p + "￿" for p in pieces]
            else:
                marked = ["".join(self._letters[x] for x in p.encode()) + "￿" for p in pieces]
            of_chunk.append([words.setdefault(w, len(words)) for w in marked])
        encoded = self._encode_words(list(words))
        for chunk, at in zip(chunks, of_chunk, strict=True):
            self._known[chunk] = self._packed(itertools.chain.from_iterable([encoded[i] for i in at]))

    def _packed(self, ids: Iterable[int]) -> bytes:
        return array(self._code, ids).tobytes()

    def _split(self, text: str) -> list[str]:
        return [x for x in _SPACE.split(text) if x] if _ODD_SPACE.search(text) else text.split()

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text, added tokens recognised, none put in."""
        chunks, marks = [], {}
        for i, text in enumerate(texts):
            if "<" in text or not self._added_by_angle:
                found = self._added.findall(text)
                if found:
                    parts = [self._split(x) for x in self._added.split(text)]
                    marks[i] = [(m, p) for m, p in zip(found, parts[1:], strict=True)]
                    chunks.append(parts[0])
                    continue
            chunks.append(self._split(text))
        seen: set[str] = set()
        seen.update(*chunks, *(p for m in marks.values() for _, p in m))
        new = seen - self._known.keys()
        if len(self._known) + len(new) > REMEMBERED_WORDS:
            self._before, self._known, new = self._known, {}, seen
        known, before = self._known, self._before
        again = new & before.keys()
        known.update((w, before[w]) for w in again)
        self._learn(sorted(new - again))
        out = [b"".join(map(known.__getitem__, p)) for p in chunks]
        for i, rest in marks.items():
            out[i] = b"".join([out[i], *(x for mark, p in rest for x in (self._packed([self.added[mark]]), *map(known.__getitem__, p)))])
        return [memoryview(ids).cast(self._code).tolist() for ids in out]

    @property
    def _added_by_angle(self) -> bool:
        return all(x.startswith("<") for x in self.added)

    def numbers(self, ids: list[int]) -> str:
        """The ids in decimal, one space between."""
        return " ".join(map(self._numbers.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The names of the tokens, one space between: the file names no other decoder."""
        return " ".join(map(self.names.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec_of(text: str) -> Codec:
    """The codec of a vocabulary, kept with its words while the worker lives."""
    return Codec(text)


#: Texts are encoded in runs of about so many characters: what a run takes, an idle worker keeps.
RUN_CHARS = 1_000_000


def _runs(texts: Iterable[str | None]) -> Iterator[list[str]]:
    run, size = [], 0
    for text in texts:
        run.append(text or "")
        size += len(run[-1])
        if size >= RUN_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def transcode(
    docs: DataFrame, path: str, derive: Callable[[Codec, list[int]], tuple], schema: str,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One pass that encodes each text and hands codec and ids to ``derive``.

    ``derive(codec, ids)`` gives the values of the columns that ``schema`` lists
    after the key. Text null: as the empty text, no ids. Every row gives one row,
    repeated rows too; other columns are not read. No shuffle; memory is bounded by
    the batch, ``REMEMBERED_WORDS`` and the longest text.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(_read(path))
    key_type = docs.schema[key].dataType.simpleString()
    out_schema = arrow_schema(f"{key} {key_type}, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary.value)
        for batch in batches:
            rows = []
            for texts in _runs(x.as_py() for x in batch.column(1)):
                rows += [derive(codec, ids) for ids in codec.encode_batch(texts)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in out_schema.names[1:]]
            arrays = [pa.array(list(c), f.type) for c, f in zip(columns, list(out_schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(out_schema[0].type), *arrays], schema=out_schema)

    return docs.select(key, text).mapInArrow(run, f"{key} {key_type}, {schema}")


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every text."""
    return transcode(docs, path, lambda _, ids: (ids,), "ids array<int>", key, text)


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every id list; null: as an empty list."""
    vocabulary = tokens.sparkSession.sparkContext.broadcast(_read(path))
    key_type = tokens.schema[key].dataType.simpleString()
    out_schema = arrow_schema(f"{key} {key_type}, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary.value)
        for batch in batches:
            texts = [codec.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(out_schema[0].type), pa.array(texts, pa.string())], schema=out_schema)

    return tokens.select(key, ids).mapInArrow(run, f"{key} {key_type}, text string")


def _read(path: str) -> str:
    """The vocabulary file, of fixed size, as the driver sees it."""
    with open(path, encoding="utf-8") as file:
        return file.read()
