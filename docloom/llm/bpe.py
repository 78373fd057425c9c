"""BPE encoding and decoding with a public tokenizer file.

A word is a doubly linked list of symbols and a priority queue of merges by
(rank, position). Each step takes the merge of lowest rank, leftmost first,
skips it if one of its symbols has changed since (a stale entry), links the
merged symbol in and queues the two pairs it forms with its neighbours.
Decoding concatenates the vocabulary strings.

Supported files have the normaliser NFC, white space runs to one space, lower
case; a splitting pattern whose matches are the words, then bytes; a word-end
suffix; special tokens that are found in the raw text, leftmost first; and no
decoder. Any other setting is refused with a ValueError. Truncation, padding
and post-processing are not applied.

Scale: a pure map over rows, no shuffle. The driver reads the file and
broadcasts its text (a few MB, whatever the corpus). Words repeat, so each
worker keeps the encodings of words in tables of bounded size, for all its
tasks, and empties them when they are full.

Defined cases: a null text counts as empty and has no ids. A very long text
is split into words one after another; a single long word costs n log n. Of
merges with the same rank the leftmost goes first. Bytes without a symbol in
the vocabulary are left out, as the model has no unknown token. Repeated rows
and rows without an id are encoded each. An empty table gives an empty result.
Extra columns pass through encode_column untouched, but for columns named as
the two results, which they replace.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import buffers, fresh, prepare, segment_words, worker_state

#: Words whose encodings a worker keeps at a time.
CACHE_WORDS = 400_000
#: Words whose token counts a worker keeps, by hash (16 bytes each).
CACHE_HASHES = 4_000_000
#: Normalised words and their parts whose token counts a worker keeps.
CACHE_PIECES = 1_500_000


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte: itself where it is printable in
    Latin-1 (and not a space), else the next free code point from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {b: chr(b) for b in plain}
    free = 256
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return out


def _check(spec: dict) -> None:
    """Raise if the file asks for what is not done here."""
    model = spec["model"]
    normal = [(n["type"], n.get("pattern"), n.get("content")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    wrong = {
        "normalizer": normal != [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)],
        "pre_tokenizer": [s["type"] for s in splits] != ["Split", "ByteLevel"] or splits[0]["behavior"] != "Removed" or not splits[0]["invert"] or "Regex" not in splits[0]["pattern"] or splits[1]["add_prefix_space"] or splits[1]["use_regex"],
        "decoder": spec.get("decoder") is not None,
        "model": model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
        "added_tokens": any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    if any(wrong.values()):
        raise ValueError(f"not supported in this tokenizer file: {', '.join(k for k, v in wrong.items() if v)}")


class Tokenizer:
    """A BPE model with word ends, from a tokenizer file's text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        _check(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks: dict[int, tuple[int, int]] = {}  # by both ids, 32 bits each
        for rank, (a, b) in enumerate(merges):
            if a in self.vocab and b in self.vocab and a + b in self.vocab:
                self.ranks.setdefault(self.vocab[a] << 32 | self.vocab[b], (rank, self.vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        letters = byte_alphabet()  # -1: no symbol
        self.inner = [self.vocab.get(letters[b], -1) for b in range(256)]
        self.last = [self.vocab.get(letters[b] + self.end, -1) for b in range(256)]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split)
        self.stops = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.cache: dict[str, tuple[list[int], str, str]] = {}

    # -- encoding ----------------------------------------------------------

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # code point by code point: the end of a word has no lower case of its own
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def merge(self, word: str) -> list[int]:
        """The ids of a word's symbols after all merges. A symbol that was
        merged into its left neighbour has the id -1."""
        data, ranks = word.encode("utf-8"), self.ranks
        if not data:
            return []
        inner = self.inner
        ids = [inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        if -1 in ids:
            ids = [i for i in ids if i >= 0]
        n = len(ids)
        if n < 2:
            return ids
        queue, a = [], ids[0]
        for i in range(1, n):
            b = ids[i]
            hit = ranks.get(a << 32 | b)
            if hit is not None:
                queue.append((hit[0], i - 1, hit[1], a, b))
            a = b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(queue)
        while queue:
            _, i, new, a, b = heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale
            ids[i] = new
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                hit = ranks.get(new << 32 | ids[k])
                if hit is not None:
                    heappush(queue, (hit[0], i, hit[1], new, ids[k]))
            p = before[i]
            if p >= 0:
                hit = ranks.get(ids[p] << 32 | new)
                if hit is not None:
                    heappush(queue, (hit[0], p, hit[1], ids[p], new))
        return [i for i in ids if i >= 0]

    def _entry(self, word: str) -> tuple[list[int], str, str]:
        """The word's ids, as decimals, and their strings put together."""
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        ids = self.merge(word)
        entry = (ids, " ".join(map(str, ids)), self.decode(ids))
        if len(word) <= 64:
            self.cache[word] = entry
        return entry

    def _pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Runs of ordinary text and special tokens, in order."""
        at = 0
        for m in self.stops.finditer(text) if self.stops else ():
            yield text[at : m.start()], None
            yield m.group(), self.special[m.group()]
            at = m.end()
        yield text[at:], None

    def entries(self, text: str) -> Iterator[tuple[list[int], str, str]]:
        get, make = self.cache.get, self._entry
        for piece, special in self._pieces(text):
            if special is not None:
                yield [special], str(special), piece
            elif piece:
                for word in self.words.findall(self.normalise(piece)):
                    entry = get(word) or make(word)
                    if entry[0]:
                        yield entry

    def encode(self, text: str) -> list[int]:
        return [i for entry in self.entries(text) for i in entry[0]]

    # -- decoding ----------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The strings of the ids, joined by spaces where the file names no
        decoder (ids without a string are left out)."""
        return " ".join(s for i in ids if (s := self.strings.get(i)) is not None)


def read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenizer(text: str) -> Tokenizer:
    """The tokenizer of a file's text; a process keeps the last one."""
    return _latest("tokenizer", text, lambda: Tokenizer(text))


def _latest(kind: str, text: str, make):
    state = worker_state()
    if kind not in state or state[kind][0] != text:
        state[kind] = (text, make())
    return state[kind][1]


class _Counts:
    """Tokens of words by their hash: sorted arrays of bounded size."""

    def __init__(self, model: Tokenizer):
        self.model = model
        self.keys, self.values = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.pieces: dict[str, int] = {}

    def of(self, distinct: np.ndarray, words) -> np.ndarray:
        """The tokens of sorted distinct hashes; words(places) gives the words
        at some places, as one text with a line for each."""
        if len(self.keys) > CACHE_HASHES:
            self.keys, self.values = self.keys[:0], self.values[:0]
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        out = np.zeros(len(distinct), np.int64)
        out[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self.counted(words(new))
            where = np.searchsorted(self.keys, distinct[new])
            self.keys, self.values = np.insert(self.keys, where, distinct[new]), np.insert(self.values, where, out[new])
        return out

    def counted(self, text: str) -> list[int]:
        """Tokens of each line of a text: a line is a word."""
        model = self.model
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        if model.stops and model.stops.search(text):
            return [len(model.encode(w)) for w in text.split("\n")]
        pieces, merge, split, out = self.pieces, model.merge, model.words.findall, []
        for word in model.normalise(text).split("\n"):
            n = pieces.get(word)
            if n is None:
                if word.isascii() and word.isalpha():
                    n = len(merge(word))
                else:
                    n = 0
                    for piece in split(word):
                        k = pieces.get(piece)
                        if k is None:
                            k = pieces[piece] = len(merge(piece))
                        n += k
                if len(word) <= 64:
                    pieces[word] = n
            out.append(n)
        return out


def with_token_counts(docs: DataFrame, path: str, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of every whole text (a column of that
    name goes). White space of ASCII always ends a word, and neither the
    normaliser nor special tokens reach across it, so a text has the tokens of
    its words, and each distinct word is encoded once for many texts."""
    names = [c for c in docs.columns if c != name]
    body = fresh(names, "body")
    file = docs.sparkSession.sparkContext.broadcast(read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _latest("token counts", file.value, lambda: _Counts(tokenizer(file.value)))
        for batch in batches:
            total = np.zeros(batch.num_rows, np.int64)
            for data, h, starts, ends, text in segment_words(*buffers(batch.column(0))):
                distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
                raw, low, high = data.tobytes(), starts[first], ends[first]
                found = counts.of(distinct, lambda new: b"\n".join([raw[a:b] for a, b in zip(low[new].tolist(), high[new].tolist())]).decode())
                total += np.bincount(text, found[back], minlength=len(total)).astype(np.int64)
            yield pa.record_batch([*batch.columns[1:], pa.array(total)], [*names, name])

    prepare(docs.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return docs.select(F.col(text_col).cast("string").alias(body), *names).mapInArrow(run, f"{kinds}, `{name}` long")


def encode_column(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """docs with the ids of every whole text and the text decoded from them."""
    names = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    body = fresh(names, "body")
    schema = docs.select(*names).schema
    file = docs.sparkSession.sparkContext.broadcast(read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(file.value)
        for batch in batches:
            ids = [model.encode(t or "") for t in batch.column(0).to_pylist()]
            yield pa.record_batch([*batch.columns[1:], pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(x) for x in ids], pa.string())], [*names, ids_col, decoded_col])

    prepare(docs.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.select(F.col(text_col).cast("string").alias(body), *names).mapInArrow(run, f"{kinds}, `{ids_col}` array<int>, `{decoded_col}` string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text;
    ids and decoded text are digested in the worker and not sent back."""
    file = docs.sparkSession.sparkContext.broadcast(read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(file.value)
        for batch in batches:
            n, shas, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                found = list(model.entries(text or ""))
                n.append(sum(len(e[0]) for e in found))
                shas.append(hashlib.sha256(" ".join([e[1] for e in found]).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([e[2] for e in found]).encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(shas), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
