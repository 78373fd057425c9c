"""Token counts of every prefix, by dynamic programming over byte-level BPE.

The encoding of a prefix of a piece ends in one token. That token is the only
one of those ending there that BPE leaves beside the last token of what comes
before it, so one pass over the bytes gives the count of every prefix: the
count where that token begins, and one. Two tokens stay beside each other if
no merge across their border comes first while the symbols at the border grow
into the two tokens; their merge trees list those symbols with the rank at
which each is used up.

A text is split into pieces by the file's pattern. Prefixes that end inside a
piece of white space, a contraction or a special token are split otherwise
than the whole text; their counts follow the split of the prefix itself, so
the table says what the library says of text[:k] for every k. From the table
`tokens_at` and `longest_within` answer any question about truncation or a
budget in the JVM, without another encoding; `count_tokens` and `truncate`
read the same table inside the worker and send back the answers only.

Supported files have no normaliser, the byte-level splitting without a prefix
space, one merge for each symbol and every byte in the vocabulary. Any other
setting is refused with a ValueError. Truncation, padding and post-processing
are not applied.

Scale: a map over rows, no shuffle. The driver broadcasts the file's text (a
few MB, whatever the corpus). A worker keeps the tables of pieces and of token
pairs between tasks, in dictionaries of bounded size that are emptied when
full. A long text is worked on in parts of about PART characters that end
where no piece can cross.

Defined cases: a null text counts as empty, has no bytes and no tokens, and an
empty table. Prefixes are counted in code points. The count may fall from one
prefix to the next; longest_within gives the longest prefix that fits, also
beyond such a place. Repeated rows and rows without an id are counted each. An
empty table gives an empty result. Other columns pass through; those named as
results are replaced.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator, Sequence
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh, prepare, worker_state
from .bpe import byte_alphabet, read

#: Characters of a text that are split together.
PART = 1 << 20
#: Pieces whose tables a worker keeps at a time (none longer than 64 characters).
CACHE_PIECES = 400_000
#: Pairs of tokens whose verdicts a worker keeps at a time.
CACHE_PAIRS = 2_000_000
#: Bytes of prefix tables sent in one Arrow batch (one longer table extends it).
BATCH_BYTES = 8 << 20

# The byte-level splitting pattern, in its published form.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Contractions of more than one letter: a prefix may end between the letters.
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")

#: Letters and numbers that Unicode took in after the tables of the tokenizers
#: library: its pattern takes them for signs.
NEWER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    "\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    "\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    "\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_SIGN = "\u0378"  # stands for one of them in the pattern: not assigned

_NEVER = 1 << 40
_NEWER = regex.compile(f"[{NEWER}]")
_WHITE_RUN = regex.compile(r"\s\s+(?=\S)")
_PIECE_END = regex.compile(r"(?<=\S)(?=\s)")


def _check(spec: dict) -> None:
    """Raise if the file asks for what is not done here."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    rank = {a + b: r for r, (a, b) in enumerate(merges)}
    wrong = {
        "normalizer": spec.get("normalizer") is not None,
        "pre_tokenizer": split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True),
        "model": model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "merges": len(rank) != len(merges) or any(rank.get(a, -1) >= r or rank.get(b, -1) >= r for r, (a, b) in enumerate(merges)),
        "vocab": any(c not in model["vocab"] for c in byte_alphabet().values()),
        "added_tokens": any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    if any(wrong.values()):
        raise ValueError(f"not supported in this tokenizer file: {', '.join(k for k, v in wrong.items() if v)}")


class Prefixes:
    """Prefix counts by a tokenizer file's text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        _check(spec)
        vocab, plain = spec["model"]["vocab"], {c: b for b, c in byte_alphabet().items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merged = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        # the symbols at either edge of a token as it grows, each with the rank
        # of the merge that uses it up
        self.left: dict[int, tuple] = {vocab[c]: ((vocab[c], _NEVER),) for c in plain}
        self.right = dict(self.left)
        whole = {vocab[c] for c in plain}  # tokens that their own bytes encode to
        for rank, (a, b) in enumerate(merges):
            x, y, new = vocab[a], vocab[b], vocab[a + b]
            self.left[new] = (*self.left[x][:-1], (x, rank), (new, _NEVER))
            self.right[new] = (*self.right[y][:-1], (y, rank), (new, _NEVER))
            if x in whole and y in whole and self.first_merge(x, y) == (x, y):
                whole.add(new)
        self.tokens = ahocorasick.Automaton()  # over bytes, as characters of Latin-1
        for s, i in vocab.items():
            if i in whole:
                key = bytes(plain[c] for c in s).decode("latin-1")
                self.tokens.add_word(key, (i, len(key)))
        self.tokens.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.pattern = regex.compile(PATTERN)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.stops = regex.compile("|".join(map(regex.escape, special))) if special else None

    def first_merge(self, a: int, b: int) -> tuple[int, int] | None:
        """The first merge across the border of two tokens that grow beside
        each other: of equal ranks, the one further left goes first."""
        left, right, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, until_x), (y, until_y) = left[i], right[j]
            rank = self.merged.get((x, y), _NEVER)
            if rank < until_x and rank <= until_y:
                return x, y
            if until_x == until_y == _NEVER:
                return None
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    def stay(self, a: int, b: int) -> bool:
        """Whether BPE leaves token b beside token a."""
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.first_merge(a, b) is None
        return found

    def byte_counts(self, data: bytes) -> list[int]:
        """Tokens of data[:k] for every k from 0, as one piece."""
        counts, last, pairs = [0] * (len(data) + 1), [0] * (len(data) + 1), self.pairs.get
        for end, (token, size) in self.tokens.iter(data.decode("latin-1")):  # the longest of each end first
            if counts[end + 1]:
                continue
            start = end + 1 - size
            if start:
                a = last[start]
                apart = pairs(a << 32 | token)
                if not (self.stay(a, token) if apart is None else apart):
                    continue
            counts[end + 1] = counts[start] + 1
            last[end + 1] = token
        return counts

    def _steps(self, piece: str) -> bytes:
        """How the count changes with each code point of a piece."""
        data = piece.encode()
        counts = self.byte_counts(data)
        if len(data) > len(piece):  # where a character ends, another begins
            counts = [0, *(n for n, b in zip(counts[1:], data[1:]) if b & 0xC0 != 0x80), counts[-1]]
        if piece in LONG_CONTRACTIONS:  # the prefix is a quote and a letter
            counts[2] = counts[1] + self.byte_counts(data[1:2])[-1]
        return array("i", map(sub, counts[1:], counts)).tobytes()

    def _made(self, piece: str) -> bytes:
        if len(self.pieces) >= CACHE_PIECES:
            self.pieces.clear()
        steps = self._steps(piece)
        if len(piece) <= 64:
            self.pieces[piece] = steps
        return steps

    def _white(self, run: str) -> int:
        """A run of white space before other text gives its last character to
        what follows; a prefix that ends with the run does not. The difference."""
        ends = [int(np.frombuffer(self.pieces.get(p) or self._made(p), np.int32).sum()) for p in (run, run[:-1], run[-1])]
        return ends[0] - ends[1] - ends[2]

    def split(self, text: str) -> list[str]:
        """The pieces of a text without special tokens, one after another."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if _NEWER.search(text):
                return [text[m.start() : m.end()] for m in self.pattern.finditer(_NEWER.sub(_SIGN, text))]
        return self.pattern.findall(text)

    def _ordinary(self, text: str) -> np.ndarray:
        """Steps of a text without special tokens."""
        get, made = self.pieces.get, self._made
        pieces = self.split(text)
        found = list(map(get, pieces))
        if None in found:
            found = [f if f is not None else get(p) or made(p) for p, f in zip(pieces, found)]
        steps = np.frombuffer(b"".join(found), np.int32)
        runs = [(m.end() - 1, c) for m in _WHITE_RUN.finditer(text) if (c := self._white(m.group()))]
        if runs:
            at, more = np.array(runs).T
            steps = steps.copy()
            np.add.at(steps, at, more.astype(np.int32))
            np.subtract.at(steps, at + 1, more.astype(np.int32))
        return steps

    def _parts(self, text: str) -> Iterator[np.ndarray]:
        at = 0
        while len(text) - at > PART:
            m = _PIECE_END.search(text, at + PART)
            if m is None:
                break
            # the white space that follows counts as the end of this part's text
            yield self._ordinary(text[at : m.start()])
            at = m.start()
        yield self._ordinary(text[at:] if at else text)

    def steps(self, text: str) -> Iterator[np.ndarray]:
        """The change of the count with each code point of a text, in parts."""
        at = 0
        for m in self.stops.finditer(text) if self.stops and self.stops.search(text) else ():
            # prefixes that end inside the special token are ordinary text
            before, n = text[at : m.start()], m.start() - at
            made = np.concatenate([*self._parts(before + m.group()[:-1])])
            yield made
            yield np.array([1 - int(made[n:].sum())], np.int32)
            at = m.end()
        if at < len(text):
            yield from self._parts(text[at:] if at else text)

    def table(self, text: str) -> np.ndarray:
        """Tokens of text[:k] for k from 1 to the length of the text."""
        parts = [*self.steps(text)]
        return np.cumsum(np.concatenate(parts), dtype=np.int32) if parts else np.empty(0, np.int32)

    def count(self, text: str, budgets: Sequence[int] = ()) -> tuple[int, list[int]]:
        """Tokens of a text, and the longest prefix within each budget, from
        the table's parts one after another."""
        total, chars, fits = 0, 0, [0] * len(budgets)
        for part in self.steps(text):
            if budgets:
                counts = total + np.cumsum(part, dtype=np.int64)
                for i, budget in enumerate(budgets):
                    # a count above the budget throughout has no place here
                    if (within := np.flatnonzero(counts <= budget)).size:
                        fits[i] = chars + int(within[-1]) + 1
            total += int(part.sum(dtype=np.int64))
            chars += len(part)
        return total, fits


def prefixes(text: str) -> Prefixes:
    """The tables of a tokenizer file's text; a process keeps the last ones."""
    state = worker_state()
    if "prefixes" not in state or state["prefixes"][0] != text:
        state["prefixes"] = (text, Prefixes(text))
    return state["prefixes"][1]


def _mapped(docs: DataFrame, path: str, text_col: str, results: dict[str, str], rows) -> DataFrame:
    """docs with result columns that rows(model, texts) gives, an iterator of
    (number of texts, their result arrays)."""
    names = [c for c in docs.columns if c not in results]
    body = fresh(names, "body")
    file = docs.sparkSession.sparkContext.broadcast(read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = prefixes(file.value)
        for batch in batches:
            at = 0
            for n, made in rows(model, (t or "" for t in batch.column(0).to_pylist())):
                yield pa.record_batch([*(c.slice(at, n) for c in batch.columns[1:]), *made], [*names, *results])
                at += n

    prepare(docs.sparkSession)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema]
    kinds += [f"`{k}` {v}" for k, v in results.items()]
    return docs.select(F.col(text_col).cast("string").alias(body), *names).mapInArrow(run, ", ".join(kinds))


def count_tokens(docs: DataFrame, path: str, budgets: Sequence[int] = (), text_col: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and, for each budget b, fits_<b>:
    the code points of the longest prefix of at most b tokens."""

    def rows(model: Prefixes, texts):
        made = [(len(t.encode()), *model.count(t, budgets)) for t in texts]
        if made:
            fits = [pa.array([m[2][i] for m in made], pa.int64()) for i in range(len(budgets))]
            yield len(made), [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), *fits]

    results = {"n_bytes": "long", "n_tokens": "long"} | {f"fits_{b}": "long" for b in budgets}
    return _mapped(docs, path, text_col, results, rows)


def prefix_table(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with prefix_tokens, an array of ints: the tokens of the first k code
    points of the text, for every k from 1. Written once, it answers all later
    questions about these texts."""

    def rows(model: Prefixes, texts):
        held: list[np.ndarray] = []
        size = 0
        for text in texts:
            held.append(model.table(text))
            size += held[-1].nbytes
            if size >= BATCH_BYTES:
                yield len(held), [_lists(held)]
                held, size = [], 0
        if held:
            yield len(held), [_lists(held)]

    return _mapped(docs, path, text_col, {"prefix_tokens": "array<int>"}, rows)


def _lists(tables: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, tables)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(tables), pa.int32()))


def tokens_at(table: Column, chars: Column | int) -> Column:
    """Tokens of the first `chars` code points (0 for none; of the whole text
    if it has fewer), from a prefix table."""
    k = F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(table))
    return F.when(k > 0, F.element_at(table, k.cast("int"))).otherwise(0)


def longest_within(table: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix of at most `budget` tokens."""
    within = F.lit(budget) if isinstance(budget, int) else budget
    return F.coalesce(F.array_max(F.transform(table, lambda n, i: F.when(n <= within, i + 1))), F.lit(0))


def truncate(docs: DataFrame, path: str, budget: int, text_col: str = "text") -> DataFrame:
    """docs with every text cut to its longest prefix of at most `budget`
    tokens (null stays null)."""
    kept = fresh([*docs.columns, "n_bytes", "n_tokens"], f"fits_{budget}")
    if kept != f"fits_{budget}" or {"n_bytes", "n_tokens"} & set(docs.columns):
        renamed = {c: fresh([*docs.columns, "n_bytes", "n_tokens", f"fits_{budget}"], c) for c in ("n_bytes", "n_tokens", f"fits_{budget}") if c in docs.columns}
    else:
        renamed = {}
    rows = count_tokens(docs.withColumnsRenamed(renamed), path, [budget], renamed.get(text_col, text_col))
    back = {v: k for k, v in renamed.items()}
    cut = F.expr(f"substring(`{text_col}`, 1, cast(`fits_{budget}` as int))")
    return rows.withColumn(text_col, cut).select(*(F.col(renamed.get(c, c)).alias(back.get(c, c)) for c in docs.columns))
