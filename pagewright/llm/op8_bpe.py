"""BPE encoding and decoding: a segment tree over the ranks of adjacent pairs yields each next merge."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

#: Letters, digits and lower-case forms that Unicode 16 and 17 added, which the
#: vocabulary's library knows and Python 3.13 doesn't.
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_DIGITS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def _class(kind: str, more: list[tuple[int, int]]) -> str:
    """The code points of a general category, as the inside of a character class."""
    runs: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == kind:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in [*runs, *more])


#: White space as Unicode has it, and what splits a run of other characters into words.
SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
GAPS = re.compile(f"[{SPACE}]+")
LETTER, DIGIT = _class("L", NEW_LETTERS), _class("N", NEW_DIGITS)
#: The words of runs that newlines separate, and the newlines.
WORDS = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+")
#: What Python splits or lowers otherwise.
ODD = re.compile("[\x1c-\x1f" + "".join(map(chr, NEW_LOWER)) + "]")
FIRST_NEW = min(NEW_LOWER)
NONE = np.iinfo(np.int64).max
#: Words of more symbols are merged one by one.
WIDEST = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def is_odd(text: str) -> bool:
    """Whether ODD is in a text; few texts need the search."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return True
    if text.isascii() or not (np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16) >= FIRST_NEW).any():
        return False
    return ODD.search(text) is not None


class Runs(dict):
    """Numbers runs as they are asked for; `new` has those not learnt yet, in order."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, run: str) -> int:
        self[run] = n = len(self)
        self.new.append(run)
        return n


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start..start+length-1 of each span, one after the other."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())


class Encoder:
    """A word-end BPE vocabulary read from a tokenizer file. Runs of text that were met stay, up to `cache` of them."""

    def __init__(self, path: str, cache: int = 100_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.token = {i: t for t, i in (vocab | self.special).items()}
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        self.size = max(self.token) + 1
        keys = np.array([a * self.size + b for a, b, _ in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([c for *_, c in merges], np.int64)
        self.rank = {(a, b): r for r, (a, b, _) in reversed(list(enumerate(merges)))}
        self.most = cache
        self.forget()

    def forget(self) -> None:
        self.runs, self.ids = Runs(), np.zeros(0, "<u4")
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE if it doesn't merge. A symbol of -1 stands for none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of at most WIDEST bytes, and how many each has, all at once: one segment tree a word, as rows of a matrix.

        A leaf holds rank * width + place of the pair that starts there, so a root is the lowest rank
        and of those the leftmost. A merge changes three leaves and the paths above them.
        """
        width = 1 << max(1, (max(map(len, words)) - 1).bit_length())
        n, levels = len(words), width.bit_length() - 1
        length = np.fromiter(map(len, words), np.int64, n)
        row = np.repeat(np.arange(n), length)
        place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = np.full((n, width + 1), -1, np.int64)  # the last column stands for no neighbour
        sym[row, place] = np.where(place == length[row] - 1, self.last[raw], self.inner[raw])
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after[:, width] = width
        after = np.where(after >= length[:, None], width, after)
        before = np.tile(np.arange(-1, width), (n, 1))
        before[:, 0] = before[:, width] = width
        tree = np.full((n, 2 * width), NONE, np.int64)
        rank = self.pair_ranks(sym[:, :-1], sym[:, 1:])
        tree[:, width:] = np.where(rank == NONE, NONE, rank * width + np.arange(width))
        for level in range(levels - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])

        def put(rows: np.ndarray, at: np.ndarray, key: np.ndarray) -> None:
            real = at < width
            rows, node, key = rows[real], at[real] + width, key[real]
            tree[rows, node] = key
            for _ in range(levels):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            top = tree[live, 1]
            a, new = top % width, self.made[top // width]
            b = after[live, a]
            c, p = after[live, b], before[live, a]
            sym[live, a], sym[live, b] = new, -1
            after[live, a] = c
            before[live, c] = np.where(c < width, a, before[live, c])
            right, left = self.pair_ranks(new, sym[live, c]), self.pair_ranks(sym[live, p], new)
            put(live, b, np.full(len(live), NONE))
            put(live, a, np.where(right == NONE, NONE, right * width + a))
            put(live, p, np.where(left == NONE, NONE, left * width + p))
            live = live[tree[live, 1] != NONE]
        kept = sym[:, :-1] >= 0
        return sym[:, :-1][kept].astype("<u4"), kept.sum(axis=1)

    def merge_one(self, word: bytes) -> np.ndarray:
        """The same for one long word, on lists."""
        n = len(word)
        width = 1 << max(1, (n - 1).bit_length())
        sym = [*map(int, self.inner[list(word[:-1])]), int(self.last[word[-1]])]
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        none = (len(self.made), 0)
        tree = [none] * (2 * width)
        pair = lambda i: (self.rank.get((sym[i], sym[after[i]]), none[0]), i) if after[i] >= 0 else none
        for i in range(n):
            tree[width + i] = pair(i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, key: tuple[int, int]) -> None:
            k = width + i
            tree[k] = key
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        while tree[1][0] < none[0]:
            rank, a = tree[1]
            b = after[a]
            c, p = after[b], before[a]
            sym[a], sym[b], after[a] = int(self.made[rank]), -1, c
            if c >= 0:
                before[c] = a
            put(b, none)
            put(a, pair(a))
            if p >= 0:
                put(p, pair(p))
        return np.array([s for s in sym if s >= 0], "<u4")

    def learn(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs without white space, one after the other, and how many each has."""
        seen: dict[str, int] = {"\n": 0}
        at = np.fromiter((seen.setdefault(w, len(seen)) for w in WORDS.findall("\n".join(runs) + "\n")), np.int64)
        words = list(seen)
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        parts, n, where = [np.zeros(0, "<u4")], np.zeros(len(raw), np.int64), [np.zeros(0, np.int64)]
        for low, high in ((0, 4), (4, 8), (8, 16), (16, 32), (32, WIDEST)):
            some = np.flatnonzero((size > low) & (size <= high))
            some = some[some > 0]
            for k in range(0, len(some), 4_000):
                part = some[k : k + 4_000]
                flat, n[part] = self.merge_many([raw[i] for i in part.tolist()])
                parts.append(flat)
                where.append(part)
        for i in np.flatnonzero(size > WIDEST).tolist():
            parts.append(self.merge_one(raw[i]))
            n[i] = len(parts[-1])
            where.append(np.array([i]))
        start = np.zeros(len(raw), np.int64)
        placed = np.concatenate(where)
        start[placed] = np.cumsum(n[placed]) - n[placed]
        ids = np.concatenate(parts)[spans(start[at], n[at])]
        ends = np.flatnonzero(at == 0)
        total = np.concatenate([[0], np.cumsum(n[at])])[ends + 1]
        return ids, np.diff(total, prepend=0)

    def chunks(self, text: str) -> list[str]:
        """A text's runs without white space, normalised; the special tokens' strings stay whole."""
        out: list[str] = []
        for i, part in enumerate(self.marks.split(text) if "<|" in text else [text]):
            if i % 2:
                out.append(part)
                continue
            part = unicodedata.normalize("NFC", part)
            odd = is_odd(part)
            part = (part.translate(NEW_LOWER) if odd else part).replace("Σ", "σ").lower()
            out += [c for c in GAPS.split(part) if c] if odd else part.split()
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.runs) > self.most:
            self.forget()
        split = [self.chunks(t) for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.runs.__getitem__, chain.from_iterable(split)), np.int64, size.sum())
        if new := self.runs.new:
            special = {k: self.special[r] for k, r in enumerate(new) if r in self.special}
            ids, n = self.learn(["" if k in special else r for k, r in enumerate(new)])
            begin = np.cumsum(n) - n
            for k, i in special.items():
                begin[k], n[k] = len(ids), 1
                ids = np.append(ids, np.uint32(i))
            self.start, self.length = np.append(self.start, begin + len(self.ids)), np.append(self.length, n)
            self.ids, self.runs.new = np.append(self.ids, ids).astype("<u4"), []
        flat = self.ids[spans(self.start[at], self.length[at])]
        ends = np.concatenate([[0], np.cumsum(self.length[at])])[np.cumsum(size)].tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens, space-joined, as the vocabulary has no decoder."""
        return " ".join(map(self.token.__getitem__, ids.tolist()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The vocabulary of a file, read once a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _parts(texts: list[str], most: int = 400_000) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters."""
    run: list[str] = []
    size = 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def encode_texts(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Add `ids`, the token ids of each whole text, in place of a column of that name. A null text counts as empty and has none."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        enc = encoder(path or vocabulary())
        return pd.Series([x.astype(np.int32) for run in _parts(texts.fillna("").tolist()) for x in enc.encode_batch(run)], index=texts.index)

    return docs.withColumn("ids", encode(F.col(text_col)))


def decode_ids(docs: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Add `decoded`, the text of an array of token ids, in place of a column of that name. Null or empty ids give an empty text."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        enc = encoder(path or vocabulary())
        return ids.map(lambda x: "" if x is None else enc.decode(np.asarray(x)))

    return docs.withColumn("decoded", decode(F.col(ids_col)))


DIGESTS = ["n_tokens", "ids_sha256", "decoded_sha256"]


def token_digests(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256: each text is encoded, and its ids decoded again, where it is read.

    They take the place of columns of these names. A null text counts as empty: no tokens, and the
    digests of nothing. Texts of any length are read whole; equal texts have equal digests, and every
    row stays, with its id null or repeated.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        enc = encoder(path or vocabulary())
        rows = [(len(x), sha256(x.tobytes()).hexdigest(), sha256(enc.decode(x).encode()).hexdigest()) for run in _parts(texts.fillna("").tolist()) for x in enc.encode_batch(run)]
        return pd.DataFrame(rows, columns=DIGESTS)

    return docs.withColumn("_bpe", digest(F.col(text_col))).select(*(c for c in docs.columns if c not in DIGESTS), "_bpe.*")


def op8_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return token_digests(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
