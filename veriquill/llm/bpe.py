"""BPE encoding and decoding by speculation: greedy longest matches, a vectorised test of every adjacent pair, exact merging where it fails.

A split of a word into tokens is the one that merging gives if every adjacent pair of tokens is compatible, that is, if merging the pair's
own characters gives just that pair. So the words of a batch are first cut greedily, then all their adjacent pairs are tested at once in
numpy, and only words with a failing pair are merged step by step.

Words come from the vocabulary file's own normaliser and pre-tokeniser; tokens, ranks and texts from its vocabulary and merges.

Defined results: null and empty texts have no tokens and decode to the empty text. Each row comes out once, also repeated ones. No
documents give no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .token_files import BYTE_CHARS

#: Distinct words and blank-separated pieces that a task remembers.
REMEMBERED = 300_000
#: Texts of these characters are normal forms, and lower() and this pattern give what the vocabulary's own normaliser and pre-tokeniser do.
PLAIN = re.compile(r"[\t\n\r\x20-\x7E\xA1-\xAC\xAE-\u012F\u0132-\u024F\u2010-\u2027\u2030-\u205E]*")
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
SHORT = 64
FAR, NEVER = np.int64(1) << 40, 1 << 62


class WordBpe:
    """The vocabulary of a tokenizers file with a BPE model whose last symbols carry a word-end mark."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.tokenizer = Tokenizer.from_file(path)
        self.splitter = self.tokenizer.pre_tokenizer[0]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.text = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: r for r, m in enumerate(merges)}
        # rank and token of a merge as one number, so that the least one is the next to do
        self.by_pair = {(self.vocab[a] << 32) | self.vocab[b]: (r << 32) | self.vocab[a + b] for r, (a, b) in enumerate(merges)}
        # When merging first makes each token (never, for single symbols), and from which halves
        size = max(self.vocab.values()) + 1
        made: dict[str, int] = {}
        self.order = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        keys, ranks = [], []
        for r, (a, b) in enumerate(merges):
            token = self.vocab[a + b]
            keys.append((self.vocab[a] << 32) | self.vocab[b])
            ranks.append(r)
            if a + b not in made:
                made[a + b] = r
                self.order[token], self.left[token], self.right[token] = r, self.vocab[a], self.vocab[b]
        by = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[by], np.array(ranks, np.int64)[by]
        # A greedy match may use tokens only that their own characters merge to
        self.usable = {t for t, i in self.vocab.items() if self._merged(self._symbols(t)) == [i]}
        # The most characters of a usable token by its first two
        self.reach: dict[str, int] = {}
        for t in self.usable:
            body = "".join(self._symbols(t))
            body = body[: len(body) - len(self.end)] if self.end and body.endswith(self.end) and len(body) > len(self.end) else body
            self.reach[body[:2]] = max(self.reach.get(body[:2], 1), len(body))
        self.words: dict[str, tuple[str, int, str]] = {}
        self.pieces: dict[str, tuple[str, int, str]] = {}
        # what was remembered before: whatever of it comes again is kept
        self.older_words, self.older_pieces = self.words, self.pieces
        self.merged_words = 0

    def _symbols(self, token: str) -> list[str]:
        body = token[: -len(self.end)] if self.end and token.endswith(self.end) and len(token) > len(self.end) else token
        symbols = list(body)
        return [*symbols[:-1], symbols[-1] + self.end] if body != token else symbols

    def _merged(self, symbols: list[str]) -> list[int]:
        """Exact merging: the pair of lowest rank first, the leftmost of equals."""
        if len(symbols) <= SHORT:
            return self._merged_short([self.vocab[s] for s in symbols])
        after = [*range(1, len(symbols)), -1]
        before = [-1, *range(len(symbols) - 1)]
        symbols = list(symbols)
        alive = [True] * len(symbols)
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(len(symbols) - 1) if (r := self.rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = a + b, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.rank.get((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        return [self.vocab[s] for s, ok in zip(symbols, alive, strict=True) if ok]

    def _merged_short(self, ids: list[int]) -> list[int]:
        get, none = self.by_pair.get, NEVER
        due = [get((a << 32) | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while due and (least := min(due)) != none:
            i = due.index(least)
            ids[i] = least & 0xFFFFFFFF
            del ids[i + 1], due[i]
            if i < len(due):
                due[i] = get((ids[i] << 32) | ids[i + 1], none)
            if i:
                due[i - 1] = get((ids[i - 1] << 32) | ids[i], none)
        return ids

    def _greedy(self, word: str) -> list[int]:
        """Longest usable token at each place; the word-end mark counts as part of the last character."""
        out, at, n = [], 0, len(word)
        usable, vocab, reach = self.usable, self.vocab, self.reach.get
        while at < n:
            for stop in range(min(n, at + reach(word[at : at + 2], 1)), at, -1):
                piece = word[at:stop] + self.end if stop == n else word[at:stop]
                if piece in usable:
                    break
            else:
                return []
            out.append(vocab[piece])
            at = stop
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of each pair of tokens gives that pair.

        The later-made token of a pair is undone into its two halves, step by step, as merging would have met them: a merge across the border
        that is due before the next step of either side makes the pair incompatible.
        """
        good = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        # what is next to undo: on the left side the right half matters, on the right side the left half
        limit = np.full(len(a), FAR)
        while len(open_):
            key = (x << 32) | y
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[place] == key, self.pair_ranks[place], FAR)
            rx, ry = self.order[x], self.order[y]
            # The border pair stands from when its later half was made until one of them is merged further, at `limit`.
            bad = rank < limit
            good[open_[bad]] = False
            ends = (rx < 0) & (ry < 0)
            go = ~bad & ~ends
            open_, x, y, rx, ry, limit = open_[go], x[go], y[go], rx[go], ry[go], limit[go]
            # On equal ranks the left one is merged first, so the right one is undone first
            right = ry >= rx
            limit = np.where(right, ry + 1, rx)
            x, y = np.where(right, x, self.right[x]), np.where(right, self.left[y], y)
        return good

    def learn(self, words: list[str]) -> None:
        """Remember (ids as text, number of ids, decoded text) of these words."""
        # letters of ASCII are spelt as they are
        spelt = [w if (w.isascii() and w.isalpha()) or w in self.added else "".join(map(BYTE_CHARS.__getitem__, w.encode())) for w in words]
        cut = [[self.added[w]] if w in self.added else self._greedy(w) for w in spelt]
        lengths = np.array([len(c) for c in cut], np.int64)
        ids = np.array([i for c in cut for i in c], np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique((ids[inside] << 32) | ids[inside + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        failing = set(owner[inside][~good].tolist()) | set(np.flatnonzero(lengths == 0).tolist())
        self.merged_words += len(failing)
        for k, (w, in_bytes) in enumerate(zip(words, spelt, strict=True)):
            found = self._merged([*in_bytes[:-1], in_bytes[-1] + self.end]) if k in failing else cut[k]
            self.words[w] = (" ".join(map(str, found)), len(found), " ".join([self.text[i] for i in found]))

    def encode(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """(ids as text, number of ids, decoded text) of each text."""
        if len(self.words) + len(self.pieces) > REMEMBERED:
            self.older_words, self.older_pieces, self.words, self.pieces = self.words, self.pieces, {}, {}
        split = [(text.lower().split(), self.pieces) if PLAIN.fullmatch(text) and not any(s in text for s in self.added) else (self._split(text), self.words) for text in texts]
        unknown = set().union(*[pieces for pieces, known in split if known is self.pieces]).difference(self.pieces)
        self.pieces |= {p: self.older_pieces[p] for p in unknown if p in self.older_pieces}
        new = {p: [p] if p.isalpha() else WORD.findall(p) for p in unknown if p not in self.pieces}
        words = {w for ws in new.values() for w in ws} | {w for ws, known in split if known is self.words for w in ws}
        self.words |= {w: self.older_words[w] for w in words if w not in self.words and w in self.older_words}
        if words := [w for w in words if w not in self.words]:
            self.learn(words)
        self.pieces |= {p: self.words[ws[0]] if len(ws) == 1 else self._joined(map(self.words.__getitem__, ws)) for p, ws in new.items()}
        return [self._joined(map(known.__getitem__, pieces)) for pieces, known in split]

    @staticmethod
    def _joined(got: Iterable[tuple[str, int, str]]) -> tuple[str, int, str]:
        got = list(got)
        return " ".join(map(itemgetter(0), got)), sum(map(itemgetter(1), got)), " ".join(map(itemgetter(2), got))

    def _split(self, text: str) -> list[str]:
        if any(s in text for s in self.added):
            return [w for part in self._parts(text) for w in ([part] if part in self.added else self._split(part))]
        text = self.tokenizer.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)] if text else []

    def _parts(self, text: str) -> list[str]:
        """Texts between special tokens and those tokens; the leftmost special token first."""
        out = []
        while text:
            found = min(((at, s) for s in self.added if (at := text.find(s)) >= 0), default=None)
            if not found:
                return [*out, text]
            out += [x for x in (text[: found[0]],) if x] + [found[1]]
            text = text[found[0] + len(found[1]) :]
        return out


@functools.lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


_OUT = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.string(), "decoded": pa.string()}
GROUP = 256  # rows encoded at once


def _encode(path: str, full: bool):
    names = list(_OUT) if full else list(_OUT)[:3]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            for first in range(0, batch.num_rows, GROUP):
                part = batch.slice(first, GROUP)
                rows = bpe.encode([t or "" for t in part.column("text").to_pylist()])
                got = [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text) for ids, n, text in rows]
                kept = [c for c in part.schema.names if c != "text" or full]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array([g[i] for g in got], _OUT[n]) for i, n in enumerate(names)], kept + names)

    return encode


def encode_documents(docs: DataFrame, vocabulary: str, full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs; with `full` also its text, ids (decimal, joined by spaces) and decoded text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    head = "doc_id long, text string" if full else "doc_id long"
    tail = ", ids string, decoded string" if full else ""
    return docs.mapInArrow(_encode(vocabulary, full), f"{head}, n_tokens long, ids_sha256 string, decoded_sha256 string{tail}")
