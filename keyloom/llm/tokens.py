"""Whole texts to token ids with the tokenizers library, each distinct piece of text encoded once per worker.

Texts are cut where neither the normalizer nor the pre-tokenizer looks across: before a run of spaces and
newlines, and between a Latin letter and a sign after it. The ids of a text are then the ids of its pieces, one
after another. Texts with other white space go to the library whole. A piece is looked up in a table that the worker keeps between tasks and empties
when it holds `most` pieces, so memory is bounded.
"""

from __future__ import annotations

import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# A run of Latin letters before white space or a sign is a piece of its own: no token joins a letter and a sign.
_WORD = r"[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^ \n.,;:!?])"
_PIECES = {True: re.compile(rf"[ \n]*+(?:{_WORD}|[^ \n]+)|[ \n]+"), False: re.compile(rf"{_WORD}|[^ \n]+")}
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SPACED_LATIN = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ÿ]+")
# Byte-level models write each byte as one character: itself where it can be printed, else the next from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_OTHER_SPACE = re.compile(r"[^\S \n]")
_STEP = 256


class _Codes(dict):
    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        code = self[piece] = len(self)
        self.new.append(piece)
        return code


class PieceEncoder:
    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        normalizer = self.tokenizer.normalizer
        #: Byte-level ids keep the white space before a word; the others drop all white space.
        self.keeps_space = normalizer is None
        self.lowers = normalizer is not None and normalizer.normalize_str("A") == "a"
        self.model = self.tokenizer.model
        vocab = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        bar = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else None
        self.forget()

    def forget(self) -> None:
        """Empties the table of pieces."""
        self.codes = _Codes()
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.spaced = np.zeros(0, bool)  # holds other white space

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Encodes the new pieces, many in one text: they are found again by their bytes or by bars between them."""
        new = self.codes.new
        if not new:
            return
        n = len(new)
        # Of Latin words, normalizer and pre-tokenizer only lower the case and show bytes: they go to the model at once.
        plain, tokenize, lowers = (_SPACED_LATIN if self.keeps_space else _LATIN).fullmatch, self.model.tokenize, self.lowers
        simple = [i for i, p in enumerate(new) if plain(p)]
        shown = [(p.lower() if lowers else p).encode().decode("latin-1").translate(_BYTE) for p in map(new.__getitem__, simple)]
        words = [[t.id for t in tokenize(w)] for w in shown]
        others = np.setdiff1d(np.arange(n), simple)
        if self.keeps_space:  # a piece that starts a text has no space: it would join the one before
            joins = np.fromiter((new[i][0] in " \n" and not new[i].isspace() for i in others.tolist()), bool, len(others))
            plain, alone = others[joins], [others[~joins]]
        else:
            plain, alone = others, []
        groups, texts = [], []
        for at in range(0, len(plain), _STEP):
            g = plain[at : at + _STEP]
            text = ("" if self.keeps_space else " | ").join([new[i] for i in g.tolist()])
            bars = 0 if self.keeps_space else text.count("|") - len(g) + 1
            if bars or any(s in text for s in self.special) or _OTHER_SPACE.search(text):
                alone.append(g)
            else:
                groups.append(g)
                texts.append(text)
        lengths, parts, order = np.zeros(n, np.int64), [], []
        if simple:
            order.append(np.array(simple))
            lengths[order[0]] = [len(w) for w in words]
            parts.append(np.array([i for w in words for i in w], np.uint32))
        for g, ids in zip(groups, self._batch(texts), strict=True):
            ids = np.asarray(ids, np.uint32)
            if self.keeps_space:
                ends = np.cumsum([len(new[i].encode()) for i in g.tolist()])
                cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
                lengths[g] = np.diff(cuts, prepend=0)
            else:
                bars = np.flatnonzero(ids == self.bar)
                lengths[g] = np.diff(np.append(bars, len(ids)), prepend=-1) - 1
                ids = np.delete(ids, bars)
            parts.append(ids)
            order.append(g)
        single = np.concatenate(alone) if alone else np.zeros(0, np.int64)
        for i, ids in zip(single.tolist(), self._batch([new[i] for i in single.tolist()]), strict=True):
            parts.append(np.asarray(ids, np.uint32))
            lengths[i] = len(ids)
        order = np.concatenate([*order, single])
        first = np.zeros(n, np.int64)
        first[order] = len(self.ids) + np.cumsum(lengths[order]) - lengths[order]
        self.ids = np.concatenate([self.ids, *parts])
        self.starts = np.concatenate([self.starts, first])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.spaced = np.concatenate([self.spaced, np.zeros(n, bool)])
        base = len(self.spaced) - n
        self.spaced[[base + i for i in single.tolist() if _OTHER_SPACE.search(new[i])]] = True
        self.codes.new = []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) one text after another, and each text's count."""
        if len(self.codes) > self.most:
            self.forget()
        get, pieces = self.codes.__getitem__, _PIECES[self.keeps_space].findall
        codes, counts, whole = [], np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            if not text:
                continue
            found = pieces(text.lower() if self.lowers and text.isascii() else text)
            codes.extend(map(get, found))
            counts[i] = len(found)
        self._learn()
        code = np.asarray(codes, np.int64)
        if self.spaced.any():
            owner = np.repeat(np.arange(len(texts)), counts)
            whole = np.unique(owner[self.spaced[code]]).tolist()
        lengths = self.lengths[code] if len(code) else np.zeros(0, np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat(self.starts[code] - (ends - lengths), lengths) + np.arange(total)] if total else np.zeros(0, np.uint32)
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        n = np.diff(edges)
        if whole:
            own = dict(zip(whole, self._batch([texts[i] for i in whole]), strict=True))
            flat = np.concatenate([np.asarray(own[i], np.uint32) if i in own else flat[edges[i] : edges[i + 1]] for i in range(len(texts))] or [flat])
            for i, ids in own.items():
                n[i] = len(ids)
        return flat.astype(np.uint32, copy=False), n


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str, most: int = 700_000) -> PieceEncoder:
    """The worker's encoder for the file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path, most)
    return _ENCODERS[path]


def with_end(flat: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each text."""
    ends = np.cumsum(n)
    return np.insert(flat, ends, end_id).astype(np.uint32), n + 1
