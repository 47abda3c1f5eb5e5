"""Byte-level BPE ids of whole texts, each distinct word encoded once per worker."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

TOKENIZER = "byte_bpe_50k.json"
#: A lone space between two other characters starts a new pre-token, so encoding may stop
#: before it and go on with it: the ids are those of the whole text.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: A space beside other white space; without it every space is such a cut.
BESIDE = re.compile(r" \s|[^\S ] ")
#: Distinct words remembered by a worker before it starts anew.
MEMORY = 600_000
#: New words encoded in one run.
RUN = 512


@lru_cache(maxsize=1)
def encoder(path: str | None = None) -> "WordCodes":
    """The worker's encoder; it lives as long as the worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return WordCodes(path)


class WordCodes:
    """Ids of texts by way of the ids of their words.

    Null and empty texts have no ids. Texts of any length are taken whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        #: Bytes of text behind each id: one character of a byte-level piece is one byte.
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i)) for i in range(size)], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.codes: dict = {}
        self.new: list[str] = []
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16)
        self.used = 0

    def _code(self, key, text: str) -> int:
        self.codes[key] = code = len(self.codes)
        self.new.append(text)
        return code

    def _learn(self) -> None:
        """Encode new words in long runs; the pieces' bytes tell where each word ends."""
        parts, lengths = [], np.zeros(len(self.new), np.int64)
        runs, at = [], 0
        for k in range(1, len(self.new) + 1):
            # A word without a space in front starts a text; its run ends with it.
            if k == len(self.new) or k - at == RUN or self.new[k][0] != " " or self.new[k - 1][0] != " ":
                runs.append((at, k))
                at = k
        got = self.tokenizer.encode_batch_fast(["".join(self.new[a:b]) for a, b in runs], add_special_tokens=False)
        for (a, b), encoded in zip(runs, got):
            run = np.array(encoded.ids, np.uint16)
            parts.append(run)
            if b - a == 1:
                lengths[a] = len(run)
            else:
                ends = np.cumsum(np.fromiter((len(w.encode()) for w in self.new[a:b]), np.int64, b - a))
                upto = np.searchsorted(np.cumsum(self.bytes_of[run]), ends, "right")
                lengths[a:b] = np.diff(upto, prepend=0)
        ids = np.concatenate(parts)
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(need, np.uint16)])
        self.flat[self.used : need] = ids
        starts = self.used + np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used, self.new = need, []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        if len(self.codes) > MEMORY:
            self._forget()
        get, code = self.codes.get, self._code
        coded: list[int] = []
        words = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if not text:
                continue
            plain = text[0] != " " and text[-1] != " " and not BESIDE.search(text)
            first, *rest = text.split(" ") if plain else CUT.split(text)
            # A text's first word has no space before it: its key is a tuple.
            c = get((first,))
            coded.append(code((first,), first) if c is None else c)
            for w in rest:
                c = get(w)
                coded.append(code(w, " " + w) if c is None else c)
            words[k] = 1 + len(rest)
        if self.new:
            self._learn()
        codes = np.asarray(coded, np.int64)
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[codes] - (ends - lengths), lengths) + np.arange(total)
        ids = self.flat[at]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words)])]
        return ids, np.diff(bounds)


def batches(frames, columns: list[str], text: str, size: int = 4_000_000):
    """Regroup Arrow batches into lists of values with about ``size`` characters of text."""
    held: list[list] = [[] for _ in columns]
    chars, at = 0, columns.index(text)
    for frame in frames:
        for row in zip(*(frame.column(c).to_pylist() for c in columns)):
            for values, value in zip(held, row):
                values.append(value)
            chars += len(row[at] or "")
            if chars >= size:
                yield held
                held, chars = [[] for _ in columns], 0
    if held[0]:
        yield held
