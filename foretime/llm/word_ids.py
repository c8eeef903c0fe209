"""Encoding whole texts with a public tokenizer that drops white space and marks word ends.

Such a tokenizer treats the words between white space apart from each other, so of a block
of texts each distinct word is encoded once. Words go through the library behind each
other in one call, and the bytes that their ids stand for tell where each ends. Words
that hold added tokens or wide white space, and those of a call whose bytes don't add up,
are encoded one by one. Nothing is kept from block to block.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CALL_WORDS = 1 << 14
WORD_END = "</w>"
MARKS = ".,;:!?"
#: Letters with at most one mark behind them: two units of the tokenizer.
LETTERS_AND_MARK = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+[.,;:!?]?$"
WIDE_SPACE = re.compile(r"[^\S ]")

_encoders: dict[str, "WordEncoder"] = {}


def default_word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def word_encoder(path: str) -> "WordEncoder":
    """The worker's own encoder of that file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of consecutive runs, each from its start on."""
    ends = np.cumsum(lengths)
    return np.repeat((starts - (ends - lengths)).astype(np.int32), lengths) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.widths = np.zeros(self.library.get_vocab_size(), np.int64)
        for word, i in vocab.items():
            self.widths[i] = len(word.removesuffix(WORD_END))
        self.mark_id = np.zeros(128, self.kind)
        for m, ids in zip(MARKS, self._one_by_one(list(MARKS)), strict=True):
            self.mark_id[ord(m)], = ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null text is empty."""
        ids, counts = self.encode_block(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(counts)[:-1])

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and how many each has."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        pool, starts, lengths = self._words(words.dictionary)
        at = words.indices.to_numpy()
        each = lengths[at]
        ids = pool[runs(starts[at], each)]
        upto = np.concatenate(([0], np.cumsum(each)))[np.asarray(split.offsets) - split.offsets[0].as_py()]
        return ids, np.diff(upto)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids with the start and length of each word's. Words are put together from
        what they share: letters apart from their mark, ASCII letters in lower case."""
        simple = pc.match_substring_regex(words, LETTERS_AND_MARK)
        stems = pc.if_else(simple, pc.utf8_rtrim(words, MARKS), words)
        stems = pc.if_else(pc.and_(simple, pc.string_is_ascii(stems)), pc.ascii_lower(stems), stems).dictionary_encode()
        has = pc.and_(simple, pc.match_substring_regex(words, "[.,;:!?]$")).to_numpy(zero_copy_only=False)
        pool, starts, lengths = self._pool(stems.dictionary.to_pylist())
        at = stems.indices.to_numpy()
        of = lengths[at]
        whole = of + has
        first = np.cumsum(whole) - whole
        out = np.empty(int(whole.sum()), self.kind)
        out[runs(first, of)] = pool[runs(starts[at], of)]
        marked = np.flatnonzero(has)
        last = np.frombuffer(words.buffers()[2], np.uint8)[np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1:][marked] - 1] if len(marked) else marked
        out[first[marked] + of[marked]] = self.mark_id[last]
        return out, first, whole

    def _pool(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odd = set()
        joined = " ".join(words)
        if "" in words or WIDE_SPACE.search(joined) or any(a in joined for a in self.added):
            odd = {i for i, w in enumerate(words) if not w or WIDE_SPACE.search(w) or any(a in w for a in self.added)}
        plain = np.array([i for i in range(len(words)) if i not in odd], np.int64)
        lengths, parts, order = np.zeros(len(words), np.int64), [], []
        for at in range(0, len(plain), CALL_WORDS):
            places = plain[at:at + CALL_WORDS]
            found = self._together([words[i] for i in places])
            if found is None:
                odd.update(places.tolist())
                continue
            parts.append(found[0])
            lengths[places] = found[1]
            order.append(places)
        rest = sorted(odd)
        for ids in self._one_by_one([words[i] for i in rest]):
            parts.append(np.array(ids, self.kind))
        lengths[rest] = [len(p) for p in parts[len(parts) - len(rest):]]
        order = np.concatenate([*order, np.array(rest, np.int64)])
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate([*parts, np.empty(0, self.kind)]), starts, lengths

    def _one_by_one(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words without white space, and how many each has."""
        text = " ".join(words)
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        plain = (text if text.isascii() else unicodedata.normalize("NFC", text).lower()).encode()
        spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
        ends = np.append(spaces, len(plain)) - np.arange(len(spaces) + 1)
        upto = np.cumsum(self.widths[ids])
        if len(ends) != len(words) or not len(upto) or upto[-1] != ends[-1]:
            return None
        cuts = np.searchsorted(upto, ends)
        return (ids, np.diff(cuts + 1, prepend=0)) if (upto[cuts] == ends).all() else None
