"""Encoding whole texts with a public byte-level tokenizer.

A text is cut before each space, where this kind of tokenizer cuts too, and pieces
not seen before are encoded by the library and remembered by the worker. A cut does
not hold for a space that stands between other white space, or after it at the
end, nor beside a token that the tokenizer adds to its vocabulary (it is found by its
name before a text is cut); a text with such a space or name is encoded as a whole.

A block of texts goes through Arrow instead: each of its distinct pieces is put together
from its letters (or digits) and the marks behind them, which are units of their own to the
tokenizer. Letters come again, so a worker keeps their ids from block to block, up to SEEN_BYTES.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foretime.llm.word_ids import runs

#: Pieces that a worker remembers; beyond that it keeps those of the texts at hand.
REMEMBERED = 200_000
#: Bytes of stems and their ids that a worker keeps from block to block; beyond that, those of the block at hand.
SEEN_BYTES = 32 << 20
#: New words per call of the library.
CALL_WORDS = 1 << 14
MARKS = ".,;:!?"
WORD = re.compile(r"\S+")
#: A piece that neither begins nor ends in white space, and what stands for a space in the vocabulary.
CLOSED = re.compile(r"\S(?:.*\S)?", re.DOTALL)
SPACE = "\u0120"
NO_CUT = re.compile(r"\s (?!\S)")
#: The same rule for Arrow, whose own white space is ASCII.
WHITE = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NO_CUT_ARROW = f"{WHITE} (?:{WHITE}|\\z)"
#: Letters or digits and the ASCII marks behind them, maybe the same again behind a line break: each is a unit of the tokenizer.
STEM, MARK = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+|[0-9]+", r"[!-/:-@\[-`{-~]*"
PARTS = rf"^(?P<stem>{STEM})(?P<tail>{MARK})(?:(?P<line>\n)(?P<stem2>(?:{STEM})?)(?P<tail2>{MARK}))?\z"

#: Bytes as a byte-level vocabulary spells them; the space stays, to part units.
SPELLED = np.array([b if 0xA1 <= b != 0xAD or 0x20 <= b < 0x7F else 0x143 if b == 0xAD else b + 0xA2 if b > 0x7E else b + 0x100 for b in range(256)], "<u4")

_encoders: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> "Encoder":
    """The worker's own encoder of that file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.units = Tokenizer(self.library.model)  # the same vocabulary, over units that are cut already
        self.units.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.added = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        self.known: dict[str, bytes] = {}
        self.path = path
        self.kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.seen = self._none()
        self.widths = self._byte_lengths()
        self.marks = dict(zip(MARKS, (x.tobytes() for x in self._ids(list(MARKS))), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null text is empty."""
        cut = [self._pieces(t) for t in texts]
        self._need(set(chain.from_iterable(cut)))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, pieces)), self.kind) for pieces in cut]

    def encode_block(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, each closed by ``end``, and how many each has; a null text is empty."""
        texts = pc.fill_null(texts, "")
        uncut = pc.match_substring_regex(texts, NO_CUT_ARROW)
        for name in self.added.values():
            uncut = pc.or_(uncut, pc.match_substring(texts, name))
        split = pc.split_pattern(pc.if_else(uncut, "", texts), " ")
        pieces, offsets = split.flatten().dictionary_encode(), np.asarray(split.offsets) - split.offsets[0].as_py()
        # what opens a text, or a whole text, has no space before it
        first = pc.if_else(uncut, texts, pc.list_element(split, 0)).dictionary_encode()
        pool, sizes = self._block(pieces.dictionary)
        opening = self._ids(first.dictionary.to_pylist())
        close = np.array([] if end is None else [end], self.kind)
        pool = np.concatenate([pool, *opening, close])
        sizes = np.concatenate((sizes, [len(x) for x in opening], [len(close)])).astype(np.int64)
        at = pieces.indices.to_numpy().copy()
        at[offsets[:-1]] = first.indices.to_numpy() + len(pieces.dictionary)
        at = np.insert(at, offsets[1:], len(sizes) - 1)
        each = sizes[at]
        upto = np.concatenate(([0], np.cumsum(each)))[offsets + np.arange(len(offsets))]
        return pool[runs((np.cumsum(sizes) - sizes)[at], each)], np.diff(upto)

    def _block(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, each behind a space, and how many each has."""
        parts = pc.extract_regex(pieces, PARTS)
        columns = [pc.struct_field(parts, f).filter(parts.is_valid()).dictionary_encode() for f in ("stem", "tail", "line", "stem2", "tail2")]
        found = [self._stems(columns[0].dictionary), *[self._listed(c.dictionary) for c in columns[1:3]],
                 self._units(columns[3].dictionary, ""), self._listed(columns[4].dictionary), self._spaced(pieces.filter(parts.is_null()).to_pylist())]
        ids, n = (np.concatenate(x) for x in zip(*found))
        bases = np.cumsum([0, *[len(sizes) for _, sizes in found]])
        n = np.append(n, 0)  # the last has no ids
        at = np.full((len(pieces), len(columns)), len(n) - 1)
        mask = parts.is_valid().to_numpy(zero_copy_only=False)
        at[mask] = np.stack([c.indices.to_numpy() + base for c, base in zip(columns, bases)], axis=1)
        at[~mask, 0] = np.arange(bases[-2], bases[-1])
        each = n[at]
        return ids[runs((np.cumsum(n) - n)[at.ravel()], each.ravel())], each.sum(axis=1)

    def _listed(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids(texts.to_pylist())
        return np.concatenate([np.empty(0, self.kind), *ids]), np.array([len(x) for x in ids], np.int64)

    def _stems(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As of units behind a space; stems of earlier blocks are not encoded again."""
        known, ids, n = self.seen
        at = pc.index_in(stems, value_set=known)
        more, m = self._units(stems.filter(at.is_null()), SPACE)
        at = at.to_numpy(zero_copy_only=False)
        new = np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), bool)
        place = np.where(new, 0, at).astype(np.int64)
        place[new] = len(known) + np.arange(len(m))
        ids, n = np.concatenate((ids, more)), np.concatenate((n, m))
        found = ids[runs((np.cumsum(n) - n)[place], n[place])], n[place]
        self.seen = pa.concat_arrays([known, stems.filter(pa.array(new))]), ids, n
        if self.seen[0].nbytes + ids.nbytes + n.nbytes > SEEN_BYTES:
            fits = stems.nbytes + found[0].nbytes + found[1].nbytes <= SEEN_BYTES
            self.seen = (stems, *found) if fits else self._none()
        return found

    def _none(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        return pa.array([], pa.string()), np.empty(0, self.kind), np.empty(0, np.int64)

    def _units(self, stems: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stems behind ``before``, and how many each has. With it they are single units of the tokenizer."""
        parts = [(np.empty(0, self.kind), np.empty(0, np.int64))]
        for lo in range(0, len(stems), CALL_WORDS):
            part = stems.slice(lo, CALL_WORDS)
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(part)], part), " ")[0].as_buffer()
            text = before + SPELLED[np.frombuffer(text, np.uint8)].tobytes().decode("utf-32-le").replace(" ", " " + before)
            found, = self.units.encode_batch_fast([text], add_special_tokens=False)
            sizes = pc.binary_length(part).to_numpy().astype(np.int64) + len(before)
            some = sizes > 0
            ids, cut = self._cut(np.array(found.ids, self.kind), np.cumsum(sizes[some]))
            sizes[some] = cut
            parts.append((ids, sizes))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _cut(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and how many stand for each word, that ends at so many bytes."""
        upto = np.cumsum(self.widths[ids])
        cuts = np.searchsorted(upto, ends)
        if not np.array_equal(upto[-1:], ends[-1:]) or not (upto[cuts] == ends).all():
            raise ValueError(f"{self.path} doesn't cut before a space")
        return ids, np.diff(cuts + 1, prepend=0)

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words as they stand behind a space, and how many each has. Those that begin and end
        without white space are encoded behind each other and told apart by the bytes that their ids stand for."""
        plain = np.fromiter((CLOSED.fullmatch(w) is not None for w in words), bool, len(words))
        together, sizes, parts = np.flatnonzero(plain), np.zeros(len(words), np.int64), []
        for lo in range(0, len(together), CALL_WORDS):
            part = [" " + words[i] for i in together[lo:lo + CALL_WORDS]]
            text = "".join(part)
            if self._names_added(text):
                raise ValueError(f"{self.path} adds a name that spans words")
            ids, sizes[together[lo:lo + CALL_WORDS]] = self._cut(*self._ids([text]), np.cumsum([len(w.encode("utf-8", "surrogatepass")) for w in part]))
            parts.append(ids)
        alone = np.flatnonzero(~plain)
        rest = self._ids([" " + words[i] for i in alone])
        sizes[alone] = [len(x) for x in rest]
        order = np.concatenate((together, alone))
        joined = np.concatenate([*parts, *rest, np.empty(0, self.kind)])
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return joined[runs(starts, sizes)], sizes

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, one without white space, as it stands behind a space."""
        self._need(set(words))
        return [np.frombuffer(self.known[w], self.kind) for w in words]

    def _need(self, pieces: set[str]) -> None:
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {p: self.known[p] for p in pieces.difference(new)}
        self._learn(new)

    def _names_added(self, text: str) -> bool:
        return any(name in text for name in self.added.values())

    def _pieces(self, text: str | None) -> list[str]:
        """What stands behind each space. A text's start is told apart by a space before it."""
        if not text:
            return []
        if NO_CUT.search(text) or self._names_added(text):
            return [" " + text]
        pieces = text.split(" ")
        pieces[0] = " " + pieces[0]
        return pieces

    def _learn(self, pieces: set[str]) -> None:
        """Encode new pieces. Words are encoded behind each other in one call and told
        apart by the bytes that their ids stand for."""
        # letters with one mark behind them are two of the tokenizer's own units
        marked = [p for p in pieces if p[-1:] in self.marks and p[:-1].isalpha()]
        pieces = pieces.difference(marked).union([p[:-1] for p in marked]).difference(self.known)
        named = self._names_added("\n".join(pieces))
        plain = [p for p in pieces if WORD.fullmatch(p) and not (named and self._names_added(p))]
        odd = list(pieces.difference(plain))
        for p, ids in zip(odd, self._ids([p[1:] if p[:1] == " " else " " + p for p in odd]), strict=True):
            self.known[p] = ids.tobytes()
        size = self.kind().itemsize
        for at in range(0, len(plain), CALL_WORDS):
            part = plain[at:at + CALL_WORDS]
            text = " " + " ".join(part)
            ids, = self._ids([text])
            raw = text.encode("utf-8", "surrogatepass")
            ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)[1:], len(raw))
            upto = np.cumsum(self.widths[ids])
            cuts = np.searchsorted(upto, ends)
            if not (upto[cuts] == ends).all():
                raise ValueError(f"{self.path} doesn't cut before a space")
            data, cuts = ids.tobytes(), ((cuts + 1) * size).tolist()
            self.known.update(zip(part, map(data.__getitem__, map(slice, [0, *cuts], cuts)), strict=False))
        known, marks = self.known, self.marks
        known.update([(p, known[p[:-1]] + marks[p[-1]]) for p in marked])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _byte_lengths(self) -> np.ndarray:
        """Bytes of text that each id stands for. In this kind of vocabulary every
        character of an entry stands for one byte; an added token stands for its name."""
        with open(self.path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        out = np.zeros(max([*vocab.values(), *self.added]) + 1, np.int64)
        for word, i in vocab.items():
            out[i] = len(word)
        for i, name in self.added.items():
            out[i] = len(name.encode())
        return out
