"""Token ids of whole texts, by the tokenizers library, with each distinct piece encoded once per worker."""

from __future__ import annotations

import json
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from ._text import U, as_bytes, mix, powers, text_slices

#: Distinct pieces that a worker keeps.
CACHE = 1_000_000

_WORD = re.compile("( ?)([a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-įı-ȿ]+)")

_SPACE, _LETTER, _OTHER, _ODD = 0, 1, 2, 3
_class = np.full(256, _OTHER, np.uint8)
_class[[0x20, 0x0A]] = _SPACE
_class[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_class[[*range(0x00, 0x0A), *range(0x0B, 0x20), 0x7F]] = _ODD


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The pattern of the pre-tokenizer that cuts words out of lower-cased text.
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits_known(settings: dict) -> bool:
    """Whether a tokenizer is of one of the two kinds whose splitting places the encoder knows."""
    model, before, normal = settings["model"], settings.get("pre_tokenizer") or {}, settings.get("normalizer")
    if model.get("type") != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or settings.get("truncation") or settings.get("padding"):
        return False
    if before.get("type") == "ByteLevel":
        return normal is None and bool(before.get("use_regex", True)) and not before["add_prefix_space"]
    if before.get("type") != "Sequence" or len(before["pretokenizers"]) != 2 or not normal or normal.get("type") != "Sequence":
        return False
    cut, level = before["pretokenizers"]
    words = cut.get("type") == "Split" and cut["pattern"] == {"Regex": _WORDS} and cut["behavior"] == "Removed" and cut["invert"]
    plain = level.get("type") == "ByteLevel" and not level["use_regex"] and not level["add_prefix_space"]
    return bool(words and plain and [n["type"] for n in normal["normalizers"]] == ["NFC", "Replace", "Lowercase"])


def _byte_symbols() -> dict[int, str]:
    """The byte-level vocabularies' symbol of each byte: itself if it prints, else the next from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SYMBOLS = _byte_symbols()


class Encoder:
    """Ids of many texts at once.

    Both vocabularies' pre-tokenizers always split before white space that follows something else,
    where a run of letters ends, and after a lone line feed, and no merge crosses a split. So a
    text's ids are those of its pieces between such places, and pieces repeat far more often than
    texts. A new piece that is one plain word goes straight to the library's model, another through
    all of it. Texts with control characters or letters beyond Latin are encoded as they are, and so
    are all texts if the tokenizer is of another kind.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.lower = self.tokenizer.normalizer is not None
        self.by_pieces = splits_known(json.loads(self.tokenizer.to_str()))
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.empty(0, U)  # sorted
        self.slots = np.empty(0, np.int64)
        self.begin, self.length = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.asarray(e.ids, np.uint32) for a in range(0, len(texts), 2000) for e in run(texts[a : a + 2000], add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids: list = [None] * len(pieces)
        rest, tokenize = [], self.tokenizer.model.tokenize
        for i, piece in enumerate(pieces):
            m = _WORD.fullmatch(piece)
            if m is None:
                rest.append(i)
                continue
            word = m[2].lower() if self.lower else piece
            ids[i] = [t.id for t in tokenize(word.encode().decode("latin-1").translate(_SYMBOLS))]
        for i, x in zip(rest, self.encode([pieces[i] for i in rest]), strict=True):
            ids[i] = x.tolist()
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((t for x in ids for t in x), np.uint32, int(length.sum()))
        begin = len(self.pool) + np.cumsum(length) - length
        slots = np.arange(len(self.begin), len(self.begin) + len(ids))
        self.pool, self.begin, self.length = np.concatenate([self.pool, flat]), np.concatenate([self.begin, begin]), np.concatenate([self.length, length])
        every, slots = np.concatenate([self.hashes, hashes]), np.concatenate([self.slots, slots])
        order = np.argsort(every, kind="stable")
        self.hashes, self.slots = every[order], slots[order]

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of simple texts, and how many each has."""
        n = len(data)
        cls = _class[data]
        start = np.zeros(n, bool)
        space, letter = cls == _SPACE, cls == _LETTER
        start[1:] = (space[1:] & ~space[:-1]) | (letter[:-1] & ~letter[1:])
        lone = (data[1:-1] == 0x0A) & ~space[:-2] & ~space[2:]
        start[2:] |= lone
        inner = offsets[:-1][offsets[:-1] < offsets[1:]]
        start[inner] = True
        if len(inner):  # a line feed that begins a text is no lone one of the rule above: nothing stands before it
            second = inner + 1
            second = second[second < n]
            start[second] &= ~(data[second - 1] == 0x0A) | np.isin(second, inner) | space[second] & ~space[second - 1]
        at = np.flatnonzero(start)
        end = np.append(at[1:], n)
        p, inv = powers(n + 1)
        total = np.empty(n + 1, U)
        total[0] = 0
        np.add(data, U(1), out=total[1:])
        total[1:] *= p[:n]
        np.cumsum(total[1:], out=total[1:])
        h = mix((total[end] - total[at]) * inv[at] + (end - at).astype(U))
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE:
            self._forget()
        place = np.searchsorted(self.hashes, distinct)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == distinct[known]
        if not known.all():
            raw, new = data.tobytes(), first[~known]
            self._learn(distinct[~known], [raw[a:b].decode() for a, b in zip(at[new].tolist(), end[new].tolist(), strict=True)])
            place = np.searchsorted(self.hashes, distinct)
        slot = self.slots[place][inverse]
        length = self.length[slot]
        done = np.cumsum(length)
        ids = self.pool[np.repeat(self.begin[slot] - (done - length), length) + np.arange(int(done[-1]) if len(done) else 0)]
        by_text = np.concatenate([[0], done])[np.searchsorted(at, offsets)]
        return ids, np.diff(by_text)

    def many(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and how many each text has (null: none)."""
        data, offsets = as_bytes(column)
        ids, counts = [], []
        for a, b in text_slices(offsets):
            if not self.by_pieces:
                got = self.encode([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(a, b)])
                ids += got
                counts.append(np.array([len(x) for x in got], np.int64))
                continue
            part, offs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            bad = _class[part] == _ODD
            lead = part >= 0xC0
            if lead.any():
                at = np.flatnonzero(lead)
                two = part[np.minimum(at + 1, len(part) - 1)]
                head = part[at]
                bad[at] = ~((head >= 0xC3) & (head <= 0xC8)) | ((head == 0xC3) & ((two == 0x97) | (two == 0xB7))) | ((head == 0xC4) & (two == 0xB0))
            odd = np.diff(np.concatenate([[0], np.cumsum(bad)])[offs]) > 0
            if not odd.any():
                x, c = self._pieces(part, offs) if len(part) else (np.empty(0, np.uint32), np.zeros(b - a, np.int64))
                ids.append(x)
                counts.append(c)
                continue
            for i in range(a, b):
                text = data[offsets[i] : offsets[i + 1]]
                if odd[i - a]:
                    x = self.encode([text.tobytes().decode()])[0]
                elif len(text):
                    x = self._pieces(text, np.array([0, len(text)]))[0]
                else:
                    x = np.empty(0, np.uint32)
                ids.append(x)
                counts.append(np.array([len(x)]))
        if not counts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        return np.concatenate(ids), np.concatenate(counts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
