"""Tokenising in tasks with the tokenizers library.

Byte-level BPE cuts a text into pre-tokens and encodes each alone. A pre-token
never goes on across a space that a non-space follows (that space begins the
next one), from an ASCII letter to another ASCII character, or from another ASCII
character than a space or an apostrophe to a letter. So texts are cut there, each
distinct piece is encoded once by the library, and the ids are put together
again, for a whole slice of texts at once. Texts with a space that white space
or nothing follows, or with the string of an added token, are encoded whole, and
so is everything if the tokenizer has other rules for pre-tokens.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .textops import Words

GENERATION = 600_000  # pieces; the cache holds two generations, about 200 MB a worker
_GROUP = 2000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER = np.zeros(256, bool)
_OTHER[:128] = ~_LETTER[:128]
_BEFORE = _OTHER.copy()  # what a letter after it is apart from
_BEFORE[[0x20, 0x27]] = False
_BLANKS = np.zeros(256, bool)
_BLANKS[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_MADE: dict[tuple[str, bool], Encoder] = {}


def _blank_follows(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space, in UTF-8, begins at ``at`` (``buf`` goes on for 3 bytes more)."""
    a, b, c = buf[at], buf[at + 1], buf[at + 2]
    wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    wide |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return _BLANKS[a] | wide


def _starts(data: np.ndarray) -> np.ndarray:
    """Where a piece begins, whatever comes before."""
    out = data == 0x20
    letter = _LETTER[data]
    out[1:] |= letter[:-1] & _OTHER[data[1:]]
    # of several blanks before a letter the last one is apart: what is cut before the letter would not tell
    single = ~_BLANKS[data[1:-1]] | (data[:-2] < 128) & ~_BLANKS[data[:-2]]
    out[2:] |= _BEFORE[data[1:-1]] & single & letter[2:]
    return out


class Encoder:
    """With ``added_tokens`` the string of a special token in a text becomes its id, as in the library; without, it is ordinary text."""

    def __init__(self, path: str, added_tokens: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if added_tokens or not t.special]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        rule = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        plain = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space")
        self.byte_level = plain and self.tokenizer.normalizer is None and all(t.split() == [t] for t in self.added)
        line = self._raw(["\n"])[0]
        self.line = int(line[0]) if len(line) == 1 else None
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, wanted: list[bytes]) -> None:
        """Puts pieces, each with the space before it if there is one, into the cache."""
        plain, odd = [], []
        for piece in wanted:
            text = piece.decode()
            (plain if text.split() == [text.removeprefix(" ")] else odd).append((piece, text))
        for a in range(0, len(plain), _GROUP):
            group = plain[a : a + _GROUP]
            ids = self._raw(["\n".join([text for _, text in group])])[0]
            cut = np.flatnonzero(ids == self.line)
            if len(cut) != len(group) - 1:
                odd += group
                continue
            raw, size = ids.tobytes(), self.kind.itemsize
            first, last = [0, *((cut + 1) * size).tolist()], [*(cut * size).tolist(), len(raw)]
            self.new.update(zip([p for p, _ in group], [raw[x:y] for x, y in zip(first, last, strict=True)], strict=True))
        self.new.update(zip([p for p, _ in odd], [x.tobytes() for x in self._raw([t for _, t in odd])], strict=True))

    def _known(self, wanted: list[bytes]) -> list[bytes]:
        if len(self.new) > GENERATION:
            self.new, self.old = {}, self.new
        self._learn([p for p in wanted if p not in self.new and p not in self.old])
        out = [self.new.get(p) for p in wanted]
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = self.new[wanted[i]] = self.old[wanted[i]]
        return out

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column in a row, and the places where each text's begin (with one more at the end). Null texts are empty."""
        column = pc.fill_null(column, "")
        n = len(column)
        whole = np.ones(n, bool)
        if self.line is not None and self.byte_level:
            words = Words.cut(column, _starts)
            spaces = np.flatnonzero(words.buf[: words.edges[-1]] == 0x20)
            owner = np.searchsorted(words.edges, spaces, "right") - 1
            odd = _blank_follows(words.buf, spaces + 1) | (spaces + 1 == words.edges[owner + 1])
            whole = np.bincount(owner[odd], minlength=n) > 0
            for token in self.added:
                whole |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
            row, start, size = words.row, words.start, words.end - words.start
            codes, _ = pd.factorize(words.hashes())
            first = np.zeros(int(codes.max(initial=-1)) + 1, np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            head = words.heads()
            whole[row[(head != head[first][codes]) | (size != size[first][codes])]] = True  # pieces of one hash that differ
            raw = words.buf.tobytes()
            keep = ~whole[row]
            used, codes = np.unique(codes[keep], return_inverse=True) if not keep.all() else (np.arange(len(first)), codes)
            row, first = row[keep], first[used]
            table = self._known([raw[a:b] for a, b in zip(start[first].tolist(), words.end[first].tolist(), strict=True)])
        else:
            row, codes, table = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        alone = np.flatnonzero(whole)
        table = table + [x.tobytes() for x in self._raw(column.take(pa.array(alone)).to_pylist())]
        codes, row = np.concatenate([codes, len(table) - len(alone) + np.arange(len(alone))]), np.concatenate([row, alone])
        order = np.argsort(row, kind="stable")
        codes, row = codes[order], row[order]
        flat = np.frombuffer(b"".join(table), self.kind)
        size = np.fromiter(map(len, table), np.int64, len(table)) // self.kind.itemsize
        begin = np.cumsum(size) - size
        each = size[codes]
        done = np.cumsum(each) - each
        ids = flat[np.repeat(begin[codes] - done, each) + np.arange(int(each.sum()))]
        return ids, np.r_[0, np.cumsum(np.bincount(row, weights=each, minlength=n).astype(np.int64))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``kind``."""
        ids, edges = self.encode_column(pa.array(texts, pa.string()))
        raw, size = ids.tobytes(), self.kind.itemsize
        return [raw[a * size : b * size] for a, b in zip(edges, edges[1:], strict=False)]


def encoder(path: str, added_tokens: bool = True) -> Encoder:
    """One per worker process; it is kept between tasks."""
    if (path, added_tokens) not in _MADE:
        _MADE[path, added_tokens] = Encoder(path, added_tokens)
    return _MADE[path, added_tokens]


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
