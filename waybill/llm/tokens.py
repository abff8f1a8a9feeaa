"""Encoding whole texts with a tokenizer file, fast enough for corpora.

``Encoder`` gives exactly the ids of the library's own ``encode``; it only avoids
encoding the same piece of text twice. A text is cut before single spaces and line ends
that stand between two visible characters. Byte-level pre-tokenization never joins
characters across such a place, so the pieces can be encoded one by one and remembered.
"""

from __future__ import annotations

import os
import re

import numpy as np

MEMO = 1 << 18  # pieces remembered per Python worker

# a space between two visible characters; Python's \s holds all of Unicode's white space
_CUT = re.compile(r"(?<=\S) (?=\S)")
# where one of these is, spaces and line ends may not stand between visible characters
_ODD = ["  ", " \n", "\n ", "\n\n"]
_ODD += [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"  # of ASCII, without the apostrophe of contractions
# a word after a space or a line end, and marks: each part is a pre-token of its own
_PLAIN = re.compile(rf"(\n?)([{_L}]+)([{_MARKS}]*)")
_ADDED = re.compile(rf"[{_L}]*[{_MARKS}]*")


def _odd(text: str) -> bool:
    return text[0].isspace() or text[-1].isspace() or any(map(text.__contains__, _ODD))


class _Memo(dict):
    """Ids of pieces, encoded where one is first looked up. Half of the pieces are those
    met last; when that half is full it becomes the other, which is forgotten."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.half, self.before = encode, limit // 2, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian bytes of ``dtype`` (two bytes where the ids fit)."""

    def __init__(self, path: str, memo: int = MEMO):
        # one thread per Spark task: the cores belong to the other tasks
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        # by a piece without the space before it; after a line end, with the line end
        self.memo = _Memo(self._piece, memo)
        state = str(self.tokenizer.pre_tokenizer)
        self.cuttable = (
            self.tokenizer.normalizer is None
            and isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel)
            and "add_prefix_space=False" in state
            and "use_regex=True" in state
            and not any(" " in t.content or "\n" in t.content or t.normalized or t.lstrip or t.rstrip
                        for t in self.tokenizer.get_added_tokens_decoder().values())
        )
        if self.cuttable:
            letters = re.findall(f"[{_L}]", "".join(map(chr, range(0x100))))
            spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
            marks = re.findall(f"[{_MARKS}]", "".join(map(chr, range(0x80))))
            self.letters = {ord(c): spell(c)[0][0] for c in [*letters, *marks, *" \n"]}
            added = self.tokenizer.get_added_tokens_decoder().values()
            self.plain = not any(_ADDED.fullmatch(t.content) for t in added)
            width = np.dtype(self.dtype).itemsize
            last = max(self.tokenizer.get_vocab().values())
            self.ids = [i.to_bytes(width, "little") for i in range(last + 1)]
            self.model = self.tokenizer.model
            self.line = self._token(self.letters[10])
            self.marks = {c: self._token(c) for c in marks}

    def pack(self, ids) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.cuttable or not text:
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if _odd(text):
            pieces = _CUT.split(text)
        else:
            pieces = text.replace("\n", " \n").split(" ")
        # no space stands before the first one
        return self._whole(pieces[0]) + b"".join(map(self.memo.__getitem__, pieces[1:]))

    def _token(self, word: str) -> bytes:
        """One pre-token of the letters and marks that ``_PLAIN`` knows."""
        if not word.isascii():
            word = word.translate(self.letters)
        elif word[0] == " ":
            word = self.letters[32] + word[1:]
        ids = self.ids
        return b"".join([ids[t.id] for t in self.model.tokenize(word)])

    def _whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _piece(self, piece: str) -> bytes:
        plain = self.plain and _PLAIN.fullmatch(piece)
        if not plain:
            return self._whole(piece if piece[0] == "\n" else " " + piece)
        line, word, mark = plain.groups()
        if mark:
            ids = self.marks.get(mark) or self._token(mark)
            return self.memo[line + word] + ids
        return self.line + self._token(word) if line else self._token(" " + word)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
