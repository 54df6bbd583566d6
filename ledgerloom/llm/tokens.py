"""Token ids of whole texts by the ``tokenizers`` library.

Byte-level BPE never merges across a space that starts a word, so the library encodes
each distinct space-delimited piece once and texts are put together from the pieces.
``tests/llm`` holds the result against the library's own encoding of the whole text.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2

# A space between two white-space characters, or before the end after one, belongs to a
# longer run: such texts are encoded whole.
_ODD = re.compile(r"\s (?:\s|\Z)")
_CACHE_ROWS = 1_000_000
# Closing marks, which are a unit of their own after letters.
_MARKS = ".,!?;:$%&*#|"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces(dict):
    """Ids (little-endian unsigned 32-bit) of ``lead`` + piece, encoded when first asked for.

    ``word,`` is put together from ``word`` and ``,``, and lines from their parts, since
    the library never merges across these places; other shapes are encoded as they are.
    When full, rare pieces are encoded each time.
    """

    def __init__(self, lead: str, owner: PieceTokenizer) -> None:
        super().__init__()
        self.lead, self.owner = lead, owner

    def __missing__(self, piece: str) -> bytes:
        owner = self.owner
        core = piece.rstrip(_MARKS)
        if core.isalpha():
            if core == piece:
                ids = owner.unit(self.lead + piece)
            else:
                ids = self[core] + owner.marks(piece[len(core) :])
        else:
            lines = piece.split("\n")
            if len(lines) > 1 and not any(x == "" or x[0].isspace() or x[-1].isspace() for x in lines):
                ids = owner.line_feed.join([self[lines[0]], *map(owner.plain.__getitem__, lines[1:])])
            else:
                ids = owner.whole(self.lead + piece)
        if len(self) < _CACHE_ROWS:
            self[piece] = ids
        return ids


class PieceTokenizer:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        # The model's own alphabet writes each byte as one character.
        alphabet = ByteLevel(False, use_regex=False)
        self._letters = {bytes([b]).decode("latin-1"): None for b in range(256)}
        for b in range(128):
            self._letters[chr(b)] = alphabet.pre_tokenize_str(chr(b))[0][0]
        for c in range(128, 2048):  # each two-byte character shows its lead and tail bytes
            raw, shown = chr(c).encode(), alphabet.pre_tokenize_str(chr(c))[0][0]
            for b, s in zip(raw, shown, strict=True):
                self._letters[chr(b)] = s
        self._table = str.maketrans({k: v for k, v in self._letters.items() if v is not None})
        self._model = self.library.model.tokenize
        self._marks: dict[str, bytes] = {}
        self.line_feed = self.whole("\n")
        self.spaced, self.plain = _Pieces(" ", self), _Pieces("", self)

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def unit(self, text: str) -> bytes:
        """Letters with or without a space in front: one unit of the library's pattern."""
        if not text.isascii():
            raw = text.encode("utf-8")
            if max(raw) > 0xDF:  # characters beyond two bytes
                return self.whole(text)
            text = raw.decode("latin-1").translate(self._table)
        elif text[0] == " ":
            text = self._letters[" "] + text[1:]
        return array("I", [t.id for t in self._model(text)]).tobytes()

    def marks(self, text: str) -> bytes:
        found = self._marks.get(text)
        if found is None:
            found = self.whole(text)
            if len(self._marks) < _CACHE_ROWS:
                self._marks[text] = found
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, without special tokens; a null text has none."""
        spaced, plain, out = self.spaced.__getitem__, self.plain.__getitem__, []
        for text in texts:
            if not text:
                out.append(b"")
            elif _ODD.search(text):
                out.append(self.whole(text))
            else:
                head, *tail = text.split(" ")
                out.append(b"".join([plain(head) if head else b"", *map(spaced, tail)]))
        return out


_loaded: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    """The process's tokenizer for a vocabulary file; Spark reuses Python workers."""
    if path not in _loaded:
        _loaded[path] = PieceTokenizer(path)
    return _loaded[path]


def ids_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")
