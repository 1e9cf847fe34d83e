"""Tables of distinct chunks: each distinct piece of text between hard boundaries is encoded once per worker.

A chunk boundary is a place that no token can cross.  For the ``tokenizers``
files whose pre-tokenizer drops white space it is ASCII white space; for
SentencePiece models whose pieces hold the word marker only in front it is the
place before a run of markers.  Where a file has no such boundary the whole
text is one chunk, which is always right.  Ids are joined back by position.
"""

from __future__ import annotations

import json
import os
import re
import string
import sys
from array import array
from functools import lru_cache

import numpy as np

#: Bytes of distinct chunks that one Python worker keeps, the longest of them, and what an entry takes besides its bytes;
#: what comes later or is longer is encoded where it is met, which changes no result.
TABLE_BYTES, CHUNK_BYTES, ENTRY_BYTES = 48 << 20, 256, 170
_MARK = "▁"
#: Marks that may close a word: ASCII ones but for the apostrophe, which has patterns of its own.
_MARKS = string.punctuation.replace("'", "").encode()


def ids_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes() if array("I").itemsize != 4 or sys.byteorder != "little" else array("I", ids).tobytes()


class ChunkTable:
    """Ids of whole texts as bytes of little-endian unsigned 32-bit integers, through a table of distinct chunks."""

    def __init__(self) -> None:
        self.table: dict[bytes, bytes] = {}
        self.held = 0

    def split(self, text: str) -> list[bytes]:
        raise NotImplementedError

    def encode(self, chunks: list[bytes]) -> list[bytes]:
        raise NotImplementedError

    def texts(self, texts: list[str]) -> list[bytes]:
        """Chunks come from the table; those that a few texts lack are encoded at once and enter it while there is room."""
        get, out = self.table.get, []
        for at in range(0, len(texts), 256):
            lacking = []
            for t in texts[at : at + 256]:
                chunks = self.split(t)
                ids = list(map(get, chunks))
                try:
                    out.append(b"".join(ids))
                except TypeError:  # None stands for what is not in the table
                    lacking.append((len(out), chunks, ids))
                    out.append(b"")
            if lacking:
                new = list({c for _, chunks, ids in lacking for c, x in zip(chunks, ids, strict=True) if x is None})
                made = dict(zip(new, self.encode(new), strict=True))
                self.enter(made)
                for i, chunks, ids in lacking:
                    out[i] = b"".join([made[c] if x is None else x for c, x in zip(chunks, ids, strict=True)])
        return out

    def enter(self, made: dict[bytes, bytes]) -> None:
        """Frequent chunks come first in any text, so a full table stays as it is."""
        for chunk, ids in made.items():
            if self.held >= TABLE_BYTES:
                return
            if len(chunk) <= CHUNK_BYTES and chunk not in self.table:
                self.table[chunk] = ids
                self.held += len(chunk) + len(ids) + ENTRY_BYTES


class WordChunks(ChunkTable):
    """A ``tokenizers`` file; chunks are what ASCII white space parts, if the file allows."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            self.parted = drops_white_space(json.load(f))

    def split(self, text: str) -> list[bytes]:
        raw = text.encode("utf-8")
        return raw.split() if self.parted else [raw]

    def encode(self, chunks: list[bytes]) -> list[bytes]:
        """A chunk is encoded as a word and the marks behind it, each of them once."""
        if not self.parted:
            return self.whole(chunks)
        parts = [word_and_marks(c) for c in chunks]
        words = set().union(*parts)
        known = {w: self.table[w] for w in words & self.table.keys()}
        new = words - known.keys()
        plain = {w: x for w in new if (x := plain_letters(w)) is not None}
        made = {w: ids_bytes([t.id for t in self.model.tokenize(x)]) for w, x in plain.items()}
        rest = list(new - plain.keys())
        made.update(zip(rest, self.whole(rest), strict=True))
        self.enter(made)
        made.update(known)
        return [b"".join([made[x] for x in p]) for p in parts]

    def whole(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([c.decode("utf-8") for c in texts], add_special_tokens=False)
        return [ids_bytes(e.ids) for e in found]


def word_and_marks(chunk: bytes) -> tuple[bytes, ...]:
    """Parts of a chunk that are encoded apart with the same result: marks behind a letter or digit, and ASCII words in lower case; a chunk that may hold a special string stays whole."""
    if b"<|" in chunk:
        return (chunk,)
    word = chunk.rstrip(_MARKS)
    if len(word) == len(chunk) or not (word[-1:].isalnum() or ends_with_letter(word)):
        return (chunk.lower() if chunk.isascii() else chunk,)
    return (word.lower() if word.isascii() else word), chunk[len(word) :]


def ends_with_letter(word: bytes) -> bool:
    """Of the Latin ones beyond ASCII, but for the one that ends with a mark in lower case."""
    last = word[-2:].decode("utf-8", "ignore")[-1:]
    return word[-1:] >= b"\x80" and "\x80" <= last < "\u0250" and last.isalpha() and last != "\u0130"


#: The characters by which byte-level models write bytes: printable ones stand for themselves, others follow from U+0100.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = dict(zip([*_SHOWN, *(b for b in range(256) if b not in _SHOWN)], [*map(chr, _SHOWN), *map(chr, range(256, 512))], strict=False))


def plain_letters(word: bytes) -> str | None:
    """What normaliser and pre-tokenizer make of a word of Latin letters (one token in lower case); None for others.

    Letters below U+0250 need no composition and but one of them changes its length in lower case.
    """
    if word.isalpha():
        return word.decode("ascii").lower()
    text = word.decode("utf-8")
    if text.isalpha() and max(text) < "\u0250" and "\u0130" not in text:
        return text.lower().encode("utf-8").decode("latin-1").translate(BYTE_CHARS)
    return None


def drops_white_space(spec: dict) -> bool:
    """Whether no token and no normaliser of a ``tokenizers`` file can see across ASCII white space."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    kept = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    blind = re.fullmatch(r"(?:'\w+\|)*\[\\p\{L\}\]\+\|\[\\p\{N\}\]\+?\|\[\^\\s\\p\{L\}\\p\{N\}\]\+", pattern) is not None
    local = all(n.get("type") in ("NFC", "Lowercase") or n.get("pattern") == {"Regex": "\\s+"} for n in norm.get("normalizers") or [norm])
    bytes_ = (pre.get("pretokenizers") or [pre])[1:]
    bytewise = len(bytes_) == 1 and bytes_[0].get("type") == "ByteLevel" and not bytes_[0].get("add_prefix_space") and not bytes_[0].get("use_regex")
    lower = any(n.get("type") == "Lowercase" for n in norm.get("normalizers") or [norm])
    added = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"])) for a in spec.get("added_tokens") or [])
    return kept and blind and local and lower and bytewise and spec.get("post_processor") is None and added


class MarkedChunks(ChunkTable):
    """A SentencePiece model; a chunk is a run of word markers and what follows up to the next run."""

    def __init__(self, path: str) -> None:
        super().__init__()
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        inner = re.compile(f"[^{_MARK}]{_MARK}")
        # a dummy prefix, spaces kept, and no piece with a marker behind another character
        self.parted = (
            not any(inner.search(m.id_to_piece(i)) for i in range(m.get_piece_size()))
            and m.encode("a", out_type=str)[0].startswith(_MARK)
            and m.decode(m.encode(" a  b ")) == " a  b "
        )
        self.marker = ids_bytes([m.piece_to_id(_MARK)])

    def split(self, text: str) -> list[bytes]:
        if not self.parted or not text:
            return [text.encode("utf-8")] if text else []
        raw = (" " + text.replace(_MARK, " ")).encode("utf-8")
        if b"  " not in raw and raw[-1:] != b" ":
            return raw[1:].split(b" ")
        return [c[1:] for c in re.findall(rb" +[^ ]*", raw)]

    def encode(self, chunks: list[bytes]) -> list[bytes]:
        ids = self.model.encode([c.decode("utf-8") for c in chunks], num_threads=1)
        return [ids_bytes(i) if c or not self.parted else self.marker for c, i in zip(chunks, ids, strict=True)]


@lru_cache(maxsize=1)
def chunk_table(path: str) -> ChunkTable:
    """One table for each Python worker; a task with another file starts another."""
    return MarkedChunks(path) if path.endswith(".model") else WordChunks(path)


@lru_cache(maxsize=4)
def vocabulary(name: str) -> str:
    """The place of a public tokenizer file; a path stays as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
