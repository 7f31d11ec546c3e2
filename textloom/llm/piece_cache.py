"""Encoding with the tokenizers library, each distinct piece of text once per worker.

A byte-level BPE splits text before it merges.  A single space between two visible characters always
begins a new split, a single line feed between them is one, and punctuation that follows letters begins
one.  So a text is cut there, and the library encodes each distinct piece, with its leading space, by
itself; the ids of the pieces are the ids of the text.  Cuts are made only between characters of which every Unicode version says that they
are visible.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Of distinct pieces in a generation of what a worker remembers.  Results do not depend on it.
CACHE_PIECES = 350_000

#: A space beside anything else than these is not cut at.
_SAFE = "!-~¡-¬®-ɏ"
_ODD = re.compile(f"[^ \n{_SAFE}]")
#: A text of which not every space and line feed is a place to cut, as a pattern of Arrow.
_UNEVEN = f"[^ \n{_SAFE}]|  |\n |\n\n| \n|\\A[ \n]|[ \n]\\z"
_SAFE_SPACE = re.compile(f"(?<=[{_SAFE}]) (?=[{_SAFE}])")
#: Letters up to U+024F, which every Unicode version knows, then ASCII punctuation.
_LETTERS, _SIGNS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", r"!-/:-@\[-`{-~"
_PLAIN = re.compile(f"( ?[{_LETTERS}]+)([{_SIGNS}]*)")
#: What the pattern does not split any more, of the parts between marks; no text that is cut has a mark.
_SPLIT, _MARK = re.compile(f" ?[{_LETTERS}]+|[{_SIGNS}]+"), "\x01"


def cut_text(text: str) -> list[str]:
    """The text cut in front of safe spaces and line feeds.

    The first piece is as it is.  Each other one had a space before it, unless it begins with a line
    feed, which is a split by itself between visible characters.
    """
    if _ODD.search(text) or "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[:1] in " \n" or text[-1:] in " \n":
        return _SAFE_SPACE.split(text)
    return text.replace("\n", " \n").split(" ")


def with_lead(piece: str) -> list[str]:
    """Parts of a piece of :func:`cut_text` that are encoded by themselves."""
    return ["\n", piece[1:]] if piece[:1] == "\n" else [" " + piece]


def letters_and_tail(piece: str) -> tuple[str, str] | None:
    """(letters with or without a space, ASCII punctuation) of a piece that is nothing else, or None."""
    plain = _PLAIN.fullmatch(piece)
    return plain.groups() if plain else None


def even_texts(texts: pa.Array) -> np.ndarray:
    """Of which texts every space and line feed is a place to cut."""
    return ~np.asarray(pc.match_substring_regex(texts, _UNEVEN))


def coded_parts(texts: pa.Array, ids_of: Callable[[list[str]], list[bytes]]) -> list[np.ndarray]:
    """Ids of each of the :func:`even_texts`; ``ids_of`` gives those of its parts, each once for all texts.

    A part is letters, or begins with something else; one that is not :func:`one_split` has several splits.
    """
    if not len(texts):
        return []
    marked = pc.replace_substring(pc.replace_substring(texts, " ", f"{_MARK} "), "\n", f"{_MARK}\n{_MARK}")
    parts = pc.split_pattern(pc.replace_substring_regex(marked, f"([{_LETTERS}])([{_SIGNS}])", f"\\1{_MARK}\\2"), _MARK)
    coded = parts.flatten().dictionary_encode()
    blobs = ids_of(coded.dictionary.to_pylist())
    sizes = np.array([len(x) >> 2 for x in blobs], np.int64)
    # ids of each part in its places: one gather for all texts
    lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(np.frombuffer(b"".join(blobs), "<u4")))
    flat, ends = lists.take(coded.indices).flatten().to_numpy(), np.cumsum(np.asarray(pc.list_value_length(parts)))
    until = np.concatenate([[0], np.cumsum(sizes[np.asarray(coded.indices)])])[np.concatenate([[0], ends])].tolist()
    return [flat[a:b] for a, b in zip(until, until[1:])]


def one_split(part: str) -> bool:
    """Whether the pattern does not split a part any more, as its characters say."""
    return _SPLIT.fullmatch(part) is not None


class _Pieces(dict):
    """Ids as bytes by piece; fills itself, and forgets what two generations have not used."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.before = encode, {}

    def __missing__(self, piece: str) -> bytes:
        done = self.before.get(piece)
        if done is None:
            done = self.encode(piece)
        if len(self) >= CACHE_PIECES:
            self.before = dict(self)
            self.clear()
        self[piece] = done
        return done


class PieceEncoder:
    """Token ids of whole texts as unsigned 32-bit little-endian bytes."""

    _loaded: dict[str, PieceEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the library takes out of a text before it splits; texts with one are encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.alone = self._splits_at_spaces()
        self.newline = self._encode_whole("\n")
        # the library writes byte b as a printable character: itself, or the next free one from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in shown)}
        self.spaced = _Pieces(self._encode_piece)
        self.words = _Pieces(self._encode_split)
        self.parts = _Pieces(self._encode_alone)

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _splits_at_spaces(self) -> bool:
        """Whether this tokenizer is byte-level and changes nothing before it splits."""
        pre = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer is not None or type(pre).__name__ != "ByteLevel" or pre.add_prefix_space or not pre.use_regex:
            return False
        return [x for x, _ in pre.pre_tokenize_str("a b, c.\nd")] == ["a", "Ġb", ",", "Ġc", ".", "Ċ", "d"]

    def _encode_whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_split(self, part: str) -> bytes:
        """Ids of a part that the pattern does not split any more."""
        # ASCII letters and punctuation are shown as themselves
        shown = part.replace(" ", "Ġ") if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def _encode_part(self, part: str) -> bytes:
        """Ids of letters and ASCII punctuation, or of anything."""
        plain = letters_and_tail(part)
        if plain is None:
            return self._encode_whole(part)
        word, tail = plain
        return self.words[word] + self.words[tail] if tail else self.words[word]

    def _encode_piece(self, piece: str) -> bytes:
        parts = with_lead(piece)
        return self._encode_part(parts[0]) if len(parts) == 1 else self.newline + self._encode_part(parts[1])

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return self._encode_whole(text)
        first, *rest = cut_text(text) if self.alone else [text]
        spaced = self.spaced
        return self._encode_whole(first) + b"".join([spaced[w] for w in rest])

    def _encode_alone(self, part: str) -> bytes:
        return self._encode_split(part) if one_split(part) else self._encode_whole(part)

    def encode_many(self, texts: pa.Array) -> list[np.ndarray]:
        """:meth:`encode` of each text, null as empty; a part is looked up once for all of them."""
        texts = pc.fill_null(texts, "")
        even = even_texts(texts) if self.alone else np.zeros(len(texts), bool)
        if self.alone:
            for x in self.added:
                even &= ~np.asarray(pc.match_substring(texts, x))
        known = self.parts
        coded = iter(coded_parts(texts.filter(pa.array(even)), lambda parts: [known[x] for x in parts]))
        return [next(coded) if e else np.frombuffer(self.encode(t.as_py()), "<u4") for t, e in zip(texts, even.tolist())]
