"""Whole-text tokenisation with a per-worker memory of encoded pieces.

A text is cut where no token of its vocabulary can reach across, and every piece is
encoded by the tokenizers library once while it is remembered. The ids are those of
encoding the whole text: byte-level vocabularies join a word only to the one space
before it, word vocabularies drop white space. Columns of texts are cut by Arrow, and
the memory is asked once for each distinct piece of some megabytes of text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLANK_RUN = re.compile(r"\s\s")
_BEFORE_BLANK = re.compile(r"(?<=\S)(?=\s)")
#: A stop begins a token of its own only behind what every vocabulary takes for a letter or digit. What
#: stands before is looked at from the stop, so that other places are passed over.
_LONE_STOP = re.compile(r"[.,](?<![A-Za-z0-9][.,])")
_OWN_STOP = re.compile(r"([.,])(?<=[A-Za-z0-9][.,])")
#: The Latin letters of one or two bytes that every version of Unicode holds for letters in composed form.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SPACED_WORD = re.compile(rf" ?[{_LETTERS}]+\Z")
#: ASCII signs behind a letter or digit are a run of their own in every cutting rule.
_WORD_AND_SIGNS = re.compile(rf"( ?[{_LETTERS}0-9]+)([!-/:-@\[-`{{-~]+)\Z")
_BLANKS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts whose cuts are not all beside a lone space or line end.
_ODD = rf"\x00|[{_BLANKS}][{_BLANKS}]"
_LONE_SIGN = rf"(?:\A|[^{_LETTERS}0-9])[.,]"
#: Bytes of text whose pieces are looked up together.
SLICE = 8 << 20


def tokenizer_path(name: str) -> str:
    """Place of an installed public vocabulary file; a path is returned as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """Code points that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_blanks = self.tokenizer.normalizer is not None
        self.model = self.tokenizer.model
        self.shown = {b: chr(c) for b, c in _byte_letters().items()}
        self.limit = limit
        self.pieces: dict[str, bytes] = {"": b""}
        self.once: dict[str, bytes] = {}

    def _cut(self, text: str) -> list[str]:
        """Pieces of ``text``; a full stop or comma after an ASCII letter or digit starts its own."""
        stops = not _LONE_STOP.search(text)
        if self.drops_blanks:
            text = text.encode().lower().decode().replace("\n", " ")
            return (text.replace(".", " .").replace(",", " ,") if stops else _OWN_STOP.sub(" \\1", text)).split(" ")
        if "\0" in text or _BLANK_RUN.search(text):
            return _BEFORE_BLANK.split(text)
        text = text.replace("\n", "\0\n\0").replace(" ", "\0 ")
        return (text.replace(".", "\0.").replace(",", "\0,") if stops else _OWN_STOP.sub("\0\\1", text)).split("\0")

    def _encode_piece(self, piece: str) -> bytes:
        """A run of Latin letters is one word of every cutting rule; the library cuts all else."""
        if _SPACED_WORD.match(piece):
            if piece.isascii():
                shown = piece.replace(" ", self.shown[32])
            else:
                shown = (piece.lower() if self.drops_blanks else piece).encode().decode("latin-1").translate(self.shown)
            return array("I", [token.id for token in self.model.tokenize(shown)]).tobytes()
        cut = _WORD_AND_SIGNS.match(piece)
        if cut:
            return self._of(cut[1]) + self._of(cut[2])
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _of(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        return self._unknown(piece) if ids is None else ids

    def _unknown(self, piece: str) -> bytes:
        """Ids of a piece not in the lasting memory, where it goes when it is met a second time."""
        ids = self.once.pop(piece, None)
        if ids is not None:
            if len(self.pieces) > self.limit:
                self.once, self.pieces = self.pieces, {"": b""}
            self.pieces[piece] = ids
            return ids
        ids = self._encode_piece(piece)
        if len(piece) <= 64:
            if len(self.once) > self.limit:
                self.once.clear()
            self.once[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Null and empty texts have no ids."""
        return b"".join(map(self._of, self._cut(text))) if text else b""

    def _cut_plain(self, texts: pa.Array) -> pa.ListArray:
        """Pieces of texts cut at lone spaces and line ends, and at stops where all of a text's stand behind words."""
        mark = " " if self.drops_blanks else "\0"
        if self.drops_blanks:
            cut = pc.replace_substring(pc.ascii_lower(texts), "\n", mark)
        else:
            cut = pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 ")
        stops = pc.replace_substring(pc.replace_substring(cut, ".", mark + "."), ",", mark + ",")
        return pc.split_pattern(pc.if_else(pc.match_substring_regex(texts, _LONE_SIGN), cut, stops), mark)

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = self._cut_plain(texts)
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.pieces.get, distinct))
        for k, ids in enumerate(known):
            if ids is None:
                known[k] = self._of(distinct[k])  # an earlier piece may have brought it
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begins, places = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        counts = sizes[places]
        ends = np.cumsum(counts)
        at = np.repeat(begins[places] - (ends - counts), counts)
        at += np.arange(len(at))
        pieces_of = parts.offsets.to_numpy()
        return np.frombuffer(b"".join(known), "<u4")[at], np.concatenate([[0], ends])[pieces_of - pieces_of[0]]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and the offsets of the texts, one more than texts."""
        texts = pc.fill_null(texts, "")
        plain = np.ones(len(texts), bool)
        if not self.drops_blanks:
            plain = ~pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        if plain.all():
            return self._encode_plain(texts)
        ids, offsets = self._encode_plain(texts.filter(pa.array(plain)))
        found: list[np.ndarray] = [ids[:0]] * len(texts)
        for k, a, b in zip(np.flatnonzero(plain), offsets[:-1], offsets[1:], strict=True):
            found[k] = ids[a:b]
        odd = np.flatnonzero(~plain)
        for k, text in zip(odd, texts.take(pa.array(odd)).to_pylist(), strict=True):
            found[k] = np.frombuffer(self.encode(text), "<u4")
        return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])


def text_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``SLICE`` bytes of text, and at least one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = [0, *(np.flatnonzero(np.diff(size // SLICE)) + 1).tolist(), batch.num_rows]
    for a, b in zip(at, at[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)


@cache
def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and vocabulary."""
    return PieceEncoder(path)
