"""Token ids of whole texts by the tokenizers library, with the ids of a piece kept for the next time.

Byte-pair encoding never crosses the pieces that a tokenizer's pre-tokenizer makes,
so the ids of a text are those of its pieces in a row. For the two pre-tokenizers
below and texts of common Latin characters, pieces are cut here and each distinct
piece is encoded by the library once; any other text or tokenizer, and a text that
holds the string of an added token, is encoded whole by the library's own call.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

from .common import give_back, kept_for

#: Pieces that a worker keeps, some 220 bytes each; others are encoded each time.
KEEP = 300_000
#: Characters of whole texts that go to the library at once.
BATCH_CHARS = 500_000

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ňŊ-ž"
#: A character outside these is cut by the library itself: classes differ between regex engines there.
_ODD = re.compile(f"[^\t\n\r -~¡-©«-±´¶-¸»¿×÷{_LETTERS}‐-‧‰-⁞€]")
_SPACED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_BARE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")


def _byte_characters() -> dict[int, int]:
    """Byte-level models write a byte as its own character if that is printable, and else as the next one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}


_BYTES = _byte_characters()


class Encoder:
    """ids(texts) gives each text's ids as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self._tokenizer.get_vocab_size()
        self._kept = _Kept(self._of_piece, keep)
        self._model = self._tokenizer.model
        spec = json.loads(self._tokenizer.to_str())
        self._pieces = self._cutter(spec)
        # The library cuts out the strings of added tokens before all else, some of them in the normalised text.
        added = [re.escape(x["content"]) for x in spec.get("added_tokens", [])]
        self._added = re.compile("|".join(added), re.IGNORECASE) if added else None

    @staticmethod
    def _cutter(spec: dict):
        normal, before = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        names = [x.get("type") for x in (normal or {}).get("normalizers", [])]
        steps = before.get("pretokenizers", [])
        if normal is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            return _SPACED.findall
        bare = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if names == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0].get("pattern", {}).get("Regex") == bare and steps[0].get("invert") and not steps[1].get("use_regex"):
            return lambda text: _BARE.findall(text.lower())
        return None

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        """Whether pieces can be cut here."""
        return not (self._pieces is None or _ODD.search(text) or self._added and self._added.search(text))

    def _of_piece(self, piece: str) -> bytes:
        """A piece goes straight to the library's model, in the characters that stand for its bytes."""
        return array("I", [x.id for x in self._model.tokenize(piece.encode().decode("latin-1").translate(_BYTES))]).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [b"".join(map(self._kept.__getitem__, self._pieces(t))) if self._plain(t) else None for t in texts]
        whole = [i for i, x in enumerate(out) if x is None]
        while whole:
            size = n = 0
            while n < len(whole) and size < BATCH_CHARS:
                size, n = size + len(texts[whole[n]]), n + 1
            for i, x in zip(whole[:n], self._encoded([texts[i] for i in whole[:n]])):
                out[i] = x
            whole = whole[n:]
        return out


class _Kept(dict):
    """Ids of pieces; one that isn't there is encoded, and kept as long as there is room."""

    def __init__(self, of: Callable[[str], bytes], room: int):
        super().__init__()
        self._of, self._room = of, room

    def __missing__(self, piece: str) -> bytes:
        ids = self._of(piece)
        if len(self) < self._room:
            self[piece] = ids
        return ids


def encoder(path: str, keep: int = KEEP) -> Encoder:
    """One for each worker process, file and number of pieces to keep."""
    kept = kept_for("tokens")
    if (path, keep) not in kept:
        kept[path, keep] = Encoder(path, keep)
        give_back()  # the tokenizer's file as JSON is larger than what is left of it
    return kept[path, keep]
