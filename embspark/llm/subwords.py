"""Encoding with a public word-level BPE file (``tokenizers`` format) at memo speed.

The normaliser of these files drops white space and no pre-token crosses it, so a
text may be cut at any ASCII white space: its ids are those of its chunks in order.
Short chunks are looked up in a memo of bounded bytes. A chunk that is one Latin word,
with or without a mark after it, goes to the BPE model directly; others are encoded
whole. A long chunk (a paragraph without spaces, base64) is normalised and cut into its
pre-tokens first, and a long pre-token between letters that no piece holds side by side.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import regex

#: Bytes of chunks that are remembered, at most, and of a whole memo (an entry takes about ENTRY_BYTES beside its contents); beyond that it starts again.
REMEMBERED, MEMO_BYTES, ENTRY_BYTES = 64, 96 << 20, 200
#: Chunks and pre-tokens above so many bytes are cut, into parts of about as many.
LONG = 1 << 14

# A Latin word, then ASCII marks other than the apostrophe: two pre-tokens, or one.
_WORD = re.compile("([a-zà-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Memo(dict):
    def __init__(self, encode: Callable[[bytes], bytes]):
        super().__init__()
        self.encode, self.held = encode, 0

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.encode(chunk)
        if len(chunk) <= REMEMBERED:
            self.held += len(chunk) + len(ids) + ENTRY_BYTES
            if self.held > MEMO_BYTES:
                self.clear()
                self.held = 0
            self[chunk] = ids
        return ids


class WordEncoder:
    """ids of texts under the tokenizer file at ``path``, without added special tokens.

    Strings of special tokens inside a text are treated as the library does by default.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.memo = _Memo(self._chunk)
        self.pre_token: regex.Pattern | None = None
        self.spanned = np.zeros((256, 256), bool)

    def _prepare_long(self) -> None:
        """The file's pattern of pre-tokens, and which two bytes some piece holds side by side."""
        rules = json.loads(self.tokenizer.to_str())
        parts = rules["pre_tokenizer"].get("pretokenizers", [rules["pre_tokenizer"]])
        self.pre_token = regex.compile(next(p["pattern"]["Regex"] for p in parts if p["type"] == "Split"))
        byte = {c: b for b, c in enumerate(self.letters)}
        for piece in rules["model"]["vocab"]:
            inner = [byte[c] for c in piece.removesuffix("</w>") if c in byte]
            self.spanned[inner[:-1], inner[1:]] = True

    def _spell(self, raw: bytes) -> str:
        return "".join(map(self.letters.__getitem__, raw))

    def _parts(self, text: str) -> Iterator[bytes]:
        if self.pre_token is None:
            self._prepare_long()
        for m in self.pre_token.finditer(self.tokenizer.normalizer.normalize_str(text)):
            raw = m[0].encode()
            at = 0
            if len(raw) > LONG:
                codes = np.frombuffer(raw, np.uint8)
                cuts = np.flatnonzero(~self.spanned[codes[:-1], codes[1:]]) + 1
                while (k := int(np.searchsorted(cuts, at + LONG))) < len(cuts):
                    to = int(cuts[k])
                    # the byte after the cut ends this part as a word of its own would, and goes again
                    yield array("I", [t.id for t in self.model.tokenize(self._spell(raw[at : to + 1]))[:-1]]).tobytes()
                    at = to
            yield array("I", [t.id for t in self.model.tokenize(self._spell(raw[at:]))]).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if len(chunk) > LONG and not any(s in chunk for s in self.specials):
            return b"".join(self._parts(text))
        m = _WORD.fullmatch(text)
        if m is None:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if m[2]:
            return self.memo[m[1].encode()] + self.memo[m[2].encode()]
        spelt = text if text.isascii() else self._spell(chunk)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def chunks(self, text: bytes) -> list[bytes]:
        """The text's chunks; lower-casing A-Z first leaves all ids but those of special strings as they are."""
        low = text.lower()
        return (text if any(s in low for s in self.specials) else low).split()

    def encode(self, texts: Sequence[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, as bytes."""
        get = self.memo.__getitem__
        return [b"".join(map(get, self.chunks(t))) for t in texts]
