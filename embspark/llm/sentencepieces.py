"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass over each word.

At every letter the automaton's output links give the pieces that end there, and each
relaxes what is known of that place: the best sum of scores ("unigram"), or, for files
that hold merges, the one last piece that merging allows ("bpe", as the library gives).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from embspark.llm.common import documents, encoded, slices, to_batch

OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])
BEST = pa.schema([*OUT, ("n_best_pieces", pa.int64()), ("best_crc32", pa.int64()), ("best_score", pa.float64())])
SPACE = "▁"
#: Letters of words that are remembered, at most, bytes of a memo (an entry takes about ENTRY_BYTES beside its letters and ids), neighbours of pieces remembered.
REMEMBERED, MEMO_BYTES, ENTRY_BYTES, PAIR_ENTRIES = 32, 96 << 20, 180, 500_000
#: Ids decoded at once.
DECODED = 1 << 20
#: No piece goes on after a space mark has ended a word, so texts are encoded word by word.
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceCoder:
    """ids of a model file, as its library gives them without begin or end.

    ``kind`` "unigram": the path with the best sum of scores. ``kind`` "bpe": merges are
    not a best sum, but whether two pieces may stand side by side depends on the two
    alone, and every prefix of a word has one valid last piece; the same pass finds it.
    """

    def __init__(self, path: str, kind: str = "bpe"):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = {}
        self.spelt: list[bytes] = []
        self.score, self.ids = {}, {}
        self.automaton = ahocorasick.Automaton()
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(piece[3:5], 16)
                self.bytes[b] = i
                self.spelt.append(bytes([b]))
            elif model.is_control(i) or model.is_unknown(i):
                self.spelt.append(b" \xe2\x81\x87 " if model.is_unknown(i) else b"")
            else:
                self.spelt.append(piece.replace(SPACE, " ").encode())
                self.score[piece], self.ids[piece] = model.get_score(i), i
                self.automaton.add_word(piece, (len(piece), piece))
        self.automaton.make_automaton()
        self.unknown, self.kind = model.unk_id(), kind
        #: what a letter without a piece costs; its first byte bears it
        self.least = min(self.score.values(), default=0) - 10
        self.weights = np.zeros(n)
        for piece, i in self.ids.items():
            self.weights[i] = self.score[piece]
        for b, i in self.bytes.items():
            self.weights[i] = 0 if 0x80 <= b < 0xC0 else self.least
        self.weights[self.unknown] = self.least
        #: two letters between which some piece goes on; elsewhere words can be cut
        self.inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.memo: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.held = {"memo": 0, "parts": 0}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0

    def merged(self, text: str) -> list[str]:
        """The text's pieces by merging, best score first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def side_by_side(self, left: str, right: str) -> bool:
        if self.n_pairs >= PAIR_ENTRIES:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        ok = self.merged(left + right) == ([left, right] if left else [right])
        self.pairs.setdefault(left, {})[right] = ok
        return ok

    def merging(self, word: str) -> bytearray:
        """Length of the last piece of each prefix that merging allows (0: none)."""
        last = bytearray(len(word) + 1)
        pairs = self.pairs
        for end, (size, piece) in self.automaton.iter(word):
            end += 1
            at = end - size
            if not last[end] and (last[at] or not at):
                before = word[at - last[at] : at]
                known = pairs.get(before)
                ok = known.get(piece) if known else None
                if ok or ok is None and self.side_by_side(before, piece):
                    last[end] = size
        return last

    def best(self, word: str) -> tuple[bytearray, float]:
        """Length of the last piece of each prefix on its path with the best sum of scores; the whole word's sum."""
        last, score = bytearray(len(word) + 1), self.score
        best = array("d", [float("-inf")]) * (len(word) + 1)
        best[0] = 0.0
        for end, (size, piece) in self.automaton.iter(word):
            end += 1
            if (s := best[end - size] + score[piece]) > best[end]:
                best[end], last[end] = s, size
        return last, best[len(word)]

    def pieces(self, word: str, last: bytearray | None = None) -> list[str]:
        """The pieces that ``last`` leads back along (none given: those of ``kind``)."""
        if last is None:
            last = self.merging(word) if self.kind == "bpe" else self.best(word)[0]
        out, at = [], len(word)
        while at:
            if not last[at]:
                raise ValueError(f"no piece ends at letter {at} of {word[:80]!r}")
            out.append(word[at - last[at] : at])
            at -= last[at]
        return out[::-1]

    def part(self, text: str) -> bytes:
        if len(text) == 1 and text not in self.score:
            return array("I", [self.bytes[b] for b in text.encode()] if self.bytes else [self.unknown]).tobytes()
        return array("I", map(self.ids.__getitem__, self.pieces(text))).tobytes()

    def remembered(self, name: str, text: str, code: Callable[[str], bytes]) -> bytes:
        memo = getattr(self, name)
        found = memo.get(text)
        if found is None:
            found = code(text)
            if len(text) <= REMEMBERED:
                self.held[name] += 4 * len(text) + len(found) + ENTRY_BYTES
                if self.held[name] > MEMO_BYTES:
                    memo.clear()
                    self.held[name] = 4 * len(text) + len(found) + ENTRY_BYTES
                memo[text] = found
        return found

    def word(self, word: str) -> bytes:
        """Cut where no piece goes on (so around letters without a piece too), then part by part."""
        inside, out, at = self.inside, [], 0
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i - 1 : i + 1] not in inside:
                out.append(self.remembered("parts", word[at:i], self.part))
                at = i
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        words = _WORD.findall(SPACE + text.replace(" ", SPACE))
        memo = self.memo
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            return b"".join([self.remembered("memo", w, self.word) for w in words])

    def sum_of_scores(self, ids: bytes) -> float:
        """Of a text's pieces; a letter without a piece (its bytes, or the unknown piece) counts as the least score less 10."""
        used = np.bincount(np.frombuffer(ids, "<u4"), minlength=len(self.weights))
        return float(used @ self.weights)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        view, spell = memoryview(ids).cast("I"), self.spelt.__getitem__
        text = b"".join([b"".join(map(spell, view[at : at + DECODED])) for at in range(0, len(view), DECODED)])
        return (text[1:] if text[:1] == b" " else text).decode(errors="replace")


def piece_codes(docs: DataFrame, path: str, kind: str = "bpe", best: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_pieces, ids_crc32, decoded_sha256, round_trip`` for each row of ``docs(doc_id, text, ...)``; with ``best`` also ``n_best_pieces, best_crc32, best_score``.

    The first checksum is over the library's ids as little-endian unsigned 32-bit numbers; the
    digest is of the text decoded from them, and ``round_trip`` says that it is the text itself.
    Those of ``best`` are of the path with the best sum of the file's scores (a letter without
    a piece costs the least score less 10), whose ids decode to the same text. Null or empty
    text: no pieces, score 0. Null ids and repeated rows give a row each. No shuffle; whole texts.
    """

    schema = BEST if best else OUT
    ddl = "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", n_best_pieces long, best_crc32 long, best_score double" * best

    def run(batches):
        coder, scored = PieceCoder(path, kind), PieceCoder(path, "unigram") if best else None
        for part in slices(batches):
            rows: list[tuple] = []
            for doc, raw in zip(part.column("doc_id").to_pylist(), encoded(part.column("text")), strict=True):
                text = raw.decode()
                ids = coder.encode(text)
                back = coder.decode(ids).encode()
                row = (doc, len(raw), len(ids) >> 2, zlib.crc32(ids), hashlib.sha256(back).hexdigest(), back == raw)
                if scored:
                    other = scored.encode(text)
                    row += len(other) >> 2, zlib.crc32(other), scored.sum_of_scores(other)
                rows.append(row)
            yield to_batch(schema, **{n: [r[k] for r in rows] for k, n in enumerate(schema.names)})

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_codes(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
