"""Token counts per document: batched encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from embspark.llm.common import documents, encoded, slices, to_batch

OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

#: Longest run of bytes that is split into chunks at once.
SEGMENT_BYTES = 1 << 20
#: New chunks that go to the library at once.
BATCH = 10_000


def segments(text: bytes, most: int = SEGMENT_BYTES):
    """Cut a long text after white space into runs of about ``most`` bytes; a word is never cut."""
    at = 0
    while len(text) - at > most:
        ends = [e for c in b" \n\t\r\x0b\x0c" if (e := text.find(c, at + most)) >= 0]
        if not ends:
            break
        end = min(ends) + 1
        yield text[at:end]
        at = end
    yield text[at:]


class BatchCounter:
    """Numbers of ids under a tokenizer file: chunks between white space that are not known yet go to the library in one batch, and only lengths are kept."""

    def __init__(self, path: str):
        from embspark.llm import subwords

        self.limits, self.coder = subwords, subwords.WordEncoder(path)
        self.known: dict[bytes, int] = {}
        self.held = 0

    def count(self, chunks: Sequence[bytes]) -> list[int]:
        short = [c for c in chunks if len(c) <= self.limits.LONG]
        codes = self.coder.tokenizer.encode_batch([c.decode() for c in short], add_special_tokens=False)
        found = dict(zip(short, (len(x.ids) for x in codes), strict=True))
        return [found[c] if c in found else len(self.coder.encode([c])[0]) >> 2 for c in chunks]

    def lengths(self, texts: Sequence[bytes]) -> list[int]:
        parts = [self.coder.chunks(t) for t in texts]
        every = set().union(*parts)
        if self.held > self.limits.MEMO_BYTES:
            self.known.clear()
            self.held = 0
        new = sorted(every.difference(self.known))
        known, once = self.known, {}
        for at in range(0, len(new), BATCH):
            for chunk, n in zip(new[at : at + BATCH], self.count(new[at : at + BATCH]), strict=True):
                if len(chunk) <= self.limits.REMEMBERED:
                    known[chunk] = n
                    self.held += len(chunk) + self.limits.ENTRY_BYTES
                else:
                    once[chunk] = n
        get = known.__getitem__ if not once else lambda c: once[c] if c in once else known[c]
        return [sum(map(get, p)) for p in parts]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, kind: str = "tokenizers") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs(doc_id, text, ...)``.

    ``path``: a tokenizer file whose pre-tokens never cross white space (``kind``
    "tokenizers") or a sentencepiece model ("sentencepiece", encoded whole). Rows come in
    Arrow batches that are cut to about equal bytes, long texts are split at white space
    (runs without any: between pre-tokens, and inside a long one between bytes that no
    piece holds side by side), and only lengths leave the function. A null or empty text
    has 0 tokens; a null ``doc_id`` stays null; repeated rows are counted each; other
    columns are ignored. No shuffle.
    """

    def count(batches):
        if kind == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            lengths = lambda texts: [len(x) for x in model.encode([t.decode() for t in texts], num_threads=1)]
        else:
            counter = BatchCounter(path)

            def lengths(texts):
                parts, n, held = [], [0] * len(texts), 0

                def counted():
                    for (k, _), found in zip(parts, counter.lengths([s for _, s in parts]), strict=True):
                        n[k] += found
                    parts.clear()

                for k, t in enumerate(texts):
                    for s in segments(t):
                        parts.append((k, s))
                        held += len(s)
                        if held > SEGMENT_BYTES:
                            counted()
                            held = 0
                counted()
                return n

        for part in slices(batches):
            texts = encoded(part.column("text"))
            n = lengths(texts)
            yield to_batch(OUT, doc_id=part.column("doc_id"), n_bytes=[len(t) for t in texts], n_tokens=n, over_limit=[x > limit for x in n])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2048)
