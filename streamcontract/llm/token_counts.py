"""Token counts by overlap resynchronisation.

A huge text is encoded as overlapping chunks with offsets. Chunk k starts at a
proven boundary; chunk k + 1 starts `overlap` characters before chunk k ends, at
no particular place. Pre-tokenisation scans left to right and looks ahead only a
few characters, so from any position at which both chunks begin a pre-token the
two splits are the same: that position is a proven stable boundary, provided it
lies `margin` characters or more before the end of chunk k. The encodings are
spliced at the first such position. Where there is none, the overlap doubles, and
once it reaches the last proven boundary the chunk itself is made longer. No
token depends on the chunk size.

Other texts are encoded pre-token by pre-token: the library encodes each
different pre-token of a batch once, and counts are summed. Texts with
characters whose class differs between Unicode versions, or with a special
string, go to the library whole.

Cases: null and empty texts have 0 bytes and 0 tokens; repeated rows give
repeated results; an empty table gives an empty table. Input columns that clash
with result columns are replaced, other columns are kept where asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamcontract.llm.common import prepare, table

CHUNK, OVERLAP, MARGIN = 1 << 15, 1 << 10, 64
CACHE = 1 << 20

# Fixed value: the published split pattern of byte-level BPE, in the words of `re`, which agree with it on plain texts.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Latin letters, ASCII digits and marks, whose classes are the same in all Unicode versions; no controls that count as white space in some, no raised digits and fractions.
_PLAIN = re.compile(r"[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\xaa\xb2\xb3\xb9\xba\xbc-\xbe\u0250-\U0010ffff]*")


class Counter:
    """Encodes texts with one tokenizer; `resynced` and `widened` count what the splicing did."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> None:
        from tokenizers import Tokenizer

        if not 0 < overlap < chunk:
            raise ValueError("overlap must be positive and less than chunk")
        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder().values()
        self.special = [x.content for x in added]
        self.chunk, self.overlap = chunk, overlap
        self.margin = max([margin, *(len(x) + 2 for x in self.special)])
        self.cache: dict[str, int] = {}
        self.resynced = self.widened = 0

    def _chunk(self, text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids of text[start:end], and each pre-token as (position in the text, index of its first id)."""
        e = self.tok.encode(text[start:end], add_special_tokens=False)
        firsts, before = [], object()
        for k, (word, (a, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if word != before:
                firsts.append((start + a, k))
                before = word
        return e.ids, firsts

    def encode(self, text: str) -> list[int]:
        """The library's ids of the whole text, by splicing."""
        n, out = len(text), []
        at, end = 0, min(len(text), self.chunk)  # at: proven boundary where the present chunk starts
        ids, firsts = self._chunk(text, at, end)
        overlap = self.overlap
        while end < n:
            start = max(at, end - overlap)
            stop = min(n, start + max(self.chunk, 2 * overlap))
            more, seconds = self._chunk(text, start, stop)
            where = dict(seconds)
            sure = next(((p, k) for p, k in firsts if at < p <= end - self.margin and p in where), None)
            if sure is None:
                self.widened += 1
                if start == at:  # the overlap is the whole chunk: lengthen it
                    end = min(n, end + self.chunk)
                    ids, firsts = self._chunk(text, at, end)
                overlap *= 2
                continue
            p, k = sure
            self.resynced += 1
            out += ids[:k]
            cut = where[p]
            ids, firsts = more[cut:], [(q, j - cut) for q, j in seconds if q >= p]
            at, end, overlap = p, stop, self.overlap
        return out + ids

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        split: list[tuple[int, list[str]]] = []
        whole: list[int] = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if len(t) > self.chunk:
                out[i] = len(self.encode(t))
            elif _PLAIN.fullmatch(t) and not any(x in t for x in self.special):
                split.append((i, SPLIT.findall(t)))
            else:
                whole.append(i)
        for i, e in zip(whole, self.tok.encode_batch([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = len(e.ids)
        if len(self.cache) > CACHE:
            self.cache.clear()
        if new := list(set().union(*(x for _, x in split)) - self.cache.keys()):
            self.cache.update(zip(new, (len(e.ids) for e in self.tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        for i, x in split:
            out[i] = sum(map(self.cache.__getitem__, x))
        return out


_counters: dict[tuple, Counter] = {}


def token_counts(df: DataFrame, tokenizer: str, *, text: str = "text", id_column: str = "doc_id", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: the id, n_bytes, n_tokens and over_limit (n_tokens > limit). One narrow pass, no shuffle.

    `tokenizer` is the path of a tokenizer file; each Python worker loads it once.
    """
    prepare(df.sparkSession)
    key = (tokenizer, chunk, overlap)
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if key not in _counters:
            _counters[key] = Counter(*key)
        for b in batches:
            n_bytes: list[int] = []
            n_tokens: list[int] = []
            part: list[str] = []
            size = 0

            def flush() -> None:
                n_tokens.extend(_counters[key].counts(part))
                part.clear()

            for x in b.column(1):
                t = x.as_py() or ""
                part.append(t)
                n_bytes.append(len(t.encode()))
                size += len(t)
                if size > 1 << 20:
                    flush()
                    size = 0
            flush()
            yield pa.record_batch([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
