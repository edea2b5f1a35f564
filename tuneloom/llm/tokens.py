"""Token counts by overlap resynchronisation.

A text of up to `CHUNK` characters is encoded at once. A longer one is encoded in overlapping chunks with offsets. Two
neighbours are spliced at a boundary inside their overlap that is proven stable: a white-space character before which a
token ends, or after which one begins, in both encodings. No pre-token spans such a place, so what stands before it
cannot change the tokens after it. Chunks without a stable common boundary, such as one unbroken word, are encoded again
with twice the overlap, until they agree or hold the rest of the text.

Short texts go through the library's own model word by word: pieces of the vocabulary file's pattern are counted once
per worker and looked up again. That path is taken only for characters below U+0300 and texts without special strings,
where the file's normaliser is lower-casing alone; all others go through the library as they are.

Cases: null text is empty and has no tokens. Rows are answered one by one: repeated rows, null doc_ids and other
columns need no rule. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneloom.llm.text import slices

CHUNK = 32_768
OVERLAP = 512
LIMIT = 2048
#: Words remembered per worker.
MEMORY = 400_000

_FOREIGN = regex.compile(r"[^\x00-˿]")


def byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in byte-level vocabularies: printable bytes themselves, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class Encoder:
    """Counts tokens of texts of any length with a vocabulary file of the tokenizers library."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.chunk, self.overlap = chunk, overlap
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.seen: dict[str, int] = {}
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.special = [t["content"] for t in parts["added_tokens"]]
        self.pattern = self._word_pattern(parts)
        self.widened = 0

    @staticmethod
    def _word_pattern(parts: dict) -> regex.Pattern | None:
        """The pattern of words, where the file lower-cases, drops what the pattern leaves and then works on bytes."""
        steps = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        splits = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"]:
            return None
        split, level = splits
        plain = split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]
        return regex.compile(split["pattern"]["Regex"]) if plain else None

    def count(self, text: str) -> int:
        return self._count_short(text) if len(text) <= self.chunk else self._count_long(text)

    def _count_short(self, text: str) -> int:
        if self.pattern is None or _FOREIGN.search(text) or any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        seen = self.seen
        words = self.pattern.findall(text.lower())
        try:
            return sum(map(seen.__getitem__, words))
        except KeyError:
            if len(seen) > MEMORY:
                seen.clear()
            for word in words:
                if word not in seen:
                    seen[word] = len(self.model.tokenize(word.encode().decode("latin-1").translate(self.letters)))
            return sum(map(seen.__getitem__, words))

    def _ends(self, text: str) -> np.ndarray:
        """Where each token of the text begins and ends, as rows."""
        offsets = self.tokenizer.encode(text, add_special_tokens=False).offsets
        return np.array(offsets, dtype=np.int64).reshape(-1, 2)

    def _count_long(self, text: str) -> int:
        total, begin, overlap = 0, 0, self.overlap
        left, left_end = self._ends(text[: self.chunk]), min(len(text), self.chunk)
        while left_end < len(text):
            # the next chunk begins inside the left one and holds the overlap and as much again as a chunk
            start = max(begin, left_end - overlap)
            end = min(len(text), start + overlap + self.chunk)
            right = self._ends(text[start:end]) + start
            cut = self._stable(text, start, left_end, left, right)
            if cut is None and start > begin:
                overlap *= 2
                self.widened += 1
                continue
            if cut is None:
                # the overlap has reached the last cut: encode from there to the end of the right chunk
                left, left_end = self._ends(text[begin:end]) + begin, end
                continue
            total += int((left[:, 1] <= cut).sum())
            left, left_end, begin, overlap = right[right[:, 0] >= cut], end, cut, self.overlap
        return total + len(left)

    @staticmethod
    def _stable(text: str, start: int, end: int, left: np.ndarray, right: np.ndarray) -> int | None:
        """The last white space inside the overlap at which no token of either encoding reaches across.

        The first and last characters of the overlap are left out: what stands there may lack its neighbours.
        """
        for cut in range(end - 2, start + 1, -1):
            if text[cut].isspace() and not text[cut - 1].isspace():
                crossing = [((e[:, 0] < cut) & (e[:, 1] > cut)).any() for e in (left, right)]
                same = np.array_equal(left[(left[:, 0] >= start + 1) & (left[:, 1] <= cut)][-4:], right[(right[:, 0] >= start + 1) & (right[:, 1] <= cut)][-4:])
                if not any(crossing) and same:
                    return cut
        return None


@functools.cache
def encoder(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Encoder:
    return Encoder(path, chunk, overlap)


_COUNTS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def _counts(path: str, limit: int, chunk: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encoder(path, chunk, overlap)
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            tokens = np.array([counter.count(t) for t in texts.to_pylist()], dtype=np.int64)
            sizes = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(tokens), pa.array(tokens > limit)], schema=_COUNTS_ARROW)

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. `chunk` and `overlap` don't change the counts."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(_counts(path, limit, chunk, overlap), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
