"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs. The vector of an n-gram binds its letters: the vector of the letter at
place k is rotated k times, and the rotated vectors are multiplied. A document bundles (adds) the vectors of its
n-grams; words are padded with a blank, so that begins and ends of words count as letters. The prototype of a language
bundles the unit vectors of its learning documents. A document gets the language of the prototype with the largest
cosine; of equal cosines the first name in order.

Letters are everything that Unicode calls a letter, lower-cased. Vectors follow from the letter's number, so every
task draws the same ones and no alphabet is fixed beforehand.

Cases: a null text, or one without letters, is `und` with score 0. A null language teaches nothing; documents with
null doc_id are never held out and teach. Without any learning document every text is `und`. Rows are answered one
by one, so repeated rows and ties of ids need no rule. Other columns are not read. Texts of any length are bundled in
slices of bounded size.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneloom.llm.text import mix, slices

DIMENSIONS = 1024
GRAM = 3
UNKNOWN = "und"
#: Distinct n-grams whose vectors are held at once.
GRAM_BLOCK = 4096
SLICE_BYTES = 1 << 20
#: Texts bundled at once: with `GRAM_BLOCK` it bounds the table of counts.
SLICE_ROWS = 2048
#: Below this cosine with every prototype a text is taken for no known language.
LEAST_SCORE = 0.1

_NO_LETTER = regex.compile(r"\P{L}+")
_BLANK = " "


@functools.lru_cache(maxsize=65536)
def _letter(code: int, place: int) -> np.ndarray:
    """The letter's signs, rotated `place` times."""
    words = mix(np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(code * 1_000_003 + 1))
    signs = np.unpackbits(words.view(np.uint8)).astype(np.int8) * 2 - 1
    return np.roll(signs, place)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Rows of signs for n-grams given as rows of letter codes."""
    out = np.ones((len(grams), DIMENSIONS), np.int8)
    for place in range(GRAM):
        letters, which = np.unique(grams[:, place], return_inverse=True)
        out *= np.stack([_letter(int(c), place) for c in letters])[which]
    return out


def bundle(texts: list[str]) -> np.ndarray:
    """A row per text: the sum of the vectors of its n-grams, zeros for a text without letters."""
    padded = [_NO_LETTER.sub(_BLANK, _BLANK + t + _BLANK).lower() for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    lengths = np.array([len(p) for p in padded])
    ends = np.cumsum(lengths)
    whole = np.zeros((len(texts), DIMENSIONS), np.float32)
    n = len(codes) - GRAM + 1
    if n <= 0:
        return whole
    keys = sum(codes[k : k + n] << (21 * (GRAM - 1 - k)) for k in range(GRAM))
    row = np.searchsorted(ends, np.arange(n), "right")
    # an n-gram lies in one text; one whose middle is blank would cross words
    inside = (np.arange(n) + GRAM <= ends[row]) & (codes[1 : n + 1] != ord(_BLANK))
    keys, row = keys[inside], row[inside]
    distinct, which = np.unique(keys, return_inverse=True)
    for begin in range(0, len(distinct), GRAM_BLOCK):
        here = slice(None) if len(distinct) <= GRAM_BLOCK else (which >= begin) & (which < begin + GRAM_BLOCK)
        part = distinct[begin : begin + GRAM_BLOCK]
        counts = np.bincount(row[here] * len(part) + which[here] - begin, minlength=len(texts) * len(part)).reshape(len(texts), len(part))
        grams = np.stack([part >> (21 * (GRAM - 1 - k)) & 0x1FFFFF for k in range(GRAM)], axis=1)
        whole += counts.astype(np.float32) @ gram_vectors(grams).astype(np.float32)
    return whole


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


_PARTS = "lang string, vector array<double>"
_PARTS_ARROW = pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.float64()))])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text", SLICE_BYTES, SLICE_ROWS):
        vectors = _unit(bundle(batch.column("text").to_pylist()))
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            total = vectors[langs == lang].sum(axis=0, dtype=np.float64)
            sums[lang] = sums[lang] + total if lang in sums else total
        if len(sums) > 4096:
            yield _parts(sums)
            sums = {}
    yield _parts(sums)


def _parts(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], schema=_PARTS_ARROW)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit vectors, from all rows with text and language.

    Tasks add up their own rows; a language arrives as one vector per task, and sums of doubles that large do not depend
    on their order beyond the last digits.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    parts = known.mapInArrow(_learn, _PARTS)
    summed = parts.select("lang", F.posexplode("vector").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v")).select("lang", "v.value").orderBy("lang").collect()
    rows = [r for r in rows if any(r["value"])]
    return [r["lang"] for r in rows], _unit(np.array([r["value"] for r in rows], dtype=np.float64).reshape(-1, DIMENSIONS)).astype(np.float32)


def _judged(texts: list[str], langs: list[str], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language (its number, `len(langs)` for none) and score of each text."""
    found = _unit(bundle(texts))
    cosines = found @ vectors.T if len(langs) else np.zeros((len(found), 1), np.float32)
    best = np.where(~found.any(axis=1) | (not langs), len(langs), np.argmax(cosines, axis=1))
    return best, np.where(best == len(langs), 0.0, np.clip(cosines.max(axis=1).astype(np.float64), 0.0, 1.0))


def _predict(langs: list[str], vectors: np.ndarray, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = np.array([*langs, UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES, SLICE_ROWS):
            best, scores = _judged(batch.column("text").to_pylist(), langs, vectors)
            yield pa.RecordBatch.from_arrays([
                *batch.drop_columns(["text"]).columns, pa.array(names[best], pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return run


def identify(docs: DataFrame, learn: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang_pred, score. `learn` has text and lang; `docs` need no lang."""
    langs, vectors = prototypes(learn)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_predict(langs, vectors, schema), "doc_id long, lang_pred string, score double")


def known_language(docs: DataFrame, learn: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents in a learned language, with all their columns; text without letters or unlike every prototype goes."""
    langs, vectors = prototypes(learn)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(text)], ["text"])
            judged = [_judged(part.column("text").to_pylist(), langs, vectors) for part in slices([texts], "text", SLICE_BYTES, SLICE_ROWS)]
            if judged:
                best, scores = (np.concatenate(x) for x in zip(*judged, strict=True))
                yield batch.filter(pa.array((best < len(langs)) & (scores >= least)))

    return docs.mapInArrow(run, docs.schema)
