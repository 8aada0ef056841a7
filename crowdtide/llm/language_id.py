"""Language identification by the nearest of several centroids per language.

A text is a TF-IDF vector of hashed byte pairs and triples of its letters. Document frequencies come from all training
documents, combined in the shuffle. Each language has ``clusters`` centroids from spherical k-means over a bounded
sample of about ``per_lang`` of its documents. A text takes the language of the centroid with the largest cosine; it is
marked as rejected if it lies farther from that centroid than nearly all of the centroid's own sample.

Sizes: ``max_langs`` languages x ``clusters`` x ``2**BITS`` numbers are broadcast, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtide.llm.arrays import LOWER, WORD, chunks, text_bytes
from crowdtide.llm.registry import register, table
from crowdtide.llm.toxicity import fold

BITS = 12
PLACES = 1 << BITS
#: Texts whose vectors are held at a time.
ROWS = 256

_FOLDED = np.where(WORD & ~np.isin(np.arange(256), np.arange(48, 58)), LOWER, 32).astype(np.uint8)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed byte pairs and triples, one row per text; whatever is no letter counts as a space."""
    n = len(offsets) - 1
    out = np.zeros(n * PLACES, np.int64)
    if len(data) > 1:
        b = _FOLDED[data].astype(np.uint32)
        doc = np.repeat(np.arange(n), np.diff(offsets))
        for size, mult in ((2, (40503, 30011)), (3, (50021, 27449, 61403))):
            m = len(b) - size + 1
            if m <= 0:
                continue
            h = np.zeros(m, np.uint32)
            for k, c in enumerate(mult):
                h += b[k : k + m] * np.uint32(c * 65537 + size)
            h *= np.uint32(2654435769)
            keep = doc[:m] == doc[size - 1 :]
            keep &= (b[:m] != 32) | (b[size - 1 :] != 32)
            at = doc[:m].astype(np.int64) * PLACES + (h >> np.uint32(32 - BITS))
            out += np.bincount(at[keep], minlength=n * PLACES)
    return out.reshape(n, PLACES)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows; an empty row stays zero."""
    x = np.log1p(tf).astype(np.float32) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 0, norm, 1)[:, None]


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart first centres; the centres and each row's own."""
    centres = x[:1] if len(x) else np.zeros((1, x.shape[1]), np.float32)
    while len(centres) < min(k, len(x)):
        near = (x @ centres.T).max(axis=1)
        centres = np.vstack([centres, x[np.argmin(near)]])
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                total = x[own == c].sum(axis=0)
                centres[c] = total / max(float(np.linalg.norm(total)), 1e-12)
    return centres, np.argmax(x @ centres.T, axis=1)


def _document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Number of documents with each place, and of documents, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(PLACES, np.int64), 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                data, offsets = text_bytes(batch.column("text").slice(start, ROWS))
                df += (counts(data, offsets) > 0).sum(axis=0)
                n += len(offsets) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, PLACES, dtype=np.int32)), pa.array(np.append(n, df))], ["place", "n"])

    sums = docs.select("text").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(PLACES + 1, np.int64)
    out[sums["place"].to_numpy() + 1] = sums["n"].to_numpy()
    return out[1:], int(out[0])


def learn(docs: DataFrame, per_lang: int, clusters: int, max_langs: int) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """IDF, and the language, centroid and least accepted cosine of every cluster."""
    sizes = docs.groupBy("lang").count().limit(max_langs + 1).collect()
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages; raise max_langs, which bounds what is broadcast")
    df, n = _document_frequencies(docs)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    if not sizes:
        return idf, [], np.zeros((0, PLACES), np.float32), np.zeros(0)
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, per_lang / r["count"])))])
    spread = 1 << 30
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < share[F.col("lang")] * spread)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        parts = []
        for start in range(0, len(group), ROWS):
            parts.append(vectors(counts(*text_bytes(pa.array(group["text"].iloc[start : start + ROWS], pa.string()))), idf))
        x = np.vstack(parts)
        centres, own = centroids(x, clusters)
        cosine = np.einsum("ij,ij->i", x, centres[own])
        least = [float(np.quantile(cosine[own == c], 0.005)) if (own == c).any() else 1.0 for c in range(len(centres))]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "least": least, "centre": [c.astype(np.float32).tobytes() for c in centres]})

    fitted = sample.select("doc_id", "lang", "text").groupBy("lang").applyInPandas(fit, "lang string, least double, centre binary")
    rows = sorted(fitted.collect(), key=lambda r: (r["lang"], bytes(r["centre"])))
    return idf, [r["lang"] for r in rows], np.stack([np.frombuffer(r["centre"], np.float32) for r in rows]), np.array([r["least"] for r in rows])


def identify_language(docs: DataFrame, per_lang: int = 1500, clusters: int = 4, max_langs: int = 64, parts: int = 5) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (cosine, 0..1), rejected.

    Learns from text and language of documents whose fold is not 0; rows without text or language teach nothing. A text
    that is null or has no letter is ``und`` with score 0, as is every text if no language was learned. Ties go to the
    language first in order. Texts count whole; repeated rows get the same answer; other columns are ignored.
    """
    held = (fold("doc_id", parts) == 0).alias("held_out")
    known = docs.where((fold("doc_id", parts) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    model = docs.sparkSession.sparkContext.broadcast(learn(known, per_lang, clusters, max_langs))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, langs, centres, least = model.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                data, offsets = text_bytes(part.column("text"))
                letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
                written = letters[offsets[1:]] > letters[offsets[:-1]]
                for i in np.flatnonzero(~written):
                    written[i] = any(map(str.isalpha, part.column("text")[int(i)].as_py() or ""))
                n = part.num_rows
                names, score, far = np.full(n, "und", dtype=object), np.zeros(n), np.ones(n, bool)
                if langs:
                    cosine = vectors(counts(data, offsets), idf) @ centres.T
                    best = np.argmax(cosine, axis=1)
                    top = np.clip(cosine[np.arange(n), best], 0, 1).astype(float)
                    names = np.where(written, np.array(langs, dtype=object)[best], "und")
                    score, far = np.where(written, top, 0.0), ~written | (top < least[best])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(far)],
                    ["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held, "text").mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


@register("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
