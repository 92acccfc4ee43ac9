"""Language identification by compression.

A text belongs to the language whose dictionary makes it smallest: each whole text, with A-Z lowered and
ASCII punctuation and whitespace as single spaces, is cut into blocks, each block is compressed on its
own with zstandard and the raw-content dictionary of each language, and the sizes of all blocks are
added up. A narrow lead of the best language over the
second one is a rejection.

Nulls and empty texts: a text that is null or has no letter is ``und`` with score 0, rejected.
Rows without a language or text are never learned from. Ties go to the language that sorts first.
Repeated rows count once in learning (the sample is drawn from distinct texts) and each gets its
own prediction. With no labelled row there is no language: every text is ``und``. Columns beside
the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.base import bound_batches
from weft.llm.hashing import FOLD

#: Labelled texts for each language at most, characters of each, and characters of all dictionaries: with many languages each has fewer texts.
SAMPLE_TEXTS, SAMPLE_CHARS, MODEL_CHARS = 400, 250, 64_000_000
BLOCK_BYTES, LEVEL = 8192, 5
#: Share of the second size by which the best must be smaller, else the text is rejected.
MIN_MARGIN = 0.003
UNDETERMINED = "und"


def fold(raw: bytes) -> bytes:
    return b" ".join(raw.translate(FOLD).split())


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit("\\p{L}")), F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """A dictionary for each language, from a sample bounded by sample_texts, sample_chars and MODEL_CHARS: of the distinct
    texts of each language, by the text's hash the first in each of sample_texts bins, and of it a stretch that begins where the hash says."""
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & has_letter(F.col("t")))
    n_languages = docs.agg(F.approx_count_distinct(lang, 0.01)).first()[0]
    sample_texts = max(1, min(sample_texts, MODEL_CHARS // (sample_chars * max(1, n_languages))))
    rows = rows.withColumn("h", F.xxhash64("t")).withColumn("bin", F.pmod("h", F.lit(sample_texts)))
    chosen = rows.groupBy("l", "bin").agg(F.min("h").alias("h")).collect()  # sample_texts for each language at most
    if not chosen:
        return {}
    ids = docs.sparkSession.createDataFrame([(r.l, r.h) for r in chosen], "l string, h long")
    stretch = F.substring("t", (F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.length("t") - F.lit(sample_chars - 1))) + 1).cast("int"), F.lit(sample_chars))
    texts = rows.join(F.broadcast(ids), ["l", "h"]).groupBy("l", "h").agg(F.min(stretch).alias("s")).collect()
    by: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: (r.l, r.h)):
        by.setdefault(r.l, []).append(r.s)
    return {k: fold("\n".join(v).encode()) for k, v in by.items()}


def predict(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text: str = "text", min_margin: float = MIN_MARGIN, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the columns in keep, lang_pred, score (lead of the best size over the second, 0 to 1) and rejected."""
    languages = sorted(model)
    docs = bound_batches(docs)
    schema = docs.select(id_col, *keep).schema
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = []
        for k in languages:
            d = zstandard.ZstdCompressionDict(model[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        for batch in batches:
            best, scores, rejected = [], [], []
            for x, known in zip(batch.column("__text"), batch.column("__known").to_pylist(), strict=True):
                if not known or not coders:
                    best.append(UNDETERMINED)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                view = memoryview(fold(memoryview(x.as_buffer()).tobytes()))
                blocks = [view[i : i + BLOCK_BYTES] for i in range(0, len(view), BLOCK_BYTES)]
                sizes = [sum(len(c(b)) for b in blocks) for c in coders]
                low = min(sizes)  # 0 where nothing is left of the text: then all tie
                first = sizes.index(low)
                second = min((s for i, s in enumerate(sizes) if i != first), default=None)
                score = 1.0 if second is None else (second - low) / max(second, 1)
                best.append(languages[first])
                scores.append(score)
                rejected.append(score < min_margin)
            arrays = [batch.column(f.name) for f in schema] + [pa.array(best, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema] + ["lang_pred", "score", "rejected"])

    t = F.col(text)
    return docs.select(id_col, *keep, t.cast("binary").alias("__text"), has_letter(t).alias("__known")).mapInArrow(run, out)
