"""Language identification by compression.

Every language has a raw-content zstandard dictionary made of sample texts. A text is encoded, in blocks, with
each dictionary; the language whose dictionary gives the fewest bytes wins, and narrow wins are marked rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import free_name, order_hash, table

LETTER, NOT_LETTERS = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")
UNKNOWN = "und"

#: Bounds of the training sample: texts a language, and the pieces that one text gives, spread over its whole length.
SAMPLE_TEXTS = 64
PIECES, PIECE_CHARS = 16, 256
#: Bytes coded at once. Blocks keep the dictionary, not the text's own beginning, as the main source of matches.
BLOCK_BYTES = 4096
LEVEL = 10
#: Bytes of the dictionary itself that every block is coded behind, and that are taken off its size again: else the
#: coder would store a block of few words as it is, and all languages would be alike.
LEAD_BYTES = 512
#: A win by less than this share of the runner-up's size is rejected.
MIN_MARGIN = 0.002


def normalise(text: str) -> str:
    """Lower-case words (letters and their marks) between single spaces: case, numbers and punctuation say nothing of a
    language."""
    return f" {NOT_LETTERS.sub(' ', text.lower()).strip()} "


def spread(text: str, pieces: int = PIECES, chars: int = PIECE_CHARS) -> str:
    """So many pieces of a normalised text, at even distances from its beginning to its end; all of it if that is less."""
    if len(text) <= pieces * chars:
        return text
    starts = (i * (len(text) - chars) // (pieces - 1) for i in range(pieces))
    return " ".join(text[s : s + chars] for s in starts)


def train_dictionaries(labelled: DataFrame, text: str, lang: str, key: str, sample_texts: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """One raw-content dictionary for each language of labelled.

    The sample is bounded: the texts of sample_texts keys a language, the first in a fixed pseudo-random order of key, of
    which each gives PIECES pieces of PIECE_CHARS characters from all of its length. Rows with null key, text or language
    are left out; of texts that repeat a key and language the least is taken. What reaches the driver grows with the
    number of languages only.
    """
    rows = labelled.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    nth = F.row_number().over(Window.partitionBy("l").orderBy(order_hash(F.col("k").cast("string")), "k"))
    chosen = rows.select("k", "l").withColumn("n", nth).where(F.col("n") <= sample_texts).groupBy("k", "l").agg(F.min("n").alias("n"))
    picked = rows.join(F.broadcast(chosen), ["k", "l"]).groupBy("l", "n").agg(F.min("t").alias("t"))

    @F.pandas_udf("string")
    def drawn(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: spread(normalise(t)))

    sample: dict[str, list[str]] = {}
    for row in picked.select("l", "n", drawn("t").alias("t")).orderBy("l", "n").collect():
        sample.setdefault(row["l"], []).append(row["t"])
    return {k: "".join(v).encode() for k, v in sorted(sample.items())}


class Coder:
    """Sizes of texts under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.coders = []
        for content in dictionaries.values():
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            coder, lead = zstandard.ZstdCompressor(dict_data=shared, write_content_size=False, write_dict_id=False), content[len(content) // 2 :][:LEAD_BYTES]
            self.coders.append((coder, lead, len(coder.compress(lead))))

    def sizes(self, data: bytes) -> list[int]:
        """Bytes that data takes under each language, in the order of langs."""
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(coder.compress(lead + b)) - alone for b in blocks) for coder, lead, alone in self.coders]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected.

        The score is 1 - exp(-30 m) for a margin m, the share of the runner-up's bytes that the winner saves; 0 for
        UNKNOWN, which is the answer for null texts and texts without letters, and if no language was learned.
        Ties go to the language that sorts first, with score 0.
        """
        if text is None or not LETTER.search(text) or not self.langs:
            return UNKNOWN, 0.0, True
        ranked = sorted(zip(self.sizes(normalise(text).encode()), self.langs, strict=True))
        if len(ranked) == 1:
            return ranked[0][1], 1.0, False
        margin = 1 - max(ranked[0][0], 0) / max(ranked[1][0], 1)
        return ranked[0][1], max(0.0, 1 - math.exp(-30 * margin)), margin < MIN_MARGIN


def identify(docs: DataFrame, text: str, dictionaries: dict[str, bytes], prefix: str = "lid_") -> DataFrame:
    """docs with the columns <prefix>lang, <prefix>score and <prefix>rejected; they replace columns of docs of these names.

    Null texts and texts without letters get UNKNOWN, 0 and true. Rows keep their number and their other columns.
    """
    own = [f"{prefix}{x}" for x in ("lang", "score", "rejected")]
    judged = free_name("judged", docs.columns)
    out = docs.withColumn(judged, judge_udf(dictionaries)(F.col(f"`{text}`")))
    kept = [c for c in docs.columns if c.lower() not in {x.lower() for x in own}]
    return out.select(*(F.col(f"`{c}`") for c in kept), *(F.col(judged)[x.removeprefix(prefix)].alias(x) for x in own))


def judge_udf(dictionaries: dict[str, bytes]):
    @F.pandas_udf("struct<lang string, score double, rejected boolean>")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = Coder(dictionaries)
        for part in parts:
            yield pd.DataFrame([coder.judge(x) for x in part], columns=["lang", "score", "rejected"])

    return judge


def held_out(key: Column | str) -> Column:
    """The fold that is never learned from; rows without a key are in no fold, and so are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the texts and languages of three folds of four."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = train_dictionaries(docs.where(~held_out("doc_id")), "text", "lang", "doc_id")
    found = identify(docs.select("doc_id", "text"), "text", dictionaries)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("lid_lang").alias("lang_pred"), F.col("lid_score").alias("score"), F.col("lid_rejected").alias("rejected"))
