"""Text encoders: anything that turns (video_id, text) into (video_id, embedding, error)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.functions.constants import EMBEDDING_DIM, ENCODE_BATCH
from watchloom.functions.text import strip


# Error of a text with nothing to encode.
NO_TEXT = "no text"


class Encoder(Protocol):
    name: str
    version: str

    def encode(self, texts: DataFrame) -> DataFrame:
        """(video_id, text) → (video_id, embedding array<float>, error string).

        A text that is blank, or whose vector is zero, has no embedding and the error ``NO_TEXT``.
        """
        ...


class HashedTermsEncoder:
    """Hashed term frequencies, weighted by rarity, as unit vectors.

    The weights are fitted once; save and load the model so that vectors of different runs
    can be compared.
    """

    name = "hashed-terms"
    version = "v1"

    def __init__(self, model: PipelineModel):
        self.model = model

    @classmethod
    def fit(cls, texts: DataFrame, dim: int = EMBEDDING_DIM) -> HashedTermsEncoder:
        stages = [
            RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"(?U)\W+"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim),
            IDF(inputCol="_tf", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="_unit", p=2.0),
        ]
        return cls(Pipeline(stages=stages).fit(texts.select("text")))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> HashedTermsEncoder:
        return cls(PipelineModel.load(path))

    def encode(self, texts: DataFrame) -> DataFrame:
        # A text of marks alone, or of terms that every text has, has no direction.
        vector = vector_to_array("_unit", "float32")
        blank = (strip(F.col("text")) == "") | ~F.exists(vector, lambda x: x != 0)
        return self.model.transform(texts).select(
            "video_id",
            F.when(~blank, vector).alias("embedding"),
            F.when(blank, NO_TEXT).alias("error"),
        )


class BatchEncoder:
    """A function from a list of texts to an array of vectors, run on Arrow batches.

    A batch that fails is reported in ``error`` and the others go on.
    """

    def __init__(
        self,
        encode_texts: Callable[[list[str]], np.ndarray],
        name: str,
        version: str = "v1",
        batch: int = ENCODE_BATCH,
    ):
        self.encode_texts = encode_texts
        self.name = name
        self.version = version
        self.batch = batch

    def encode(self, texts: DataFrame) -> DataFrame:
        encode_texts, size = self.encode_texts, self.batch

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), size):
                    part = frame.iloc[at : at + size]
                    yield _encode_part(part, encode_texts)

        return texts.select("video_id", "text").mapInPandas(
            run, "video_id string, embedding array<float>, error string"
        )


def _encode_part(part: pd.DataFrame, encode_texts) -> pd.DataFrame:
    out = pd.DataFrame({"video_id": part["video_id"].to_numpy(), "embedding": None, "error": NO_TEXT})
    filled = part["text"].str.strip().to_numpy() != ""
    if not filled.any():
        return out
    try:
        texts = part["text"][filled].tolist()
        vectors = np.asarray(encode_texts(texts), dtype=np.float64)
        lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
        unit = (vectors / np.where(lengths == 0, 1, lengths)).astype(np.float32)
        good = filled.copy()
        good[filled] = lengths[:, 0] > 0
        out.loc[good, "error"] = None
        rows = iter(unit[lengths[:, 0] > 0])
        out["embedding"] = [next(rows) if g else None for g in good]
    except Exception as failure:  # a batch may fail for any reason of the plugged-in model
        out.loc[filled, "error"] = f"{type(failure).__name__}: {failure}"
    return out
