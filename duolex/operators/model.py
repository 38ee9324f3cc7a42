"""A model-backed embedder: loaded once per Python worker, run in mapInArrow over one row per pair."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from importlib.util import find_spec
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ModelError, ProcessingError
from ..options import Settings
from ..sources.model_files import model_access

#: Gives the vectors of the words of both sides from one inference; raises ValueError where the pair exceeds the model's length.
Encoder = Callable[[Sequence[str], Sequence[str]], tuple[np.ndarray, np.ndarray]]


def word_means(pieces: np.ndarray, word_of: Sequence[int], n: int) -> np.ndarray:
    """Means of subword vectors by word; every word needs a piece."""
    count = np.bincount(word_of, minlength=n)
    if len(count) > n or (count == 0).any():
        raise ValueError("a word without a piece, or a piece without a word")
    out = np.zeros((n, pieces.shape[1]))
    np.add.at(out, np.asarray(word_of), pieces)
    return out / count[:, None]


def subwords(tokenizer: Any, words: Sequence[str]) -> tuple[list[str], list[int]]:
    """(pieces of all words in a row, the word of each). A word that the tokenizer leaves nothing of is its unknown token."""
    pieces, word_of = [], []
    for k, word in enumerate(words):
        own = list(tokenizer.tokenize(word)) or [x for x in [getattr(tokenizer, "unk_token", None)] if x]
        if not own:
            raise ValueError(f"no subwords for {word!r}, and no unknown token")
        pieces += map(str, own)
        word_of += [k] * len(own)
    return pieces, word_of


def pooled(hidden: np.ndarray, tokenizer: Any, words: Sequence[str]) -> np.ndarray:
    """Word vectors from the vectors of a side's pieces (special ones removed, padding behind)."""
    pieces, word_of = subwords(tokenizer, words)
    if len(hidden) < len(pieces):
        raise ValueError("the pair is longer than the model's sequences")
    return word_means(hidden[: len(pieces)], word_of, len(words))


def transformer(settings: Settings) -> Encoder:
    """Loads the model that the settings name. Runs in the worker; everything it needs is looked for there."""
    model_access_ = model_access(settings.model, settings.model_update_policy)
    for library in ("torch", "transformers", "sentencepiece"):
        if find_spec(library) is None:
            raise ModelError(f"the {library} package is missing")
    import torch
    from transformers import AutoModel, AutoTokenizer

    if settings.device.lower().startswith("cuda") and not torch.cuda.is_available():
        raise ModelError(f"device {settings.device} is asked for, but there is none")
    name = str(model_access_.snapshot or model_access_.model_id)
    tokenizer, model = AutoTokenizer.from_pretrained(name), AutoModel.from_pretrained(name, output_hidden_states=True).to(settings.device).eval()

    def encode(source: Sequence[str], target: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        inputs = tokenizer([list(source), list(target)], is_split_into_words=True, padding=True, truncation=True, return_tensors="pt").to(settings.device)
        with torch.no_grad():
            hidden = model(**inputs).hidden_states
        if settings.layer >= len(hidden):
            raise ValueError(f"the model has no layer {settings.layer}")
        rows = hidden[settings.layer][:, 1:-1].cpu().numpy()
        return pooled(rows[0], tokenizer, source), pooled(rows[1], tokenizer, target)

    return encode


def checked(vectors: np.ndarray, n: int) -> np.ndarray:
    v = np.asarray(vectors, float)
    if v.ndim != 2 or len(v) != n or not np.isfinite(v).all():
        raise ProcessingError("vectors must be finite, one for each token")
    return v


#: What this Python worker has loaded.
_LOADED: dict[str, Encoder] = {}


def _encoder(name: str, make: Callable[[], Encoder]) -> Encoder:
    if name not in _LOADED:
        try:
            _LOADED[name] = make()
        except Exception as e:
            raise ModelError(f"the model can't be loaded: {e}") from e
    return _LOADED[name]


class ModelEmbedder:
    """`make` builds the encoder; it is called in the worker, at its first batch, and kept for all later ones. Python runs one
    task per worker, so inferences of a worker never overlap. Given settings, the encoder is the model that they name."""

    def __init__(self, make: Callable[[], Encoder] | None = None, settings: Settings | None = None):
        self.settings = settings or Settings()
        self.make = make or (lambda s=self.settings: transformer(s))

    def warm_up(self, spark: SparkSession, tasks: int = 1) -> None:
        """Loads the model in a worker before the first pair comes, and fails where it can't be loaded. One small task for each of `tasks`."""
        make, name = self.make, hashlib.sha256(cloudpickle.dumps(self.make)).hexdigest()

        def load(batches):
            for b in batches:
                _encoder(name, make)
                yield b

        spark.range(tasks).repartition(tasks).mapInArrow(load, "id long").count()

    def embed(self, tokens: DataFrame) -> DataFrame:
        make, name = self.make, hashlib.sha256(cloudpickle.dumps(self.make)).hexdigest()
        side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("idx", "text"))))
        packed = tokens.groupBy("pair_id").agg(side("source").alias("source"), side("target").alias("target"))

        def run(batches):
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    s, t = ([x["text"] for x in r[k]] for k in ("source", "target"))
                    if not s or not t:
                        continue
                    encode = _encoder(name, make)
                    try:
                        a, c = encode(s, t)
                        a, c = checked(a, len(s)), checked(c, len(t))
                    except Exception as e:
                        raise ProcessingError(f"pair {r['pair_id']} can't be embedded: {e}") from e
                    if a.shape[1] != c.shape[1]:
                        raise ProcessingError(f"pair {r['pair_id']}: vectors of two lengths")
                    for k, v in (("source", a), ("target", c)):
                        rows += [(r["pair_id"], k, i, x.tolist()) for i, x in enumerate(v)]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64())), strict=True)], names=["pair_id", "side", "idx", "vec"])

        return packed.mapInArrow(run, "pair_id string, side string, idx int, vec array<double>")
